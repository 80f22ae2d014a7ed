"""Token ids in binary shards, with a minimal perfect hash index for access by key.

A shard is two files: raw little-endian ids of its documents in ascending order of key, and an
index. The index maps each distinct key to one slot without collisions: keys that
share no position of a bit array are placed there, the others go on to the next array,
and the number of set bits before a key's bit is its slot. A slot holds a fingerprint of its
key, by which other keys are told apart, and the key's records (first and number).
Records hold offset and number of ids. Every step of an access takes constant time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenurelens.llm.encoder import encoder
from tenurelens.llm.words import blocks, mix, slices
from tenurelens.llm.worker import Committed, read_range, released
from tenurelens.sources.workspace import scratch_path, settle

END_ID = 2
MAGIC = b"TIDX0001"
#: Bits of a level for each key that reaches it.
SPREAD = 2.0
BATCH_BYTES = 1_000_000
_FINGERPRINT = 1000


def _positions(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys, level + 1) % np.uint64(bits)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels in bits, and all levels' bits one behind the other, for distinct uint64 keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(64, -(-int(SPREAD * len(left)) // 64) * 64)
        at = _positions(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has it. ``before``: set bits before each bit."""
    out = np.full(len(keys), -1, dtype=np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _positions(keys[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = before[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, _FINGERPRINT) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: list[int | None], counts: list[int], width: int) -> bytes:
    """The index of records given in order; equal keys are adjacent, NULL keys come first."""
    nulls = sum(k is None for k in keys)
    named = np.array(keys[nulls:], dtype=np.int64).view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]])) if len(named) else np.zeros(0, np.int64)
    distinct = named[first]
    sizes, bits = perfect_hash(distinct)
    before = np.cumsum(bits) - bits
    slot = slots(distinct, sizes, bits, before)
    prints, begin, number = (np.zeros(len(distinct), t) for t in ("<u4", "<u8", "<u4"))
    prints[slot] = fingerprints(distinct)
    begin[slot] = first + nulls
    number[slot] = np.diff(np.concatenate([first, [len(named)]]))
    n_ids = np.array(counts, dtype="<u4")
    offsets = (np.cumsum(n_ids, dtype=np.uint64) - n_ids).astype("<u8")
    arrays = [np.packbits(bits), prints, begin, number, offsets, n_ids]
    head = json.dumps({"levels": sizes, "slots": len(distinct), "records": len(keys), "nulls": nulls, "width": width}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


class Index:
    """An index read back from its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        n = int.from_bytes(data[8:12], "little")
        head = json.loads(data[12 : 12 + n])
        at = 12 + n

        def array(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.levels, self.nulls, self.width = head["levels"], head["nulls"], head["width"]
        bits = sum(self.levels)
        self.bits = np.unpackbits(array("u1", bits // 8)).astype(bool)
        self.before = np.cumsum(self.bits) - self.bits
        self.prints = array("<u4", head["slots"])
        self.begin, self.number = array("<u8", head["slots"]), array("<u4", head["slots"])
        self.offsets, self.counts = array("<u8", head["records"]), array("<u4", head["records"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each int64 key; number 0 for a key that isn't there."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = slots(keys, self.levels, self.bits, self.before)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == fingerprints(keys[found])
        begin, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[found], number[found] = self.begin[slot[found]], self.number[slot[found]]
        return begin, number


def _write(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get()
        width = 2 if max(encode.tokenizer.get_vocab_size() - 1, end) < 1 << 16 else 4
        name, attempt = f"shard-{task.partitionId():06d}", task.taskAttemptId()
        payload, keys, counts = None, [], []
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                payload = payload or Committed(folder, f"{name}.ids", attempt)
                texts = [t or "" for t in some["text"].to_pylist()]
                for k, ids in zip(some["doc_id"].to_pylist(), encode(texts, end), strict=True):
                    payload.write(ids.astype(f"<u{width}").tobytes())
                    keys.append(k)
                    counts.append(len(ids))
        if payload is None:
            return
        payload.commit()
        index = Committed(folder, f"{name}.idx", attempt)
        index.write(index_bytes(keys, counts, width))
        index.commit()
        named = [k for k in keys if k is not None]
        row = [name, task.partitionId(), named[0] if named else None, named[-1] if named else None, len(keys) - len(named), len(keys), sum(counts), index.at]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string(), *[pa.int64()] * 7], strict=True)], _MANIFEST)

    return run


_MANIFEST = ["shard", "place", "least", "most", "nulls", "records", "ids", "index_bytes"]


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID
) -> DataFrame:
    """Writes the shards below ``folder`` (a place every executor can write to); returns the manifest.

    Documents are in ascending order of key over all shards, NULL first, texts of a
    repeated key by hash and then value. NULL text is empty and has the ``end`` id only. One row per
    shard: shard, place, least and most key, nulls, records, ids, index_bytes, start (ids
    in all shards before). A shard is a range partition, so the session's partitions bound
    its size; a key that is very frequent is split by the text's hash. The files of
    a repeated task replace equal ones.
    """
    # the place of a row depends on values alone, so a repeated task writes the same bytes
    by = [F.col("doc_id").asc_nulls_first(), F.col("__hash").asc()]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("__hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by, F.col("text").asc_nulls_first()).select("doc_id", "text")
    written = settle(
        dealt.mapInArrow(released(_write(folder, tokenizer, end)), "shard string, place long, least long, most long, nulls long, records long, ids long, index_bytes long"),
        "shards",
    )
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(folder: str):
    def records(index: Index, name: str, start: int, first: np.ndarray, number: np.ndarray, keys: list):
        """All records of the keys given, in blocks of neighbouring payload."""
        which = np.repeat(np.arange(len(keys)), number)
        record = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + first[which]
        for some in blocks(list(zip(which.tolist(), record.tolist(), strict=True)), lambda r: int(index.counts[r[1]]), 4_000_000):
            at = [r for _, r in some]
            low = int(index.offsets[min(at)])
            high = int(index.offsets[max(at)]) + int(index.counts[max(at)])
            data = np.frombuffer(read_range(folder, f"{name}.ids", low * index.width, (high - low) * index.width), f"<u{index.width}")
            offset = [int(index.offsets[r]) for r in at]
            ids = [data[o - low : o - low + int(index.counts[r])].astype("<u4").tobytes() for o, r in zip(offset, at, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[w] for w, _ in some], pa.int64()), pa.array([start + o for o in offset], pa.int64()), pa.array([int(index.counts[r]) for r in at], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, index = None, None
        for batch in batches:
            names = batch["shard"].to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                name, start = names[a], part["start"][0].as_py()
                if name != open_name:
                    index = Index(read_range(folder, f"{name}.idx", 0, part["index_bytes"][0].as_py()))
                    open_name = name
                keys = part["doc_id"].to_pylist()
                if keys[0] is None:
                    yield from records(index, name, start, np.zeros(1, np.int64), np.full(1, index.nulls), [None])
                    keys = keys[1:]
                if keys:
                    first, number = index.find(np.array(keys, dtype=np.int64))
                    yield from records(index, name, start, first, number, keys)

    return run


def lookup(keys: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """All records of the distinct keys of ``keys`` (one long column): doc_id, start, n_tokens, ids (uint32).

    A key goes to the shards whose range holds it, found by bisection in the list of shards, one
    row per shard file; a key that no index has is left out. NULL finds the records
    without a key.
    """
    name = keys.columns[0]
    shards = [r.asDict() for r in manifest.orderBy("place").collect()]
    ranged = [s for s in shards if s["least"] is not None]
    least, most = (np.array([s[c] for s in ranged], dtype=np.int64) for c in ("least", "most"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch["doc_id"]
            named = doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first, last = np.searchsorted(most, named, "left"), np.searchsorted(least, named, "right")
            n = np.maximum(last - first, 0)
            key = np.repeat(named, n)
            shard = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            to = [(int(k), ranged[s]) for k, s in zip(key, shard, strict=True)]
            if doc_ids.null_count:
                to += [(None, s) for s in shards if s["nulls"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in to], pa.int64()), pa.array([s["shard"] for _, s in to], pa.string()), *(pa.array([s[c] for _, s in to], pa.int64()) for c in ("start", "index_bytes"))],
                ["doc_id", "shard", "start", "index_bytes"],
            )

    distinct = keys.select(F.col(name).cast("long").alias("doc_id")).distinct()
    routed = distinct.mapInArrow(route, "doc_id long, shard string, start long, index_bytes long")
    # a number of partitions, because the few bytes of a route say nothing about the shard behind it
    dealt = routed.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())
    return dealt.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = scratch_path(spark, "token-shards")
    manifest = write_shards(docs, folder, tokenizer)
    return lookup(docs.select("doc_id"), folder, manifest)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = round_trip(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
