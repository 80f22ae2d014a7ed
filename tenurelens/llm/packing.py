"""Best-fit packing of token pieces into sequences, with certified bounds.

Pieces are dealt to partitions and packed there by best-fit decreasing. Dual-feasible
functions give a lower bound of every partition's number of sequences, and of all
pieces together. A partition above its bound is packed once more, with best fits of up to
three pieces at a time. While more sequences are in use than the bound of all, the pieces of
sequences with room are exchanged between partitions: dealt anew by another hash, and packed
again. At first partitions above their own bounds exchange; when a round of those
saves nothing, all partitions do. A round of all that saves nothing ends it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenurelens.llm.encoder import encoder
from tenurelens.llm.words import slices
from tenurelens.llm.worker import released
from tenurelens.sources.workspace import settle

CAPACITY = 1024
END_ID = 2
#: Pieces that meet in one task.
PARTITION_PIECES = 32_768
#: Texts encoded at once, in bytes.
BATCH_BYTES = 500_000
#: Numbers that a part keeps for its sequences; it has fewer pieces.
_PART = 1 << 20
#: Rounds after which what is packed is written anew, so that a read of it meets few tables.
_REWRITTEN = 8


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of sequences for ``counts[s]`` pieces of each size s from 0 to ``capacity``.

    The largest bound of two families of dual-feasible functions: the thresholds that
    round large pieces up and small ones down, and the functions that round multiples of 1/k.
    """
    if not counts.any():
        return 0
    sizes = np.arange(capacity + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for e in np.flatnonzero(n[: capacity // 2 + 1]):
        value = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin.

    Bins are kept by their room; the bits of an integer tell which rooms occur, so the
    tightest bin is found in one step.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


def best_filling(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``best_fit_decreasing``, but bins are closed one by one.

    The longest piece left opens a bin; then the best fit is sought among one, two and three
    further pieces, the largest first: those that leave the least room. Sets of
    sizes are bits of integers, so all pairs of a sum are found in one step.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable").tolist():
        left[int(lengths[i])].append(i)
    have = sum(1 << s for s in range(1, capacity + 1) if left[s])
    mirror = sum(1 << (capacity - s) for s in range(1, capacity + 1) if left[s])

    def take(size: int) -> int:
        nonlocal have, mirror
        i = left[size].pop()
        if not left[size]:
            have &= ~(1 << size)
            mirror &= ~(1 << (capacity - size))
        return i

    def pair(total: int) -> tuple[int, int] | None:
        both = have & (mirror >> (capacity - total))
        while both:
            a = both.bit_length() - 1
            if a * 2 != total or len(left[a]) > 1:
                return a, total - a
            both &= ~(1 << a)
        return None

    def filling(room: int) -> list[int]:
        longest = have.bit_length() - 1
        for total in range(min(room, 3 * longest), 0, -1):
            if have >> total & 1:
                return [total]
            if found := pair(total):
                return [*found]
            third = have & ((1 << total) - 1)
            for _ in range(24):
                if not third:
                    break
                c = third.bit_length() - 1
                third &= ~(1 << c)
                found = pair(total - c) if total > c else None
                if found and len(left[c]) > found.count(c):
                    return [c, *found]
        return []

    fill: list[int] = []
    while have:
        at = 0
        sizes = [have.bit_length() - 1]
        while sizes:
            for size in sizes:
                i = take(size)
                bins[i], offsets[i] = len(fill), at
                at += size
            sizes = filling(capacity - at) if at < capacity and have else []
        fill.append(at)
    return bins, offsets, np.array(fill, dtype=np.int64)


def _pack(capacity: int, base: int):
    def run(table: pa.Table) -> pa.Table:
        # rows come in any order after a shuffle; the order by key makes a repeated task pack alike
        table = table.sort_by("key")
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if len(fill) > bound:
            other = best_filling(lengths, capacity)
            if len(other[2]) < len(fill):
                bins, offsets, fill = other
        part = int(table["part"][0].as_py())
        n = len(lengths)
        return pa.table(
            {
                "key": table["key"].cast(pa.int64()),
                "length": table["length"].cast(pa.int64()),
                "sequence_id": pa.array(base + part * _PART + bins, pa.int64()),
                "offset": pa.array(offsets, pa.int64()),
                "fill": pa.array(fill[bins], pa.int64()),
                "above": pa.array(np.full(n, len(fill) > bound)),
            }
        )

    return run


_PACKED = "key long, length long, sequence_id long, offset long, fill long, above boolean"


def _parts(n: int, partition_pieces: int) -> int:
    return max(1, -(-n // partition_pieces))


def _dealt(pieces: DataFrame, n: int, turn: int, capacity: int, partition_pieces: int, base: int = 0) -> DataFrame:
    """The pieces packed in parts that the turn deals anew; the sequences' numbers start at ``base``."""
    part = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(_parts(n, partition_pieces))).alias("part")
    packed = pieces.select("key", "length", part).groupBy("part").applyInArrow(_pack(capacity, base), _PACKED)
    return settle(packed, f"packed-{turn}")


def _bins(packed: DataFrame) -> int:
    """Sequences in use; each has one piece at offset 0."""
    return packed.where("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Columns key, length, sequence_id, offset for ``pieces`` (key long, unique; length 1 to ``capacity``).

    Offsets of a sequence are gapless from 0. No piece is cut or left out; an empty table
    gives an empty result. Which of several pieces of equal length goes where is decided
    by the key, so reruns agree.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    bound = lower_bound(counts, capacity)
    n = int(counts.sum())
    packed, base = _dealt(pieces, n, 0, capacity, partition_pieces), _parts(n, partition_pieces) * _PART
    total, turn, every = _bins(packed), 1, False
    while total > bound:
        gives = F.col("fill") < capacity
        if not every:
            gives = gives & F.col("above")
        open_ = packed.where(gives)
        moved, before = open_.count(), _bins(open_)
        after = before
        if moved:
            again = _dealt(open_, moved, turn, capacity, partition_pieces, base)
            after, turn = _bins(again), turn + 1
            base += _parts(moved, partition_pieces) * _PART
        if after < before:
            packed, total = packed.where(~gives).union(again), total - before + after
            if turn % _REWRITTEN == 0:
                packed = settle(packed, f"packed-after-{turn}")
        elif every:
            break
        else:
            every = True
    return packed.select("key", "length", "sequence_id", "offset")


def _pieces(tokenizer: str, end: int, capacity: int):
    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                doc, piece, start, length, data = [], [], [], [], []
                texts = [t or "" for t in some["text"].to_pylist()]
                for d, ids in zip(some["doc_id"].to_pylist(), encode(texts, end), strict=True):
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        doc.append(d)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        data.append(ids[a:b].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids (little-endian uint32), key.

    A document is its whole text's ids and ``end``. Only documents of more than ``capacity``
    ids are cut, into pieces of ``capacity``; the first may be shorter. NULL text is
    empty. A repeated row is a document of its own. The result is a written table.
    """
    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        released(_pieces(tokenizer, end, capacity)), f"doc_id {kind}, piece int, start long, length long, ids binary"
    )
    return settle(cut.withColumn("key", F.monotonically_increasing_id()), "token-pieces")


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids, sequence_id, offset.

    A piece of ``capacity`` ids is a sequence by itself and takes no part in the packing.
    """
    pieces = token_pieces(docs, tokenizer, key, text, end, capacity)
    whole = pieces.where(F.col("length") == capacity)
    packed = pack(pieces.where(F.col("length") < capacity).select("key", "length"), capacity)
    alone = whole.select("*", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = pieces.where(F.col("length") < capacity).join(packed.drop("length"), "key").select(alone.columns)
    return alone.union(placed).drop("key")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))
