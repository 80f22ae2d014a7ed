"""Token counts of whole texts, from the pieces of each distinct pre-token.

A tokenizer cuts a text into pre-tokens and each pre-token, by itself, into pieces. So every distinct
pre-token of the corpus is cut once, and a document's count is the sum, over its pre-tokens, of
frequency times pieces: no list of ids is ever made.

The frequencies meet the pieces in a join. The most frequent pre-tokens, a bounded
number of bounded length, are sent to all tasks and are added up where the texts are read; they
would be the hot keys of a shuffle. All others are joined by a shuffle, in which
no key is frequent. Texts are read twice and never move.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.llm.encoder import Encoder, _spans
from tenurelens.llm.words import _BYTE_VALUES, _power_tables, mix, slices, words_of
from tenurelens.llm.worker import kept, released
from tenurelens.sources.workspace import settle

BATCH_BYTES = 2_000_000
#: Pre-tokens sent to all tasks, at most, and the bytes that each of them may have.
COMMON = 1 << 17
COMMON_BYTES = 64
#: Distinct words, and bytes of long ones, that a task holds before it hands over what it counted.
HELD = 500_000
HELD_BYTES = 32 << 20
#: Words whose pre-tokens a task remembers.
REMEMBERED = 500_000
#: Steps of frequency in a power of two.
STEPS = 8
#: Bytes of plain letters, A-Z and a-z, and of marks that end a word.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
#: U+00C0 to U+00FF are this byte and one more; two of them are no letters.
_LATIN, _NO_LETTERS = 0xC3, (0x97, 0xB7)


class Splitter(Encoder):
    """Pre-tokens of whole texts as a tokenizer file makes them, and the number of pieces of one.

    Where the file allows it, a text is the sequence of its words, so that each distinct word of a
    slice is split once; other texts are split as a whole. Added tokens stand alone.
    """

    def __init__(self, path: str):
        super().__init__(path)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or (t.normalized and self.tokenizer.normalizer) for t in tokens):
            raise ValueError(f"{path} has added tokens that depend on what stands beside them")
        # the longest of those that begin at a place is taken
        names = sorted((t.content for t in tokens if t.content), key=len, reverse=True)
        self.alone = re.compile("|".join(map(re.escape, names))) if names else None
        self.normalizer, self.splitter, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model

    def split(self, text: str) -> tuple[int, list[str]]:
        """The number of added tokens in ``text``, and its pre-tokens: as in the text, or as the file writes them where it changes texts."""
        parts = self.alone.split(text) if self.alone else [text]
        found = []
        for part in filter(None, parts):
            part = self.normalizer.normalize_str(part) if self.normalizer else part
            found += [part[a:b] if self.attached else p for p, (a, b) in self.splitter.pre_tokenize_str(part)]
        return len(parts) - 1, found

    def pieces(self, pretoken: str) -> int:
        written = [p for p, _ in self.splitter.pre_tokenize_str(pretoken)] if self.attached else [pretoken]
        return sum(len(self.model.tokenize(p)) for p in written)

    def spans(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens and words of a slice, and which of them are words; of every
        occurrence its text and its number among the distinct; the texts to split as a whole.

        Letters with marks behind them or not are cut in place: the letters with the blank before
        them are a pre-token, so are the marks, and so is a line feed. Other words are left to ``split``.
        Within one slice spans are told apart by 64 bits.
        """
        w = words_of([t.encode("utf-8") for t in texts], table=None)
        odd = self._whole(texts, w.raw, w.texts)
        count = np.diff(w.first)
        use = np.repeat(~odd, count)
        owner = np.repeat(np.arange(len(texts)), count)[use]
        begins, stops = w.begins[use], w.stops[use]
        if not self.attached:
            return self._distinct(w.raw, owner, begins, stops, np.ones(len(begins), bool), odd)
        blank, feed = w.raw[begins - 1] == 32, w.raw[begins - 1] == 10
        opens = np.searchsorted(w.texts, begins, "right") - 1
        first = begins == w.texts[opens] if len(begins) else blank
        blank, feed = blank & ~first, feed & ~first
        letters, marks = _counts(_letters(w.raw)), _counts(_MARK[w.raw])
        inner = letters[stops] - letters[begins]
        ends = begins + inner
        plain = (inner > 0) & (letters[ends] - letters[begins] == inner) & (marks[stops] - marks[ends] == stops - ends)
        tail, lone = plain & (ends < stops), plain & feed
        return self._distinct(
            w.raw,
            np.concatenate([owner[plain], owner[tail], owner[lone], owner[~plain]]),
            np.concatenate([(begins - blank)[plain], ends[tail], begins[lone] - 1, (begins - (blank | feed))[~plain]]),
            np.concatenate([ends[plain], stops[tail], begins[lone], stops[~plain]]),
            np.concatenate([np.zeros(plain.sum() + tail.sum() + lone.sum(), bool), np.ones((~plain).sum(), bool)]),
            odd,
        )

    @staticmethod
    def _distinct(raw, owner, begins, stops, whole, odd):
        up, down = _power_tables(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)])])
        keys = mix((sums[stops] - sums[begins]) * down[begins] + whole.astype(np.uint64), 9)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        data = raw.tobytes()
        return [data[a:b] for a, b in zip(begins[first].tolist(), stops[first].tolist(), strict=True)], whole[first], owner, inverse, odd


def _counts(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(flags)])


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and the letters from U+00C0 to U+00FF."""
    letter = _LETTER[raw]
    lead = np.flatnonzero(raw[:-1] == _LATIN)
    lead = lead[~np.isin(raw[lead + 1], _NO_LETTERS)]
    letter[lead] = letter[lead + 1] = True
    return letter


def _splitter(path: str) -> Splitter:
    return kept(("splitter", path), lambda: Splitter(path))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch["text"].to_pylist()]


def _tally(path: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pre-tokens of a task's texts with their occurrences, added up before they are shuffled."""

    def run(batches):
        splitter = _splitter(path)
        pretokens: defaultdict[bytes, int] = defaultdict(int)
        words: defaultdict[bytes, int] = defaultdict(int)
        size = 0

        def handed_over() -> pa.RecordBatch:
            for word, n in words.items():
                for pretoken in splitter.split(word.decode("utf-8"))[1]:
                    pretokens[pretoken.encode("utf-8")] += n
            names, times = pa.array(list(pretokens.keys()), pa.binary()).cast(pa.string()), pa.array(list(pretokens.values()), pa.int64())
            words.clear(), pretokens.clear()
            return pa.RecordBatch.from_pydict({"pretoken": names, "n": times})

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = _texts(part)
                found, whole, _, inverse, odd = splitter.spans(texts)
                for span, is_word, n in zip(found, whole.tolist(), np.bincount(inverse, minlength=len(found)).tolist(), strict=True):
                    if is_word:
                        words[span] += n
                    else:
                        pretokens[span] += n
                size += sum(len(span) for span in found if len(span) > COMMON_BYTES)
                for i in np.flatnonzero(odd).tolist():
                    size += len(texts[i])
                    for pretoken in splitter.split(texts[i])[1]:
                        pretokens[pretoken.encode("utf-8")] += 1
                if len(words) + len(pretokens) > most or size > HELD_BYTES:
                    yield handed_over()
                    size = 0
        yield handed_over()

    return run


def _cut(path: str):
    def run(batches):
        splitter = _splitter(path)
        for batch in batches:
            pieces = [splitter.pieces(p) for p in batch["pretoken"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"pretoken": batch["pretoken"], "n": batch["n"], "pieces": pa.array(pieces, pa.int64())})

    return run


def pretokens(docs: DataFrame, path: str, text: str = "text", held: int = HELD) -> DataFrame:
    """Every distinct pre-token of the texts: pretoken, n (occurrences), pieces."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(released(_tally(path, held)), "pretoken string, n long")
    total = found.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return settle(total.mapInArrow(_cut(path), "pretoken string, n long, pieces long"), "pretokens")


def _level(n: Column) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def common(table: DataFrame, most: int = COMMON) -> dict[bytes, int]:
    """Pieces of the most frequent pre-tokens: all from some frequency upwards, ``most`` at most."""
    short = table.where(F.octet_length("pretoken") <= COMMON_BYTES).withColumn("level", _level(F.col("n")))
    total, least = 0, None
    for level, n in sorted(((r["level"], r["n"]) for r in short.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return {}
    rows = short.where(F.col("level") >= least).select("pretoken", "pieces").toArrow()
    return dict(zip(rows["pretoken"].cast(pa.binary()).to_pylist(), rows["pieces"].to_pylist(), strict=True))


def _looked_up(path: str, known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text the pieces of its common pre-tokens, and its other pre-tokens with their frequencies."""

    def run(batches):
        splitter, table = _splitter(path), known.value
        remembered: dict[bytes, tuple[int, list[bytes]]] = {}

        def look(pretokens: list[str]) -> tuple[int, list[bytes]]:
            got, left = 0, []
            for p in pretokens:
                p = p.encode("utf-8")
                n = table.get(p)
                if n is None:
                    left.append(p)
                else:
                    got += n
            return got, left

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = _texts(part)
                spans, whole, owner, inverse, odd = splitter.spans(texts)
                pieces = np.fromiter((table.get(s, -1) for s in spans), dtype=np.int64, count=len(spans))
                pieces[whole] = 0
                number = (pieces < 0).astype(np.int64)
                words = {}
                for i in np.flatnonzero(whole).tolist():
                    word = spans[i]
                    seen = remembered.get(word)
                    if seen is None:
                        seen = remembered[word] = look(splitter.split(word.decode("utf-8"))[1])
                    pieces[i], number[i], words[i] = seen[0], len(seen[1]), seen[1]
                pieces[pieces < 0] = 0
                others = []
                for i in np.flatnonzero(number).tolist():
                    others += words.get(i) or [spans[i]]
                sums = np.bincount(owner, weights=pieces[inverse], minlength=len(texts)).astype(np.int64)
                open_ = number[inverse] > 0
                pairs, times = np.unique(owner[open_] * max(len(spans), 1) + inverse[open_], return_counts=True)
                text, word = np.divmod(pairs, max(len(spans), 1))
                at = _spans((np.cumsum(number) - number)[word], number[word])
                text, times = np.repeat(text, number[word]), np.repeat(times, number[word])
                for i in np.flatnonzero(odd).tolist():
                    alone, found = splitter.split(texts[i])
                    got, left = look(found)
                    sums[i] = alone + got
                    at = np.concatenate([at, np.arange(len(others), len(others) + len(left))])
                    text, times = np.concatenate([text, np.full(len(left), i)]), np.concatenate([times, np.ones(len(left), np.int64)])
                    others += left
                order = np.argsort(text, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
                rest = pa.array(others, pa.binary()).cast(pa.string()).take(pa.array(at[order]))
                entries = pa.StructArray.from_arrays([rest, pa.array(times[order])], ["pretoken", "n"])
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(sums), pa.ListArray.from_arrays(pa.array(ends), entries)], ["key", "pieces", "rest"])
                if len(remembered) > REMEMBERED:
                    remembered.clear()

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``).

    The counts are those of the file's own library for the whole text, without added special tokens;
    the content of an added token in a text is one token, as in the library. A NULL text counts as empty and has no
    tokens. Repeated rows and keys are counted each by itself. An empty table gives an empty result.
    """
    if not path.endswith(".json"):
        raise ValueError(f"{path} is no tokenizer file with pre-tokens")
    spark = docs.sparkSession
    table = pretokens(docs, path, text)
    known = spark.sparkContext.broadcast(common(table))
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sized = some.select("key", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = some.schema["key"].dataType.simpleString()
    looked = sized.select(F.struct("key", F.octet_length("text").cast("long").alias("n_bytes")).alias("key"), "text").mapInArrow(
        released(_looked_up(path, known)), f"key struct<key:{kind},n_bytes:bigint>, pieces long, rest array<struct<pretoken:string,n:bigint>>"
    )
    rows = settle(looked.select(F.monotonically_increasing_id().alias("row"), "key.*", "pieces", "rest"), "common-counted")
    pieces = F.coalesce("pieces", F.raise_error(F.lit("a text changed while it was counted")).cast("long"))
    others = (
        rows.select("row", F.explode("rest").alias("e")).select("row", "e.*")
        .join(table.select("pretoken", "pieces"), "pretoken", "left")
        .groupBy("row").agg(F.sum(F.col("n") * pieces).alias("others"))
    )
    total = F.col("pieces") + F.coalesce("others", F.lit(0))
    counted = rows.drop("rest").join(others, "row", "left").withColumn("n_tokens", total)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
