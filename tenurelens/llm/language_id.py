"""Language identification by a convolutional network over bytes.

Texts are cut into windows of fixed length. A window's bytes are embedded; filters of several
widths run over them; each filter's largest value goes into a softmax over the
languages. The network is trained in numpy on windows of a bounded sample of labelled texts;
all windows of a whole text vote with their probabilities, weighed by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tenurelens.llm.words import blocks
from tenurelens.llm.worker import released

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    window: int = 64
    embedding: int = 8
    filters: int = 16
    widths: tuple[int, ...] = (2, 3, 4)
    #: Bound of the training sample: texts of each language, and windows of each text.
    texts_per_language: int = 400
    windows_per_text: int = 6
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    seed: int = 7
    #: One text in so many is held out.
    folds: int = 5


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a NULL key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def windows(text: str, size: int) -> np.ndarray:
    """All windows of a text, one row each; the last is filled up with zero bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, size)


@dataclass
class Network:
    languages: list[str]
    widths: tuple[int, ...]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place in a filter, the filters' values of each byte: a convolution is a sum of lookups."""
        d = self.embed.shape[1]
        return [[(self.embed @ f[k * d : (k + 1) * d]).astype(np.float32) for k in range(w)] for w, f in zip(self.widths, self.filters, strict=True)]

    def log_probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pooled = []
        for width, table, bias in zip(self.widths, tables, self.biases, strict=True):
            n = x.shape[1] - width + 1
            z = table[0][x[:, :n]]
            for k in range(1, width):
                z += table[k][x[:, k : k + n]]
            pooled.append(np.maximum(z.max(axis=1) + bias, 0))
        return _log_softmax(np.concatenate(pooled, axis=1) @ self.dense + self.offset)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, languages: list[str], s: Settings) -> Network:
    """Minimises cross-entropy by Adam; only the window place that won a filter's pool gets its gradient."""
    rng = np.random.default_rng(s.seed)
    d, total = s.embedding, s.filters * len(s.widths)
    params = [rng.normal(0, 0.5, (256, d))]
    params += [rng.normal(0, (2 / (w * d)) ** 0.5, (w * d, s.filters)) for w in s.widths]
    params += [np.zeros(s.filters) for _ in s.widths]
    params += [rng.normal(0, (1 / total) ** 0.5, (total, len(languages))), np.zeros(len(languages))]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    k = len(s.widths)
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), s.batch):
            bx, by = x[order[a : a + s.batch]], y[order[a : a + s.batch]]
            embed, filters, biases, dense, offset = params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1]
            e, rows, hidden, won = embed[bx], np.arange(len(bx)), [], []
            for w, f, b in zip(s.widths, filters, biases, strict=True):
                n = bx.shape[1] - w + 1
                z = sum(e[:, j : j + n] @ f[j * d : (j + 1) * d] for j in range(w))
                at = z.argmax(axis=1)
                won.append(at)
                hidden.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + b)
            h = np.concatenate(hidden, axis=1)
            p = np.exp(_log_softmax(np.maximum(h, 0) @ dense + offset))
            p[rows, by] -= 1
            p /= len(bx)
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = np.maximum(h, 0).T @ p, p.sum(axis=0)
            back = (p @ dense.T) * (h > 0)
            for i, (w, f, at) in enumerate(zip(s.widths, filters, won, strict=True)):
                g = back[:, i * s.filters : (i + 1) * s.filters]
                grads[1 + k + i] = g.sum(axis=0)
                for j in range(w):
                    bytes_ = bx[rows[:, None], at + j]
                    grads[1 + i][j * d : (j + 1) * d] = np.einsum("bfd,bf->df", embed[bytes_], g)
                    np.add.at(grads[0], bytes_, g[:, :, None] * f[j * d : (j + 1) * d].T[None])
            step += 1
            for q, g, m_, v_ in zip(params, grads, m, v, strict=True):
                m_ += 0.1 * (g - m_)
                v_ += 0.001 * (g * g - v_)
                q -= s.rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)
    low = [p.astype(np.float32) for p in params]
    return Network(languages, s.widths, low[0], low[1 : 1 + k], low[1 + k : 1 + 2 * k], low[-2], low[-1])


def _sampled(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, order, window = [], [], []
            for lang, place, text in zip(*(batch[c].to_pylist() for c in ("lang", "place", "text")), strict=True):
                all_ = windows(text, s.window)
                rng = np.random.default_rng(abs(place))
                for i in rng.permutation(len(all_))[: s.windows_per_text]:
                    language.append(lang)
                    order.append(place)
                    window.append(all_[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(language, pa.string()), pa.array(order, pa.int64()), pa.array(window, pa.binary())], ["lang", "place", "window"])

    return run


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", settings: Settings = Settings()) -> Network | None:
    """A network for the labels of ``docs``, None if there is nothing to learn from.

    Learns from texts with letters and labels outside the held-out fold, at most
    ``texts_per_language`` of each label, chosen by hash over the whole table.
    """
    s = settings
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & (fold(F.col("key"), s.folds) != 0) & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.xxhash64(F.col("key").cast("string"), F.lit(s.seed))
    chance = F.least(F.lit(1.0), F.lit(1.5 * s.texts_per_language + 20) / F.col("n"))
    # one row per label, as the network has one output per label; texts must not be dealt by label
    chosen = (
        labelled.join(F.broadcast(counts), "lang")
        .withColumn("place", place)
        .where(F.pmod("place", F.lit(1 << 30)) < chance * (1 << 30))
        .select("lang", "place", "text")
    )
    rows = chosen.mapInArrow(_sampled(s), "lang string, place long, window binary").toArrow()
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for lang, at, window in zip(*(rows[c].to_pylist() for c in ("lang", "place", "window")), strict=True):
        if _LETTER.search(window.decode("utf-8", "ignore")):
            texts.setdefault(lang, []).append((at, window))
    if not texts:
        return None
    languages = sorted(texts)
    x, y = [], []
    for i, lang in enumerate(languages):
        keep = set(sorted({at for at, _ in texts[lang]})[: s.texts_per_language])
        some = sorted(r for r in texts[lang] if r[0] in keep)
        x += [np.frombuffer(w, dtype=np.uint8) for _, w in some]
        y += [i] * len(some)
    return train(np.stack(x), np.array(y), languages, s)


def _predict(network: Network | None, size: int, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else []
        for batch in batches:
            texts = batch["text"].to_pylist()
            known = [i for i, t in enumerate(texts) if network and t and _LETTER.search(t)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for some in blocks(known, lambda i: len(texts[i]), 250_000):
                cut = [windows(texts[i], size) for i in some]
                x = np.concatenate(cut)
                logs = np.concatenate([network.log_probabilities(x[a : a + 512], tables) for a in range(0, len(x), 512)])
                weight = (x != 0).sum(axis=1)[:, None] + 1e-9
                first = np.cumsum([0, *map(len, cut[:-1])])
                p = np.add.reduceat(np.exp(logs.astype(np.float64)) * weight, first, axis=0) / np.add.reduceat(weight, first, axis=0)
                for i, row in zip(some, p, strict=True):
                    best = int(row.argmax())
                    lang[i], score[i] = network.languages[best], min(1.0, float(row[best]))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang), pa.array(score)], [*batch.schema.names, *names])

    return run


def predict(
    docs: DataFrame, network: Network | None, settings: Settings = Settings(), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Adds the language and its score (0 to 1) under ``names`` to ``docs``, whose column ``text`` is read whole.

    ``und`` with score 0 is for NULL texts, texts without a letter, and all texts if
    there is no network.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(released(_predict(network, settings.window, names)), schema)


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose column ``text`` has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(t and _LETTER.search(t)) for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (doc_id, text, lang).

    A repeated row gets the same answer again. An empty table gives an empty result.
    """
    network = fit(docs, settings=settings)
    found = predict(docs.select("doc_id", "text"), network, settings)
    return found.select("doc_id", (fold(F.col("doc_id"), settings.folds) == 0).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
