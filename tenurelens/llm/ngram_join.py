"""Self-join of documents by the Jaccard similarity of their word n-grams, in prefix trees.

Every n-gram becomes a token whose highest byte is a level of its frequency, so that sorted
tokens are in one global order, rare ones first. Two sets can only reach the threshold if
they share a token among the first ones of both (the prefix). Sets with a shared prefix token
fall into groups; each group, or each pair of blocks of a large one, is joined in one task:
its ordered sets form a trie, every set walks down it, paths in common are counted
once, and a subtree is left when the tokens that remain cannot lift the overlap to what is needed.
This is done twice: with the prefixes alone, which part the groups, and
then with whole sets in what is left of them. Equal sets are one class and enter once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tenurelens.llm.components import connected_components
from tenurelens.llm.words import mix, shingle_runs, slices
from tenurelens.llm.worker import released
from tenurelens.sources.workspace import remove, scratch_path, settle, settle_alone, settle_at, tidy

#: Texts shingled at once, in bytes; some twenty times as much is held meanwhile.
BATCH_BYTES = 500_000
#: Shingles that a task counts at a time.
_WAITING = 1 << 20


@dataclass(frozen=True)
class Settings:
    size: int = 3
    #: Documents link when percent * union <= 100 * intersection.
    percent: int = 90
    #: Cells of the frequency sketch; it decides the order of tokens, never a link.
    cells: int = 1 << 22
    #: Tokens of all sets of a block; groups beyond it are joined in pairs of blocks.
    block_tokens: int = 1 << 19
    #: A token counted so often by the sketch is hot, and its classes are tied in parts.
    hot: int = 100_000
    #: Classes of a token up to which they are paired; those of other tokens are grouped.
    few: int = 32
    #: Cells of the map of documents whose sets are needed; others are not shingled again.
    wanted: int = 1 << 22


def needed(a, b, percent: int):
    """Least intersection of linked sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two linked sets share a token among the first so many of each: an overlap is at least percent of n."""
    return n - -(-percent * n // 100) + 1


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sketched(s: Settings):
    """Counts of shingles by hash: for each part of the cells the cells that were met, and how often.

    What a task hands on follows the text it read, not the number of cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(s)
        counts, waiting, n = np.zeros((parts, s.cells // parts), np.uint32), [], 0

        def add() -> None:
            found, times = np.unique(np.concatenate(waiting), return_counts=True)
            counts.reshape(-1)[found] += times.astype(np.uint32)

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                runs, _ = shingle_runs(_texts(part["text"]), s.size)
                waiting.append((runs % np.uint64(s.cells)).astype(np.int32))
                n += len(runs)
                if n > _WAITING:
                    add()
                    waiting, n = [], 0
        if waiting:
            add()
        met = [(i, np.flatnonzero(row)) for i, row in enumerate(counts)]
        met = [(i, cells.astype("<u4"), counts[i][cells].astype("<u4")) for i, cells in met if len(cells)]
        if met:
            numbers, cells, data = zip(*met, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), *(pa.array([x.tobytes() for x in column], pa.binary()) for column in (cells, data))], ["part", "cells", "counts"]
            )

    return run


def _parts(s: Settings) -> int:
    return max(1, s.cells >> 16)


def _leveled(s: Settings):
    """The sum of the rows of each part, as levels; the rows of a part follow each other."""
    size = s.cells // _parts(s)

    def levels(part: int, total: np.ndarray) -> pa.RecordBatch:
        data = _level(total).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for part, cells, data in zip(*(batch[c].to_pylist() for c in ("part", "cells", "counts")), strict=True):
                if part != at:
                    if at is not None:
                        yield levels(at, total)
                    at, total = part, np.zeros(size, dtype=np.int64)
                total[np.frombuffer(cells, dtype="<u4")] += np.frombuffer(data, dtype="<u4")
        if at is not None:
            yield levels(at, total)

    return run


def frequency_levels(texts: DataFrame, s: Settings) -> np.ndarray:
    """The level of each cell: eight steps to a doubling of the shingles counted in it, over the whole table.

    One byte for each cell comes to the driver, however many texts there are.
    """
    counted = texts.mapInArrow(released(_sketched(s)), "part int, cells binary, counts binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((_parts(s), s.cells // _parts(s)), dtype=np.uint8)
    with tidy(texts.sparkSession):
        for row in counted.mapInArrow(_leveled(s), "part int, levels binary").collect():
            out[row["part"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out.reshape(-1)


def ordered_sets(texts: list[bytes], levels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct tokens, ascending within each text, and where each text's begin."""
    runs, first = shingle_runs(texts, s.size)
    level = levels[(runs % np.uint64(s.cells)).astype(np.int64)].astype(np.uint64)
    tokens = (level << np.uint64(56)) | (mix(runs, 77) >> np.uint64(8))
    for a, b in zip(first[:-1], first[1:], strict=True):
        tokens[a:b].sort()
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[first[:-1][first[:-1] < len(tokens)]] = True
    before = np.concatenate([[0], np.cumsum(new)])
    return tokens[new], before[first]


def _signed(levels: np.ndarray, s: Settings):
    """Size, two hashes of the set, and the prefix of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                tokens, first = ordered_sets(_texts(part["text"]), levels, s)
                n = np.diff(first)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens, seed))])[first] for seed in (1, 2)]
                h1, h2 = ((x[1:] - x[:-1]).view(np.int64) for x in sums)
                length = np.where(n > 0, prefix_length(n, s.percent), 0)
                take = np.repeat(first[:-1], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), prefix], ["doc_id", "n", "h1", "h2", "prefix"])

    return run


def _gathered(levels: np.ndarray, wanted: np.ndarray, s: Settings):
    """The whole ordered set of each text that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch["place"].to_numpy()]))
            for part in slices(batch, "text", BATCH_BYTES):
                tokens, first = ordered_sets(_texts(part["text"]), levels, s)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens, seed))])[first] for seed in (1, 2)]
                h1, h2 = ((x[1:] - x[:-1]).view(np.int64) for x in sums)
                data = [tokens[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(h1), pa.array(h2), pa.array(data, pa.binary())], ["doc_id", "h1", "h2", "tokens"])

    return run


class Trie:
    """A trie of ordered sets with chains of single children joined, at most ``step`` tokens to a node.

    Built from the sets in lexicographic order: a set's path leaves its predecessor's where
    their common prefix ends. The sets may be prefixes of larger ones of the given sizes.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None, step: int = 32):
        self.sizes = [len(x) for x in sets] if sizes is None else sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        begin, end, parent, depth, ends = [], [], [], [], []
        flat: list[np.ndarray] = []
        size = 0
        path: list[int] = []  # nodes from the root, of the set before
        before = None
        for i in order:
            x = sets[i]
            common = 0
            if before is not None:
                m = min(len(x), len(before))
                differs = np.flatnonzero(x[:m] != before[:m])
                common = int(differs[0]) if len(differs) else m
            while path and depth[path[-1]] - (end[path[-1]] - begin[path[-1]]) >= common and depth[path[-1]] > common:
                path.pop()
            if path and depth[path[-1]] > common:
                # the path branches off within a node: cut it in two; the rest keeps its children
                node = path[-1]
                keep = common - (depth[node] - (end[node] - begin[node]))
                begin.append(begin[node])
                end.append(begin[node] + keep)
                parent.append(parent[node])
                depth.append(common)
                ends.append([])
                begin[node] += keep
                parent[node] = len(begin) - 1
                path[-1] = len(begin) - 1
            flat.append(x[common:])
            at = common
            while at < len(x):
                upto = min(at + step, len(x))
                begin.append(size + at - common)
                end.append(size + upto - common)
                parent.append(path[-1] if path else -1)
                depth.append(upto)
                ends.append([])
                path.append(len(begin) - 1)
                at = upto
            size += len(x) - common
            if path:
                ends[path[-1]].append(i)
            before = x
        self.tokens = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.begin, self.end = (np.array(v, dtype=np.int64) for v in (begin, end))
        depths, parents = np.array(depth, dtype=np.int64), np.array(parent, dtype=np.int64)
        count = len(parents)
        self.children = np.argsort(parents, kind="stable")
        self.first = np.searchsorted(parents[self.children], np.arange(-1, count + 1), "left")
        self.ends = ends
        self.has_end = np.array([bool(e) for e in ends], dtype=bool)
        # sizes of the sets that end at or below each node, from the deepest up
        self.least, self.most = np.full(count, 1 << 62, np.int64), np.zeros(count, np.int64)
        for k in np.argsort(-depths, kind="stable").tolist():
            for i in ends[k]:
                self.least[k] = min(self.least[k], self.sizes[i])
                self.most[k] = max(self.most[k], self.sizes[i])
            if parents[k] >= 0:
                p = parents[k]
                self.least[p] = min(self.least[p], self.least[k])
                self.most[p] = max(self.most[p], self.most[k])

    def _below(self, nodes: np.ndarray) -> np.ndarray:
        a, b = self.first[nodes + 1], self.first[nodes + 2]
        n = b - a
        return self.children[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def linked(self, x: np.ndarray, size: int, member: np.ndarray, least: int, most: int, percent: int) -> list[int]:
        """The stored sets of ``least`` to ``most`` tokens that reach the threshold with a set of ``size`` tokens.

        ``x`` is that set or its first tokens; of prefixes, those are returned that may still
        reach it. ``member`` is a scratch array over all tokens, all False.
        """
        member[x] = True
        rank = np.cumsum(member)
        unseen = size - len(x)
        last = int(x[-1]) if unseen else len(member)
        found: list[int] = []
        nodes = self._below(np.array([-1]))
        overlap = np.zeros(len(nodes), dtype=np.int64)
        passed = overlap.copy()  # tokens of a path that were compared with all of x that could equal them
        while len(nodes):
            fits = (self.most[nodes] >= least) & (self.least[nodes] <= most)
            nodes, overlap, passed = nodes[fits], overlap[fits], passed[fits]
            if not len(nodes):
                break
            length = self.end[nodes] - self.begin[nodes]
            ends = np.cumsum(length)
            tokens = self.tokens[np.repeat(self.begin[nodes] - (ends - length), length) + np.arange(ends[-1])]
            hits = np.concatenate([[0], np.cumsum(member[tokens])])
            overlap = overlap + hits[ends] - hits[ends - length]
            if unseen:
                known = np.concatenate([[0], np.cumsum(tokens <= last)])
                passed = passed + known[ends] - known[ends - length]
            else:
                passed = passed + length
            left = size - rank[self.tokens[self.end[nodes] - 1]]
            smallest = np.maximum(np.maximum(self.least[nodes], least), overlap)
            can = overlap + np.minimum(left, np.minimum(self.most[nodes], most) - passed)
            go = can >= needed(smallest, size, percent)
            nodes, overlap, passed, left = nodes[go], overlap[go], passed[go], left[go]
            for k in np.flatnonzero(self.has_end[nodes]).tolist():
                for i in self.ends[nodes[k]]:
                    n = self.sizes[i]
                    if least <= n <= most and overlap[k] + min(left[k], n - passed[k]) >= needed(n, size, percent):
                        found.append(i)
            n = self.first[nodes + 2] - self.first[nodes + 1]
            overlap, passed = np.repeat(overlap, n), np.repeat(passed, n)
            nodes = self._below(nodes)
        member[x] = False
        return found


class _Joined:
    """Sets that are linked, as a forest; only links that join two trees are kept."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def spanning_links(
    sets: list[np.ndarray], sizes: list[int], left: list[int], right: list[int] | None, percent: int
) -> list[tuple[int, int]]:
    """Links that connect what all links connect: among ``left``, or between ``left`` and ``right``.

    Within a block a set asks only for sets that aren't larger, so each pair is seen once
    or, at equal sizes, twice.
    """
    names, ids = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    cuts = np.cumsum([0, *map(len, sets)])
    local = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    trie = Trie([local[i] for i in left], [sizes[i] for i in left])
    member, joined = np.zeros(len(names), dtype=bool), _Joined(len(sets))
    for i in left if right is None else right:
        n = sizes[i]
        least = -(-percent * n // 100)
        most = n if right is None else 100 * n // percent
        for j in trie.linked(local[i], n, member, least, most, percent):
            if left[j] != i:
                joined.link(i, left[j])
    return joined.links


def _joined(s: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("class", "ascending")])
        ids, sides, sizes, data = (table[c].to_pylist() for c in ("class", "side", "n", "tokens"))
        # a class may come in several times, by equal rows
        keep = [i for i in range(len(ids)) if i == 0 or (ids[i], sides[i]) != (ids[i - 1], sides[i - 1])]
        sets = [np.frombuffer(x, dtype=np.uint64) if isinstance(x, bytes) else np.array(x, dtype=np.int64).view(np.uint64) for x in (data[i] for i in keep)]
        left = [k for k, i in enumerate(keep) if sides[i] == 0]
        right = [k for k, i in enumerate(keep) if sides[i] == 1]
        own = bool(table["own"][0].as_py())
        links = spanning_links(sets, [sizes[i] for i in keep], left, None if own else right, s.percent) if left and (own or right) else []
        a, b = ([ids[keep[link[e]]] for link in links] for e in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


_TASK = ["component", "at", "first", "second"]


def _tasks(members: DataFrame, columns: list[str], s: Settings) -> DataFrame:
    """Each member of a group (component, class, n, weight) once for every pair of blocks it takes part in.

    A group of up to ``block_tokens`` tokens, by weight, is one block. A larger one is cut by
    size first: linked sizes differ by less than one step, so a step meets itself and the next.
    """
    weights = members.groupBy("component").agg(F.sum("weight").alias("tokens"), F.count("*").alias("sets")).where("sets > 1")
    step = _step(F.col("n"), s)
    sized = members.join(weights, "component")
    stepped = settle(
        sized.withColumn("step", F.when(F.col("tokens") <= s.block_tokens, F.lit(-1).cast("long")).otherwise(step)).drop("tokens", "sets"), "stepped"
    )
    steps = stepped.groupBy("component", "step").agg(F.ceil(F.sum("weight") / s.block_tokens).cast("int").alias("blocks"))
    after = steps.select("component", (F.col("step") - 1).alias("step"), F.col("blocks").alias("after"))
    before = steps.select("component", (F.col("step") + 1).alias("step"), F.col("blocks").alias("before"))
    # a group has either the one step -1 or others, so -1 meets no neighbour
    around = steps.join(after, ["component", "step"], "left").join(before, ["component", "step"], "left")
    around = around.select("component", "step", "blocks", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("after", "before")))
    dealt = stepped.join(around, ["component", "step"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    me = F.col("block")
    every = F.concat(
        # block pairs within the step: the smaller block is on side 0
        F.transform(
            upto(F.col("blocks")),
            lambda b: F.struct((F.col("step") * 2).alias("at"), F.least(me, b).alias("first"), F.greatest(me, b).alias("second"), F.when(me <= b, 0).otherwise(1).alias("side"), (me == b).alias("own")),
        ),
        # this step's blocks on side 0 with the next step's, and on side 1 with those of the step before
        F.transform(upto(F.col("after")), lambda b: F.struct((F.col("step") * 2 + 1).alias("at"), me.alias("first"), b.alias("second"), F.lit(0).alias("side"), F.lit(False).alias("own"))),
        F.transform(upto(F.col("before")), lambda b: F.struct((F.col("step") * 2 - 1).alias("at"), b.alias("first"), me.alias("second"), F.lit(1).alias("side"), F.lit(False).alias("own"))),
    )
    return dealt.withColumn("t", F.explode(every)).select("component", "class", "n", *columns, "t.at", "t.first", "t.second", "t.side", "t.own")


def _grouped(links: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that have links, with the component of each."""
    groups = connected_components(links)
    return settle(groups.join(classes.withColumnRenamed("class", "node"), "node").withColumnRenamed("node", "class"), "members")


def _step(n, s: Settings):
    """Sizes of one step differ by less than the threshold allows for linked sets."""
    return F.floor(F.ln(n.cast("double")) / -np.log(s.percent / 100.0)).cast("long")


def _level(count):
    """Eight steps to a doubling, in one byte."""
    return np.minimum(255, np.round(8 * np.log2(np.asarray(count) + 1.0)))


def _touching(classes: DataFrame, s: Settings) -> DataFrame:
    """Links that connect the classes which share a prefix token and may be linked by size and shared tokens.

    Of a token in ``few`` classes all pairs are looked at, and kept if the tokens they share can lift them to the threshold:
    so classes that meet by chance don't grow into groups. The classes of another token
    are chained by size, cut where neighbours differ too much. Its level bounds
    their number, but for hot tokens: their classes are chained within a step of sizes and
    one of 64 parts, and the first of each part to the next first of the same or the next step.
    """
    first = classes.select("class", "n", F.explode("prefix").alias("token"))
    hot = F.shiftrightunsigned("token", 56) >= int(_level(s.hot))

    def chained(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("n", "class")
        return rows.withColumn("b", F.lag("class").over(order)).withColumn("smaller", F.lag("n").over(order))

    met = first.where(~hot).withColumn("among", F.count("*").over(Window.partitionBy("token"))).where("among > 1")
    met = settle(met, "met")
    many = met.where(F.col("among") > s.few)
    near = 100 * F.col("smaller") >= s.percent * F.col("n")
    cold = chained(many, "token").where(near)
    parts = first.where(hot).withColumns({"step": _step(F.col("n"), s), "part": F.pmod("class", F.lit(64))})
    parts = chained(parts, "token", "step", "part")
    heads = parts.where(F.col("b").isNull()).select("token", "class", "step")
    order = Window.partitionBy("token").orderBy("step", "class")
    heads = heads.withColumns({"b": F.lag("class").over(order), "before": F.lag("step").over(order)})
    others = many.select("class").union(first.where(hot).select("class")).groupBy("class").agg(F.count("*").alias("others"))
    links = [_pairs(met.where(F.col("among") <= s.few), others, s), cold, parts.where(F.col("b").isNotNull()), heads.where(F.col("step") - F.col("before") <= 1)]
    return reduce(DataFrame.union, [x.select(F.col("class").alias("a"), "b") for x in links])


def _pairs(met: DataFrame, others: DataFrame, s: Settings) -> DataFrame:
    """(class, b): pairs that share tokens of ``met`` (token, class, n) and may reach the threshold.

    Below the last token of one of both prefixes all common tokens are in both; above it, no more can be common than that set
    has left. ``others`` counts a class's prefix tokens that are not in ``met`` and may be shared, too.
    """
    lists = met.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "class"))).alias("all"))
    larger = lists.select("all", F.posexplode("all").alias("at", "y"))
    both = larger.select("y", F.explode(F.slice("all", F.lit(1), F.col("at"))).alias("x"))
    both = both.where(100 * F.col("x.n") >= s.percent * F.col("y.n"))
    shared = both.groupBy(F.col("x.class").alias("class"), F.col("y.class").alias("b")).agg(
        F.count("*").alias("shared"), F.first("x.n").alias("n"), F.first("y.n").alias("m")
    )
    known = shared.join(others, "class", "left").join(others.toDF("b", "others_b"), "b", "left")
    more = F.least(F.coalesce("others", F.lit(0)), F.coalesce("others_b", F.lit(0)))
    left = F.ceil(s.percent * F.col("m") / 100) - 1
    least = F.ceil(s.percent * (F.col("n") + F.col("m")) / (100 + s.percent))
    return known.where(F.col("shared") + more + left >= least)


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: the key, n_shingles, component_id.

    The component is the least key reachable by links. A text with fewer words than an n-gram
    is one shingle; a text without words, or NULL, has none and links with nothing. Rows
    with equal sets are linked whatever their keys. A component whose keys are
    all NULL has no name. Whole texts are read three times and never shuffled, but for the
    sets of those that share a prefix token with another.
    """
    s, spark = settings, docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    levels = frequency_levels(texts.select("text"), s)
    same, path = ["h1", "h2"], scratch_path(spark, "signatures")
    signed = settle_at(texts.mapInArrow(released(_signed(levels, s)), "doc_id long, n long, h1 long, h2 long, prefix array<long>"), path)
    classes = settle(
        signed.where("n > 0")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    # prefixes are most of what is written; from here on only those of classes are read
    signed = settle(signed.drop("prefix"), "sizes")
    remove(spark, path)

    def candidates() -> DataFrame:
        near = _grouped(_touching(classes, s), classes.select("class", "n", "prefix")).withColumn("weight", F.size("prefix"))
        prefixes = _tasks(near, ["prefix"], s).withColumnRenamed("prefix", "tokens")
        return prefixes.groupBy(*_TASK).applyInArrow(_joined(s), "a long, b long")

    pairs = settle_alone(spark, "candidates", candidates)

    def links() -> DataFrame:
        members = _grouped(pairs, classes.select("class", "n", "doc_id", *same)).withColumn("weight", F.col("n"))
        place = F.pmod(F.xxhash64("doc_id"), F.lit(s.wanted)).cast("int").alias("place")
        wanted = np.zeros(s.wanted, dtype=bool)
        wanted[members.select(place).distinct().toArrow()["place"].to_numpy()] = True
        sets = texts.select("doc_id", "text", place).mapInArrow(released(_gathered(levels, wanted, s)), "doc_id long, h1 long, h2 long, tokens binary")
        tasks = _tasks(members, ["doc_id", *same], s)
        match = (F.col("s.doc_id").eqNullSafe(F.col("t.doc_id"))) & (F.col("s.h1") == F.col("t.h1")) & (F.col("s.h2") == F.col("t.h2"))
        loaded = tasks.alias("t").join(sets.alias("s"), match).select(*(f"t.{c}" for c in _TASK), "t.side", "t.own", "t.class", "t.n", "s.tokens")
        return loaded.groupBy(*_TASK).applyInArrow(_joined(s), "a long, b long")

    linked = settle_alone(spark, "links", links)

    def names() -> DataFrame:
        joined = connected_components(linked)
        found = classes.select("class", "doc_id", *same).join(joined, F.col("class") == F.col("node"), "left")
        return found.select("doc_id", *same, F.coalesce("component", "class").alias("component"))

    named = settle_alone(spark, "named", names)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "component").select(*same, "component_id")
    out = signed.select("doc_id", "n", *same).join(by_set, same, "left")
    return out.select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [w]
    else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i:i + 2])) end as s from words
), tokens as (
  select doc_id, unnest(s) as t from sets
), numbered as (
  select doc_id, dense_rank() over (order by t) as t from tokens
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from numbered a join numbered b on a.t = b.t and a.doc_id <> b.doc_id group by all
), links as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 90 * (len(x.s) + len(y.s) - n)
), reach as (
  with recursive r(a, b) as (select a, b from links union select r.a, links.b from r join links on r.b = links.a)
  select a, min(b) as least from r group by a
)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id
from sets left join reach on doc_id = a
"""
