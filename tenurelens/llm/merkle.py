"""A Merkle manifest of a table: postorder logs written by aligned builders, proofs by closed-form positions.

Leaves are numbered in their tree's order. A builder takes the ``8 ** LEVELS`` leaves of one aligned block
and appends every node to its log when the node is complete: eight children, then their parent. The roots of
the blocks are the leaves of the next pass, until each tree has one node left. The roots of the trees form one more tree.

In a postorder log a node's position follows from the sizes of the subtrees before it, so siblings are
read by position: nothing but the log is stored, neither pointers nor levels. Proofs are taken from the top down: a block
adds its own siblings to the path that it was handed from above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenurelens.llm.crc import crc32_sql
from tenurelens.operators.joins import lookup_join
from tenurelens.sources.workspace import settle, settle_lookup

FAN = 8
#: Levels that a builder closes.
LEVELS = 3
BLOCK = FAN**LEVELS
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = "array<struct<key:{},changed:binary>>"


# -- positions ----------------------------------------------------------------


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def position(level: int, index: int, n: int) -> int:
    """Where the log of a tree of ``n`` leaves has a node: behind all nodes completed before it.

    Before a leaf stand the leaves before it and the full subtrees that they make; a parent
    follows its last leaf by as many places as it is levels above it.
    """
    last = min((index + 1) * FAN**level, n) - 1
    at = level
    while last:
        at, last = at + last, last // FAN
    return at


def _hash(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


def postorder(leaves: list[bytes], levels: int) -> bytes:
    """The nodes over the leaves in the order of their completion; the last run of a level may have fewer children, even one."""
    log, open_ = bytearray(), [bytearray() for _ in range(levels)]
    for place, digest in enumerate(leaves, start=1):
        log += digest
        last = place == len(leaves)
        for level in range(levels):
            open_[level] += digest
            if not last and place % FAN ** (level + 1):
                break
            digest = _hash(bytes(open_[level]))
            open_[level].clear()
            log += digest
    return bytes(log)


def local_path(log: bytes, index: int, n: int, levels: int) -> bytes:
    """Per level the node's place in its run, the number of its siblings, and their digests from left to right."""
    out = bytearray()
    for level in range(levels):
        place, first = index % FAN, index - index % FAN
        count = min(FAN, -(-n // FAN**level) - first)
        out += bytes((place, count - 1))
        for sibling in range(first, first + count):
            if sibling != index:
                at = position(level, sibling, n) * SIZE
                out += log[at : at + SIZE]
        index //= FAN
    return bytes(out)


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(path):
        place, end = path[at], at + 2 + path[at + 1] * SIZE
        yield place, path[at + 2 : end]
        at = end


def folded(path: bytes, digest: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for place, others in steps(path):
        digest = _hash(others[: place * SIZE] + digest + others[place * SIZE :])
    return digest


# -- leaves -------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it, or ``-`` for NULL."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def leaves(docs: DataFrame, tree: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """tree, key, leaf and changed: the leaf with the columns ``changed`` put in place, NULL where these are NULL or not given."""
    found = [F.col(c) for c in fields]
    other = F.lit(None).cast("binary")
    if changed:
        given = [F.coalesce(changed[c], F.col(c)) if c in changed else F.col(c) for c in fields]
        other = F.when(reduce(Column.__or__, [c.isNotNull() for c in changed.values()]), leaf_hash(given))
    name = F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit(""))
    return docs.select(name.alias("tree"), F.col(key).alias("key"), leaf_hash(found).alias("leaf"), other.alias("changed"))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with place (from 0, by ``order`` within ``tree``) and total (rows of the tree).

    Rows are dealt out by ranges of the order, equal ones too, and counted per range: no tree has to fit into a task.
    """
    rows = settle(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    ranged = rows.repartitionByRange("tree", *order, "salt").sortWithinPartitions("tree", *order)
    ranged = ranged.drop("salt").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    ranged = settle(ranged, "ranges")
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("n").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(by_tree).alias("total"))
    joined = lookup_join(ranged, settle_lookup(runs, "runs"), ["tree", "part"])
    return joined.withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


# -- builders -----------------------------------------------------------------


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One log per block, from leaves in order. Rows: block (tree, block, total), leaf, entry (key, changed)."""
    current, digests, entries = None, [], []

    def log() -> pa.RecordBatch:
        total = current["total"]
        levels = LEVELS if total > BLOCK else height(total)
        nodes = postorder(digests, levels)
        given = pa.concat_arrays(entries)
        held = pa.ListArray.from_arrays(pa.array([0, len(given)], pa.int32()), given)
        columns = [pa.array([v], t) for v, t in ((current["tree"], pa.string()), (current["block"], pa.int64()), (total, pa.int64()))]
        columns += [pa.array([len(digests)], pa.int32()), pa.array([nodes], pa.binary()), pa.array([nodes[-SIZE:]], pa.binary()), held]
        return pa.RecordBatch.from_arrays(columns, ["tree", "block", "total", "leaves", "nodes", "root", "entries"])

    for batch in batches:
        begin = 0
        for i, (block, leaf) in enumerate(zip(batch["block"].to_pylist(), batch["leaf"].to_pylist(), strict=True)):
            if block != current:
                if current is not None:
                    entries.append(batch["entry"].slice(begin, i - begin))
                    yield log()
                current, digests, entries, begin = block, [], [], i
            digests.append(leaf)
        entries.append(batch["entry"].slice(begin))
    if current is not None:
        yield log()


def _logs(nodes: DataFrame, name: str) -> DataFrame:
    """Logs of all blocks of nodes (tree, place, total, leaf, key, changed)."""
    kind = nodes.schema["key"].dataType.simpleString()
    block = F.floor(F.col("place") / BLOCK).cast("long")
    rows = nodes.select(F.struct("tree", block.alias("block"), "total").alias("block"), "place", "leaf", F.struct("key", "changed").alias("entry"))
    ordered = rows.repartition("block.tree", "block.block").sortWithinPartitions("block.tree", "block.block", "place")
    kinds = f"tree string, block long, total long, leaves int, nodes binary, root binary, entries {ENTRY.format(kind)}"
    return settle(ordered.drop("place").mapInArrow(_built, kinds), name)


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """The logs over the leaves, over the roots of their blocks, and so on."""
    found = [_logs(nodes, "logs-0")]
    while not (above := found[-1].where(F.col("total") > BLOCK)).isEmpty():
        total = F.ceil(F.col("total") / BLOCK).cast("long")
        none = [F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("changed")]
        found.append(_logs(above.select("tree", F.col("block").alias("place"), total.alias("total"), F.col("root").alias("leaf"), *none), f"logs-{len(found)}"))
    return found


@dataclass(frozen=True)
class Manifest:
    """The logs of every tree and of the tree over their roots, by passes, and its root; None over no leaves."""

    logs: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None


def _roots(logs: list[DataFrame]) -> DataFrame:
    out = None
    for log in logs:
        some = log.where(F.col("total") <= BLOCK).select("tree", "root")
        out = some if out is None else out.unionByName(some)
    return out


def build(found: DataFrame) -> Manifest:
    """The manifest of leaves (tree, key, leaf, changed): by key within a tree, equal keys by leaf; trees bytewise, the unnamed one first."""
    logs = _passes(placed(found, ["key", "leaf", "changed"]))
    subroots = _roots(logs).select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("changed"))
    top = _passes(placed(subroots, ["key"]))
    last = _roots(top).first()
    return Manifest(logs, top, bytes(last["root"]) if last else None)


# -- proofs -------------------------------------------------------------------


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf of every log: tree, place, leaf, entry, and its path to the root."""
    for batch in batches:
        for row in range(batch.num_rows):
            tree, block, total, n, log, above, subroot = (batch[c][row].as_py() for c in ("tree", "block", "total", "leaves", "nodes", "path", "subroot"))
            levels = LEVELS if total > BLOCK else height(total)
            at = [position(0, i, n) * SIZE for i in range(n)]
            paths = [local_path(log, i, n, levels) + above for i in range(n)]
            columns = [pa.array([tree] * n, pa.string()), pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64())]
            columns += [pa.array([log[a : a + SIZE] for a in at], pa.binary()), pa.array(paths, pa.binary()), pa.array([subroot] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, batch["entries"][row].values], ["tree", "place", "leaf", "path", "subroot", "entry"])


def _paths(logs: list[DataFrame], from_above: DataFrame) -> DataFrame:
    """Paths of the leaves of ``logs``; ``from_above`` holds the path of each tree's root (tree, path)."""
    handed = None
    for number, log in reversed(list(enumerate(logs))):
        tops = log.where(F.col("total") <= BLOCK).join(from_above, "tree").withColumn("subroot", F.col("root"))
        if handed is not None:
            below = handed.select("tree", F.col("place").alias("block"), "path", "subroot")
            tops = tops.unionByName(log.where(F.col("total") > BLOCK).join(below, ["tree", "block"]))
        kind = log.schema["entries"].dataType.elementType.simpleString()
        kinds = f"tree string, place long, leaf binary, path binary, subroot binary, entry {kind}"
        handed = tops.mapInArrow(_handed_down, kinds)
        if number:
            handed = settle(handed, f"paths-{number}")
    return handed


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: tree, key, leaf, changed, subroot and path, its siblings level by level up to the manifest's root."""
    start = manifest.top[0].select("tree", F.lit(b"").alias("path")).distinct()
    top = _paths(manifest.top, start)
    down = _paths(manifest.logs, settle(top.select(F.col("entry.key").alias("tree"), "path"), "tree-paths"))
    return down.select("tree", "entry.key", "leaf", "entry.changed", "subroot", "path")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = [b if a is None else a for a, b in zip(batch["changed"].to_pylist(), batch["leaf"].to_pylist(), strict=True)]
        paths = batch["path"].to_pylist()
        proof = [hashlib.sha256("".join(others.hex() for _, others in steps(p)).encode()).hexdigest() for p in paths]
        root = [folded(p, d).hex() for p, d in zip(paths, given, strict=True)]
        kept = [batch[c] for c in ("key", "leaf", "subroot")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(proof), pa.array(root)], ["key", "leaf", "subroot", "proof_sha256", "folded_root"])


def verify(found: DataFrame, root: bytes | None) -> DataFrame:
    """Proofs folded from the changed leaf, or the leaf where none is changed: key, leaf, subroot, root, proof_sha256, folded_root, verified."""
    kind = found.schema["key"].dataType.simpleString()
    kinds = f"key {kind}, leaf binary, subroot binary, proof_sha256 string, folded_root string"
    done = found.select("key", "leaf", "changed", "subroot", "path").mapInArrow(_verified, kinds)
    digests = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot")}
    done = done.withColumns(digests | {"root": F.lit(root.hex() if root else None).cast("string")})
    return done.withColumn("verified", F.col("folded_root") == F.col("root")).select(
        "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def checked(docs: DataFrame, changed: dict[str, Column] | None = None, tree: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The manifest of ``docs``, and every row's proof against what ``changed`` makes of it.

    NULL is a value of every field; a NULL tree is a tree of its own, the first, and a NULL key comes first in its
    tree. Repeated rows are leaves of their own; those of one key are ordered by their digests. Empty and very long texts
    are hashed whole. Columns not among ``fields`` are not part of a leaf. An empty table has no root and no rows.
    """
    manifest = build(leaves(docs, tree, key, fields, changed))
    return verify(proofs(manifest), manifest.root).withColumnRenamed("key", key)


def tampered_text() -> dict[str, Column]:
    """A third of the rows, by a hash of doc_id, with A-Z of the text in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return {"text": F.when(hit, F.translate("text", UPPER, LOWER))}


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return checked(docs.select(*FIELDS), tampered_text())


# -- the same in SQL ----------------------------------------------------------

#: Levels written out in SQL, for trees and for the tree over their roots: enough for 8 ** 8 leaves and 8 ** 4 trees.
_SQL_LEVELS, _SQL_TOP = 8, 4


def _sql_leaf(text: str) -> str:
    values = [f"case when {c} is null then '-' else strlen({v}::varchar) || ':' || {v}::varchar end" for c, v in ((c, text if c == "text" else c) for c in FIELDS)]
    return f"sha256(concat({', '.join(values)}))"


def _sql_levels(name: str, first: str, levels: int) -> str:
    """Nodes of every level (tree, i, h, n): runs of eight while more than one is left, then the last one again."""
    parts = [f"{name}0 as ({first})"]
    for k in range(levels):
        parts.append(
            f"{name}_run{k} as (select tree, i // {FAN} as run, any_value(n) as n, list(h order by i) as hs from {name}{k} group by tree, i // {FAN})"
        )
        parts.append(
            f"{name}{k + 1} as (select tree, run as i, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h, "
            f"(n + {FAN - 1}) // {FAN} as n from {name}_run{k})"
        )
    return ",\n".join(parts)


def _sql_fold(name: str, source: str, levels: str, count: int) -> str:
    """Rows of ``source`` (tree, i, folded, proof) carried up, level by level."""
    parts = []
    for k in range(count):
        own = f"(p.i % {FAN})::int"
        before, after = f"array_to_string(hs[1:{own}], '')", f"array_to_string(hs[{own} + 2:], '')"
        parts.append(
            f"{name}{k} as (select p.* replace (p.i // {FAN} as i, case when r.n > 1 then sha256({before} || folded || {after}) else folded end as folded, "
            f"case when r.n > 1 then proof || {before} || {after} else proof end as proof) from {source} p "
            f"join {levels}_run{k} r on p.tree = r.tree and p.i // {FAN} = r.run)"
        )
        source = f"{name}{k}"
    return ",\n".join(parts)


ORACLE = f"""
with hashed as (
  select *, coalesce('=' || lang, '') as tree, {_sql_leaf("text")} as leaf,
    case when {crc32_sql("doc_id::varchar")} % 3 = 0 then {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as changed
  from documents
), leaves as (
  select doc_id, tree, leaf, coalesce(changed, leaf) as folded, '' as proof,
    row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n
  from hashed
), {_sql_levels("t", "select tree, i, leaf as h, n from leaves", _SQL_LEVELS)},
subroots as (select tree, h as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from t{_SQL_LEVELS}),
{_sql_levels("u", "select '' as tree, i, subroot as h, n from subroots", _SQL_TOP)},
{_sql_fold("p", "leaves", "t", _SQL_LEVELS)},
crossed as (
  select doc_id, leaf, subroot, folded, proof, '' as tree, s.i as i from p{_SQL_LEVELS - 1} l join subroots s on l.tree = s.tree
), {_sql_fold("q", "crossed", "u", _SQL_TOP)}
select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = h as verified
from q{_SQL_TOP - 1}, u{_SQL_TOP}
"""
