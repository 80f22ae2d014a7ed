"""Deletion of later copies of repeated line runs, by a suffix array over line sequences.

Lines become identifiers; the suffixes of all documents' line sequences are ranked by
distributed prefix doubling: the rank of a suffix by its first 2n lines follows from two ranks
by n lines. Suffixes with the same rank at depth n form an interval of the suffix array whose
longest common prefix is n lines or more. Suffixes that stand alone at a depth leave the
doubling there.

A run counts when it holds ``min_words`` words or more. A line is deleted when it lies in
such a run that also begins at an earlier place, in the order of documents by
key. The maximal repeated runs are the unions of their shortest counting windows, one
beginning at each line and one ending at each line, so it is enough to look up the
interval of each such window: the ranks of its first and its last 2^j lines name it.
A window has ``min_words`` lines at most, which bounds the depth of the doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenurelens.llm.mixing import word_count
from tenurelens.llm.rows import ROW
from tenurelens.sources.workspace import settle, settle_alone

MIN_WORDS = 50
SPACE = " \t\n\x0b\x0c\r"
#: A line takes the blank lines behind it along, and blank lines at the start of a text.
LINE_END = r"\n(?=[^\n]*[^\x20\x09-\x0D])"
AT = "__at"


def _lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def _sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with words: row, key, place in the text, line hashes, words."""
    lines = docs.select(ROW, F.col(key).alias("key"), F.posexplode(_lines(F.col(text))).alias(AT, "line"))
    bare = F.btrim("line", F.lit(SPACE))
    return lines.withColumn("line", bare).where("line <> ''").select(
        ROW, "key", AT, F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), word_count(F.col("line")).alias("words")
    )


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank``, the dense rank of distinct rows by ``by``, from a range partitioning.

    Ranks within a partition are offset by the rows of the partitions before it; one
    row per partition is all that meets in one place.
    """
    dealt = pairs.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    local = settle(dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*by))), "sorted-pairs")
    sizes = local.groupBy("__part").agg(F.max("__n").cast("long").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    return local.join(offsets, "__part").withColumn("rank", F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")


def _doubled(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """Per depth 1, 2, 4, ... the suffixes (row, at, rank) that share their first lines with another."""
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ranked = _ranked(shared, ["h1", "h2"])
    level = settle(lines.join(ranked, ["h1", "h2"]).select(ROW, AT, "rank", "words", "key"), "depth")
    levels = [level]
    depth = 1
    while depth * 2 <= min_words:
        tail = level.select(ROW, (F.col(AT) - depth).alias(AT), F.col("rank").alias("r2"))
        pairs = settle(level.select(ROW, AT, F.col("rank").alias("r1")).join(tail, [ROW, AT]), "pairs")
        shared = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        level = settle(pairs.join(_ranked(shared, ["r1", "r2"]), ["r1", "r2"]).select(ROW, AT, "rank"), "depth")
        if level.isEmpty():
            break
        levels.append(level)
        depth *= 2
    return levels


def _windows(level: DataFrame, min_words: int) -> DataFrame:
    """(row, at, n, key): the shortest runs of ``min_words`` words that begin or end at a line.

    Only runs all of whose lines are repeated lines are of interest; a gap in the places ends one.
    """

    def shortest(frame, backward: bool) -> DataFrame:
        near = F.collect_list(F.struct(F.col(AT).alias("at"), F.col("words").alias("w"))).over(frame)
        ordered = F.reverse(near) if backward else near
        taken = F.aggregate(
            ordered,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")),
            lambda s, x: F.when(s["sum"] >= min_words, s).otherwise(
                F.struct((s["sum"] + x["w"]).alias("sum"), (s["n"] + 1).alias("n"))
            ),
        )
        found = level.withColumn("__near", ordered).withColumn("__taken", taken)
        n = F.col("__taken.n")
        last = F.element_at("__near", n)["at"]
        begins = F.least(F.col(AT), last)
        return (
            found.where(F.col("__taken.sum") >= min_words)
            .where(F.abs(last - F.col(AT)) == n - 1)
            .select(ROW, begins.alias(AT), n.alias("n"), "key")
        )

    order = Window.partitionBy(ROW).orderBy(AT)
    ahead = shortest(order.rangeBetween(0, min_words - 1), False)
    behind = shortest(order.rangeBetween(-(min_words - 1), 0), True)
    return ahead.union(behind).distinct()


def repeated_lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(row, at): places of the lines to delete. ``docs`` has a stable column ``__row``."""
    lines = settle(_sequences(docs, key, text), "lines")
    levels = _doubled(lines, min_words)
    power = F.lit(len(levels) - 1)
    for j in reversed(range(len(levels) - 1)):
        power = F.when(F.col("n") < 2 ** (j + 1), F.lit(j)).otherwise(power)
    deepest = 2 ** len(levels)  # longer windows are not repeated
    windows = settle(
        _windows(levels[0], min_words).where(F.col("n") < deepest).withColumn("j", power.cast("int")), "windows"
    )
    ranks = levels[0].select(F.lit(0).alias("j"), ROW, AT, "rank")
    for j, level in enumerate(levels[1:], 1):
        ranks = ranks.union(level.select(F.lit(j).alias("j"), ROW, AT, "rank"))
    first = ranks.withColumnRenamed("rank", "ra")
    last = ranks.select("j", ROW, F.col(AT).alias("__last"), F.col("rank").alias("rb"))
    named = (
        windows.withColumn("__last", F.col(AT) + F.col("n") - F.pow(F.lit(2), F.col("j")).cast("int"))
        .join(first, ["j", ROW, AT])
        .join(last, ["j", ROW, "__last"])
        .select("n", "ra", "rb", F.struct(F.col("key").isNull(), F.col("key"), F.col(ROW), F.col(AT)).alias("place"))
    )
    named = settle(named, "named-windows")
    earliest = named.groupBy("n", "ra", "rb").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    later = named.join(earliest, ["n", "ra", "rb"]).where("place <> first")
    return later.select(
        F.col(f"place.{ROW}").alias(ROW),
        F.explode(F.sequence(F.col(f"place.{AT}"), F.col(f"place.{AT}") + F.col("n") - 1)).alias(AT),
    ).distinct()


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    names: tuple[str, str] = ("lines_total", "lines_deleted"),
) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and two columns more:
    all lines and deleted lines under ``names``, counted in lines that hold words.

    Every row stays, also one that loses all lines. Lines are compared without white space
    at their ends; blank lines go with the line before them. NULL and empty texts have no
    lines and stay as they are. Rows are in the order of the key, NULL last, and of the
    table among equal keys, so of repeated rows the first keeps its lines. A run that
    overlaps its own earlier copy within a document counts as a copy. A column ``__row`` of unique
    longs, if there is one, stands for the order of the table.
    """
    stable = docs if ROW in docs.columns else settle(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
    gone = settle_alone(stable.sparkSession, "gone-lines", lambda: repeated_lines(stable, key, text, min_words))
    marks = gone.groupBy(ROW).agg(F.sort_array(F.collect_list(AT)).alias("__gone"))
    out = stable.join(marks, ROW, "left").withColumn("__lines", _lines(F.col(text)))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.transform(places, lambda i: F.get("__lines", i))
    total = F.size(F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    columns = [F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(
        *columns,
        F.when(F.col(text).isNull(), 0).otherwise(total).alias(names[0]),
        F.coalesce(F.size("__gone"), F.lit(0)).alias(names[1]),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


ORACLE = r"""
with source as (
  select row_number() over (order by doc_id nulls last) as r, doc_id, text from documents
), raw as (
  select r, doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as p from source
), cut as (
  select *, greatest(sum(case when regexp_matches(l, '[^\x20\x09-\x0D]') then 1 else 0 end) over (partition by r order by p), 1) - 1 as k from raw
), parts as (
  select r, doc_id, k, string_agg(l, chr(10) order by p) as part from cut group by r, doc_id, k
), lines as (
  select *, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line, len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) as words from parts
), full_lines as (
  select *, sum(words) over (partition by r order by k) as upto from lines where line <> ''
), ends as (
  select a.r, a.k as s, min(b.k) as e from full_lines a join full_lines b
    on a.r = b.r and b.k between a.k and a.k + 49 and b.upto - a.upto + a.words >= 50 group by a.r, a.k
  union
  select a.r, max(b.k) as s, a.k as e from full_lines a join full_lines b
    on a.r = b.r and b.k between a.k - 49 and a.k and a.upto - b.upto + b.words >= 50 group by a.r, a.k
), runs as (
  select w.r, w.s, w.e, list(f.line order by f.k) as content
  from ends w join full_lines f on f.r = w.r and f.k between w.s and w.e group by w.r, w.s, w.e
), earliest as (
  select *, row_number() over (partition by content order by r, s) as n from runs
), gone as (
  select distinct r, unnest(generate_series(s::bigint, e::bigint)) as k from earliest where n > 1
), joined as (
  select p.r, string_agg(p.part, chr(10) order by p.k) filter (where g.k is null) as kept,
    count(*) filter (where p.line <> '') as total, count(g.k) as deleted
  from lines p left join gone g on p.r = g.r and p.k::bigint = g.k group by p.r
)
select doc_id, case when text is null then null else coalesce(kept, '') end as text,
  coalesce(total, 0)::int as lines_total, coalesce(deleted, 0)::int as lines_deleted
from source left join joined using (r)
"""
