"""Spelling variants: words that differ by one edit, grouped under their most frequent form.

The near pairs are the pairs accepted by the composition of the vocabulary's minimal acceptor, a
transducer that makes exactly one edit, and the acceptor again. The composition is enumerated from many initial states: a
pair's edit lies in one window of the shorter word, and what stands before and after the window is the
same in both words. Words of one length and of the next that agree outside a window start from the same
state. Every pair is found in one window only, the one where its words first differ.

A word begins with two windows, its halves. Where too many words agree outside a window, the window is
halved, down to a single character, outside which few words can agree. So no
task holds more than a bounded number of words of a state, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.llm.acceptor import Register
from tenurelens.llm.crc import crc32_sql
from tenurelens.operators.joins import lookup_join
from tenurelens.sources.workspace import settle, settle_lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7
LEAST = 2
RATIO = 10
#: Words that a task holds of one initial state; windows with more of them are halved.
MOST = 4096
#: Words whose states are kept in one register.
REGISTER = 20_000
PAIR = "a string, n_a long, b string, n_b long"


def _worn(key: Column, run: Column, one_in: int) -> Column:
    """The run without one of its characters, by a hash of its key and itself, once in ``one_in``."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, short).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, one_in: int = 31) -> DataFrame:
    """Words of ``shortest`` letters or more and ``least`` occurrences or more: word, n.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; one of ``one_in``, by
    the key and the run, loses a letter first. A NULL text has no words; a NULL key takes no letter.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0)))
    runs = docs.select(F.col(key).alias("key"), run.alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = runs.select("key", lowered.alias("run")).select(_worn(F.col("key"), F.col("run"), one_in).alias("word"))
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


# -- windows ------------------------------------------------------------------


def _state(m: Column, low: Column, high: Column) -> Column:
    """A number for the initial state: the shorter length, the window, and all outside of it.

    The last window ends with the shorter word, and takes what the longer one has behind it.
    """
    word = F.col("word")
    behind = high + 1 + F.length(word) - m
    return F.xxhash64(m, low, high, F.substring(word, F.lit(1), low), F.substring(word, behind, F.length(word)))


def _windowed(words: DataFrame, windows: Column) -> DataFrame:
    """Rows for every window (m, low, high) in the array ``windows``; ``word`` has m letters or one more."""
    rows = words.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.*").where("low < high")
    return rows.withColumn("state", _state(F.col("m"), F.col("low"), F.col("high")))


def _window(m: Column, low: Column, high: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def _halves(m: Column) -> list[Column]:
    middle = F.floor(m / 2)
    return [_window(m, F.lit(0), middle), _window(m, middle, m)]


def _first_windows(words: DataFrame) -> DataFrame:
    """Both halves of each word, and of the word one letter shorter that it may come from."""
    length = F.length("word")
    return _windowed(words, F.array(*_halves(length), *_halves(length - 1)))


def _split_windows(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2)
    m = F.col("m")
    return _windowed(rows, F.array(_window(m, F.col("low"), middle), _window(m, middle, F.col("high"))))


# -- composition --------------------------------------------------------------


class _Pairs:
    """Pairs that a task has found and not yet handed on."""

    def __init__(self):
        self.columns: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, a: tuple[str, int], b: tuple[str, int]) -> None:
        for column, value in zip(self.columns, (*a, *b), strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], ["a", "n_a", "b", "n_b"])
        self.columns = ([], [], [], [])
        return out


def compose(register: Register, rows: list[tuple[str, int, int, int, int]], found: _Pairs) -> None:
    """Near pairs among the rows (word, n, m, low, high) of one initial state.

    Two states may share a number by chance, so rows are told apart by what lies outside their window.
    """
    groups: dict[tuple, tuple[list, list]] = {}
    for word, n, m, low, high in rows:
        longer = len(word) - m
        inner = word[low : high + longer]
        group = groups.setdefault((m, low, high, word[:low], word[high + longer :]), ([], []))
        group[longer].append((inner, word, n))
    for (m, _, high, _, _), (short, long) in groups.items():
        if not short or len(short) + len(long) < 2:
            continue
        short.sort()
        long.sort()
        start = register.acceptor([inner for inner, _, _ in short])
        for i, j in register.replaced(start):
            found.add(short[i][1:], short[j][1:])
        if long:
            other = register.acceptor([inner for inner, _, _ in long])
            for i, j in register.inserted(start, other, at_end=high == m):
                found.add(short[i][1:], long[j][1:])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their states."""
    register, found, current, rows, used = Register(), _Pairs(), None, [], 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("state", "word", "n", "m", "low", "high")]
        for state, *row in zip(*columns, strict=True):
            if state != current:
                if len(rows) > 1:
                    compose(register, rows, found)
                    used += len(rows)
                    if used > REGISTER:
                        register, used = Register(), 0
                current, rows = state, []
            rows.append(row)
        if len(found.columns[0]) > 10_000:
            yield found.batch()
    if len(rows) > 1:
        compose(register, rows, found)
    yield found.batch()


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """Every pair of words one insertion, deletion or replacement apart, once: a, n_a, b, n_b.

    ``words`` holds distinct words with their n.
    """
    rows, parts = settle(_first_windows(words), "windows"), []
    while True:
        big = settle_lookup(rows.groupBy("state").agg(F.count("*").alias("rows")).where(F.col("rows") > most), "big-states")
        small = rows
        if big.rows:
            marked = lookup_join(rows, big, ["state"])
            # a window of one letter is not halved: its states hold no more words than there are pairs of letters
            whole = F.col("rows").isNull() | (F.col("high") - F.col("low") <= 1)
            small = marked.where(whole)
            rows = settle(_split_windows(marked.where(~whole)), "windows")
        ordered = small.select("state", "word", "n", "m", "low", "high").repartition("state").sortWithinPartitions("state")
        parts.append(settle(ordered.mapInArrow(_composed, PAIR), "near-pairs"))
        if not big.rows:
            break
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    return pairs


# -- forms --------------------------------------------------------------------


def with_forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Adds n_near, form and form_n: the near word of largest n, the first of equals in code point order, if that n is ``ratio`` times the word's."""
    both = pairs.select(F.explode(F.array(F.struct("a", "n_b", "b"), F.struct(F.col("b").alias("a"), F.col("n_a").alias("n_b"), F.col("a").alias("b")))).alias("p"))
    first = F.struct((-F.col("p.n_b")).alias("n"), F.col("p.b").alias("b"))
    near = both.groupBy(F.col("p.a").alias("word")).agg(F.count("*").alias("n_near"), F.min(first).alias("first"))
    joined = words.join(near, "word", "left")
    enough = -F.col("first.n") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("first.b")).alias("form"), F.when(enough, -F.col("first.n")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds root: the last of a word's forms, the word itself if it has none.

    Every step doubles how far the roots look ahead. Since n grows by a ratio with each form, the paths are short.
    """
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        steps = settle(steps, "roots")
        ahead = steps.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        joined = steps.join(ahead, F.col("root") == F.col("at"), "left")
        if joined.where("beyond is not null").isEmpty():
            break
        steps = joined.select("word", F.coalesce("beyond", "root").alias("root"))
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """Per word of the vocabulary: word, n, n_near, form, form_n, root.

    Documents without words, empty and NULL texts give no rows, repeated rows count again, and an empty table
    gives an empty result. Words may have any length.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than the word")
    words = settle(vocabulary(docs, key, text, shortest, least), "vocabulary")
    return with_roots(settle(with_forms(words, near_pairs(words), ratio), "forms"))


def query(spark, sf_dir: str) -> DataFrame:
    found = variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = f"""
with runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') as run from documents
), hashed as (
  select run, {crc32_sql("concat(doc_id::varchar, ':', run)")} as h, doc_id from runs
), worn as (
  select case when h % 31 = 0 and doc_id is not null
    then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed
), v as (
  select word, count(*)::bigint as n from worn where length(word) >= 7 group by word having count(*) >= 2
), without as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), near as (
  select a.word, b.word as other, b.n from without a join without b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select l.word, s.word, s.n from without l join v s on l.rest = s.word
  union select s.word, l.word, l.n from without l join v s on l.rest = s.word
), best as (
  select word, count(*)::bigint as n_near, first(other order by n desc, other) as form, max(n) as form_n from near group by word
), formed as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 10 * v.n then form end as form,
    case when form_n >= 10 * v.n then form_n end as form_n
  from v left join best on v.word = best.word
), recursive_paths as (
  with recursive paths(word, reached) as (
    select word, word from formed
    union all select paths.word, formed.form from paths join formed on paths.reached = formed.word where formed.form is not null
  ) select paths.word, paths.reached as root from paths join formed on paths.reached = formed.word where formed.form is null
)
select formed.word, form, root, n, n_near, form_n from formed join recursive_paths using (word)
"""
