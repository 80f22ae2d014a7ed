"""Training frame of all eligible years and scoring frame of the next year."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.operators import eligibility as el, encode, salary, score_frame as sf
from tenurelens.operators.joins import null_safe_join
from tenurelens.plans.history import History
from tenurelens.sources.workspace import settle, settle_lookup


@dataclass(frozen=True)
class Fitted:
    """Training frame, the target means the scoring frame has to reuse, and the rows the frame was filtered from."""

    frame: DataFrame
    means: encode.TargetMeans
    rows: DataFrame


@dataclass(frozen=True)
class Unpriced:
    """Rows before the pension join, which comes last: what is looked up for a row before is looked up once, however often it is multiplied.

    ``pension`` holds the pension rows of those that are not ``single``.
    """

    rows: DataFrame
    pension: DataFrame | None
    growth: float | None = None

    @classmethod
    def of(cls, rows: DataFrame, history: History, cfg: PolicyConfig, growth: float | None = None) -> Unpriced:
        if history.rates is None:
            return cls(rows, None, growth)
        others = rows.filter(~F.col("single")).drop("BIWEEKLY_RATE")
        return cls(rows, el.pension_table(others, history.rates, cfg, growth, how="inner"), growth)

    def priced(self, cfg: PolicyConfig, rows: DataFrame | None = None) -> DataFrame:
        """``rows``, or some of them with more columns, joined to their pension rows."""
        rows = self.rows if rows is None else rows
        found = el.with_pension(rows.filter("single"), cfg, self.growth)
        if self.pension is not None:
            others = rows.filter(~F.col("single")).drop("BIWEEKLY_RATE")
            found = found.unionByName(el.attach_pension(others, self.pension, how="inner"))
        return _pension_first(found.drop("single"))

    def counted(self, name: str) -> DataFrame:
        """``rows`` with how often the join repeats them under ``name``, without those it drops."""
        rows = self.rows.filter("single").withColumn(name, F.lit(1).cast("long"))
        if self.pension is None:
            return rows
        times = self.pension.groupBy("EMPLOYEE_ID", "MAX_PP").agg(F.count(F.lit(1)).alias(name))
        return rows.unionByName(null_safe_join(self.rows.filter(~F.col("single")), times, ["EMPLOYEE_ID", "MAX_PP"], "inner"))


def _pension_first(frame: DataFrame) -> DataFrame:
    """The pension columns before those of the peers."""
    names = [c for c in frame.columns if c not in el.PENSION]
    at = names.index("eligible_persent")
    return frame.select(*names[:at], *el.PENSION, *names[at:])


def _unpriced_train(history: History, cfg: PolicyConfig) -> DataFrame:
    rows = history.panel.filter(el.is_eligible(cfg))
    peers = settle_lookup(el.peer_stats(history.panel, cfg.eligible_age, cfg.eligible_service), "peers")
    rows = salary.attach_fallback(el.attach_peers(rows, peers), history.fallback)
    return encode.normalise(salary.fill_train(rows), cfg)


def train_rows(history: History, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Eligible employee-years, imputed and normalised; those that lack a rate or a share are still there."""
    return Unpriced.of(_unpriced_train(history, cfg), history, cfg).priced(cfg)


def train_base(history: History, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Eligible employee-years, imputed and normalised, before target means."""
    return _usable(train_rows(history, cfg))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(~salary.no_rate() & ~salary.no_share())


def train_frame(history: History, cfg: PolicyConfig = PolicyConfig(), fit_on=None) -> Fitted:
    """``fit_on`` restricts the rows the target means are fitted on.

    By default all rows are used, test rows included; pass a condition such as
    the training split to keep test labels out of the encoding. Rows are written before the pension join multiplies
    them; the means weigh each by its repetitions.
    """
    found = Unpriced.of(settle(_unpriced_train(history, cfg), "train_rows"), history, cfg)
    if fit_on is None:
        means = encode.TargetMeans.fit(_usable(found.counted("__times")), cfg=cfg, weight="__times")
    else:
        means = encode.TargetMeans.fit(_usable(found.priced(cfg)).filter(fit_on), cfg=cfg)
    return Fitted(found.priced(cfg, means.apply(_usable(found.rows))), means, found.priced(cfg))


def _unpriced_score(history: History, cfg: PolicyConfig) -> DataFrame:
    rows = sf.roll_forward(sf.score_population(history.panel, cfg), cfg)
    last_year = history.panel.filter(F.col("FISCAL_YEAR") == cfg.last_fiscal_year)
    peers = settle_lookup(el.peer_stats(last_year, cfg.forward_age, cfg.forward_service), "next_peers")
    rows = salary.attach_fallback(el.attach_peers(rows, peers, by_year=False), history.fallback)
    return encode.normalise(salary.fill_score(rows, cfg), cfg)


#: Columns of the panel that the scoring frame leaves.
_LEFT = ["DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE", "MAX_PP", "retire", "JOB_CLASS"]


def score_rows(history: History, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Next year's eligible employees with everything but target means; those that lack a share are still there."""
    return Unpriced.of(_unpriced_score(history, cfg), history, cfg, cfg.rate_growth).priced(cfg).drop(*_LEFT)


def score_base(history: History, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    return score_rows(history, cfg).filter(~salary.no_share())


def score_frame(history: History, means: encode.TargetMeans, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    found = Unpriced.of(_unpriced_score(history, cfg), history, cfg, cfg.rate_growth)
    return found.priced(cfg, means.apply_unseen(found.rows.filter(~salary.no_share()))).drop(*_LEFT)


@dataclass(frozen=True)
class Scored:
    """Scoring frame, and the rows the frame was filtered from."""

    frame: DataFrame
    rows: DataFrame


def scored(history: History, means: encode.TargetMeans, cfg: PolicyConfig = PolicyConfig()) -> Scored:
    """``score_frame`` by way of a written table, from which dropped rows can be counted."""
    found = Unpriced.of(settle(means.apply_filled(_unpriced_score(history, cfg)), "score_rows"), history, cfg, cfg.rate_growth)
    rows = found.priced(cfg).drop(*_LEFT)
    return Scored(rows.filter(~salary.no_share() & ~encode.unseen_step()), rows)
