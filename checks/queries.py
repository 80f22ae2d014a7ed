"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextvars import ContextVar
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import trade_payroll as trade
from checks.oracle import FAN_OUT_TWINS, OUTPUT_DECIMALS, ROUNDED
from checks.sheets import write_sheets
from tenurelens.config import PolicyConfig
from tenurelens.functions import dates
from tenurelens.functions.nullsafe import in_list
from tenurelens.operators import eligibility as el, employee_year as ey, encode, forest
from tenurelens.operators import profile, salary, score_frame as sf, search, snapshots, steps
from tenurelens.plans import drops, frames, modelling
from tenurelens.plans.history import History, build_history, panel_rows
from tenurelens.sources import io, schema, sheet
from tenurelens.sources.workspace import Lookup, scratch_path, settle, settle_lookup

Query = Callable[[SparkSession, str], DataFrame]

CFG = replace(PolicyConfig(), last_fiscal_year=trade.LAST_FISCAL_YEAR)
ID = ["EMPLOYEE_ID", "FISCAL_YEAR"]
# whether the payroll of the running query has several titles and rates per period
_FAN_OUT: ContextVar[bool] = ContextVar("fan_out", default=False)


# -- shared inputs ------------------------------------------------------------


def facts(spark: SparkSession, d: str) -> DataFrame:
    return trade.payroll(spark, d, _FAN_OUT.get())


def fanned(query: Query) -> Query:
    """The same query over the payroll with several titles and rates per period."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        token = _FAN_OUT.set(True)
        try:
            return query(spark, d)
        finally:
            _FAN_OUT.reset(token)

    return run


def rounded(query: Query, columns: Sequence[str]) -> Query:
    """Sums of doubles differ in their last bits between engines, so both sides round what they return."""
    return lambda spark, d: query(spark, d).withColumns({c: F.round(c, OUTPUT_DECIMALS) for c in columns})


def calendar(spark: SparkSession, d: str) -> Lookup:
    return settle_lookup(trade.fiscal_calendar(spark, d), "calendar")


def checks(spark: SparkSession, d: str) -> DataFrame:
    return ey.with_fiscal_year(facts(spark, d), calendar(spark, d))


def ladder(spark: SparkSession, d: str) -> Lookup:
    return settle_lookup(steps.step_table(trade.job_steps(spark, d), CFG), "job_steps")


def aged(spark: SparkSession, d: str) -> DataFrame:
    return ey.with_ages(ey.last_period(checks(spark, d), CFG), CFG)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled panel with the last-period attributes, as the history builds it."""
    rows = checks(spark, d)
    panel, *_ = panel_rows(rows, cfg=CFG)
    return ey.with_label(ey.with_ages(panel, CFG), CFG).drop("single")


def stepped(spark: SparkSession, d: str) -> DataFrame:
    return steps.with_steps(labelled(spark, d), ladder(spark, d), CFG)


def salaries(spark: SparkSession, d: str) -> DataFrame:
    return salary.summary(checks(spark, d), CFG)


def paid(spark: SparkSession, d: str) -> DataFrame:
    """Labelled panel with steps and salary statistics."""
    return salary.attach(stepped(spark, d), salaries(spark, d))


def eligible(spark: SparkSession, d: str) -> DataFrame:
    """Eligible rows with steps and clean categories."""
    return encode.normalise(stepped(spark, d).filter(el.is_eligible(CFG)), CFG)


def rolled(spark: SparkSession, d: str) -> DataFrame:
    return sf.roll_forward(sf.score_population(paid(spark, d), CFG), CFG)


def fallback(spark: SparkSession, d: str) -> Lookup:
    return settle_lookup(salary.fallback(salaries(spark, d), CFG), "fallback")


def history(spark: SparkSession, d: str, cfg: PolicyConfig = CFG) -> History:
    return build_history(facts(spark, d), trade.fiscal_calendar(spark, d), trade.job_steps(spark, d), cfg)


def both_frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both frames as the job writes them before it fits."""
    past = history(spark, d)
    fitted = frames.train_frame(past, CFG)
    return settle(fitted.frame, "train"), settle(frames.score_frame(past, fitted.means, CFG), "score")


def written_train(spark: SparkSession, d: str) -> DataFrame:
    return settle(frames.train_frame(history(spark, d), CFG).frame, "train")


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return modelling.bare_rows(written_train(spark, d), "model_rows", CFG).filter("is_train")


# -- sources and sinks --------------------------------------------------------


def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sink_parquet")
    io.write_parquet(aged(spark, d), path, partition_by=["FISCAL_YEAR"])
    return spark.read.parquet(path).select(*ID, "MAX_PP", "age", "service_year")


def sink_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sink_csv")
    io.write_csv(facts(spark, d), path)
    return io.read_csv(spark, path, schema.PAYROLL)


def spoilt_csv(spark: SparkSession, d: str) -> io.Parsed:
    """Payroll as CSV in which some fields hold line breaks and some numbers are no numbers, read back."""
    path = scratch_path(spark, "spoilt_csv")
    employee = F.col("EMPLOYEE_ID")
    text = {f.name: F.col(f.name).cast("string") for f in schema.PAYROLL.fields}
    text["JOB_CLASS_TITLE"] = F.when(employee % 13 == 0, F.concat("JOB_CLASS_TITLE", F.lit(chr(10) + "X"))).otherwise(F.col("JOB_CLASS_TITLE"))
    text["HW_TYPE_PAY"] = F.when(employee % 11 == 0, "12a").otherwise(text["HW_TYPE_PAY"])
    text["MOU"] = F.when(employee % 22 == 0, "7.5").when(employee % 3 == 0, F.concat(text["MOU"], F.lit(".0"))).otherwise(text["MOU"])
    io.write_csv(facts(spark, d).select(*[c.alias(n) for n, c in text.items()]), path)
    return io.parse_csv(spark, path, schema.PAYROLL, multi_line=True)


def csv_accepted(spark: SparkSession, d: str) -> DataFrame:
    return spoilt_csv(spark, d).rows


def csv_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Records set apart, by reason, and whether each names its file and holds its record."""
    found = spoilt_csv(spark, d).rejected
    named = F.col("file").contains("spoilt_csv") & F.col("record").contains("12a")
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.bool_and(named).alias("named"))


def frames_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """The scoring frame written as CSV and read back by its schema."""
    path = scratch_path(spark, "score_csv")
    io.write_csv(score_frame(spark, d), path)
    return io.read_csv(spark, path, schema.SCORE_FRAME)


def scan_step_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The step table, one row per job, title and grade, from the first sheet of a spreadsheet."""
    path = f"{scratch_path(spark, 'steps')}.xlsx"
    table = trade.job_steps(spark, d)
    write_sheets(path, [[table.columns, *map(tuple, table.toLocalIterator())], [["another", "sheet"]]])
    return sheet.read_sheet(spark, path, schema.JOB_STEPS)


# -- projections and filters --------------------------------------------------


def project_panel_cols(spark: SparkSession, d: str) -> DataFrame:
    return ey.regular(checks(spark, d), CFG).select(*schema.PANEL_KEYS, "PAYROLL_SEQUENCE")


def drop_scratch(spark: SparkSession, d: str) -> DataFrame:
    return salaries(spark, d).drop("HW_TYPE_PAY", "OT_TYPE_PAY")


def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = aged(spark, d)
    return rows.select(*forest.feature_columns(rows.columns))


def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).filter(in_list("MOU", CFG.supervisor_units)).select("EMPLOYEE_ID", "PAYROLL_SEQUENCE", "MOU")


def filter_year(spark: SparkSession, d: str) -> DataFrame:
    return aged(spark, d).filter(F.col("FISCAL_YEAR") == CFG.last_fiscal_year).select(*ID, "age")


def limit_head(spark: SparkSession, d: str) -> DataFrame:
    return aged(spark, d).orderBy(*ID).limit(5).select(*ID, "MAX_PP", "age", "service_year")


# -- joins --------------------------------------------------------------------


def attached(columns: Sequence[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = checks(spark, d)
        joined = ey.attach_last_period(ey.last_period(rows, CFG), rows, columns)
        return joined.select(*ID, "MAX_PP", *columns)

    return run


def join_last_period_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = checks(spark, d)
    joined = ey.attach_last_period(ey.last_period(rows, CFG), rows, ["JOB_CLASS_TITLE"])
    return joined.select(*ID, "MAX_PP", "JOB_CLASS_TITLE")


def join_salary_summary(spark: SparkSession, d: str) -> DataFrame:
    return salary.attach(labelled(spark, d), salaries(spark, d)).select(*ID, *schema.SALARY_STATS)


def join_step_dim(spark: SparkSession, d: str) -> DataFrame:
    joined = steps.attach_steps(labelled(spark, d), ladder(spark, d))
    return joined.select(*ID, "JOB_CLASS", "JOB_CLASS_TITLE", "PAY_GRADE", "HIGHEST_STEP")


def join_pension(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).filter(el.is_eligible(CFG)).drop("BIWEEKLY_RATE")
    table = el.pension_table(rows, ey.snapshot(facts(spark, d), ["BIWEEKLY_RATE"]), CFG)
    return el.attach_pension(rows, table).select(*ID, *el.PENSION)


def join_peer_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(labelled(spark, d), "labelled")
    peers = settle_lookup(el.peer_stats(rows, CFG.eligible_age, CFG.eligible_service), "peers")
    joined = el.attach_peers(rows.filter(el.is_eligible(CFG)), peers)
    return joined.select(*ID, "eligible_persent", "total_ecount")


def join_peer_stats_score(spark: SparkSession, d: str) -> DataFrame:
    rows = stepped(spark, d).withColumns({c: F.lit(None).cast("double") for c in schema.SALARY_STATS})
    rows = settle(rows, "stepped")
    last = rows.filter(F.col("FISCAL_YEAR") == CFG.last_fiscal_year)
    peers = settle_lookup(el.peer_stats(last, CFG.forward_age, CFG.forward_service), "peers")
    ahead = sf.roll_forward(sf.score_population(rows, CFG), CFG)
    return el.attach_peers(ahead, peers, by_year=False).select(*ID, "eligible_persent", "total_ecount")


def join_fallback_salary(spark: SparkSession, d: str) -> DataFrame:
    joined = salary.attach_fallback(labelled(spark, d), fallback(spark, d))
    return joined.select(*ID, *salary.FALLBACK_STATS)


def join_target_means(names: Sequence[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = settle(eligible(spark, d), "eligible")
        means = encode.TargetMeans.fit(rows, cfg=CFG)
        return means.apply(rows, names).select(*ID, *names)

    return run


def dropped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each rule drops from panel, training frame and scoring frame."""
    past = history(spark, d)
    fitted = frames.train_frame(past, CFG)
    return drops.report(past, fitted, frames.scored(past, fitted.means, CFG), CFG)


# -- what the joins multiply ---------------------------------------------------

STRICT = replace(CFG, snapshot_mode=snapshots.STRICT)


def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Attribute rows of every employee's last periods, and rows after the joins."""
    rows = checks(spark, d)
    return snapshots.multiplicities(ey.last_period(rows, CFG), rows)


def snapshot_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of the history, which counts before it joins."""
    return history(spark, d).report.frame(spark)


def snapshot_refused(spark: SparkSession, d: str) -> DataFrame:
    """Keys that strict mode refuses."""
    return snapshot_counts(spark, d).where(snapshots.multiplied())


def snapshot_strict(spark: SparkSession, d: str) -> DataFrame:
    """The panel with its attributes, every employee-year by one row or none at all."""
    rows = checks(spark, d)
    panel, *_ = panel_rows(rows, cfg=STRICT)
    return panel.select(*ID, "MAX_PP", *schema.SNAPSHOT, "MOU", "JOB_CLASS", "BIWEEKLY_RATE")


def train_frame_strict(spark: SparkSession, d: str) -> DataFrame:
    return frames.train_frame(history(spark, d, STRICT), STRICT).frame


# -- aggregations -------------------------------------------------------------


def agg_eligible_counts(spark: SparkSession, d: str) -> DataFrame:
    return el.eligible_counts(labelled(spark, d), CFG.eligible_age, CFG.eligible_service)


def agg_eligible_counts_fwd(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).filter(F.col("FISCAL_YEAR") == CFG.last_fiscal_year)
    return el.eligible_counts(rows, CFG.forward_age, CFG.forward_service)


def _flags_named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"0": "not_eligible", "1": "eligible"})


def pivot_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _flags_named(el.pivot_eligible(agg_eligible_counts(spark, d)))


def pivot_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    return _flags_named(el.pivot_eligible(agg_eligible_counts(spark, d)).fillna(0, ["0", "1"]))


def peer_share(spark: SparkSession, d: str) -> DataFrame:
    return el.peer_stats(labelled(spark, d), CFG.eligible_age, CFG.eligible_service)


def target_mean(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return encode.target_mean(eligible(spark, d), encode.TARGET_MEANS[name], name)

    return run


def target_mean_fallback(spark: SparkSession, d: str) -> DataFrame:
    return encode.mean_of_groups(target_mean("jclass_persent")(spark, d), "jclass_persent", CFG)


def target_means_all(spark: SparkSession, d: str) -> DataFrame:
    """Every key set of the one-pass fit, with its name."""
    means = encode.TargetMeans.fit(eligible(spark, d), cfg=CFG)
    name = F.coalesce(*[F.when(F.col("set_id") == i, n) for n, i in means.sets.items()])
    keys = [k for k in means.table.columns if k not in ("set_id", "target_mean")]
    return means.table.select(name.alias("mean_name"), *keys, "target_mean")


def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Missing values, extremes and mean of every payroll column."""
    return profile.column_summary(facts(spark, d)).select("column_name", "row_count", "nulls", "min", "mean", "max")


EXACT = ["column_name", "kind", "row_count", "nulls", "min", "mean", "max", "distinct", "top", "top_count"]


def exact_profile(of: Query) -> Query:
    """All of the summary but its quartiles, which SQL has no sketches for."""
    return lambda spark, d: profile.column_summary(of(spark, d)).select(*EXACT)


def quartile_ranks(of: Query) -> Query:
    """Whether every quartile's true rank is where the sketch promises it, threefold for a confidence near certainty."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = settle(of(spark, d), "profiled")
        errors = profile.rank_errors(rows, profile.column_summary(rows))
        return errors.select("column_name", "quantile", "known", (F.col("rank_error") <= 3 * profile.RANK_ERROR).alias("within"))

    return run


def with_fixed_prediction(spark: SparkSession, d: str) -> DataFrame:
    guess = (F.col("age") >= 60).cast("double").alias("prediction")
    return labelled(spark, d).select(F.col("retire").cast("double").alias("label"), guess)


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return forest.confusion(with_fixed_prediction(spark, d))


def fbeta(spark: SparkSession, d: str) -> DataFrame:
    return forest.fbeta(with_fixed_prediction(spark, d), CFG.betas)


# -- expressions --------------------------------------------------------------


def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select(
        "EMPLOYEE_ID",
        dates.parse_dmy("DATE_OF_BIRTH").alias("born"),
        dates.parse_dmy("ORIGINAL_HIRE_DATE").alias("hired"),
    )


def fix_birth_century(spark: SparkSession, d: str) -> DataFrame:
    return parse_dates(spark, d).select("EMPLOYEE_ID", dates.birth_date("born", CFG).alias("born"))


def fix_hire_century(spark: SparkSession, d: str) -> DataFrame:
    return parse_dates(spark, d).select("EMPLOYEE_ID", dates.hire_date("hired", CFG).alias("hired"))


def next_fy_start(spark: SparkSession, d: str) -> DataFrame:
    rows = ey.last_period(checks(spark, d), CFG)
    return rows.select(*ID, dates.next_year_start("FISCAL_YEAR", CFG).alias("next_fy_startdate"))


def text_concat(spark: SparkSession, d: str) -> DataFrame:
    number = (F.col("FISCAL_YEAR") - 2000 + 1).cast("string")
    return ey.last_period(checks(spark, d), CFG).select(*ID, F.concat(F.lit("01-JUL-"), number).alias("start_text"))


def cast_job(spark: SparkSession, d: str) -> DataFrame:
    rows = trade.job_steps(spark, d)
    return rows.select("JOB", F.col("JOB").try_cast("int").alias("job_number"), F.col("JOB_CLASS_TITLE").try_cast("int").alias("title_number"))


def flag_eligible(spark: SparkSession, d: str) -> DataFrame:
    return aged(spark, d).select(
        *ID,
        el.eligible_flag(CFG.eligible_age, CFG.eligible_service).alias("whether_eligible"),
        el.eligible_flag(CFG.forward_age, CFG.forward_service).alias("whether_eligible_next"),
    )


def label_retire(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("EMPLOYEE_ID", "PAYROLL_SEQUENCE", ey.retire_label(CFG).alias("retire"))


def flag_supervisor(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("EMPLOYEE_ID", "MOU", ey.supervisor_flag(CFG).alias("whether_supervisor"))


def step_default(spark: SparkSession, d: str) -> DataFrame:
    rows = steps.attach_steps(labelled(spark, d), ladder(spark, d))
    return rows.select(*ID, "JOB_CLASS", steps.step_default(CFG).alias("HIGHEST_STEP"))


def step_headroom(spark: SparkSession, d: str) -> DataFrame:
    rows = steps.attach_steps(labelled(spark, d), ladder(spark, d))
    rows = rows.withColumn("HIGHEST_STEP", steps.step_default(CFG))
    return steps.with_headroom(rows).select(*ID, "HIGHEST_STEP", "SALARY_STEP", "dif_step", "whether_highest")


def step_repair(spark: SparkSession, d: str) -> DataFrame:
    return stepped(spark, d).select(*ID, "HIGHEST_STEP", "SALARY_STEP", "dif_step", "whether_highest")


def retirement_factor(spark: SparkSession, d: str) -> DataFrame:
    return aged(spark, d).select(*ID, "age", "service_year", el.retirement_factor(CFG).alias("retirement_factor"))


def pension_estimate(spark: SparkSession, d: str) -> DataFrame:
    """This year's estimate, and the one with the rate grown by a year."""
    rows = labelled(spark, d).drop("BIWEEKLY_RATE").withColumn("retirement_factor", el.retirement_factor(CFG))
    rows = ey.attach_last_period(rows, facts(spark, d), ["BIWEEKLY_RATE"], how="inner")
    rate = F.col("BIWEEKLY_RATE")
    return rows.select(
        *ID,
        el.pension_amount(rate, CFG).alias("retirement_pension"),
        el.pension_amount(rate * CFG.rate_growth, CFG).alias("retirement_pension_next"),
    )


def paid_with_fallback(spark: SparkSession, d: str) -> tuple[DataFrame, Lookup]:
    """Panel and fallback over salary statistics that are computed once."""
    stats = settle(salaries(spark, d), "salaries")
    return salary.attach(stepped(spark, d), stats), settle_lookup(salary.fallback(stats, CFG), "fallback")


def impute_train(spark: SparkSession, d: str) -> DataFrame:
    return frames.train_base(history(spark, d), CFG).select(*ID, *schema.SALARY_STATS)


def impute_score(spark: SparkSession, d: str) -> DataFrame:
    panel, means = paid_with_fallback(spark, d)
    ahead = sf.roll_forward(sf.score_population(panel, CFG), CFG)
    return salary.impute_score(salary.attach_fallback(ahead, means), CFG).select(*ID, *schema.SALARY_STATS)


def normalise_categories(spark: SparkSession, d: str) -> DataFrame:
    columns = [name for name, _, _ in CFG.category_rules]
    return facts(spark, d).select("EMPLOYEE_ID", *[encode.normalised(c, CFG).alias(c) for c in columns])


def score_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Means of the earlier years, applied to the last one."""
    rows = settle(eligible(spark, d), "eligible")
    earlier = rows.filter(F.col("FISCAL_YEAR") < CFG.last_fiscal_year)
    means = encode.TargetMeans.fit(earlier, cfg=CFG)
    last = rows.filter(F.col("FISCAL_YEAR") == CFG.last_fiscal_year)
    return means.apply_unseen(last).select(*ID, *encode.TARGET_MEANS)


def union_score_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = sf.last_year_active(labelled(spark, d), CFG)
    first, second = rows.filter(el.is_eligible(CFG)), rows.filter(el.is_newly_eligible(CFG))
    return sf.append(first, second).select(*ID, "age", "service_year")


def hashed(column: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return labelled(spark, d).select(*ID, *encode.hashed_columns(column))

    return run


def hash_all(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text hashed once; the queries of single columns hash row by row."""
    rows = settle(labelled(spark, d).select(*ID, *encode.HASHED), "texts_of_rows")
    return encode.hash_encode(rows, encode.TextDictionary.of(rows)).select(*ID, *encode.HASHED_COLUMNS)


# -- model --------------------------------------------------------------------


def split_train_test(spark: SparkSession, d: str) -> DataFrame:
    return forest.with_split(aged(spark, d), CFG).select(*ID, "is_train")


def class_weight(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select(*ID, "retire", forest.class_weight(cfg=CFG).alias("weight"))


def rf_fit(forests: Sequence[forest.ForestParams]) -> Query:
    """Confusion counts of each fitted forest on its training and test rows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = modelling.model_rows(written_train(spark, d), "model_rows", CFG)
        found = []
        for params in forests:
            said = modelling.fit_rows(rows, params, CFG).predictions()
            counts = said.groupBy("is_train", F.col("label").cast("int").alias("label")).agg(
                *[F.count(F.when(F.col("prediction") == p, 1)).alias(f"predicted_{p}") for p in (0, 1)]
            )
            found.append(counts.select(F.lit(params.depth).alias("depth"), F.lit(params.features).alias("max_features"), *counts.columns))
        return reduce(DataFrame.unionByName, found)

    return run


def rf_predict_all(spark: SparkSession, d: str) -> DataFrame:
    """Prediction of every training-frame row, test rows included."""
    frame = written_train(spark, d)
    said = modelling.train(frame, forest.FINAL_FORESTS[0], CFG).predictions()
    return said.select(*frame.columns, "is_train", F.col("prediction").cast("int").alias("pred"))


def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    frame = written_train(spark, d)
    return forest.importances(spark, modelling.train(frame, forest.FINAL_FORESTS[0], CFG).model)


def rf_score(spark: SparkSession, d: str) -> DataFrame:
    train, score = both_frames(spark, d)
    rows = modelling.bare_rows(train, "model_rows", CFG)
    return modelling.fit_rows(rows, forest.FINAL_FORESTS[-1], CFG).score(score, CFG)


def agg_predicted_total(spark: SparkSession, d: str) -> DataFrame:
    return modelling.predicted_total(rf_score(spark, d))


def rf_fit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that every fitted forest has predicted, by split and label; the votes are left out."""
    counted = rf_fit(forest.FINAL_FORESTS)(spark, d)
    return counted.select("depth", "max_features", "is_train", "label", (F.col("predicted_0") + F.col("predicted_1")).alias("rows"))


def rf_predict_keys(spark: SparkSession, d: str) -> DataFrame:
    """Known rows with their split and label, and whether they were given a class."""
    said = rf_predict_all(spark, d)
    return said.select(*ID, "retire", "is_train", F.col("pred").isin(0, 1).alias("predicted"))


def rf_score_keys(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows of the coming year, and whether they were given a class."""
    return rf_score(spark, d).select(*ID, "age", "service_year", F.col("pred").isin(0, 1).alias("predicted"))


def predicted_total_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows, and whether the predicted total is the count of positive predictions among them."""
    scored = settle(rf_score(spark, d), "scored")
    counted = scored.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("pred") == 1).alias("positive"))
    total = modelling.predicted_total(scored).select("predicted_total").scalar()
    return counted.select("scored", F.equal_null(F.nullif("positive", F.lit(0)), F.nullif(total, F.lit(0))).alias("total_holds"))


def feature_names(spark: SparkSession, d: str) -> DataFrame:
    """The ranked features and the rows their forest was fitted on, and whether the importances are shares of one."""
    rows = modelling.model_rows(written_train(spark, d), "model_rows", CFG)
    model = modelling.fit_rows(rows, forest.FINAL_FORESTS[0], CFG).model
    found = forest.importances(spark, model)
    total = found.agg(F.sum("importance")).scalar()
    fitted = rows.filter("is_train").agg(F.count(F.lit(1))).scalar()
    share = (F.col("importance") >= 0) & (F.abs(total - 1) < 1e-9)
    return found.select("feature", fitted.alias("fit_rows"), share.alias("is_share"))


def grid_points(spark: SparkSession, d: str) -> DataFrame:
    """Every point of the whole search, with the most leaves that its bound allows a tree over the training rows."""
    rows = training_rows(spark, d).agg(F.count(F.lit(1)).alias("train_rows"))
    points = search.Grid.full(CFG.betas).points(spark).select(*search.POINT, "least", rows.scalar().alias("train_rows"))
    return points.withColumn("most_leaves", F.floor(F.col("train_rows") / F.col("least")))


def folds(spark: SparkSession, d: str) -> DataFrame:
    found = search.with_folds(training_rows(spark, d), CFG)
    return found.select(*ID, F.col("label").cast("int").alias("label"), "fold")


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    return folds(spark, d).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def searched(spark: SparkSession, d: str) -> search.Search:
    """The last stage of the search for beta 0.3, whole: every point, all trees and folds."""
    return search.search(training_rows(spark, d), search.Grid({0.3: forest.stages(0.3)[-1:]}), CFG)


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of every point, best first."""
    return searched(spark, d).points.drop("stage", "point").orderBy("rank")


def grid_results(spark: SparkSession, d: str) -> DataFrame:
    """The counts and the score of every fold of every point, beside the point's mean, spread and rank."""
    found = searched(spark, d)
    return found.folds.join(found.points.drop("folds"), search.POINT)


# -- whole frames -------------------------------------------------------------


def retire_rate_by_department(spark: SparkSession, d: str) -> DataFrame:
    """Checks to panel to label to eligible rows, by department."""
    rows = labelled(spark, d).filter(el.is_eligible(CFG))
    return rows.groupBy("FMS_DEPARTMENT_TITLE").agg(
        F.count(F.lit(1)).alias("employee_years"), F.avg("retire").alias("retire_rate")
    )


def train_frame(spark: SparkSession, d: str) -> DataFrame:
    return frames.train_frame(history(spark, d), CFG).frame


def score_frame(spark: SparkSession, d: str) -> DataFrame:
    past = history(spark, d)
    return frames.score_frame(past, frames.train_frame(past, CFG).means, CFG)


MEAN_QUERIES = {
    "target_mean_job": "jclass_persent",
    "target_mean_step": "CSTEP_persent",
    **{
        f"target_mean_{keys[0].lower()}": name
        for name, keys in encode.TARGET_MEANS.items()
        if len(keys) == 1
    },
}
HASH_QUERIES = {f"hash_{column.lower()}": column for column in encode.HASHED}


def _plain() -> dict[str, Query]:
    one_key = [n for n, k in encode.TARGET_MEANS.items() if len(k) == 1]
    two_keys = [n for n, k in encode.TARGET_MEANS.items() if len(k) == 2]
    return {
        "retire_rate_by_department": retire_rate_by_department,
        "train_frame": train_frame,
        "score_frame": score_frame,
        # sources and sinks
        "scan_payroll": facts,
        "scan_fiscal_calendar": trade.fiscal_calendar,
        "scan_step_dim": trade.job_steps,
        "scan_step_sheet": scan_step_sheet,
        "sink_roundtrip": sink_roundtrip,
        "sink_csv_roundtrip": sink_csv_roundtrip,
        "csv_accepted": csv_accepted,
        "csv_rejected": csv_rejected,
        "frames_from_csv": frames_from_csv,
        # projections and filters
        "project_panel_cols": project_panel_cols,
        "drop_scratch": drop_scratch,
        "feature_columns": feature_columns,
        "filter_regular": lambda s, d: ey.regular(facts(s, d), CFG).select("EMPLOYEE_ID", "PAYROLL_SEQUENCE", "CHECK_TYPE"),
        "filter_active_regular": lambda s, d: salary.active_regular(facts(s, d), CFG).select("EMPLOYEE_ID", "PAYROLL_SEQUENCE", "BIWEEKLY_RATE"),
        "filter_not_null": lambda s, d: facts(s, d).filter(F.col("ORIGINAL_HIRE_DATE").isNotNull()).select("EMPLOYEE_ID", "ORIGINAL_HIRE_DATE"),
        "filter_eligible": lambda s, d: aged(s, d).filter(el.is_eligible(CFG)).select(*ID, "age", "service_year"),
        "filter_newly_eligible": lambda s, d: aged(s, d).filter(el.is_newly_eligible(CFG)).select(*ID, "age", "service_year"),
        "filter_ambiguous_jobs": lambda s, d: steps.unambiguous(trade.job_steps(s, d), CFG),
        "filter_in_list": filter_in_list,
        "filter_year": filter_year,
        "limit_head": limit_head,
        # joins
        "join_fiscal_year": lambda s, d: checks(s, d).select("EMPLOYEE_ID", "PAYROLL_SEQUENCE", "FISCAL_YEAR"),
        "join_last_period": attached(schema.SNAPSHOT),
        "join_last_period_fanout": fanned(join_last_period_fanout),
        "join_last_period_mou": attached(["MOU"]),
        "join_last_period_jobclass": attached(["JOB_CLASS"]),
        "join_last_period_rate": attached(["BIWEEKLY_RATE"]),
        "join_salary_summary": join_salary_summary,
        "join_step_dim": join_step_dim,
        "join_pension": join_pension,
        "join_peer_stats": join_peer_stats,
        "join_peer_stats_score": join_peer_stats_score,
        "join_fallback_salary": join_fallback_salary,
        "join_target_means_1": join_target_means(one_key),
        "join_target_means_2": join_target_means(two_keys),
        # what the joins multiply
        "dropped_rows": dropped_rows,
        "snapshot_counts": snapshot_counts,
        "snapshot_report": snapshot_report,
        "snapshot_refused": snapshot_refused,
        "snapshot_strict": snapshot_strict,
        "train_frame_strict": train_frame_strict,
        # aggregations
        "agg_last_period": lambda s, d: ey.last_period(checks(s, d), CFG),
        "agg_salary_summary": salaries,
        "agg_mean_of_means": lambda s, d: salary.fallback(salaries(s, d), CFG),
        "agg_eligible_counts": agg_eligible_counts,
        "agg_eligible_counts_fwd": agg_eligible_counts_fwd,
        "pivot_eligible": pivot_eligible,
        "pivot_fill_zero": pivot_fill_zero,
        **{key: target_mean(name) for key, name in MEAN_QUERIES.items()},
        "target_mean_fallback": target_mean_fallback,
        "target_means_all": target_means_all,
        "distinct_snapshot": lambda s, d: ey.snapshot(facts(s, d), schema.SNAPSHOT),
        "profile_nulls": profile_nulls,
        "profile_payroll": exact_profile(facts),
        "profile_score_frame": exact_profile(score_frame),
        "profile_payroll_ranks": quartile_ranks(facts),
        "profile_score_frame_ranks": quartile_ranks(score_frame),
        "confusion_matrix": confusion_matrix,
        "fbeta": fbeta,
        # expressions
        "parse_dates": parse_dates,
        "fix_birth_century": fix_birth_century,
        "fix_hire_century": fix_hire_century,
        "next_fy_start": next_fy_start,
        "age_service": lambda s, d: aged(s, d).select(*ID, "age", "service_year"),
        "text_concat": text_concat,
        "cast_job": cast_job,
        "ratio_overtime": lambda s, d: salaries(s, d).select(*schema.SALARY_KEYS, "OT_TYPE_PAY_PERSENT"),
        "rate_estimate": lambda s, d: salaries(s, d).select(*schema.SALARY_KEYS, "RATE_PP_ESTIMATE"),
        "peer_share": peer_share,
        "roll_forward": lambda s, d: rolled(s, d).select(*ID, "age", "service_year"),
        "roll_step": lambda s, d: rolled(s, d).select(*ID, "SALARY_STEP", "HIGHEST_STEP", "dif_step", "whether_highest"),
        "roll_rate": lambda s, d: rolled(s, d).select(*ID, "RATE_PP", "RATE_PP_ESTIMATE"),
        "label_retire": label_retire,
        "flag_eligible": flag_eligible,
        "flag_supervisor": flag_supervisor,
        "step_default": step_default,
        "step_headroom": step_headroom,
        "step_repair": step_repair,
        "retirement_factor": retirement_factor,
        "pension_estimate": pension_estimate,
        "impute_train": impute_train,
        "impute_score": impute_score,
        "normalise_categories": normalise_categories,
        "score_unseen": score_unseen,
        "union_score_frame": union_score_frame,
        # hashing and model
        **{key: hashed(column) for key, column in HASH_QUERIES.items()},
        "hash_all": hash_all,
        "split_train_test": split_train_test,
        "class_weight": class_weight,
        "rf_fit": rf_fit(forest.FINAL_FORESTS[-1:]),
        "rf_fit_deep": rf_fit(forest.FINAL_FORESTS[:-1]),
        "rf_predict_all": rf_predict_all,
        "feature_importance": feature_importance,
        "rf_score": rf_score,
        "agg_predicted_total": agg_predicted_total,
        "rf_fit_rows": rf_fit_rows,
        "rf_predict_keys": rf_predict_keys,
        "rf_score_keys": rf_score_keys,
        "predicted_total_bounds": predicted_total_bounds,
        "feature_names": feature_names,
        "grid_points": grid_points,
        "folds": folds,
        "fold_sizes": fold_sizes,
        "grid_search": grid_search,
        "grid_results": grid_results,
    }


def queries() -> dict[str, Query]:
    found = _plain()
    found |= {f"{name}_fanout": fanned(found[name]) for name in FAN_OUT_TWINS}
    return {name: rounded(q, ROUNDED[name]) if name in ROUNDED else q for name, q in found.items()}
