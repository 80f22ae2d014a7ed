"""The whole job on payroll files.

    spark-submit --py-files ... -m tenurelens --payroll P --calendar C --steps S --out DIR

Inputs are CSV files with a header, or parquet where the path ends in .parquet, or the first sheet of
a spreadsheet where it ends in .xlsx.
``DIR`` receives train, score, predictions, confusion, importances and total as
parquet, and the predictions of the coming year as CSV. ``--frames DIR`` starts from the
train and score frames of an earlier run instead of payroll, ``--train T --score S`` from such
frames in CSV or parquet. Records that don't parse fail the job; with ``--rejected DIR`` they are
written there, with file and reason, and the job goes on. ``--multi-line`` allows line breaks in quoted fields. ``--tune`` also writes
the whole search, all points of all stages for each beta; run again after a stop, it fits only
what ``finished_fits`` lacks. ``--strict`` refuses payroll with several
attribute rows in an employee's last period, ``--fan-out-limit`` payroll that they multiply too far;
``snapshot_report`` says how far, ``dropped_rows`` how many rows each rule has dropped.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tenurelens.config import PolicyConfig
from tenurelens.operators import forest, snapshots
from tenurelens.plans import drops, frames, modelling
from tenurelens.plans.history import build_history
from tenurelens.sources import io, schema
from tenurelens.sources.sheet import SUFFIX, read_sheet
from tenurelens.sources.workspace import run_folder


@dataclass(frozen=True)
class Files:
    """How inputs are read: ``rejected`` names a folder for records that don't parse, which otherwise fail the job."""

    spark: SparkSession
    rejected: str | None = None
    multi_line: bool = False

    def read(self, name: str, path: str, fields: T.StructType) -> DataFrame:
        if path.rstrip("/").endswith(".parquet"):
            return io.read_parquet(self.spark, path, fields)
        if path.rstrip("/").endswith(SUFFIX):
            return read_sheet(self.spark, path, fields)
        if self.rejected is None:
            return io.read_csv(self.spark, path, fields, self.multi_line)
        parsed = io.parse_csv(self.spark, path, fields, self.multi_line)
        io.write_parquet(parsed.rejected, f"{self.rejected}/{name}")
        return parsed.rows


def run(spark: SparkSession, files: Files, payroll: str, calendar: str, steps: str, out: str, cfg: PolicyConfig, tune: bool = False) -> None:
    history = build_history(
        files.read("payroll", payroll, schema.PAYROLL),
        files.read("calendar", calendar, schema.FISCAL_CALENDAR),
        files.read("steps", steps, schema.JOB_STEPS),
        cfg,
    )
    io.write_parquet(history.report.frame(spark), f"{out}/snapshot_report")
    fitted = frames.train_frame(history, cfg)
    scored = frames.scored(history, fitted.means, cfg)
    io.write_parquet(drops.report(history, fitted, scored, cfg), f"{out}/dropped_rows")
    # the results are the tables that the model reads
    train, score = io.written(fitted.frame, f"{out}/train"), io.written(scored.frame, f"{out}/score")
    model(spark, train, score, out, cfg, tune)


def model(spark: SparkSession, train: DataFrame, score: DataFrame, out: str, cfg: PolicyConfig, tune: bool = False) -> None:
    """The first forest predicts the rows it knows and ranks features; the last one predicts the coming year."""
    trained = modelling.train(train, forest.FINAL_FORESTS[0], cfg)
    said = trained.predictions()
    coming = modelling.fit_rows(trained.rows, forest.FINAL_FORESTS[-1], cfg).score(score, cfg)
    if tune:
        found = modelling.tune(trained.rows, cfg.betas, cfg, folder=f"{out}/finished_fits")
        io.write_parquet(found.folds, f"{out}/search_folds")
        io.write_parquet(found.points, f"{out}/search_points")

    known = said.select(*train.columns, "is_train", F.col("prediction").cast("int").alias("pred"))
    io.write_parquet(known, f"{out}/predictions")
    for name, part in (("train", said.filter("is_train")), ("test", said.filter("not is_train"))):
        io.write_parquet(forest.confusion(part), f"{out}/confusion_{name}")
    io.write_parquet(forest.importances(spark, trained.model), f"{out}/importances")
    io.write_parquet(modelling.predicted_total(coming), f"{out}/predicted_total")
    io.write_csv(coming, f"{out}/next_year_csv")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tenurelens", description="Retirement model from payroll history")
    for name in ("payroll", "calendar", "steps", "train", "score", "frames", "rejected"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--multi-line", action="store_true")
    parser.add_argument("--out", required=True)
    parser.add_argument("--tune", action="store_true")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--fan-out-limit", type=float)
    parser.add_argument("--last-fiscal-year", type=int, default=PolicyConfig.last_fiscal_year)
    args = parser.parse_args(argv)
    if args.frames:
        args.train, args.score = (f"{args.frames}/{name}" for name in ("train", "score"))
    if not (args.train and args.score) and not (args.payroll and args.calendar and args.steps):
        parser.error("give --payroll, --calendar and --steps, or --train and --score, or --frames")
    spark = SparkSession.builder.appName("tenurelens").getOrCreate()
    cfg = replace(
        PolicyConfig(),
        last_fiscal_year=args.last_fiscal_year,
        snapshot_mode=snapshots.STRICT if args.strict else snapshots.LITERAL,
        fan_out_limit=args.fan_out_limit,
    )
    with run_folder(spark):
        _start(args, Files(spark, args.rejected, args.multi_line), cfg)


def _start(args: argparse.Namespace, files: Files, cfg: PolicyConfig) -> None:
    """The part of the job that the given inputs ask for."""
    spark = files.spark
    if args.frames:
        # written by an earlier run
        train, score = io.read_parquet(spark, args.train, schema.TRAIN_FRAME), io.read_parquet(spark, args.score, schema.SCORE_FRAME)
    elif args.train:
        # other files are typed once
        train = io.written(files.read("train", args.train, schema.TRAIN_FRAME), f"{args.out}/train")
        score = io.written(files.read("score", args.score, schema.SCORE_FRAME), f"{args.out}/score")
    else:
        run(spark, files, args.payroll, args.calendar, args.steps, args.out, cfg, args.tune)
        return
    model(spark, train, score, args.out, cfg, args.tune)


if __name__ == "__main__":
    main()
