"""The job started from frames in CSV."""

from pathlib import Path

from checks import queries as q, trade_payroll as trade
from tenurelens import __main__ as job
from tenurelens.sources import io, workspace
from tests.conftest import SMALL


def test_job_from_csv_frames(spark, tmp_path, rows):
    train, score = q.both_frames(spark, SMALL)
    for name, frame in (("train", train), ("score", score)):
        io.write_csv(frame, str(tmp_path / name))
    header = next((tmp_path / "train").glob("part-*.csv")).read_text().split("\n")[0]
    (tmp_path / "train" / "more.csv").write_text(f"{header}\n1,2,3\n")
    before = set(Path(workspace.shared_folder(spark)).glob("tenurelens/run-*"))
    paths = {n: str(tmp_path / n) for n in ("train", "score", "rejected", "out")}
    job.main([*(x for n, p in paths.items() for x in (f"--{n}", p)), "--last-fiscal-year", str(trade.LAST_FISCAL_YEAR)])
    assert set(Path(workspace.shared_folder(spark)).glob("tenurelens/run-*")) == before

    rejected = spark.read.parquet(f"{paths['rejected']}/train").collect()
    assert [(r["record"], r["reason"]) for r in rejected] == [("1,2,3", "wrong number of fields")]
    assert spark.read.parquet(f"{paths['rejected']}/score").count() == 0
    out = {n: spark.read.parquet(f"{paths['out']}/{n}") for n in ("train", "score", "predictions", "predicted_total")}
    assert rows(out["train"].select(*train.columns)) == rows(train) and rows(out["score"].select(*score.columns)) == rows(score)
    assert out["predictions"].count() == train.count()
    assert out["predicted_total"].first()[0] == q.agg_predicted_total(spark, SMALL).first()[0]
