"""Spreadsheets read by sheet number, and the cells they may hold."""

import zipfile

import pytest

from checks import queries as q, sheets, trade_payroll as trade
from pyspark.sql.types import StringType, StructField, StructType

from tenurelens import __main__ as job
from tenurelens.sources import sheet
from tenurelens.sources.schema import JOB_STEPS
from tests.conftest import SMALL

HEADER = ["JOB", "more", "JOB_CLASS_TITLE", "PAY_GRADE", "HIGHEST_STEP"]


def test_columns_by_name_of_one_sheet(spark, tmp_path, rows):
    first = [HEADER, ["10", "x", "CLERK & <CO>", 0, 5], [20, None, " ", "Z", None], [], [30, "", "NA", None, 7.0]]
    second = [["HIGHEST_STEP", "PAY_GRADE", "JOB_CLASS_TITLE", "JOB"], [1, "a", "b", "c"]]
    sheets.write_sheets(str(tmp_path / "steps.xlsx"), [first, second])
    for path in (tmp_path / "steps.xlsx", tmp_path):
        found = sheet.read_sheet(spark, str(path), JOB_STEPS)
        assert found.schema.fieldNames() == JOB_STEPS.fieldNames()
        assert rows(found) == sorted([("10", "CLERK & <CO>", "0", 5), ("20", " ", "Z", None), ("30", None, None, 7)], key=repr)
    assert rows(sheet.read_sheet(spark, f"file:{tmp_path}/steps.xlsx", JOB_STEPS, sheet=2)) == [("c", "b", "a", 1)]
    assert spark.read.format(sheet.NAME).load(str(tmp_path)).columns == HEADER
    with pytest.raises(Exception, match="no sheet 3 of 2"):
        sheet.read_sheet(spark, str(tmp_path), JOB_STEPS, sheet=3).collect()
    with pytest.raises(Exception, match="no column GONE"):
        sheet.read_sheet(spark, str(tmp_path), StructType([StructField("GONE", StringType())])).collect()


def test_cells_of_every_kind(tmp_path):
    """Inline and formatted strings, formulas, booleans, errors, fractions, cells without a reference."""
    cells = (
        '<c r="B1" t="inlineStr"><is><r><t>a</t></r><r><t> b</t></r><rPh><t>no</t></rPh></is></c><c t="str"><f>X()</f><v>c</v></c>'
        '<c r="AA1" t="b"><v>1</v></c><c r="AB1" t="e"><v>#N/A</v></c><c r="AC1"><v>0.5</v></c><c r="AD1"><v>1E3</v></c><c r="AE1"/>'
    )
    path = tmp_path / "cells.xlsx"
    sheets.write_sheets(str(path), [[]])
    with zipfile.ZipFile(path) as old:
        parts = {n: old.read(n).decode() for n in old.namelist() if n != "xl/sharedStrings.xml"}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace("<sheetData>", f"<sheetData><row>{cells}</row>")
    with zipfile.ZipFile(path, "w") as new:
        for name, text in parts.items():
            new.writestr(name, text)
    (found,) = sheet.rows(str(path))
    assert found[:3] == [None, "a b", "c"] and found[26:] == ["TRUE", None, "0.5", "1000", None] and len(found) == 31


def test_the_job_reads_a_sheet_of_steps(spark, tmp_path, rows):
    table = trade.job_steps(spark, SMALL)
    sheets.write_sheets(str(tmp_path / "s.xlsx"), [[table.columns, *map(tuple, table.collect())]])
    assert rows(job.Files(spark).read("steps", str(tmp_path / "s.xlsx"), JOB_STEPS)) == rows(table)
    assert rows(q.scan_step_sheet(spark, SMALL)) == rows(table)
