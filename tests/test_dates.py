"""Date text, century repair and whole years."""

from datetime import date

import pytest

from tenurelens.functions import dates


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column("x")).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("15-MAR-55", date(2055, 3, 15)),
        ("15-Mar-99", date(2099, 3, 15)),
        ("7-JUL-01", date(2001, 7, 7)),
        ("29-FEB-00", date(2000, 2, 29)),
        ("31-FEB-01", None),
        ("", None),
        ("soon", None),
        (None, None),
    ],
)
def test_parse(spark, text, expected):
    assert one(spark, text, dates.parse_dmy) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("15-MAR-55", date(1955, 3, 15)), ("29-FEB-00", date(1900, 2, 28)), ("01-JAN-19", date(1919, 1, 1))],
)
def test_birth_century(spark, text, expected):
    assert one(spark, text, lambda c: dates.birth_date(dates.parse_dmy(c))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("01-JAN-18", date(2018, 1, 1)),
        ("01-JAN-19", date(1919, 1, 1)),
        ("31-DEC-75", date(1975, 12, 31)),
        ("29-FEB-00", date(2000, 2, 29)),
    ],
)
def test_hire_century(spark, text, expected):
    assert one(spark, text, lambda c: dates.hire_date(dates.parse_dmy(c))) == expected


def test_year_start_and_whole_years(spark):
    df = spark.createDataFrame([(2018, date(1960, 7, 1)), (None, None)], "fy int, born date")
    start = dates.next_year_start("fy")
    first, second = df.select(start, dates.whole_years(start, "born")).collect()
    # 21549 days are 59 blocks of 365, although the 59th birthday is that very day
    assert tuple(first) == (date(2019, 7, 1), 59)
    assert tuple(second) == (None, None)


def test_whole_years_count_blocks_of_365_days(spark):
    df = spark.createDataFrame([(date(2019, 7, 1), date(2009, 7, 3)), (date(2019, 7, 1), date(2009, 7, 4))], "a date, b date")
    assert [r[0] for r in df.select(dates.whole_years("a", "b")).collect()] == [10, 9]


def test_other_spellings(spark):
    texts = ["07-JUL-55", "07-JUL-1955", "7/7/1955", "07-07-55", "7 July 1955", " 7.jul.55 ", "7-13-55", "x"]
    from tenurelens.functions.dates import birth_date, parse_dmy

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(birth_date(parse_dmy("t")).alias("d")).collect()
    assert [str(r.d) for r in rows] == ["1955-07-07"] * 6 + ["None"] * 2
