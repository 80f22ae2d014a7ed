"""Day-month-year text, century repair, fiscal-year start and whole years."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenurelens.config import PolicyConfig
from tenurelens.functions.nullsafe import _column


# tried in turn: months by name or number, years of two or four digits
SPELLINGS = ("d-MMM-yy", "d-MMM-yyyy", "d-M-yy", "d-M-yyyy", "d-MMMM-yy", "d-MMMM-yyyy")


def parse_dmy(text: Column | str) -> Column:
    """``07-JUL-55``, ``7/7/1955`` or ``7 July 1955`` to a date; anything unreadable is NULL."""
    usual = F.try_to_date(_column(text), SPELLINGS[0])
    plain = F.regexp_replace(F.trim(_column(text)), r"[\s/.,-]+", "-")
    return F.coalesce(usual, *[F.try_to_date(plain, s) for s in SPELLINGS])


def into_century(date: Column | str, century: int) -> Column:
    """Same day in ``century``; 29 February falls back to the 28th."""
    date = _column(date)
    target = F.pmod(F.year(date), F.lit(100)) + century
    return F.add_months(date, (target - F.year(date)) * 12)


def birth_date(date: Column | str, cfg: PolicyConfig = PolicyConfig()) -> Column:
    return into_century(date, cfg.birth_century)


def hire_date(date: Column | str, cfg: PolicyConfig = PolicyConfig()) -> Column:
    date = _column(date)
    late = F.year(date) > cfg.latest_hire_year
    return F.when(late, into_century(date, cfg.birth_century)).otherwise(date)


def next_year_start(fiscal_year: Column | str, cfg: PolicyConfig = PolicyConfig()) -> Column:
    month, day = cfg.year_start
    return F.make_date(_column(fiscal_year) + 1, F.lit(month), F.lit(day))


def whole_years(end: Column | str, start: Column | str, cfg: PolicyConfig = PolicyConfig()) -> Column:
    """Full blocks of 365 days, not calendar years."""
    days = F.datediff(_column(end), _column(start))
    return F.floor(days / F.lit(cfg.days_per_year)).cast("int")
