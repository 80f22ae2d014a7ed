"""Business rules as parameters. Nothing else in the library holds a constant."""

from __future__ import annotations

from dataclasses import dataclass, field


# Category spellings, job codes, pay-step ceilings, retirement
# factors and rates that results depend on.
@dataclass(frozen=True)
class PolicyConfig:
    # payroll vocabulary
    regular_check: str = "Regular"
    active_status: str = "Active"
    retired_reason: str = "Retired/Pensioned"

    # calendar
    year_start: tuple[int, int] = (7, 1)
    days_per_year: int = 365
    birth_century: int = 1900
    latest_hire_year: int = 2018
    last_fiscal_year: int = 2018

    # retirement eligibility; the forward pair is one year lower
    eligible_age: int = 55
    eligible_service: int = 10
    forward_age: int = 54
    forward_service: int = 9

    # pension: rate * 26 / 12 * service * factor * accrual
    pays_per_year: int = 26
    months_per_year: int = 12
    accrual: float = 0.0216
    full_factor_service: int = 30
    retirement_factors: tuple[tuple[int, float], ...] = (
        (55, 0.925),
        (56, 0.94),
        (57, 0.955),
        (58, 0.97),
        (59, 0.985),
    )

    # one year ahead
    rate_growth: float = 1.02

    # bargaining units whose members supervise
    supervisor_units: tuple[int, ...] = (12, 13, 16, 17, 19, 20, 22, 25, 32, 36, 39, 63)

    # highest step when the step table has none, by job class
    step_defaults: tuple[tuple[int, tuple[int, ...]], ...] = (
        (0, (3766, 5113)),
        (15, (1790, 1960, 2340, 3183, 7209, 7211, 7213, 7214)),
        (5, (3198, 7294)),
        (11, (1576,)),
    )
    step_default_else: int = 12

    # (title, grade) rows of the step table with two ceilings; grade None = any
    ambiguous_jobs: tuple[tuple[str, str | None], ...] = (
        ("MUNICIPAL POLICE OFFICER III", None),
        ("MACHINIST SUPERVISOR", "0"),
        ("SUPT OF OPERATIONS I", "1"),
        ("CONSTR INSPECTOR", "Z"),
        ("SR CONSTR INSPECTOR", "A"),
        ("SR CONSTR INSPECTOR", "X"),
    )

    # column -> (spellings, replacement); exact match, no trimming
    category_rules: tuple[tuple[str, tuple[str, ...], str], ...] = (
        ("WORK_SCHEDULE", ("N/A", "Variable", " "), "Other"),
        ("ETHNICITY", ("Unknown", ""), "Other"),
        ("MARITAL_STATUS", ("",), "Unknown"),
    )

    # several attribute rows in a last period: "literal" multiplies as the joins do, "strict"
    # refuses; a limit refuses more rows to an employee-year in literal mode, too
    snapshot_mode: str = "literal"
    fan_out_limit: float | None = None

    # sums run in fixed point, finer than amounts of money and hours need, so that a
    # result does not depend on the order in which tasks add up: decimals of pay and
    # hours, of their group means, of shares
    sum_decimals: int = 10
    mean_decimals: int = 10
    share_decimals: int = 15

    # model
    split_seed: int = 82
    train_percent: int = 80
    class_weights: tuple[tuple[int, float], ...] = ((0, 1.0), (1, 5.0))
    forest_seed: int = 10
    missing_feature: float = -1.0
    # what an infinite feature becomes; finite values stay
    infinite_feature: float = 1e18
    # a seeded fit depends on the layout of its rows, so it has a size of its own
    fit_partitions: int = 32
    folds: int = 5
    betas: tuple[float, ...] = field(default=(0.5, 0.3))
