"""The same results in plain SQL over the given tables, for DuckDB.

``CTES`` holds the shared relations in the order they build on each other; a
query names the last one it reads and gets every relation up to it.
"""

from __future__ import annotations

import re

DAY = "strptime({0}, '%d-%b-%y')"


OUTPUT_DECIMALS = 8


def strict_sum(c: str) -> str:
    return f"case when count({c}) = count(*) then fsum({c}) end"


def strict_avg(c: str) -> str:
    return f"case when count({c}) = count(*) then fsum({c}) / count(*) end"


def ieee_div(a: str, b: str) -> str:
    return (
        f"case when {b} = 0 then case when {a} > 0 then 'Infinity'::double "
        f"when {a} < 0 then '-Infinity'::double end else {a} / {b} end"
    )


SNAPSHOT = (
    "FMS_DEPARTMENT_TITLE, JOB_CLASS_TITLE, PAY_GRADE, WORK_SCHEDULE, SALARY_STEP, "
    "RETIREMENT_PENSION_PLAN, ETHNICITY, GENDER, MARITAL_STATUS, JOB_STATUS, SEPARATION_REASON"
)
STATS = ["RATE_PP", "HW_HOURS_PP", "OT_HOURS_PP", "OT_TYPE_PAY_PERSENT", "RATE_PP_ESTIMATE"]
PANEL = (
    "FISCAL_YEAR, EMPLOYEE_ID, DATE_OF_BIRTH, ORIGINAL_HIRE_DATE, MAX_PP, next_fy_startdate, age, service_year, "
    "FMS_DEPARTMENT_TITLE, JOB_CLASS_TITLE, PAY_GRADE, WORK_SCHEDULE, SALARY_STEP, RETIREMENT_PENSION_PLAN, "
    "ETHNICITY, GENDER, MARITAL_STATUS, retire, RATE_PP, HW_HOURS_PP, OT_HOURS_PP, OT_TYPE_PAY_PERSENT, "
    "RATE_PP_ESTIMATE, MOU, whether_supervisor, JOB_CLASS, HIGHEST_STEP, dif_step, whether_highest"
)
TRAIN = PANEL + ", retirement_factor, retirement_pension, eligible_persent, total_ecount"
SCORE = ", ".join(
    c
    for c in TRAIN.split(", ")
    if c not in ("DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE", "MAX_PP", "retire", "JOB_CLASS")
)
MEANS = {
    "WORK_SCHEDULE_persent": ["WORK_SCHEDULE"],
    "RETIREMENT_PENSION_PLAN_persent": ["RETIREMENT_PENSION_PLAN"],
    "ETHNICITY_persent": ["ETHNICITY"],
    "GENDER_persent": ["GENDER"],
    "MARITAL_STATUS_persent": ["MARITAL_STATUS"],
    "MOU_persent": ["MOU"],
    "HSTEP_persent": ["HIGHEST_STEP"],
    "jclass_persent": ["FMS_DEPARTMENT_TITLE", "JOB_CLASS_TITLE"],
    "CSTEP_persent": ["HIGHEST_STEP", "SALARY_STEP"],
}
# Unit codes, retirement factors and pay-step ceilings, as in the rules checked.
SUPERVISORS = "12, 13, 16, 17, 19, 20, 22, 25, 32, 36, 39, 63"
PEER_KEYS = "FISCAL_YEAR, FMS_DEPARTMENT_TITLE, JOB_CLASS_TITLE"


def facts(title: str, rate: str) -> str:
    phase = "(o_custkey * 31 + year(o_orderdate) * 12 + month(o_orderdate)) % 7"
    born = "date '1930-01-01' + cast((o_custkey * 7919) % 14610 as int)"
    hired = (
        "case when o_custkey % 37 = 0 then null "
        "else date '1965-01-01' + cast((o_custkey * 104729) % 10950 as int) end"
    )
    return f"""
    select o_custkey as EMPLOYEE_ID,
      cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as PAYROLL_SEQUENCE,
      case when l_returnflag = 'R' then 'Adjustment' else 'Regular' end as CHECK_TYPE,
      upper(strftime({born}, '%d-%b-%y')) as DATE_OF_BIRTH,
      upper(strftime({hired}, '%d-%b-%y')) as ORIGINAL_HIRE_DATE,
      c_mktsegment as FMS_DEPARTMENT_TITLE,
      {title} as JOB_CLASS_TITLE,
      cast(case o_custkey % 17 when 0 then 3766 when 1 then 5113 when 2 then 1790 when 3 then 3198
           when 4 then 7294 when 5 then 1576 else 1000 + o_custkey % 17 end as int) as JOB_CLASS,
      case when o_custkey % 5 = 4 then 'Z' else cast(o_custkey % 5 as varchar) end as PAY_GRADE,
      case o_custkey % 6 when 0 then 'N/A' when 1 then ' ' when 2 then 'Variable'
           else concat('WS', cast(o_custkey % 6 as varchar)) end as WORK_SCHEDULE,
      cast(1 + (o_custkey % 4) + 2 * (year(o_orderdate) - 1995) as int) as SALARY_STEP,
      concat('PLAN', cast(o_custkey % 3 as varchar)) as RETIREMENT_PENSION_PLAN,
      case o_custkey % 5 when 0 then '' when 1 then 'Unknown'
           else concat('E', cast(o_custkey % 5 as varchar)) end as ETHNICITY,
      case when o_custkey % 2 = 0 then 'F' else 'M' end as GENDER,
      case o_custkey % 4 when 0 then '' when 1 then 'Single' else 'Married' end as MARITAL_STATUS,
      case when {phase} < 5 then 'Active' else 'Separated' end as JOB_STATUS,
      case {phase} when 5 then 'Retired/Pensioned' when 6 then 'Resigned' end as SEPARATION_REASON,
      nullif(c_nationkey, 7) as MOU,
      {rate} as BIWEEKLY_RATE,
      case when l_quantity = 50 then null else l_quantity end as HW_TYPE_HOURS,
      l_discount * 100 as OT_TYPE_HOURS,
      case when o_custkey % 29 = 0 then cast(0 as double) else l_extendedprice end as HW_TYPE_PAY,
      case when o_custkey % 58 = 0 then cast(0 as double) else l_extendedprice * l_discount end as OT_TYPE_PAY
    from lineitem join orders on l_orderkey = o_orderkey
      join customer on o_custkey = c_custkey join part on l_partkey = p_partkey"""


TITLE = (
    "case o_custkey % 17 when 14 then 'MACHINIST SUPERVISOR' when 15 then 'MUNICIPAL POLICE OFFICER III' "
    "when 16 then 'CONSTR INSPECTOR' else concat('JC', cast(o_custkey % 17 as varchar)) end"
)

HEADROOM = """HIGHEST_STEP - SALARY_STEP as dif_step,
      case when HIGHEST_STEP = SALARY_STEP then 1 else 0 end as whether_highest"""

FACTOR = """case when service_year < 30 then case age when 55 then 0.925 when 56 then 0.94 when 57 then 0.955
      when 58 then 0.97 when 59 then 0.985 else 1 end else 1 end::double"""

NORMAL = """replace (
      case when WORK_SCHEDULE in ('N/A', 'Variable', ' ') then 'Other' else WORK_SCHEDULE end as WORK_SCHEDULE,
      case when ETHNICITY in ('Unknown', '') then 'Other' else ETHNICITY end as ETHNICITY,
      case when MARITAL_STATUS = '' then 'Unknown' else MARITAL_STATUS end as MARITAL_STATUS)"""


def at_last(columns: str) -> str:
    return f"(select distinct EMPLOYEE_ID as id_, PAYROLL_SEQUENCE as seq_, {columns} from checks)"


def peer_counts(source: str, age: int, service: int) -> str:
    return f"""
    select {PEER_KEYS}, case when age >= {age} and service_year >= {service} then 1 else 0 end as whether_eligible,
      count(distinct EMPLOYEE_ID) as ecount
    from {source} group by all"""


def peer_stats(counts: str) -> str:
    return f"""
    select {PEER_KEYS},
      coalesce(sum(ecount) filter (whether_eligible = 1), 0)::double
        / (sum(ecount)::double) as eligible_persent,
      cast(sum(ecount) as bigint) as total_ecount
    from {counts} group by {PEER_KEYS}"""


def pension(source: str, rate: str) -> str:
    """The frame joined back to its own pension rows."""
    return f"""
    select f.*, p.retirement_factor, p.retirement_pension from {source} f left join (
      select EMPLOYEE_ID, MAX_PP, retirement_factor,
        {rate} * 26 / 12 * service_year * retirement_factor * 0.0216::double as retirement_pension
      from (select EMPLOYEE_ID, MAX_PP, service_year, {FACTOR} as retirement_factor from {source}) r
      left join {at_last('BIWEEKLY_RATE')} s on EMPLOYEE_ID = id_ and MAX_PP = seq_) p
    on f.EMPLOYEE_ID = p.EMPLOYEE_ID and f.MAX_PP = p.MAX_PP"""


def same(keys: list[str], a: str, b: str) -> str:
    return " and ".join(f"{a}.{k} is not distinct from {b}.{k}" for k in keys)


def with_means(source: str, fitted: str, names: list[str] | None = None) -> str:
    names = list(MEANS) if names is None else names
    joins = [
        f"left join (select {', '.join(MEANS[n])}, sum(retire)::double / count(retire) as {n} from {fitted} group by all) m{i} "
        f"on {same(MEANS[n], 'f', f'm{i}')}"
        for i, n in enumerate(names)
    ]
    columns = ", ".join(f"m{i}.{n}" for i, n in enumerate(names))
    return f"select f.*, {columns} from {source} f " + "\n      ".join(joins)


def job_fallback(fitted: str) -> str:
    return (
        f"(select {strict_avg('v')} from (select sum(retire)::double / count(retire) as v from {fitted} "
        "group by FMS_DEPARTMENT_TITLE, JOB_CLASS_TITLE))"
    )


def seen(source: str, fitted: str) -> str:
    return f"""
    select * replace (coalesce(jclass_persent, {job_fallback(fitted)}) as jclass_persent)
    from ({with_means(source, fitted)}) where CSTEP_persent is not null"""


CTES = {
    "facts": facts(TITLE, "cast(1500 + (o_custkey % 50) * 40 as double)"),
    "calendar": """
    select distinct PAYROLL_SEQUENCE, cast(PAYROLL_SEQUENCE // 100
      + case when PAYROLL_SEQUENCE % 100 >= 7 then 1 else 0 end as int) as FISCAL_YEAR
    from (select cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as PAYROLL_SEQUENCE from orders)""",
    "job_steps": f"""
    select distinct cast(1000 + o_custkey % 17 as varchar) as JOB, {TITLE} as JOB_CLASS_TITLE,
      case when o_custkey % 5 = 4 then 'Z' else cast(o_custkey % 5 as varchar) end as PAY_GRADE,
      cast(case (o_custkey % 17 - 6) % 7 when 0 then 0 when 1 then 2 when 2 then 5 when 3 then 6
        when 4 then 12 when 5 then 15 end as int) as HIGHEST_STEP
    from orders where o_custkey % 17 >= 6""",
    "usable_steps": """
    select distinct * from job_steps where not coalesce(JOB_CLASS_TITLE = 'MUNICIPAL POLICE OFFICER III'
      or (JOB_CLASS_TITLE = 'MACHINIST SUPERVISOR' and PAY_GRADE = '0')
      or (JOB_CLASS_TITLE = 'SUPT OF OPERATIONS I' and PAY_GRADE = '1')
      or (JOB_CLASS_TITLE = 'CONSTR INSPECTOR' and PAY_GRADE = 'Z')
      or (JOB_CLASS_TITLE = 'SR CONSTR INSPECTOR' and PAY_GRADE in ('A', 'X')), true)""",
    "checks": "select f.*, c.FISCAL_YEAR from facts f left join calendar c using (PAYROLL_SEQUENCE)",
    "last_pp": """
    select FISCAL_YEAR, EMPLOYEE_ID, DATE_OF_BIRTH, ORIGINAL_HIRE_DATE, max(PAYROLL_SEQUENCE) as MAX_PP
    from checks where CHECK_TYPE = 'Regular' group by all""",
    "people": "select EMPLOYEE_ID, MAX_PP, count(*) as people from last_pp group by all",
    "multiplied": f"""
    select *, panel_rows * panel_rows * rates as pension_rows from (
      select *, people * snapshots * units * classes as panel_rows from people join (
        select EMPLOYEE_ID, PAYROLL_SEQUENCE as MAX_PP, count(distinct row({SNAPSHOT})) as snapshots,
          count(distinct row(MOU)) as units, count(distinct row(JOB_CLASS)) as classes, count(distinct row(BIWEEKLY_RATE)) as rates
        from checks group by all) using (EMPLOYEE_ID, MAX_PP))""",
    "dated": f"""
    select FISCAL_YEAR, EMPLOYEE_ID,
      make_date(1900 + year({DAY.format('DATE_OF_BIRTH')}) % 100, month({DAY.format('DATE_OF_BIRTH')}),
        day({DAY.format('DATE_OF_BIRTH')})) as DATE_OF_BIRTH,
      make_date(1900 + year({DAY.format('ORIGINAL_HIRE_DATE')}) % 100, month({DAY.format('ORIGINAL_HIRE_DATE')}),
        day({DAY.format('ORIGINAL_HIRE_DATE')})) as ORIGINAL_HIRE_DATE,
      MAX_PP, make_date(FISCAL_YEAR + 1, 7, 1) as next_fy_startdate
    from last_pp where ORIGINAL_HIRE_DATE is not null""",
    "aged": """
    select *, cast((next_fy_startdate - DATE_OF_BIRTH) // 365 as int) as age,
      cast((next_fy_startdate - ORIGINAL_HIRE_DATE) // 365 as int) as service_year from dated""",
    "labelled": f"""
    select * from (
      select * exclude (id_, seq_, JOB_STATUS, SEPARATION_REASON),
        case when JOB_STATUS = 'Active' then 0 when SEPARATION_REASON = 'Retired/Pensioned' then 1 else 2 end as retire
      from aged join {at_last(SNAPSHOT)} s on EMPLOYEE_ID = id_ and MAX_PP = seq_) where retire <> 2""",
    "salaries": f"""
    select *, {ieee_div('OT_TYPE_PAY', '(OT_TYPE_PAY + HW_TYPE_PAY)')} as OT_TYPE_PAY_PERSENT,
      RATE_PP + {ieee_div('(RATE_PP * OT_TYPE_PAY)', 'HW_TYPE_PAY')} as RATE_PP_ESTIMATE
    from (select EMPLOYEE_ID, FISCAL_YEAR, JOB_CLASS_TITLE, SALARY_STEP,
        {strict_avg('BIWEEKLY_RATE')} as RATE_PP, {strict_avg('HW_TYPE_HOURS')} as HW_HOURS_PP,
        {strict_avg('OT_TYPE_HOURS')} as OT_HOURS_PP, {strict_sum('c.HW_TYPE_PAY')} as HW_TYPE_PAY,
        {strict_sum('c.OT_TYPE_PAY')} as OT_TYPE_PAY
      from checks c where JOB_STATUS = 'Active' and CHECK_TYPE = 'Regular'
      group by EMPLOYEE_ID, FISCAL_YEAR, JOB_CLASS_TITLE, SALARY_STEP)""",
    "fallback": f"""
    select *, {ieee_div('OT_TYPE_PAY2', '(OT_TYPE_PAY2 + HW_TYPE_PAY2)')} as OT_TYPE_PAY_PERSENT2,
      RATE_PP2 + {ieee_div('(RATE_PP2 * OT_TYPE_PAY2)', 'HW_TYPE_PAY2')} as RATE_PP_ESTIMATE2
    from (select JOB_CLASS_TITLE, SALARY_STEP,
        {', '.join(f"{strict_avg(c)} as {c}2" for c in ['RATE_PP', 'HW_HOURS_PP', 'OT_HOURS_PP', 'HW_TYPE_PAY', 'OT_TYPE_PAY'])}
      from salaries group by JOB_CLASS_TITLE, SALARY_STEP)""",
    "stepless": f"""
    select l.*, {', '.join('s.' + c for c in STATS)}, m.MOU,
      case when m.MOU in ({SUPERVISORS}) then 1 else 0 end as whether_supervisor,
      j.JOB_CLASS, u.HIGHEST_STEP as known_step
    from labelled l
      left join salaries s on {same(['EMPLOYEE_ID', 'FISCAL_YEAR', 'JOB_CLASS_TITLE', 'SALARY_STEP'], 'l', 's')}
      join {at_last('MOU')} m on l.EMPLOYEE_ID = m.id_ and l.MAX_PP = m.seq_
      join {at_last('JOB_CLASS')} j on l.EMPLOYEE_ID = j.id_ and l.MAX_PP = j.seq_
      left join (select * from usable_steps where HIGHEST_STEP is not null) u
        on j.JOB_CLASS = cast(u.JOB as int) and {same(['JOB_CLASS_TITLE', 'PAY_GRADE'], 'l', 'u')}""",
    "defaulted": """
    select * exclude (known_step), coalesce(known_step, case when JOB_CLASS in (3766, 5113) then 0
      when JOB_CLASS in (1790, 1960, 2340, 3183, 7209, 7211, 7213, 7214) then 15
      when JOB_CLASS in (3198, 7294) then 5 when JOB_CLASS = 1576 then 11 else 12 end) as HIGHEST_STEP
    from stepless""",
    "panel": f"""
    select *, {HEADROOM} from (
      select * replace (cast(case when HIGHEST_STEP >= SALARY_STEP then HIGHEST_STEP
        when HIGHEST_STEP = 12 then 15
        when HIGHEST_STEP = 0 and SALARY_STEP <= 5 then 5
        when HIGHEST_STEP = 0 and SALARY_STEP <= 8 then 8
        when HIGHEST_STEP = 0 and SALARY_STEP <= 12 then 12
        when HIGHEST_STEP = 2 or HIGHEST_STEP = 6 then 8 else HIGHEST_STEP end as int) as HIGHEST_STEP)
      from defaulted)""",
    "eligible": f"select * {NORMAL} from panel where age >= 55 and service_year >= 10",
    "pensioned": pension("(select * from panel where age >= 55 and service_year >= 10)", "BIWEEKLY_RATE"),
    "counts": peer_counts("panel", 55, 10),
    "peers": peer_stats("counts"),
    "next_counts": peer_counts("panel where FISCAL_YEAR = 2001", 54, 9),
    "next_peers": peer_stats("next_counts"),
    "imputed": f"""
    select p.* replace ({', '.join(f'coalesce(p.{c}, {c}2) as {c}' for c in STATS)}),
      e.eligible_persent, e.total_ecount
    from pensioned p left join peers e on {same(PEER_KEYS.split(', '), 'p', 'e')}
      left join fallback f on {same(['JOB_CLASS_TITLE', 'SALARY_STEP'], 'p', 'f')}""",
    "train_base": f"""
    select {TRAIN} from (select * {NORMAL} from imputed)
    where RATE_PP is not null and OT_TYPE_PAY_PERSENT is not null""",
    "rolled": f"""
    select *, {HEADROOM} from (
      select * exclude (dif_step, whether_highest) replace (FISCAL_YEAR + 1 as FISCAL_YEAR, age + 1 as age,
        service_year + 1 as service_year, SALARY_STEP + case whether_highest when 0 then 1 else 0 end as SALARY_STEP,
        RATE_PP * 1.02::double as RATE_PP, RATE_PP_ESTIMATE * 1.02::double as RATE_PP_ESTIMATE)
      from panel where FISCAL_YEAR = 2001 and retire = 0 and age >= 54 and service_year >= 9)""",
    "rolled_pension": pension("rolled", "BIWEEKLY_RATE * 1.02::double"),
    "score_imputed": f"""
    select p.* replace (coalesce(p.OT_TYPE_PAY_PERSENT, OT_TYPE_PAY_PERSENT2) as OT_TYPE_PAY_PERSENT,
        coalesce(p.RATE_PP_ESTIMATE, RATE_PP_ESTIMATE2 * 1.02::double) as RATE_PP_ESTIMATE),
      e.eligible_persent, e.total_ecount
    from rolled_pension p left join next_peers e on {same(['FMS_DEPARTMENT_TITLE', 'JOB_CLASS_TITLE'], 'p', 'e')}
      left join fallback f on {same(['JOB_CLASS_TITLE', 'SALARY_STEP'], 'p', 'f')}""",
    "score_base": f"""
    select {SCORE} from (select * {NORMAL} from score_imputed) where OT_TYPE_PAY_PERSENT is not null""",
}


def key_hash(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || EMPLOYEE_ID::varchar || '|' || FISCAL_YEAR::varchar), 1, 8))::bigint"


CTES["scored"] = seen("score_base", "train_base")
CTES["train_rows"] = f"select * from train_base where {key_hash(82)} % 100 < 80"
CTES["folded"] = f"""
    select EMPLOYEE_ID, FISCAL_YEAR, retire as label,
      cast((row_number() over (partition by retire order by {key_hash(10)}, EMPLOYEE_ID, FISCAL_YEAR) - 1) % 5 as int) as fold
    from train_rows"""

# The columns of the frame that are numbers, then the means, then the hashed columns.
NUMBERS = (
    "FISCAL_YEAR, age, service_year, SALARY_STEP, " + ", ".join(STATS) + ", whether_supervisor, HIGHEST_STEP, dif_step, "
    "whether_highest, retirement_factor, retirement_pension, eligible_persent, total_ecount"
).split(", ")


# Ranges of the search stages, the first grid key varying slowest.
POINTS = """
    select b.beta::double as beta, s.* from (values (0.5), (0.3)) b(beta), lateral (
      select 1 as stage, i + 1 as point, 100 + 100 * i as trees, 10 as depth, 100 as min_split, 20 as min_leaf, 'sqrt' as max_features from range(9) r(i)
      union all select 2, d * 8 + s + 1, 100, 3 + 2 * d, 50 + 20 * s, 20, 'sqrt' from range(11) r(d), range(8) q(s)
      union all select 3, s * 14 + l + 1, 100, case when b.beta = 0.5 then 15 else 3 end, 50 + 10 * s, 10 + 10 * l, 'sqrt' from range(10) r(s), range(14) q(l)
      union all select 4, f + 1, 100, case when b.beta = 0.5 then 15 else 3 end, case when b.beta = 0.5 then 60 else 130 end,
        case when b.beta = 0.5 then 10 else 40 end, (2 + 3 * f)::varchar from range(11) r(f)) s"""


def _upto(last: str, select: str, fan_out: bool = False) -> str:
    """``select`` over the relations up to ``last`` that it needs."""
    ctes = dict(CTES)
    if fan_out:
        ctes["facts"] = facts("p_type", "l_extendedprice / 20")
    names = list(ctes)
    needed: list[str] = []
    text = select + f" {last} "
    for name in reversed(names):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += ctes[name]
    head = ",\n".join(f"{n} as materialized ({ctes[n]})" for n in reversed(needed))
    return f"with {head}\n{select}"


STATS2 = [f"{c}2" for c in STATS]
# columns that come from sums of doubles, by query
ROUNDED = {
    "agg_salary_summary": [*STATS, "HW_TYPE_PAY", "OT_TYPE_PAY"],
    "agg_mean_of_means": [*STATS2, "HW_TYPE_PAY2", "OT_TYPE_PAY2"],
    "drop_scratch": STATS,
    "ratio_overtime": ["OT_TYPE_PAY_PERSENT"],
    "rate_estimate": ["RATE_PP_ESTIMATE"],
    "roll_rate": ["RATE_PP", "RATE_PP_ESTIMATE"],
    "join_salary_summary": STATS,
    "join_fallback_salary": STATS2,
    "impute_train": STATS,
    "impute_score": STATS,
    "profile_nulls": ["mean"],
    "profile_payroll": ["mean"],
    "profile_score_frame": ["min", "mean", "max"],
    "target_mean_fallback": ["jclass_persent_fallback"],
    "score_unseen": ["jclass_persent"],
    "train_frame": [*STATS, "jclass_persent"],
    "train_frame_strict": [*STATS, "jclass_persent"],
    "score_frame": [*STATS, "jclass_persent"],
    "frames_from_csv": [*STATS, "jclass_persent"],
}
FAN_OUT_TWINS = [
    "train_frame",
    "score_frame",
    "join_salary_summary",
    "join_step_dim",
    "peer_share",
    "target_means_all",
    "impute_train",
    "union_score_frame",
    "snapshot_counts",
    "snapshot_report",
    "snapshot_refused",
]
ROUNDED |= {f"{name}_fanout": ROUNDED[name] for name in FAN_OUT_TWINS if name in ROUNDED}


def rounded(sql: str, columns: list[str]) -> str:
    out = ", ".join(f"round({c}, {OUTPUT_DECIMALS}) as {c}" for c in columns)
    return f"select * replace ({out}) from ({sql})"


ID = "EMPLOYEE_ID, FISCAL_YEAR"


def attached(columns: str, fan_out: bool = False) -> str:
    return _upto(
        "checks",
        f"select {ID}, MAX_PP, {columns} from last_pp join {at_last(columns)} s "
        "on EMPLOYEE_ID = id_ and MAX_PP = seq_",
        fan_out,
    )


def hash_counts(column: str, prefix: str, buckets: int) -> tuple[str, str]:
    """A lookup of the hashed columns per distinct text, and its output columns."""
    sign = "case when (h // 1024) % 2 = 0 then 1 else -1 end"
    sums = ", ".join(
        f"cast(coalesce(sum({sign}) filter (h % {buckets} = {b}), 0) as int) as {prefix}_{b}" for b in range(buckets)
    )
    lookup = f"""(select v, {sums} from (
      select v, ('0x' || substr(md5(c), 1, 8))::bigint as h from (
        select v, unnest(string_split(v, '')) as c from (
          select distinct cast({column} as varchar) as v from panel where {column} is not null)) where c <> '')
      group by v)"""
    columns = ", ".join(f"coalesce({prefix}_{b}, 0) as {prefix}_{b}" for b in range(buckets))
    return lookup, columns


HASHED = {
    "JOB_CLASS_TITLE": ("jobclass", 3),
    "FMS_DEPARTMENT_TITLE": ("department", 3),
    "PAY_GRADE": ("paygrade", 3),
    "WORK_SCHEDULE": ("schedule", 3),
    "RETIREMENT_PENSION_PLAN": ("plan", 3),
    "ETHNICITY": ("ethnicity", 3),
    "GENDER": ("gender", 2),
    "MARITAL_STATUS": ("mstatus", 3),
    "MOU": ("mou", 3),
}


def hashed(columns: list[str]) -> str:
    parts = [(c, *hash_counts(c, *HASHED[c])) for c in columns]
    joins = " ".join(f"left join {lk} h{i} on cast(p.{c} as varchar) = h{i}.v" for i, (c, lk, _) in enumerate(parts))
    out = ", ".join(cols for _, _, cols in parts)
    return _upto("panel", f"select {ID}, {out} from panel p {joins}")


def target_mean(name: str) -> str:
    keys = ", ".join(MEANS[name])
    return _upto("eligible", f"select {keys}, sum(retire)::double / count(retire) as {name} from eligible group by {keys}")


def all_means(fan_out: bool = False) -> str:
    columns = list(dict.fromkeys(k for keys in MEANS.values() for k in keys))
    kinds = {"HIGHEST_STEP": "int", "SALARY_STEP": "int", "MOU": "int"}
    parts = []
    for name, keys in MEANS.items():
        out = ", ".join(c if c in keys else f"cast(null as {kinds.get(c, 'varchar')}) as {c}" for c in columns)
        parts.append(f"select '{name}' as mean_name, {out}, sum(retire)::double / count(retire) as target_mean from eligible group by {', '.join(keys)}")
    return _upto("eligible", " union all ".join(parts), fan_out)


PAYROLL = (
    "EMPLOYEE_ID, PAYROLL_SEQUENCE, CHECK_TYPE, DATE_OF_BIRTH, ORIGINAL_HIRE_DATE, FMS_DEPARTMENT_TITLE, JOB_CLASS_TITLE, "
    "JOB_CLASS, PAY_GRADE, WORK_SCHEDULE, SALARY_STEP, RETIREMENT_PENSION_PLAN, ETHNICITY, GENDER, MARITAL_STATUS, JOB_STATUS, "
    "SEPARATION_REASON, MOU, BIWEEKLY_RATE, HW_TYPE_HOURS, OT_TYPE_HOURS, HW_TYPE_PAY, OT_TYPE_PAY"
).split(", ")
TEXTS = {*SNAPSHOT.split(", "), "CHECK_TYPE", "DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE"} - {"SALARY_STEP"}


def profile(source: str, columns: list[str]) -> str:
    """One row per column: exact counts, extremes and means of numbers, value counts of texts."""
    parts = []
    for c in columns:
        counts = f"'{{}}' as kind, count(*) as row_count, count(*) - count({c}) as nulls"
        if c in TEXTS:
            parts.append(
                f"select '{c}' as column_name, {counts.format('text')}, null::double as min, null::double as mean, null::double as max, "
                f"count(distinct {c}) as \"distinct\", (select {c} from {source} where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as top, "
                f"(select count(*) from {source} where {c} is not null group by {c} order by count(*) desc limit 1) as top_count from {source}"
            )
            continue
        kind, v = ("date", f"({c} - date '1970-01-01')::double") if c == "next_fy_startdate" else ("number", f"{c}::double")
        mean = (
            f"case when count(*) filter ({v} = 'Infinity'::double) > 0 then 'Infinity'::double "
            f"else fsum({v}) filter ({v} < 'Infinity'::double) / count({c}) end"
        )
        parts.append(
            f"select '{c}' as column_name, {counts.format(kind)}, min({v}) as min, {mean} as mean, max({v}) as max, "
            f"null::bigint as \"distinct\", null::varchar as top, null::bigint as top_count from {source}"
        )
    return " union all ".join(parts)


def quartile_ranks(source: str, columns: list[str]) -> str:
    known = [c for c in columns if c not in TEXTS]
    return " union all ".join(f"select '{c}' as column_name, q as quantile, (select count({c}) from {source}) as known, true as within from (values (0.25::double), (0.5::double), (0.75::double)) v(q)" for c in known)


SCORED = [*SCORE.split(", "), *MEANS]


JOINED = f"(select * from last_pp join {at_last(SNAPSHOT)} s on EMPLOYEE_ID = id_ and MAX_PP = seq_)"
MEANT = "(" + with_means(f"(select * {NORMAL} from score_imputed)", "train_base", ["CSTEP_persent"]) + ")"
# frame, its rows before any is dropped, step, rule, condition, what earlier rules have dropped
DROPS = [
    ("panel", JOINED, 1, "no readable hire date", "ORIGINAL_HIRE_DATE is null", ""),
    ("panel", JOINED, 2, "unknown status or reason", "(JOB_STATUS is null or (JOB_STATUS <> 'Active' and SEPARATION_REASON is null))", "ORIGINAL_HIRE_DATE is null"),
    (
        "panel", JOINED, 3, "left for another reason", "(JOB_STATUS <> 'Active' and SEPARATION_REASON <> 'Retired/Pensioned')",
        "ORIGINAL_HIRE_DATE is null or coalesce(JOB_STATUS is null or (JOB_STATUS <> 'Active' and SEPARATION_REASON is null), false)",
    ),
    ("train", "imputed", 1, "no rate", "RATE_PP is null", ""),
    ("train", "imputed", 2, "no overtime share", "OT_TYPE_PAY_PERSENT is null", "RATE_PP is null"),
    ("score", MEANT, 1, "no overtime share", "OT_TYPE_PAY_PERSENT is null", ""),
    ("score", MEANT, 2, "unseen step", "CSTEP_persent is null", "OT_TYPE_PAY_PERSENT is null"),
]
FEATURES = ", ".join(f"'{c}'" for c in [*NUMBERS, *MEANS, *(f"{p}_{b}" for p, n in HASHED.values() for b in range(n))])
FIXED = "(select retire, case when age >= 60 then 1 else 0 end as said from labelled)"
RAW = DAY.format
FULL = {
    c: f"make_date({{0}} + year({RAW(c)}) % 100, month({RAW(c)}), day({RAW(c)}))"
    for c in ("DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE")
}


def _plain(fan_out: bool) -> dict[str, str]:
    def upto(last: str, select: str, fan_out: bool = fan_out) -> str:
        return _upto(last, select, fan_out)

    def on(last: str, columns: str = "*", where: str = "") -> str:
        return upto(last, f"select {columns} from {last} {where}")

    one_key = [n for n, k in MEANS.items() if len(k) == 1]
    two_keys = [n for n, k in MEANS.items() if len(k) == 2]
    stats = ", ".join(STATS)
    sql = {
        "retire_rate_by_department": upto(
            "labelled",
            "select FMS_DEPARTMENT_TITLE, count(*) as employee_years, sum(retire)::double / count(retire) as retire_rate "
            "from labelled where age >= 55 and service_year >= 10 group by all",
        ),
        "scan_payroll": on("facts"),
        "scan_fiscal_calendar": on("calendar"),
        "scan_step_dim": on("job_steps"),
        "scan_step_sheet": on("job_steps"),
        "sink_roundtrip": on("aged", f"{ID}, MAX_PP, age, service_year"),
        "sink_csv_roundtrip": on("facts"),
        "csv_accepted": upto(
            "facts",
            "select * replace (case when EMPLOYEE_ID % 13 = 0 then JOB_CLASS_TITLE || chr(10) || 'X' else JOB_CLASS_TITLE end as JOB_CLASS_TITLE) "
            "from facts where EMPLOYEE_ID % 11 <> 0",
        ),
        "csv_rejected": upto(
            "facts",
            "select case when EMPLOYEE_ID % 22 = 0 then 'MOU is no int; HW_TYPE_PAY is no double' else 'HW_TYPE_PAY is no double' end as reason, "
            "count(*) as n, true as named from facts where EMPLOYEE_ID % 11 = 0 group by all",
        ),
        "project_panel_cols": on(
            "checks",
            "FISCAL_YEAR, EMPLOYEE_ID, DATE_OF_BIRTH, ORIGINAL_HIRE_DATE, PAYROLL_SEQUENCE",
            "where CHECK_TYPE = 'Regular'",
        ),
        "drop_scratch": on("salaries", f"{ID}, JOB_CLASS_TITLE, SALARY_STEP, {stats}"),
        "feature_columns": on(
            "aged", "FISCAL_YEAR, DATE_OF_BIRTH, ORIGINAL_HIRE_DATE, MAX_PP, next_fy_startdate, age, service_year"
        ),
        "filter_regular": on("facts", "EMPLOYEE_ID, PAYROLL_SEQUENCE, CHECK_TYPE", "where CHECK_TYPE = 'Regular'"),
        "filter_active_regular": on(
            "facts",
            "EMPLOYEE_ID, PAYROLL_SEQUENCE, BIWEEKLY_RATE",
            "where JOB_STATUS = 'Active' and CHECK_TYPE = 'Regular'",
        ),
        "filter_not_null": on("facts", "EMPLOYEE_ID, ORIGINAL_HIRE_DATE", "where ORIGINAL_HIRE_DATE is not null"),
        "filter_eligible": on("aged", f"{ID}, age, service_year", "where age >= 55 and service_year >= 10"),
        "filter_newly_eligible": on(
            "aged",
            f"{ID}, age, service_year",
            "where (age = 54 and service_year >= 9) or (age >= 55 and service_year = 9)",
        ),
        "filter_ambiguous_jobs": on("usable_steps"),
        "filter_in_list": on("facts", "EMPLOYEE_ID, PAYROLL_SEQUENCE, MOU", f"where MOU in ({SUPERVISORS})"),
        "filter_year": on("aged", f"{ID}, age", "where FISCAL_YEAR = 2001"),
        "limit_head": on(
            "aged", f"{ID}, MAX_PP, age, service_year", "order by EMPLOYEE_ID, FISCAL_YEAR limit 5"
        ),
        "join_fiscal_year": on("checks", "EMPLOYEE_ID, PAYROLL_SEQUENCE, FISCAL_YEAR"),
        "join_last_period": attached(SNAPSHOT),
        "join_last_period_fanout": attached("JOB_CLASS_TITLE", fan_out=True),
        "join_last_period_mou": attached("MOU"),
        "join_last_period_jobclass": attached("JOB_CLASS"),
        "join_last_period_rate": attached("BIWEEKLY_RATE"),
        "join_salary_summary": on("stepless", f"{ID}, {stats}"),
        "join_step_dim": on(
            "stepless", f"{ID}, JOB_CLASS, JOB_CLASS_TITLE, PAY_GRADE, known_step as HIGHEST_STEP"
        ),
        "join_pension": on("pensioned", f"{ID}, retirement_factor, retirement_pension"),
        "join_peer_stats": upto(
            "peers",
            f"select l.EMPLOYEE_ID, l.FISCAL_YEAR, eligible_persent, total_ecount from labelled l left join peers e "
            f"on {same(PEER_KEYS.split(', '), 'l', 'e')} where age >= 55 and service_year >= 10",
        ),
        "join_peer_stats_score": upto(
            "rolled",
            "select EMPLOYEE_ID, p.FISCAL_YEAR, eligible_persent, total_ecount from rolled p left join next_peers e "
            f"on {same(['FMS_DEPARTMENT_TITLE', 'JOB_CLASS_TITLE'], 'p', 'e')}",
        ),
        "join_fallback_salary": upto(
            "labelled",
            f"select EMPLOYEE_ID, FISCAL_YEAR, {', '.join(c + '2' for c in STATS)} from labelled l "
            f"left join fallback f on {same(['JOB_CLASS_TITLE', 'SALARY_STEP'], 'l', 'f')}",
        ),
        "join_target_means_1": upto(
            "eligible",
            f"select {ID}, {', '.join(one_key)} from ({with_means('eligible', 'eligible', one_key)})",
        ),
        "join_target_means_2": upto(
            "eligible",
            f"select {ID}, {', '.join(two_keys)} from ({with_means('eligible', 'eligible', two_keys)})",
        ),
        "dropped_rows": upto(
            "score_imputed",
            "select frame, step::int as step, rule, rows_in, dropped from ("
            + " union all ".join(
                f"select '{frame}' as frame, {step} as step, '{rule}' as rule, count(*) filter ({'not (' + before + ')' if before else 'true'}) as rows_in, "
                f"count(*) filter ({met}{' and not (' + before + ')' if before else ''}) as dropped from {source}"
                for frame, source, step, rule, met, before in DROPS
            )
            + ")",
        ),
        "snapshot_counts": on("multiplied"),
        "snapshot_report": on(
            "multiplied",
            "cast(sum(people) as bigint) as employee_years, count(*) filter (pension_rows > 1) as ambiguous, "
            "cast(sum(panel_rows) as bigint) as snapshot_rows, cast(sum(pension_rows) as bigint) as pension_rows, "
            "sum(pension_rows)::double / sum(people)::double as factor",
        ),
        "snapshot_refused": on("multiplied", where="where pension_rows > 1"),
        "snapshot_strict": upto(
            "checks",
            f"select {ID}, MAX_PP, {SNAPSHOT}, MOU, JOB_CLASS, BIWEEKLY_RATE from last_pp "
            f"join {at_last(SNAPSHOT + ', MOU, JOB_CLASS, BIWEEKLY_RATE')} s on EMPLOYEE_ID = id_ and MAX_PP = seq_",
        ),
        "agg_last_period": on("last_pp"),
        "agg_salary_summary": on("salaries"),
        "agg_mean_of_means": on("fallback"),
        "agg_eligible_counts": on("counts"),
        "agg_eligible_counts_fwd": on("next_counts"),
        "pivot_eligible": upto(
            "counts",
            f"select {PEER_KEYS}, cast(max(ecount) filter (whether_eligible = 0) as bigint) as not_eligible, "
            f"cast(max(ecount) filter (whether_eligible = 1) as bigint) as eligible from counts group by {PEER_KEYS}",
        ),
        "pivot_fill_zero": upto(
            "counts",
            f"select {PEER_KEYS}, cast(coalesce(max(ecount) filter (whether_eligible = 0), 0) as bigint) as not_eligible, "
            "cast(coalesce(max(ecount) filter (whether_eligible = 1), 0) as bigint) as eligible "
            f"from counts group by {PEER_KEYS}",
        ),
        "target_mean_job": target_mean("jclass_persent"),
        "target_mean_step": target_mean("CSTEP_persent"),
        **{f"target_mean_{MEANS[n][0].lower()}": target_mean(n) for n in one_key},
        "target_mean_fallback": upto("eligible", f"select {job_fallback('eligible')} as jclass_persent_fallback"),
        "target_means_all": all_means(fan_out),
        "distinct_snapshot": upto(
            "facts", f"select distinct EMPLOYEE_ID, PAYROLL_SEQUENCE, {SNAPSHOT} from facts"
        ),
        "profile_nulls": upto("facts", f"select column_name, row_count, nulls, min, mean, max from ({profile('facts', PAYROLL)})"),
        "profile_payroll": upto("facts", profile("facts", PAYROLL)),
        "profile_score_frame": upto("scored", profile("scored", SCORED)),
        "profile_payroll_ranks": upto("facts", quartile_ranks("facts", PAYROLL)),
        "profile_score_frame_ranks": upto("scored", quartile_ranks("scored", SCORED)),
        "confusion_matrix": upto(
            "labelled",
            "select retire as label, count(*) filter (said = 0) as predicted_0, "
            f"count(*) filter (said = 1) as predicted_1 from {FIXED} group by retire",
        ),
        "fbeta": upto(
            "labelled",
            f"""select beta::double as beta, tp, fp, fn,
              case when tp = 0 then 0::double
                else (beta::double * beta::double + 1) * tp
                  / ((beta::double * beta::double + 1) * tp + beta::double * beta::double * fn + fp) end as fbeta
            from (select count(*) filter (retire = 1 and said = 1) as tp, count(*) filter (retire = 0 and said = 1) as fp,
              count(*) filter (retire = 1 and said = 0) as fn from {FIXED}), (values (0.5), (0.3)) b(beta)""",
        ),
        "parse_dates": on(
            "facts",
            f"EMPLOYEE_ID, {FULL['DATE_OF_BIRTH'].format(2000)} as born, "
            f"{FULL['ORIGINAL_HIRE_DATE'].format(2000)} as hired",
        ),
        "fix_birth_century": on("facts", f"EMPLOYEE_ID, {FULL['DATE_OF_BIRTH'].format(1900)} as born"),
        "fix_hire_century": on("facts", f"EMPLOYEE_ID, {FULL['ORIGINAL_HIRE_DATE'].format(1900)} as hired"),
        "next_fy_start": on("last_pp", f"{ID}, make_date(FISCAL_YEAR + 1, 7, 1) as next_fy_startdate"),
        "age_service": on("aged", f"{ID}, age, service_year"),
        "text_concat": on("last_pp", f"{ID}, '01-JUL-' || cast(FISCAL_YEAR - 2000 + 1 as varchar) as start_text"),
        "cast_job": on(
            "job_steps",
            "JOB, try_cast(JOB as int) as job_number, try_cast(JOB_CLASS_TITLE as int) as title_number",
        ),
        "ratio_overtime": on("salaries", f"{ID}, JOB_CLASS_TITLE, SALARY_STEP, OT_TYPE_PAY_PERSENT"),
        "rate_estimate": on("salaries", f"{ID}, JOB_CLASS_TITLE, SALARY_STEP, RATE_PP_ESTIMATE"),
        "peer_share": on("peers"),
        "roll_forward": on("rolled", f"{ID}, age, service_year"),
        "roll_step": on("rolled", f"{ID}, SALARY_STEP, HIGHEST_STEP, dif_step, whether_highest"),
        "roll_rate": on("rolled", f"{ID}, RATE_PP, RATE_PP_ESTIMATE"),
        "label_retire": on(
            "facts",
            "EMPLOYEE_ID, PAYROLL_SEQUENCE, case when JOB_STATUS = 'Active' then 0 "
            "when SEPARATION_REASON = 'Retired/Pensioned' then 1 else 2 end as retire",
        ),
        "flag_eligible": on(
            "aged",
            f"{ID}, case when age >= 55 and service_year >= 10 then 1 else 0 end as whether_eligible, "
            "case when age >= 54 and service_year >= 9 then 1 else 0 end as whether_eligible_next",
        ),
        "flag_supervisor": on(
            "facts", f"EMPLOYEE_ID, MOU, case when MOU in ({SUPERVISORS}) then 1 else 0 end as whether_supervisor"
        ),
        "step_default": on("defaulted", f"{ID}, JOB_CLASS, cast(HIGHEST_STEP as int) as HIGHEST_STEP"),
        "step_headroom": on("defaulted", f"{ID}, HIGHEST_STEP, SALARY_STEP, {HEADROOM}"),
        "step_repair": on("panel", f"{ID}, HIGHEST_STEP, SALARY_STEP, dif_step, whether_highest"),
        "retirement_factor": on("aged", f"{ID}, age, service_year, {FACTOR} as retirement_factor"),
        "pension_estimate": upto(
            "labelled",
            f"select {ID}, BIWEEKLY_RATE * 26 / 12 * service_year * {FACTOR} * 0.0216::double as retirement_pension, "
            f"BIWEEKLY_RATE * 1.02::double * 26 / 12 * service_year * {FACTOR} * 0.0216::double as retirement_pension_next "
            f"from labelled join {at_last('BIWEEKLY_RATE')} r on EMPLOYEE_ID = id_ and MAX_PP = seq_",
        ),
        "impute_train": on("imputed", f"{ID}, {stats}", "where RATE_PP is not null and OT_TYPE_PAY_PERSENT is not null"),
        "impute_score": on("score_imputed", f"{ID}, {stats}", "where OT_TYPE_PAY_PERSENT is not null"),
        "normalise_categories": upto(
            "facts", f"select EMPLOYEE_ID, WORK_SCHEDULE, ETHNICITY, MARITAL_STATUS from (select * {NORMAL} from facts)"
        ),
        "score_unseen": upto(
            "eligible",
            f"select {ID}, {', '.join(MEANS)} from ("
            + seen("(select * from eligible where FISCAL_YEAR = 2001)", "(select * from eligible where FISCAL_YEAR < 2001)")
            + ")",
        ),
        "union_score_frame": upto(
            "labelled",
            f"select {ID}, age, service_year from labelled where FISCAL_YEAR = 2001 and retire = 0 "
            "and age >= 55 and service_year >= 10 union all "
            f"select {ID}, age, service_year from labelled where FISCAL_YEAR = 2001 and retire = 0 "
            "and ((age = 54 and service_year >= 9) or (age >= 55 and service_year = 9))",
        ),
        **{f"hash_{c.lower()}": hashed([c]) for c in HASHED},
        "hash_all": hashed(list(HASHED)),
        "split_train_test": on(
            "aged",
            f"{ID}, ('0x' || substr(md5('82|' || EMPLOYEE_ID::varchar || '|' || FISCAL_YEAR::varchar), 1, 8))::bigint "
            "% 100 < 80 as is_train",
        ),
        "rf_fit_rows": upto(
            "train_base",
            f"select depth, max_features, {key_hash(82)} % 100 < 80 as is_train, retire as label, count(*) as rows from train_base, "
            "(values (15::int, '8'), (15, '20'), (3, '8')) f(depth, max_features) group by all",
        ),
        "rf_predict_keys": on("train_base", f"{ID}, retire, {key_hash(82)} % 100 < 80 as is_train, true as predicted"),
        "rf_score_keys": on("scored", f"{ID}, age, service_year, true as predicted"),
        "predicted_total_bounds": on("scored", "count(*) as scored, true as total_holds"),
        "feature_names": upto(
            "train_rows", f"select feature, (select count(*) from train_rows) as fit_rows, true as is_share from (select unnest([{FEATURES}]) as feature)"
        ),
        "grid_points": upto(
            "train_rows",
            "select *, cast(floor(train_rows / least) as bigint) as most_leaves from (select beta, stage::int as stage, point::int as point, "
            "trees::int as trees, depth::int as depth, min_split::int as min_split, min_leaf::int as min_leaf, max_features, "
            f"greatest(min_leaf, ceil(min_split / 2))::int as least, (select count(*) from train_rows) as train_rows from ({POINTS}))",
        ),
        "folds": on("folded"),
        "fold_sizes": upto("folded", "select label, fold, count(*) as n from folded group by all"),
        "class_weight": on(
            "labelled", f"{ID}, retire, case retire when 1 then 5 else 1 end::double as weight"
        ),
    }
    sql["train_frame"] = sql["train_frame_strict"] = upto("train_base", with_means("train_base", "train_base"))
    sql["score_frame"] = sql["frames_from_csv"] = upto("score_base", seen("score_base", "train_base"))
    return sql


def oracle_sql() -> dict[str, str]:
    sql, several = _plain(False), _plain(True)
    sql |= {f"{name}_fanout": several[name] for name in FAN_OUT_TWINS}
    return {name: rounded(q, ROUNDED[name]) if name in ROUNDED else q for name, q in sql.items()}
