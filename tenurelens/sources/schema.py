"""Named schemas of the inputs and the column groups the operators refer to."""

from __future__ import annotations

from pyspark.sql import types as T

PAYROLL = T.StructType(
    [
        T.StructField("EMPLOYEE_ID", T.LongType(), False),
        T.StructField("PAYROLL_SEQUENCE", T.IntegerType(), False),
        T.StructField("CHECK_TYPE", T.StringType()),
        T.StructField("DATE_OF_BIRTH", T.StringType()),
        T.StructField("ORIGINAL_HIRE_DATE", T.StringType()),
        T.StructField("FMS_DEPARTMENT_TITLE", T.StringType()),
        T.StructField("JOB_CLASS_TITLE", T.StringType()),
        T.StructField("JOB_CLASS", T.IntegerType()),
        T.StructField("PAY_GRADE", T.StringType()),
        T.StructField("WORK_SCHEDULE", T.StringType()),
        T.StructField("SALARY_STEP", T.IntegerType()),
        T.StructField("RETIREMENT_PENSION_PLAN", T.StringType()),
        T.StructField("ETHNICITY", T.StringType()),
        T.StructField("GENDER", T.StringType()),
        T.StructField("MARITAL_STATUS", T.StringType()),
        T.StructField("JOB_STATUS", T.StringType()),
        T.StructField("SEPARATION_REASON", T.StringType()),
        T.StructField("MOU", T.IntegerType()),
        T.StructField("BIWEEKLY_RATE", T.DoubleType()),
        T.StructField("HW_TYPE_HOURS", T.DoubleType()),
        T.StructField("OT_TYPE_HOURS", T.DoubleType()),
        T.StructField("HW_TYPE_PAY", T.DoubleType()),
        T.StructField("OT_TYPE_PAY", T.DoubleType()),
    ]
)

FISCAL_CALENDAR = T.StructType(
    [
        T.StructField("PAYROLL_SEQUENCE", T.IntegerType(), False),
        T.StructField("FISCAL_YEAR", T.IntegerType()),
    ]
)

JOB_STEPS = T.StructType(
    [
        T.StructField("JOB", T.StringType()),
        T.StructField("JOB_CLASS_TITLE", T.StringType()),
        T.StructField("PAY_GRADE", T.StringType()),
        T.StructField("HIGHEST_STEP", T.IntegerType()),
    ]
)

PANEL_KEYS = ["FISCAL_YEAR", "EMPLOYEE_ID", "DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE"]

# attributes read from the last pay period of a panel row
SNAPSHOT = [
    "FMS_DEPARTMENT_TITLE",
    "JOB_CLASS_TITLE",
    "PAY_GRADE",
    "WORK_SCHEDULE",
    "SALARY_STEP",
    "RETIREMENT_PENSION_PLAN",
    "ETHNICITY",
    "GENDER",
    "MARITAL_STATUS",
    "JOB_STATUS",
    "SEPARATION_REASON",
]

SALARY_KEYS = ["EMPLOYEE_ID", "FISCAL_YEAR", "JOB_CLASS_TITLE", "SALARY_STEP"]
SALARY_STATS = ["RATE_PP", "HW_HOURS_PP", "OT_HOURS_PP", "OT_TYPE_PAY_PERSENT", "RATE_PP_ESTIMATE"]

# the panel every later frame starts from
PANEL = (
    PANEL_KEYS
    + ["MAX_PP", "next_fy_startdate", "age", "service_year"]
    + SNAPSHOT[:9]
    + ["retire"]
    + SALARY_STATS
    + ["MOU", "whether_supervisor", "JOB_CLASS", "HIGHEST_STEP", "dif_step", "whether_highest"]
)

MEANS = [
    "WORK_SCHEDULE_persent",
    "RETIREMENT_PENSION_PLAN_persent",
    "ETHNICITY_persent",
    "GENDER_persent",
    "MARITAL_STATUS_persent",
    "MOU_persent",
    "HSTEP_persent",
    "jclass_persent",
    "CSTEP_persent",
]

_DATES = {"DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE", "next_fy_startdate"}
_LONGS = {"EMPLOYEE_ID", "total_ecount"}
_TEXTS = {f.name for f in PAYROLL.fields if isinstance(f.dataType, T.StringType)} - _DATES
_DOUBLES = {*SALARY_STATS, "retirement_factor", "retirement_pension", "eligible_persent", *MEANS}


def _kind(name: str) -> T.DataType:
    for names, kind in ((_DATES, T.DateType()), (_LONGS, T.LongType()), (_TEXTS, T.StringType()), (_DOUBLES, T.DoubleType())):
        if name in names:
            return kind
    return T.IntegerType()


# the frames that a model can start from; the scoring frame lacks what only the past has
_FRAME = [*PANEL, "retirement_factor", "retirement_pension", "eligible_persent", "total_ecount", *MEANS]
TRAIN_FRAME = T.StructType([T.StructField(c, _kind(c)) for c in _FRAME])
SCORE_FRAME = T.StructType(
    [f for f in TRAIN_FRAME.fields if f.name not in ("DATE_OF_BIRTH", "ORIGINAL_HIRE_DATE", "MAX_PP", "retire", "JOB_CLASS")]
)
