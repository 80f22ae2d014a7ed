"""Hand-written checks: a plain base row with the differing fields replaced."""

from tenurelens.sources.schema import PAYROLL

BASE = {
    "EMPLOYEE_ID": 1,
    "PAYROLL_SEQUENCE": 1,
    "CHECK_TYPE": "Regular",
    "DATE_OF_BIRTH": "15-MAR-55",
    "ORIGINAL_HIRE_DATE": "01-JUL-85",
    "FMS_DEPARTMENT_TITLE": "FIRE",
    "JOB_CLASS_TITLE": "CLERK",
    "JOB_CLASS": 1358,
    "PAY_GRADE": "0",
    "WORK_SCHEDULE": "80",
    "SALARY_STEP": 3,
    "RETIREMENT_PENSION_PLAN": "P",
    "ETHNICITY": "E",
    "GENDER": "F",
    "MARITAL_STATUS": "Single",
    "JOB_STATUS": "Active",
    "SEPARATION_REASON": None,
    "MOU": 12,
    "BIWEEKLY_RATE": 2000.0,
    "HW_TYPE_HOURS": 80.0,
    "OT_TYPE_HOURS": 4.0,
    "HW_TYPE_PAY": 2000.0,
    "OT_TYPE_PAY": 100.0,
}


def payroll(spark, *changes):
    rows = [tuple({**BASE, **c}[f] for f in PAYROLL.fieldNames()) for c in changes]
    return spark.createDataFrame(rows, PAYROLL)


def calendar(spark, years):
    return spark.createDataFrame(list(years.items()), "PAYROLL_SEQUENCE int, FISCAL_YEAR int")
