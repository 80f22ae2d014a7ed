"""Payroll-shaped tables derived from order, customer, line and part tables.

A customer plays the employee, the month of an order the pay period, a line the
check. ``FIXTURES.md`` section 3 lists the expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenurelens.sources.schema import FISCAL_CALENDAR, JOB_STEPS, PAYROLL

LAST_FISCAL_YEAR = 2001


def _read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def _period(date: str = "o_orderdate") -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def _date_text(date: Column) -> Column:
    return F.upper(F.date_format(date, "dd-MMM-yy"))


def _title() -> Column:
    return F.expr(
        """case o_custkey % 17
             when 14 then 'MACHINIST SUPERVISOR'
             when 15 then 'MUNICIPAL POLICE OFFICER III'
             when 16 then 'CONSTR INSPECTOR'
             else concat('JC', cast(o_custkey % 17 as string)) end"""
    )


def _job_class() -> Column:
    return F.expr(
        """cast(case o_custkey % 17 when 0 then 3766 when 1 then 5113 when 2 then 1790
                  when 3 then 3198 when 4 then 7294 when 5 then 1576
                  else 1000 + o_custkey % 17 end as int)"""
    )


def _grade() -> Column:
    return F.expr("case when o_custkey % 5 = 4 then 'Z' else cast(o_custkey % 5 as string) end")


def _dates(employee: str) -> dict[str, Column]:
    """Both dates as text."""
    born = F.expr(f"date_add(date '1930-01-01', cast(({employee} * 7919) % 14610 as int))")
    hired = F.expr(
        f"""case when {employee} % 37 = 0 then null
                else date_add(date '1965-01-01', cast(({employee} * 104729) % 10950 as int)) end"""
    )
    return {"DATE_OF_BIRTH": _date_text(born), "ORIGINAL_HIRE_DATE": _date_text(hired)}


def payroll(spark: SparkSession, folder: str, fan_out: bool = False) -> DataFrame:
    """``fan_out`` gives an employee several titles and rates per pay period."""
    orders = _read(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customer = _read(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    if not fan_out:
        # spelled once a person; with ``fan_out`` the checks move once more, and texts are dearer to carry than to spell
        customer = customer.withColumns(_dates("c_custkey"))
    line = _read(
        spark, folder, "lineitem",
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    )
    people = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    # both sides grow with the data: shuffle them even where the few columns read
    # make one of them look small enough to broadcast
    checks = line.hint("merge").join(people, F.col("l_orderkey") == F.col("o_orderkey"))
    title, rate = _title(), F.expr("cast(1500 + (o_custkey % 50) * 40 as double)")
    if fan_out:
        part = _read(spark, folder, "part", "p_partkey", "p_type")
        checks = checks.join(part, F.col("l_partkey") == F.col("p_partkey"))
        checks = checks.withColumns(_dates("o_custkey"))
        title, rate = F.col("p_type"), F.col("l_extendedprice") / 20

    phase = "(o_custkey * 31 + year(o_orderdate) * 12 + month(o_orderdate)) % 7"
    return checks.select(
        F.col("o_custkey").alias("EMPLOYEE_ID"),
        _period().alias("PAYROLL_SEQUENCE"),
        F.expr("case when l_returnflag = 'R' then 'Adjustment' else 'Regular' end").alias("CHECK_TYPE"),
        "DATE_OF_BIRTH",
        "ORIGINAL_HIRE_DATE",
        F.col("c_mktsegment").alias("FMS_DEPARTMENT_TITLE"),
        title.alias("JOB_CLASS_TITLE"),
        _job_class().alias("JOB_CLASS"),
        _grade().alias("PAY_GRADE"),
        F.expr(
            """case o_custkey % 6 when 0 then 'N/A' when 1 then ' ' when 2 then 'Variable'
                    else concat('WS', cast(o_custkey % 6 as string)) end"""
        ).alias("WORK_SCHEDULE"),
        F.expr("cast(1 + (o_custkey % 4) + 2 * (year(o_orderdate) - 1995) as int)").alias("SALARY_STEP"),
        F.expr("concat('PLAN', cast(o_custkey % 3 as string))").alias("RETIREMENT_PENSION_PLAN"),
        F.expr(
            """case o_custkey % 5 when 0 then '' when 1 then 'Unknown'
                    else concat('E', cast(o_custkey % 5 as string)) end"""
        ).alias("ETHNICITY"),
        F.expr("case when o_custkey % 2 = 0 then 'F' else 'M' end").alias("GENDER"),
        F.expr("case o_custkey % 4 when 0 then '' when 1 then 'Single' else 'Married' end").alias("MARITAL_STATUS"),
        F.expr(f"case when {phase} < 5 then 'Active' else 'Separated' end").alias("JOB_STATUS"),
        F.expr(f"case {phase} when 5 then 'Retired/Pensioned' when 6 then 'Resigned' end").alias("SEPARATION_REASON"),
        F.expr("nullif(c_nationkey, 7)").alias("MOU"),
        rate.alias("BIWEEKLY_RATE"),
        F.expr("case when l_quantity = 50 then null else l_quantity end").alias("HW_TYPE_HOURS"),
        (F.col("l_discount") * 100).alias("OT_TYPE_HOURS"),
        F.expr("case when o_custkey % 29 = 0 then 0d else l_extendedprice end").alias("HW_TYPE_PAY"),
        F.expr("case when o_custkey % 58 = 0 then 0d else l_extendedprice * l_discount end").alias("OT_TYPE_PAY"),
    ).select(*PAYROLL.fieldNames())


def fiscal_calendar(spark: SparkSession, folder: str) -> DataFrame:
    periods = _read(spark, folder, "orders", "o_orderdate").select(_period().alias("PAYROLL_SEQUENCE")).distinct()
    year = F.expr("cast(floor(PAYROLL_SEQUENCE / 100) as int) + case when PAYROLL_SEQUENCE % 100 >= 7 then 1 else 0 end")
    return periods.withColumn("FISCAL_YEAR", year).select(*FISCAL_CALENDAR.fieldNames())


def job_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Classes 0..5 are left out, so that the defaults by class are reached."""
    people = _read(spark, folder, "orders", "o_custkey").filter("o_custkey % 17 >= 6")
    highest = F.expr(
        """cast(case (o_custkey % 17 - 6) % 7 when 0 then 0 when 1 then 2 when 2 then 5 when 3 then 6
                  when 4 then 12 when 5 then 15 end as int)"""
    )
    return people.select(
        _job_class().cast("string").alias("JOB"),
        _title().alias("JOB_CLASS_TITLE"),
        _grade().alias("PAY_GRADE"),
        highest.alias("HIGHEST_STEP"),
    ).distinct().select(*JOB_STEPS.fieldNames())
