"""The six source tables derived from the star-schema test tables.

Orders, customers and line items play orders, supporting attributes and task instances. The
dictionary comes from the parts, the phases from the dictionary, and the calendar spans the years
the orders and line items touch.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.sources.stage import stage
from taskspan.sources.tables import Warehouse

TRAIN_WINDOW = ("1995-01-01", "2000-12-31")
TEST_WINDOW = ("2001-01-01", "2001-12-31")
NONWORK_FROM_YEAR = 1995

ORDERS = {
    "orderID": "cast(o_orderkey as string)",
    "sourcekey": "o_orderkey",
    "sourceSystem": "case o_custkey % 5 when 0 then 'Netbuild' when 1 then 'BPM-QS' "
                    "when 2 then 'Legacy' else 'CORE' end",
    "status": "case o_orderstatus when 'F' then 'Completed' when 'O' then 'Open' "
              "else 'Cancelled' end",
    "inidordertype": "cast(o_orderkey % 9 as int)",
    "orderAction": "case o_orderkey % 8 when 0 then 'INS' when 1 then 'DIS' when 2 then 'Install' "
                   "when 3 then 'Disconnect' when 4 then 'Grooms' when 5 then 'None' "
                   "when 6 then ' ' end",
    "IncludedFlag": "case when o_custkey % 8 = 7 then 'N' when o_custkey % 8 = 6 then 'F' "
                    "else 'Y' end",
    "ProjectType": "case when o_orderkey % 6 = 0 then null else o_orderpriority end",
    "T_projecttype": "case o_custkey % 7 when 0 then '' when 1 then null "
                     "when 2 then 'Mileage Reduction' else 'Standard' end",
    "orderclasstype": "case o_custkey % 9 when 0 then '' when 1 then null when 2 then 'Null' "
                      "when 3 then 'B' else 'A' end",
    "IMPPOS2": "case when o_orderkey % 11 = 0 then null else 'IMP' end",
    "ordertype": "o_orderpriority",
    "is3rdpartycoloneeded": "case o_custkey % 3 when 0 then 'False' when 1 then 'false' "
                            "else 'true' end",
    "categoryCd": "case when o_orderkey % 13 = 0 then null when o_orderkey % 10 < 7 "
                  "then concat('C', cast(o_orderkey % 2 as string)) "
                  "else concat('R', cast(o_orderkey % 97 as string)) end",
    "orderWfStart": "cast(o_orderdate as date)",
    "completedate": "cast(o_orderdate as date) + cast(o_custkey % 45 - 2 as int)",
    "CLECILEC": "cast(null as string)",
}

ATTRIBUTES = {
    "sourcekey": "o_orderkey",
    "orderDescription": "case o_orderkey % 12 when 0 then '' when 1 then null "
                        "when 2 then 'Offnet Groom' else o_orderpriority end",
    "creatorGroup": "c_mktsegment",
    "WorkGroup": "case when o_orderkey % 17 = 0 then null else c_name end",
    "PDNOrder": "case when o_orderkey % 3 = 0 then null else 'true' end",
    "IsBuildingAdd": "case o_orderkey % 3 when 0 then 'False' when 1 then 'false' end",
    "QtyOfCircuits": "case when o_orderkey % 19 = 0 then null else cast(o_orderkey % 6 as int) end",
    "Expedite": "case o_custkey % 6 when 0 then '' when 1 then null when 2 then 'Yes' "
                "when 3 then 'No' when 4 then 'Y' else 'N' end",
}

TASK_DAYS = (
    "cast(case l_partkey % 4 when 0 then floor(l_quantity / 6) when 1 then floor(l_quantity / 2) "
    "when 2 then l_quantity else l_quantity * l_linenumber end "
    "+ case when l_orderkey % 151 = 0 then 220 else 0 end as int) - 2"
)

TASKS = {
    "sourcekey": "l_orderkey",
    "subIntID": "cast(case when l_partkey in (17, 1017) then 40 else l_partkey % 40 end as int)",
    "_id": "l_linenumber",
    "taskid": "concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', "
              "cast(l_linenumber as string))",
    "owner": "concat('owner', cast(l_suppkey % 10 as string))",
    "startDate": "cast(l_shipdate as date)",
    "completeDate": f"cast(l_shipdate as date) + ({TASK_DAYS})",
    "originalstartDate": "cast(l_shipdate as date) - 1",
    "originalcompleteDate": f"cast(l_shipdate as date) + ({TASK_DAYS} + 1)",
    "deleteind": "case when l_suppkey % 23 = 0 then 'Y' else 'N' end",
    "isinserted": "cast(case when l_suppkey % 29 = 0 then 1 when l_suppkey % 31 = 0 then null "
                  "else 0 end as int)",
    "taskJeop": "case when l_returnflag = 'R' and l_linenumber = 7 "
                "then 'AMO_VOIDEP(Voice Dependency)' "
                "when l_returnflag = 'R' and l_linenumber = 6 then 'AMO_911DEP(e911 Dependency)' "
                "when l_linenumber < 5 then null else 'None' end",
}

_dimensions: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{expression} as {name}" for name, expression in columns.items()))


def calendar_between(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per day of the given years; weekends and three fixed holidays are not work days."""
    epoch = date(1970, 1, 1)
    days = spark.range(
        (date(first_year, 1, 1) - epoch).days, (date(last_year + 1, 1, 1) - epoch).days
    ).select(F.date_from_unix_date(F.col("id").cast("int")).alias("date"))
    fixed_holiday = F.date_format("date", "MM-dd").isin("01-01", "07-04", "12-25")
    return days.select(
        "date",
        F.dayofyear("date").alias("daynuminyear"),
        F.when((F.weekday("date") >= 5) | fixed_holiday, 0).otherwise(1).alias("isworkday"),
    )


def _dimension_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dictionary, phases and calendar, stored once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _dimensions:
        task_types = (
            spark.read.parquet(f"{sf_dir}/part.parquet")
            .selectExpr("cast(case when p_partkey in (17, 1017) then 40 else p_partkey % 40 end "
                        "as int) as SubIntID")
            .distinct()
        )
        dictionary = stage(_select(task_types, {
            "SubIntID": "SubIntID",
            "SubIntervalName": "concat('task_', cast(case when SubIntID = 40 then 40 "
                               "else SubIntID % 37 end as string))",
            "PID": "cast(SubIntID % 5 as int)",
            "isfdtask": "cast(case when SubIntID = 39 then 1 else 0 end as int)",
        }), "dictionary")
        phases = stage(
            dictionary.select("PID").distinct()
            .withColumn("phaseName", F.concat(F.lit("phase_"), F.col("PID").cast("string"))),
            "phases",
        )
        first = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(
            F.year(F.min("o_orderdate"))).first()[0]
        last = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(
            F.year(F.max("l_shipdate"))).first()[0]
        calendar = stage(calendar_between(spark, first - 1, last + 2), "calendar")
        _dimensions[key] = (dictionary, phases, calendar)
    return _dimensions[key]


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Build the six source tables from the parquet files in `sf_dir`."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed(
        "c_custkey", "o_custkey")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dictionary, phases, calendar = _dimension_tables(spark, sf_dir)
    return Warehouse(
        orders=_select(orders, ORDERS),
        attributes=_select(orders.join(customers, "o_custkey"), ATTRIBUTES),
        tasks=_select(items, TASKS),
        dictionary=dictionary,
        phases=phases,
        calendar=calendar,
    ).checked()
