"""Table layouts, fixed values and the schema check used at stage boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- Fixed values: names and literals that results depend on ---------------------------------

SOURCE_SYSTEMS = ("CORE", "Netbuild", "BPM-QS")
INCLUDED_FLAGS = ("Y", "F")
EXCLUDED_ORDER_TYPE = 3
DEPENDENCY_CODES = ("AMO_VOIDEP(Voice Dependency)", "AMO_911DEP(e911 Dependency)")
ORDER_ACTION_NAMES = {"INS": "Install", "DIS": "Disconnect"}
EXPEDITE_NAMES = {"No": "N", "Yes": "Y"}
BOOLEAN_NAMES = {"False": "false"}
RARE_LABEL = "Others"
MIN_CATEGORY_ORDERS = 100
MIN_TASK_ROWS = 10
TRIM_FRACTION = 0.1
# (label, highest P99 in the bucket, days a task of the bucket may take)
P99_BUCKETS = (("0-10", 10, 30), ("11-30", 30, 90), ("31-90", 90, 180), ("90+", None, 360))

DAYS = "subIntIntervalsDays"

TASK_COLUMNS = (
    "orderID", "subIntID", "subIntervalName", "owner", "PID", "phaseName", "sourceSystem",
    "startDate", "completeDate", "subIntIntervalsDays", "ProjectType", "T_projecttype", "IMPPOS2",
    "orderClassType", "orderAction", "orderDescription", "is3rdpartycoloneeded", "creatorGroup",
    "WorkGroup", "PDNOrder", "isBuildingAdd", "categoryCD", "QtyOfCircuits", "Expedite", "taskJeop",
)
TASK_IDS = ("orderID", "subIntID", "_id", "taskid")
FEATURES = (
    "subIntID", "sourceSystem", "PID", "orderClassType", "T_projecttype", "Expedite",
    "orderAction", "orderDescription", "categoryCD",
)
CONFIG_KEYS = (
    "sourceSystem", "subIntID", "PID", "orderAction", "Expedite", "orderDescription",
    "orderClassType", "T_projecttype", "categoryCD",
)
TRAIN_COLUMNS = (
    "orderID", "subIntID", "subIntervalName", "sourceSystem", "PID", "phaseName",
    "orderClassType", "T_projecttype", "Expedite", "orderAction", "orderDescription", "categoryCD",
    "subIntIntervalsDays",
)
CONFIG_STATS_COLUMNS = (
    "config", "sourceSystem", "subIntID", "subIntervalName", "PID", "phaseName", "orderAction",
    "Expedite", "orderDescription", "orderClassType", "T_projecttype", "categoryCD", "count",
    "min", "mean", "median", "percentile_60", "percentile_70", "percentile_75", "percentile_80",
    "max", "stddev",
)

# ---- Source tables ---------------------------------------------------------------------------

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SOURCE_SCHEMAS = {
    "orders": _struct(
        orderID=_S, sourcekey=_L, sourceSystem=_S, status=_S, inidordertype=_I, orderAction=_S,
        IncludedFlag=_S, ProjectType=_S, T_projecttype=_S, orderclasstype=_S, IMPPOS2=_S,
        ordertype=_S, is3rdpartycoloneeded=_S, categoryCd=_S, orderWfStart=_D, completedate=_D,
        CLECILEC=_S,
    ),
    "attributes": _struct(
        sourcekey=_L, orderDescription=_S, creatorGroup=_S, WorkGroup=_S, PDNOrder=_S,
        IsBuildingAdd=_S, QtyOfCircuits=_I, Expedite=_S,
    ),
    "tasks": _struct(
        sourcekey=_L, subIntID=_I, _id=_I, taskid=_S, owner=_S, startDate=_D, completeDate=_D,
        originalstartDate=_D, originalcompleteDate=_D, deleteind=_S, isinserted=_I, taskJeop=_S,
    ),
    "dictionary": _struct(SubIntID=_I, SubIntervalName=_S, PID=_I, isfdtask=_I),
    "phases": _struct(PID=_I, phaseName=_S),
    "calendar": _struct(date=_D, daynuminyear=_I, isworkday=_I),
}

TASK_SCHEMA = T.StructType([
    T.StructField(
        name,
        _I if name in ("subIntID", "PID", DAYS, "QtyOfCircuits")
        else _D if name in ("startDate", "completeDate")
        else _S,
    )
    for name in TASK_COLUMNS
])

# Keys the warehouse may hold as text or as numbers.
_KEY_COLUMNS = ("orderid", "sourcekey", "_id", "taskid")
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_MOMENT = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, _WHOLE):
        return "whole"
    if isinstance(data_type, _MOMENT):
        return "moment"
    return data_type.typeName()


def check_schema(df: DataFrame, expected: T.StructType, name: str) -> DataFrame:
    """Return `df` unchanged, or fail naming the missing or mistyped columns.

    Names match without regard to case, whole numbers of any width match each other, and so do
    dates and timestamps: the warehouse decides those. Keys may be text or whole numbers.
    """
    have = {f.name.lower(): _kind(f.dataType) for f in df.schema.fields}

    def accepted(column: T.StructField) -> tuple[str, ...]:
        key = column.name.lower() in _KEY_COLUMNS
        return ("string", "whole") if key else (_kind(column.dataType),)

    wrong = [
        f"{f.name}: expected {' or '.join(accepted(f))}, found {have.get(f.name.lower(), 'nothing')}"
        for f in expected.fields
        if have.get(f.name.lower()) not in accepted(f)
    ]
    if wrong:
        raise ValueError(f"{name} does not have the expected columns: " + "; ".join(wrong))
    return df
