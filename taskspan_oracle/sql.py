"""DuckDB SQL for the registered queries.

Only the mapping from the test tables to the six source tables is shared with the library; the rest
is stated again in SQL, with plain windows, row-level expansions and direct aggregates.
"""

from __future__ import annotations

from taskspan.sources import mapping

ORACLES: dict[str, str] = {}

_TRAIN = mapping.TRAIN_WINDOW
_TEST = mapping.TEST_WINDOW

# ---- the six source tables -------------------------------------------------------------------


def _list(columns: dict[str, str]) -> str:
    return ",\n  ".join(f"{expression} as {name}" for name, expression in columns.items())


_CTES: dict[str, str] = {
    "w_orders": f"select {_list(mapping.ORDERS)} from orders",
    "w_attributes": f"select {_list(mapping.ATTRIBUTES)} "
                    "from orders join customer on o_custkey = c_custkey",
    "w_tasks": f"select {_list(mapping.TASKS)} from lineitem",
    "w_dictionary": """
        select r as SubIntID,
          concat('task_', cast(case when r = 40 then 40 else r % 37 end as string)) as SubIntervalName,
          cast(r % 5 as int) as PID,
          cast(case when r = 39 then 1 else 0 end as int) as isfdtask
        from (select distinct cast(case when p_partkey in (17, 1017) then 40
                                        else p_partkey % 40 end as int) as r from part)""",
    "w_phases": """
        select distinct PID, concat('phase_', cast(PID as string)) as phaseName from w_dictionary""",
    "w_calendar": f"""
        select cast(d as date) as date, cast(dayofyear(d) as int) as daynuminyear,
          case when isodow(d) >= 6 or strftime(d, '%m-%d') in ('01-01', '07-04', '12-25')
               then 0 else 1 end as isworkday
        from (select unnest(generate_series(
                cast(make_date(cast(a as int), 1, 1) as timestamp),
                cast(make_date(cast(b as int), 12, 31) as timestamp), interval 1 day)) as d
              from (select (select year(min(o_orderdate)) - 1 from orders) as a,
                           (select year(max(l_shipdate)) + 2 from lineitem) as b))""",
    "w_off": f"""
        select date from w_calendar
        where isworkday = 0 and year(date) >= {mapping.NONWORK_FROM_YEAR}""",
}

# ---- extracts --------------------------------------------------------------------------------

_RULES = """o.sourceSystem in ('CORE', 'Netbuild', 'BPM-QS') and o.inidordertype <> 3
          and rtrim(o.orderAction) not in ('None', '')"""

_CLEAN_TEXT = """
          coalesce(o.ProjectType, 'None') as ProjectType,
          case when o.T_projecttype is null or rtrim(o.T_projecttype) = '' then 'None'
               else o.T_projecttype end as T_projecttype,
          coalesce(o.IMPPOS2, 'None') as IMPPOS2,
          case when o.orderclasstype is null or rtrim(o.orderclasstype) in ('', 'Null') then 'None'
               else o.orderclasstype end as orderClassType,
          o.orderAction as orderAction,
          case when a.orderDescription is null or rtrim(a.orderDescription) = '' then 'None'
               else a.orderDescription end as orderDescription,
          coalesce(o.is3rdpartycoloneeded, 'false') as is3rdpartycoloneeded,
          coalesce(a.creatorGroup, 'None') as creatorGroup,
          coalesce(a.WorkGroup, 'None') as WorkGroup,
          coalesce(a.PDNOrder, 'false') as PDNOrder,
          coalesce(a.IsBuildingAdd, 'false') as isBuildingAdd,
          coalesce(o.categoryCd, 'None') as categoryCD,
          coalesce(a.QtyOfCircuits, 0) as QtyOfCircuits,
          case when a.Expedite is null or rtrim(a.Expedite) = '' then 'N'
               else a.Expedite end as Expedite,
          coalesce(t.taskJeop, 'None') as taskJeop"""


def _star(start: str, complete: str) -> str:
    return f"""
        from w_orders o
        join w_attributes a on a.sourcekey = o.sourcekey
        join w_tasks t on t.sourcekey = o.sourcekey
        join w_dictionary d on d.SubIntID = t.subIntID
        join w_phases p on p.PID = d.PID
        join w_calendar b on b.date = t.{start}
        join w_calendar e on e.date = t.{complete}"""


def _extract(window: tuple[str, str], start: str, complete: str, ids: bool) -> str:
    names = ("startdate", "completedate") if ids else ("startDate", "completeDate")
    return f"""
        select distinct o.orderID, t.subIntID, {"t._id, t.taskid," if ids else ""}
          d.SubIntervalName as subIntervalName, t.owner, d.PID, p.phaseName, o.sourceSystem,
          t.{start} as {names[0]}, t.{complete} as {names[1]},
          e.daynuminyear - b.daynuminyear as subIntIntervalsDays, {_CLEAN_TEXT}
        {_star(start, complete)}
        where o.status = 'Completed' and {_RULES}
          and o.completedate between date '{window[0]}' and date '{window[1]}'
          and o.IncludedFlag in ('Y', 'F')
          and t.deleteind = 'N' and t.isinserted <> 1 and d.isfdtask = 0"""


def _clean(table: str, days: str) -> str:
    return f"""
        select * replace (
          case {days} when 0 then 1 else {days} end as {days},
          case orderAction when 'INS' then 'Install' when 'DIS' then 'Disconnect'
               else orderAction end as orderAction,
          case isBuildingAdd when 'False' then 'false' else isBuildingAdd end as isBuildingAdd,
          case is3rdpartycoloneeded when 'False' then 'false'
               else is3rdpartycoloneeded end as is3rdpartycoloneeded,
          case Expedite when 'No' then 'N' when 'Yes' then 'Y' else Expedite end as Expedite)
        from {table} where {days} >= 0"""


_COLUMNS = [
    "orderID", "subIntID", "subIntervalName", "owner", "PID", "phaseName", "sourceSystem",
    "startDate", "completeDate", "subIntIntervalsDays", "ProjectType", "T_projecttype", "IMPPOS2",
    "orderClassType", "orderAction", "orderDescription", "is3rdpartycoloneeded", "creatorGroup",
    "WorkGroup", "PDNOrder", "isBuildingAdd", "categoryCD", "QtyOfCircuits", "Expedite", "taskJeop",
]
_ALL = ", ".join(_COLUMNS)
_NULLS_FIRST = ", ".join(f"{c} nulls first" for c in _COLUMNS)
_KEYS = ("sourceSystem, subIntID, PID, orderAction, Expedite, orderDescription, orderClassType, "
         "T_projecttype, categoryCD")
_FEATURES = ("subIntID, sourceSystem, PID, orderClassType, T_projecttype, Expedite, orderAction, "
             "orderDescription, categoryCD")


def _quantiles(levels: dict[str, float]) -> str:
    return ", ".join(
        f"round(quantile_cont(subIntIntervalsDays, {p}), 6) as {name}"
        for name, p in levels.items())


# The deviation comes from whole-number sums: a running mean turns an exact .5 into .49999.
_LISTS = """
          select {keys}, list(cast(subIntIntervalsDays as double) order by subIntIntervalsDays) as v,
            cast(count(*) - 1 as double) as m, count(*) as n, min(subIntIntervalsDays) as low,
            max(subIntIntervalsDays) as high, avg(subIntIntervalsDays) as mean,
            case when count(*) > 1 then sqrt(cast(
                count(*) * sum(cast(subIntIntervalsDays as bigint) * subIntIntervalsDays)
                - sum(subIntIntervalsDays) * sum(subIntIntervalsDays) as double)
              / (count(*) * (count(*) - 1))) end as std
          from {table} group by {keys}"""


def _whole_quantiles(levels: dict[str, float]) -> str:
    """Rounded quantiles of the sorted list `v` with positions 0 to `m`.

    Between two neighbours the value is (high - position) * low + (position - low) * high, in this
    order of operations: it decides where values that end in .5 are rounded to.
    """
    return ", ".join(f"""
      round(case when m * {p} = floor(m * {p}) then v[cast(m * {p} as bigint) + 1]
        else (ceil(m * {p}) - m * {p}) * v[cast(floor(m * {p}) as bigint) + 1]
           + (m * {p} - floor(m * {p})) * v[cast(ceil(m * {p}) as bigint) + 1] end) as {name}"""
        for name, p in levels.items())


_P_TASK = _quantiles({"percentile_50": .5, "percentile_60": .6, "percentile_75": .75,
                      "percentile_80": .8, "percentile_95": .95, "percentile_99": .99})
_P_V2 = {"median": .5, "percentile_60": .6, "percentile_70": .7, "percentile_75": .75,
         "percentile_80": .8}

_CTES |= {
    "x_tasks": _extract(_TRAIN, "startDate", "completeDate", True),
    "x_quarter": _extract(("1998-04-01", "1998-06-30"), "startDate", "completeDate", True),
    "x_distinct": _extract(_TRAIN, "startDate", "completeDate", False),
    "x_test": _extract(_TEST, "originalstartDate", "originalcompleteDate", False),
    "x_orders": f"""
        select o.orderID, o.sourceSystem, e.daynuminyear - b.daynuminyear as orderIntervalDays,
          coalesce(o.ProjectType, 'None') as ProjectType,
          case when o.T_projecttype is null or rtrim(o.T_projecttype) = '' then 'None'
               else o.T_projecttype end as T_projecttype,
          coalesce(o.IMPPOS2, 'None') as IMPPOS2,
          case when o.orderclasstype is null or rtrim(o.orderclasstype) = '' then 'None'
               else o.orderclasstype end as orderClassType,
          o.ordertype as orderType, o.is3rdpartycoloneeded, a.creatorGroup,
          a.WorkGroup as workGroup, a.IsBuildingAdd as isBuildingAdd, o.categoryCd as categoryCD,
          o.orderAction,
          case when a.orderDescription is null or rtrim(a.orderDescription) = '' then 'None'
               else a.orderDescription end as orderDescription,
          case when a.Expedite is null or rtrim(a.Expedite) = '' then 'N'
               else a.Expedite end as Expedite,
          o.CLECILEC
        from w_orders o join w_attributes a on a.sourcekey = o.sourcekey
        join w_calendar b on b.date = o.orderWfStart
        join w_calendar e on e.date = o.completedate
        where o.completedate is not null and o.orderWfStart is not null and {_RULES}
          and o.status = 'Completed' and o.IncludedFlag in ('Y', 'F')
          and o.completedate between date '{_TRAIN[0]}' and date '{_TRAIN[1]}'""",
    "x_cancelled": f"""
        select distinct o.orderID, t.subIntID, d.SubIntervalName as subIntervalName, t.owner, d.PID,
          p.phaseName, o.sourceSystem, t.startDate as startdate, t.completeDate as completedate,
          e.daynuminyear - b.daynuminyear as subIntIntervalsDays,
          coalesce(o.ProjectType, 'None') as ProjectType,
          coalesce(o.T_projecttype, 'None') as T_projectType,
          coalesce(o.IMPPOS2, 'None') as IMPPOS2,
          coalesce(o.orderclasstype, 'None') as orderClassType,
          coalesce(o.ordertype, 'None') as orderType, o.orderAction,
          coalesce(a.orderDescription, 'None') as orderDescription,
          coalesce(o.is3rdpartycoloneeded, 'false') as is3rdpartycoloneeded,
          coalesce(a.creatorGroup, 'None') as creatorGroup,
          coalesce(a.WorkGroup, 'None') as WorkGroup, coalesce(a.PDNOrder, 'false') as PDNOrder,
          coalesce(a.IsBuildingAdd, 'false') as isBuildingAdd,
          coalesce(o.categoryCd, 'None') as categoryCD, coalesce(a.QtyOfCircuits, 0) as QtyOfCircuits,
          case when rtrim(a.Expedite) = '' then 'N' else a.Expedite end as Expedite,
          coalesce(t.taskJeop, 'None') as taskJeop
        {_star("startDate", "completeDate")}
        where {_RULES} and o.IncludedFlag = 'Y' and o.status = 'Cancelled'
          and t.completeDate between date '{_TRAIN[0]}' and date '{_TRAIN[1]}'
          and t.taskJeop in ('AMO_VOIDEP(Voice Dependency)', 'AMO_911DEP(e911 Dependency)')
          and e.daynuminyear - b.daynuminyear >= 0""",
    "c_tasks": _clean("x_tasks", "subIntIntervalsDays"),
    "c_test": _clean("x_test", "subIntIntervalsDays"),
    "c_orders": _clean("x_orders", "orderIntervalDays"),
    # ---- outliers
    "trimmed": f"""
        select * exclude (n, rn) from (
          select *, count(subIntIntervalsDays) over (partition by subIntervalName) as n,
            row_number() over (partition by subIntervalName order by subIntIntervalsDays,
              md5(concat_ws('|', orderID, subIntID, _id, taskid)), {_NULLS_FIRST}) as rn
          from c_tasks) where n >= 10 and rn > n // 10""",
    "trimmed_test": f"""
        select * exclude (n, rn) from (
          select *, count(*) over (partition by subIntervalName) as n,
            row_number() over (partition by subIntervalName order by subIntIntervalsDays,
              md5(concat_ws('|', {_ALL}))) as rn
          from c_test where taskJeop = 'None')
        where n <= 10 or (rn > n // 10 and rn <= 9 * n // 10)""",
    "thresholds": """
        select *, case Category when '0-10' then 30 when '11-30' then 90 when '31-90' then 180
                                when '90+' then 360 end as Outlier_threshold
        from (select *, case when percentile_99 <= 10 then '0-10' when percentile_99 <= 30 then '11-30'
                             when percentile_99 <= 90 then '31-90' when percentile_99 > 90 then '90+'
                        end as Category
              from (select subIntervalName, subIntID,
                      quantile_cont(subIntIntervalsDays, 0.99) as percentile_99
                    from trimmed group by all))""",
    "joined": """
        select t.*, s.Category, s.Outlier_threshold
        from trimmed t join thresholds s on s.subIntervalName = t.subIntervalName""",
    "kept": "select * from joined where subIntIntervalsDays <= Outlier_threshold",
    # ---- categories
    "rare": """
        select categoryCD, count(orderID) as orders from c_orders
        where sourceSystem = 'CORE' and categoryCD is not null
        group by categoryCD having count(orderID) < 100""",
    "binned": f"""
        select {_ALL.replace("categoryCD", "case when categoryCD in (select categoryCD from rare) "
                             "then 'Others' else categoryCD end as categoryCD")} from kept""",
    "slim": "select " + _ALL.replace("startDate", 'startdate as "startDate"').replace(
        "completeDate", 'completedate as "completeDate"') + " from c_tasks",
}


def _merge(table: str, prefix: str) -> dict[str, str]:
    """Rework merge of a task table: one row per order and task."""
    rest = [c for c in _COLUMNS if c not in ("orderID", "subIntID", "startDate", "completeDate")]
    firsts = ", ".join(
        f"arg_min({c}, rn) as {c}" for c in _COLUMNS if c not in ("orderID", "subIntID"))
    return {
        f"{prefix}_first": f"""
            select orderID, subIntID, count(subIntervalName) as "count", {firsts}
            from (select *, row_number() over (partition by orderID, subIntID
                    order by startDate nulls first, completeDate nulls first,
                    {", ".join(f"{c} nulls first" for c in rest)}) as rn from {table})
            group by orderID, subIntID having count(subIntervalName) >= 1""",
        f"{prefix}_dates": f"""
            select orderID, subIntID, count(*) as business_days,
              string_agg(strftime(day, '%Y-%m-%d'), ',' order by day) as B_dates
            from (select distinct orderID, subIntID,
                    cast(unnest(generate_series(cast(startDate as timestamp),
                      cast(completeDate as timestamp), interval 1 day)) as date) as day
                  from {table} where startDate <= completeDate)
            where day not in (select date from w_off) group by orderID, subIntID""",
        prefix: f"""
            select {", ".join("f." + c for c in _COLUMNS if c != "subIntIntervalsDays")},
              cast(case when f."count" > 1 then coalesce(d.business_days, 0)
                   else f.subIntIntervalsDays end as int) as subIntIntervalsDays,
              f."count", coalesce(d.B_dates, '') as B_dates
            from {prefix}_first f left join {prefix}_dates d
              on d.orderID = f.orderID and d.subIntID = f.subIntID""",
    }


_CTES |= _merge("slim", "m_tasks") | _merge("binned", "m_train")
_CTES |= {
    "train": """
        select orderID, subIntID, subIntervalName, sourceSystem, PID, phaseName, orderClassType,
          T_projecttype, Expedite, orderAction, orderDescription, categoryCD,
          case subIntIntervalsDays when 0 then 1 else subIntIntervalsDays end as subIntIntervalsDays
        from m_train""",
    "test": f"select {_ALL} from trimmed_test union all select {_ALL} from c_test "
            "where taskJeop <> 'None'",
    "days": """
        select * replace (case subIntIntervalsDays when 0 then 1 else subIntIntervalsDays end
                          as subIntIntervalsDays) from m_train""",
    "types": """
        select d.SubIntID as subIntID, d.SubIntervalName as subIntervalName, d.PID, p.phaseName
        from w_dictionary d join w_phases p on p.PID = d.PID where d.isfdtask = 0""",
    "cfg": f"""
        select concat(sourceSystem || '|' || subIntID || '|' || PID || '|' || orderAction || '|'
            || Expedite || '|' || orderDescription || '|' || orderClassType || '|'
            || T_projecttype || '|' || categoryCD) as config,
          sourceSystem, cast(subIntID as string) as subIntID, cast(PID as string) as PID, orderAction,
          Expedite, orderDescription, orderClassType, T_projecttype, categoryCD,
          n as "count", low as "min", round(mean) as mean, {_whole_quantiles(_P_V2)},
          high as "max", round(std) as stddev
        from ({_LISTS.format(keys=_KEYS, table="train")})""",
    "cfg_named": """
        select c.config, c.sourceSystem, c.subIntID, t.subIntervalName, c.PID, t.phaseName,
          c.* exclude (config, sourceSystem, subIntID, PID)
        from cfg c join types t on cast(t.subIntID as string) = c.subIntID""",
    "looked": f"""
        select t.* rename (subIntIntervalsDays as Actual),
          coalesce(c.q, s.q, (select quantile_cont(subIntIntervalsDays, 0.75) from train))
            as Prediction
        from test t
        left join (select {_KEYS}, quantile_cont(subIntIntervalsDays, 0.75) as q
                   from train group by {_KEYS}) c
          on {" and ".join(f"c.{k} = t.{k}" for k in _KEYS.split(", "))}
        left join (select subIntID, quantile_cont(subIntIntervalsDays, 0.75) as q
                   from train group by subIntID) s on s.subIntID = t.subIntID""",
}


def _needed(text: str) -> list[str]:
    """CTE names a statement mentions, dependencies first."""
    import re

    found: list[str] = []

    def visit(sql: str) -> None:
        words = set(re.findall(r"\b(?:from|join)\s+(\w+)", sql))
        for name in _CTES:
            if name in words and name not in found:
                visit(_CTES[name])
                found.append(name)

    visit(text)
    return found


def _oracle(name: str, sql: str) -> None:
    ctes = ",\n".join(f"{cte} as ({_CTES[cte]})" for cte in _needed(sql))
    ORACLES[name] = f"with {ctes}\n{sql}"


_oracle("extract_tasks", "select * from x_tasks")
_oracle("extract_tasks_original", "select * from x_test")
_oracle("extract_quarter_by_month", "select * from x_quarter")
_oracle("extract_orders", "select * from x_orders")
_oracle("extract_cancelled", "select * from x_cancelled")
_oracle("nonworkdays", "select date from w_off")
_oracle("task_dictionary", "select * from types")
_oracle("write_read_roundtrip", "select * from c_tasks")
_oracle("published_swap", "select * from c_tasks")
_oracle("stage_counts", " union all ".join(
    f"select '{stage}' as stage, count(*) as rows from {cte}" for stage, cte in (
        ("extracted", "x_tasks"), ("cleaned", "c_tasks"), ("trimmed", "trimmed"),
        ("thresholded", "kept"), ("binned", "binned"), ("merged", "m_train"))))
_oracle("project_case_insensitive",
        'select orderID, taskid as "taskID", startdate as "startDate", '
        'completedate as "completeDate", WorkGroup as "workGroup" from x_tasks')
_oracle("filter_ne_null", "select taskid, _id, isinserted from w_tasks where isinserted <> 1")
_oracle("filter_not_in", "select orderID, orderAction from w_orders "
                         "where rtrim(orderAction) not in ('None', '')")
_oracle("filter_between", "select orderID, completedate from w_orders where completedate "
                          f"between date '{_TRAIN[0]}' and date '{_TRAIN[1]}'")
_oracle("clean_tasks", "select * from c_tasks")
_oracle("clean_orders", "select * from c_orders")
_oracle("clean_test", "select * from c_test")
_oracle("tasks_min_count", """
    select * from c_tasks where subIntervalName in (
      select subIntervalName from c_tasks group by subIntervalName
      having count(subIntIntervalsDays) >= 10)""")
_oracle("split_jeop", """
    select orderID, subIntID, taskJeop,
      case when taskJeop = 'None' then 'none' else 'jeop' end as part from c_test""")
_oracle("slice_tasks", """
    select * from kept where subIntervalName = 'task_0'
      and T_projecttype = 'Mileage Reduction' and orderAction = 'Grooms'""")
_oracle("slice_stats", """
    select * from cfg_named where subIntervalName = 'task_0'
      and T_projecttype = 'Mileage Reduction' and orderDescription = 'Offnet Groom'""")
_oracle("distinct_tasks", "select * from x_distinct")
_oracle("star_join", """
    select o.sourcekey, t.taskid, o.orderID, o.status, d.SubIntervalName as subIntervalName,
      p.phaseName, a.orderDescription, a.creatorGroup
    from w_orders o join w_attributes a on a.sourcekey = o.sourcekey
    join w_tasks t on t.sourcekey = o.sourcekey
    join w_dictionary d on d.SubIntID = t.subIntID join w_phases p on p.PID = d.PID""")
_oracle("calendar_interval", """
    select t.taskid, t._id, t.startDate, t.completeDate,
      e.daynuminyear - b.daynuminyear as subIntIntervalsDays,
      cast(date_diff('day', t.startDate, t.completeDate) as int) as elapsedDays
    from w_tasks t join w_calendar b on b.date = t.startDate
    join w_calendar e on e.date = t.completeDate""")
_oracle("stats_backjoin_fanout", """
    select b.subIntervalName, b.rows_before, a.rows_after
    from (select subIntervalName, count(*) as rows_before from trimmed group by all) b
    join (select subIntervalName, count(*) as rows_after from joined group by all) a
      on a.subIntervalName = b.subIntervalName""")
_oracle("task_repeat_count", """
    select orderID, subIntID, taskid, _id,
      count(subIntervalName) over (partition by orderID, subIntID) as "count" from c_tasks""")
_oracle("business_dates", """
    select c.orderID, c.taskid, c._id, c.startdate, c.completedate,
      cast(count(x.day) as int) as business_days,
      coalesce(string_agg(strftime(x.day, '%Y-%m-%d'), ',' order by x.day), '') as B_dates
    from c_tasks c left join (
      select k.date as day from w_calendar k
      where k.date not in (select date from w_off)) x
      on x.day between c.startdate and c.completedate
    group by all""")
_oracle("task_counts", """
    select subIntervalName, count(subIntIntervalsDays) as "count" from c_tasks group by all""")
_oracle("task_stats", f"""
    select subIntervalName, subIntID, count(subIntIntervalsDays) as "count",
      round(avg(subIntIntervalsDays), 6) as mean, round(stddev_samp(subIntIntervalsDays), 6) as std,
      min(subIntIntervalsDays) as "min", {_P_TASK}, max(subIntIntervalsDays) as "max"
    from trimmed group by subIntervalName, subIntID""")
_oracle("task_stats_v2", f"""
    select subIntervalName, subIntID, count(subIntIntervalsDays) as "count",
      round(avg(subIntIntervalsDays), 6) as mean, round(stddev_samp(subIntIntervalsDays), 6) as std,
      min(subIntIntervalsDays) as "min", {_quantiles(_P_V2)}, max(subIntIntervalsDays) as "max"
    from c_tasks group by subIntervalName, subIntID""")
_oracle("task_stats_merged", f"""
    select subIntervalName, subIntID, count(subIntIntervalsDays) as "count",
      round(avg(subIntIntervalsDays), 6) as mean, round(stddev_samp(subIntIntervalsDays), 6) as std,
      min(subIntIntervalsDays) as "min", {_quantiles(_P_V2)}, max(subIntIntervalsDays) as "max"
    from c_tasks group by subIntervalName, subIntID""")
_oracle("config_stats_merged", "select * from cfg")
_oracle("backoff_quantiles", f"""
    select cast(case grouping({_KEYS}) when 0 then 0 when 383 then 1 else 2 end as int) as level,
      {_KEYS}, round(quantile_cont(subIntIntervalsDays, 0.75), 6) as quantile
    from train group by grouping sets (({_KEYS}), (subIntID), ())""")
_oracle("config_stats", "select * from cfg")
_oracle("config_stats_named", "select * from cfg_named")
_oracle("config_stats_wide", f"""
    select {_KEYS}, is3rdpartycoloneeded, isBuildingAdd, n as "count", round(mean) as mean,
      round(std) as std, low as "min",
      {_whole_quantiles({"percentile_25": .25, "median": .5, "percentile_60": .6,
                         "percentile_75": .75, "percentile_80": .8, "percentile_99": .99})},
      high as "max"
    from ({_LISTS.format(keys=_KEYS + ", is3rdpartycoloneeded, isBuildingAdd", table="days")})""")
_oracle("stats_reconcile", """
    select 'before' as step, count(*) as configs, cast(sum("count") as bigint) as rows from cfg
    union all
    select 'after' as step, count(*) as configs, cast(sum("count") as bigint) as rows
    from cfg_named""")
_oracle("task_size_split", """
    select count(*) filter (where n >= 10) as tasks_enough,
      count(*) filter (where n < 10) as tasks_few
    from (select count(subIntIntervalsDays) as n from c_tasks group by subIntervalName)""")
_oracle("rare_categories", "select * from rare")
_oracle("category_nunique", "select count(distinct categoryCD) as n_unique from c_orders")
_oracle("category_value_counts", """
    select categoryCD, count(*) as "count" from c_orders where categoryCD is not null
    group by categoryCD order by "count" desc, categoryCD""")
_FLAG = "case when taskJeop = 'None' then 'N' else 'Y' end as taskJeop_flagged"
_oracle("jeop_flag_counts", f"""
    select taskJeop_flagged, count(*) as "count" from (select {_FLAG} from m_train)
    group by taskJeop_flagged order by "count" desc, taskJeop_flagged""")
_oracle("interval_describe", """
    select count(*) as "count", round(avg(subIntIntervalsDays), 5) as mean,
      round(stddev_samp(subIntIntervalsDays), 5) as std, min(subIntIntervalsDays) as "min",
      round(quantile_cont(subIntIntervalsDays, 0.25), 5) as percentile_25,
      round(quantile_cont(subIntIntervalsDays, 0.5), 5) as percentile_50,
      round(quantile_cont(subIntIntervalsDays, 0.75), 5) as percentile_75,
      max(subIntIntervalsDays) as "max" from c_tasks""")
_oracle("trim_bottom", "select * from trimmed")
_oracle("trim_both", "select * from trimmed_test")
_oracle("p99_category", "select * replace (round(percentile_99, 6) as percentile_99) from thresholds")
_oracle("threshold_outliers", "select * from kept")
_oracle("head_rework", """
    select orderID, subIntID, startdate as "startDate", completedate as "completeDate", taskid,
      n as "count"
    from (select *, count(subIntervalName) over (partition by orderID, subIntID) as n from c_tasks)
    where n > 1 order by orderID, subIntID, startdate, completedate, taskid limit 5""")
_oracle("union_by_name", """
    select *, case when taskJeop <> 'None' then 'Y' end as taskJeop_flagged from c_test""")
_oracle("with_cancelled", f"""
    select {_ALL} from slim union all
    select {_ALL} from (select * replace (
      case subIntIntervalsDays when 0 then 1 else subIntIntervalsDays end as subIntIntervalsDays,
      case isBuildingAdd when 'False' then 'false' else isBuildingAdd end as isBuildingAdd)
      from x_cancelled)""")
_oracle("null_defaults", """
    select sourcekey, coalesce(creatorGroup, 'None') as creatorGroup,
      coalesce(WorkGroup, 'None') as WorkGroup, coalesce(PDNOrder, 'false') as PDNOrder,
      coalesce(IsBuildingAdd, 'false') as IsBuildingAdd,
      coalesce(QtyOfCircuits, 0) as QtyOfCircuits from w_attributes""")
_oracle("blank_to_none", """
    select o.sourcekey,
      case when o.T_projecttype is null or rtrim(o.T_projecttype) = '' then 'None'
           else o.T_projecttype end as T_projecttype,
      case when o.orderclasstype is null or rtrim(o.orderclasstype) in ('', 'Null') then 'None'
           else o.orderclasstype end as orderClassType,
      case when a.orderDescription is null or rtrim(a.orderDescription) = '' then 'None'
           else a.orderDescription end as orderDescription,
      case when a.Expedite is null or rtrim(a.Expedite) = '' then 'N'
           else a.Expedite end as Expedite,
      case when rtrim(a.Expedite) = '' then 'N' else a.Expedite end as Expedite_or_missing
    from w_orders o join w_attributes a on a.sourcekey = o.sourcekey""")
_oracle("bin_rare_categories", """
    select * replace (case when categoryCD in (select categoryCD from rare) then 'Others'
                           else categoryCD end as categoryCD) from c_tasks""")
_oracle("jeop_flag", f"select orderID, subIntID, {_FLAG} from m_train")
_oracle("config_key", 'select config, "count" from cfg')
_oracle("round_predictions",
        "select orderID, subIntID, round_even(Prediction, 0) as Prediction from looked")
_oracle("rework_days", """
    select orderID, subIntID, "count", subIntIntervalsDays as days from m_tasks where "count" > 1""")
_oracle("rework_merge", "select * from m_tasks")
_oracle("prepare_train", "select * from m_train")
_oracle("prepare_test", "select * from test")
_oracle("train_table", "select * from train")
_oracle("train_features", f"select orderID, {_FEATURES}, subIntIntervalsDays from train")
_oracle("test_features", f"select orderID, {_FEATURES}, subIntIntervalsDays from test")
_oracle("category_index", "select t.orderID, t.subIntID, " + ", ".join(
    f"i{i}.position as {c}_index" for i, c in enumerate(_FEATURES.split(", "))
) + " from train t " + " ".join(f"""
    join (select {c}, cast(row_number() over (order by count(*) desc, cast({c} as string)) - 1
            as int) as position from train group by {c}) i{i} on i{i}.{c} = t.{c}"""
    for i, c in enumerate(_FEATURES.split(", "))))
_oracle("unseen_categories", " union all ".join(f"""
    select '{c}' as feature, cast({c} as string) as category, count(*) as rows from test
    where {c} not in (select {c} from train) group by {c}""" for c in _FEATURES.split(", ")))
_oracle("quantile_lookup", f"""
    select orderID, {_FEATURES}, Actual, round(Prediction, 6) as Prediction from looked""")
_oracle("eval_metrics", """
    select count(*) as n, round(sqrt(avg((Actual - Prediction) ** 2)), 6) as rmse,
      round(avg(abs(Actual - Prediction)), 6) as mae,
      round(1 - sum((Actual - Prediction) ** 2) / sum((Actual - m) ** 2), 6) as r2,
      round(median(abs(Actual - Prediction)), 6) as median_ae
    from (select Actual, Prediction, avg(Actual) over () as m from looked)""")
_oracle("pinball_loss", """
    select round(avg(case when Actual >= Prediction then 0.75 * (Actual - Prediction)
                          else 0.25 * (Prediction - Actual) end), 6) as pinball_loss,
      round(avg(case when Actual <= Prediction then 1.0 else 0.0 end), 6) as coverage
    from looked""")
_BASE = "(select quantile_cont(subIntIntervalsDays, 0.75) from train)"
_oracle("boost_start", " union all ".join(f"""
    select '{c}' as feature, cast({c} as string) as category, {_BASE} as base, count(*) as rows,
      round(cast(sum(case when subIntIntervalsDays > {_BASE} then 0.75 else -0.25 end) as double), 6)
        as gradient
    from train group by {c}""" for c in _FEATURES.split(", ")))
_oracle("boost_leaves", f"""
    select PID, quantile_cont(subIntIntervalsDays - {_BASE}, 0.75) as value from train group by PID""")
_oracle("scored_columns",
        f"select orderID, {_FEATURES}, subIntIntervalsDays as Actual from test")
