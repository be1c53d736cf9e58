"""Queries of the general data problems: nested records (3), hierarchies (4), attributes as of event time (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import entity_key
from tidemark.operators.asof import known_at
from tidemark.operators.hierarchy import descendants, hierarchies
from tidemark.operators.nested import json_elements, json_values
from tidemark.session import table


def _records(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "run_history").select(
        "execution_arn",
        "event_id",
        F.col("execution_started_event_details.input").alias("started"),
        F.col("state_entered_event_details.input").alias("entered"),
        F.lit(None).cast("string").alias("output"),
    )
    runs = table(spark, sf, "run_executions").select("execution_arn", F.lit(0).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("started"), F.lit(None).cast("string").alias("entered"), "output")
    # events are delivered twice; equal texts of one event are one record
    return events.filter("started is not null or entered is not null").unionByName(runs.filter("output is not null")).distinct()


_KEYS, _TEXTS = ["execution_arn", "event_id"], ["started", "entered", "output"]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = json_elements(_records(spark, sf), _KEYS, _TEXTS).select("execution_arn", "event_id", F.col("path").alias("element_path"), F.col("parent").alias("parent_path"))
    return found.distinct()


def p3_members(spark: SparkSession, sf: str) -> DataFrame:
    """The table of scalar members and elements, each with its enclosing element."""
    values = json_values(_records(spark, sf), _KEYS, _TEXTS)
    return values.select("execution_arn", "event_id", "text_column", F.col("path").alias("value_path"), F.col("parent").alias("parent_path"), "member", "position", "value").distinct()


def _placed(spark: SparkSession, sf: str, paths: bool) -> DataFrame:
    return hierarchies(table(spark, sf, "run_history"), group="execution_arn", node="event_id", parent="previous_event_id", version="recorded_at", paths=paths)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    placed = _placed(spark, sf, False).filter("kind != 'tree'")
    return placed.select("execution_arn", "event_id", "kind", F.col("top").alias("top_event_id"), F.col("depth").alias("node_depth"))


def p4_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with its path from the top, depth, top event and number of descendants."""
    placed = _placed(spark, sf, True)
    return placed.select("execution_arn", "event_id", "kind", F.col("top").alias("top_event_id"), F.col("depth").alias("node_depth"), "path", "n_descendants")


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every descendant of every event with its distance, on loops too."""
    below = descendants(table(spark, sf, "run_history"), group="execution_arn", node="event_id", parent="previous_event_id", version="recorded_at")
    return below.select("execution_arn", "event_id", F.col("descendant").alias("descendant_event_id"), "distance")


def _as_of(spark: SparkSession, sf: str, carry: dict) -> DataFrame:
    signals = table(spark, sf, "alpha_signals")
    filings = table(spark, sf, "rag_documents").filter("doc_type is distinct from 'news'")
    filed = F.col("filed_date").cast("timestamp_ntz")
    return known_at(
        signals,
        filings,
        entity=entity_key(F.col("ticker")),
        event_time=F.col("signal_ts"),
        change_entity=entity_key(F.col("ticker")),
        available_at=F.when(filed.isNotNull() & F.col("ingested_at").isNotNull(), F.greatest(filed, F.col("ingested_at"))),
        rank=[F.col("filed_date"), F.col("ingested_at")],
        tie=F.col("id"),
        carry=carry,
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _as_of(spark, sf, {"document_id": F.col("id")}).filter("document_id is not null").select("signal_id", "document_id").distinct()


def p6_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal row with the filing in force and known at its time, null where there is none."""
    carry = {"document_id": F.col("id"), "doc_type": F.col("doc_type"), "filed_date": F.col("filed_date"), "filing_title": F.col("title")}
    out = _as_of(spark, sf, carry)
    return out.select("signal_id", "ticker", "signal_ts", "score", "horizon_days", "market_regime", "received_at", *carry)


_KEY = r"nullif(upper(regexp_replace(ticker, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), '')"

_ASOF_SQL = f"""
with s as (select *, {_KEY} as tk from alpha_signals),
d as (select *, {_KEY} as tk from rag_documents where doc_type is distinct from 'news' and filed_date is not null and ingested_at is not null)
"""

_P4_SQL = """
with recursive n as (
  select execution_arn g, event_id id, arg_max(coalesce(previous_event_id, 0), recorded_at) p from run_history
  where execution_arn is not null and event_id is not null group by 1, 2),
l as (select n.*, m.id nxt from n left join n m on m.g = n.g and m.id = n.p and n.p <> 0),
down as (
  select g, id, case when p = 0 then 'tree' else 'detached' end kind, id top, 0::bigint depth from l where nxt is null
  union all select l.g, l.id, down.kind, down.top, down.depth + 1 from l join down on l.g = down.g and l.nxt = down.id),
rest as (select l.g, l.id, l.nxt from l anti join down on l.g = down.g and l.id = down.id),
walk as (
  select g, id, nxt cur, 1::bigint step from rest
  union all select walk.g, walk.id, rest.nxt, step + 1 from walk join rest on rest.g = walk.g and rest.id = walk.cur
  where walk.cur <> walk.id and step <= (select max(c) from (select count(*) c from rest group by g))),
loop as (select g, id, max(step) len from walk where cur = id group by 1, 2),
low as (select loop.g, loop.id, least(loop.id, min(walk.cur)) top from loop join walk on walk.g = loop.g and walk.id = loop.id group by 1, 2),
hang as (select walk.g, walk.id, min_by(low.top, step) top, min(step) depth from walk join low on low.g = walk.g and low.id = walk.cur
  where (walk.g, walk.id) not in (select (g, id) from low) group by 1, 2)
select g execution_arn, id event_id, kind, top top_event_id, depth node_depth from down where kind = 'detached'
union all select g, id, 'cycle', top, 0 from low
union all select g, id, 'below_cycle', top, depth from hang
"""


_OPENED = r"case when json_type({c}) = 'VARCHAR' and regexp_matches({c} ->> '$', '^\s*[\[{{]') and json_valid({c} ->> '$') and json_type(({c} ->> '$')::json) in ('OBJECT', 'ARRAY') then ({c} ->> '$')::json else {c} end"

_P3_SQL = f"""
with recursive t as (select distinct execution_arn g, event_id id, x from (
  select execution_arn, event_id, unnest([execution_started_event_details.input, state_entered_event_details.input]) x from run_history
  union all select execution_arn, 0, output from run_executions) where x is not null and json_valid(x)),
r as (select g, id, {_OPENED.format(c='x::json')} j, '$' path, '$' parent, false el from t),
w as (select g, id, j, path, parent, el from r
  union all select g, id, {_OPENED.format(c='c')}, path || s, case when is_object and el then path else parent end, not is_object
  from (select g, id, path, parent, el, json_type(j) = 'OBJECT' is_object,
    unnest(case json_type(j) when 'OBJECT' then list_transform(json_keys(j), lambda k: '.' || k) when 'ARRAY' then list_transform(range(json_array_length(j)::bigint), lambda i: '[' || i || ']') else [] end) s,
    unnest(case json_type(j) when 'OBJECT' then json_extract(j, '$.*') when 'ARRAY' then json_extract(j, '$[*]') else [] end) c from w))
select distinct g execution_arn, id event_id, path element_path, parent parent_path from w where el and json_type(j) = 'OBJECT'
"""


def queries() -> dict:
    return {"p3_found": p3_found, "p3_members": p3_members, "p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants, "p6_found": p6_found, "p6_enriched": p6_enriched}


def oracle_sql() -> dict[str, str]:
    best = "order by d.filed_date desc, d.ingested_at desc, d.id"
    join = "d.tk = s.tk and d.filed_date <= s.signal_ts::date and d.ingested_at <= s.signal_ts"
    return {
        "p3_found": _P3_SQL,
        "p4_found": _P4_SQL,
        "p6_found": f"{_ASOF_SQL} select distinct signal_id, document_id from (select s.signal_id, s.tk, s.signal_ts, first(d.id {best}) document_id from s join d on {join} group by 1, 2, 3)",
        "p6_enriched": f"""{_ASOF_SQL}, k as (select distinct tk, signal_ts from s),
b as (select s.tk, s.signal_ts, first(d {best}) b from k s join d on {join} group by 1, 2)
select signal_id, ticker, s.signal_ts, score, horizon_days, market_regime, received_at, b.b.id document_id, b.b.doc_type doc_type, b.b.filed_date filed_date, b.b.title filing_title
from s left join b on b.tk = s.tk and b.signal_ts = s.signal_ts""",
    }
