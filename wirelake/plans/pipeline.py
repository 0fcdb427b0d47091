"""The query language: ``filter | stage | stage`` over observations, as a chain of DataFrame operations.

Stages run left to right, each on what the one before returns: select, group, sum/avg/min/max, count, distinct,
window, top, timeline, sort, limit. Nothing becomes SQL text. Filters on the event type and the time also name the
partitions that can hold a match, where the rows have partition columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as datafield

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake import schema
from wirelake.errors import QuerySyntaxError
from wirelake.functions import net
from wirelake.plans import predicate as P

#: Parts of a query, rows of a limit, and rows of a result.
MAX_PARTS, MAX_LIMIT, RESULT_ROWS = 8, 10_000, 10_000
_ALIAS = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,31}")
_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
_CALLS = tuple(f"{x} " for x in _AGGREGATES)


def parts_of(query: str) -> list[str]:
    """The query cut at single bars outside of strings."""
    if len(query.encode()) > P.MAX_BYTES:
        raise QuerySyntaxError(f"a query has at most {P.MAX_BYTES} bytes")
    out, start, quoted, k = [], 0, False, 0
    while k < len(query):
        c = query[k]
        if quoted and c == "\\":
            k += 2
            continue
        if c == '"':
            quoted = not quoted
        elif c == "|" and not quoted:
            run = len(query) - k - len(query[k:].lstrip("|"))
            if run == 1:
                out.append(query[start:k].strip())
                start = k + 1
            k += run
            continue
        k += 1
    out.append(query[start:].strip())
    if len(out) > MAX_PARTS:
        raise QuerySyntaxError(f"a query has at most a filter and {MAX_PARTS - 1} stages")
    return out


@dataclass
class _State:
    """What the stages so far make of the rows."""

    df: DataFrame
    keys: list[str] | None = None  # of a group that waits for its aggregate
    windowed: bool = False
    window_waits: bool = False
    aggregated: bool = False
    made: set[str] = datafield(default_factory=set)


def with_keys(df: DataFrame) -> DataFrame:
    """``df`` with the address keys that it lacks."""
    lacking = {f"{c}_key": net.ip_key(F.col(c)) for c in ("src_ip", "dst_ip") if c in df.columns and f"{c}_key" not in df.columns}
    return df.withColumns(lacking) if lacking else df


def with_virtual(df: DataFrame, query: str) -> DataFrame:
    """``df`` with the payload fields that the query names, in either spelling."""
    named = {}
    for column, (path, numeric) in schema.VIRTUAL.items():
        if column in query or column.replace("_", ".", 1) in query:
            value = net.json_scalar(F.col("payload"), path)
            named[column] = value.try_cast("bigint") if numeric else value
    return df.withColumns(named) if named else df


def partitions_of(node: P.Node, columns: list[str]) -> Column | None:
    """A condition on the partition columns that every match fulfils; null for none."""
    tests = []
    for part in P.conjuncts(node):
        if not isinstance(part, P.Compare):
            continue
        if part.field.column == "event_type" and part.op == "==" and "event" in columns:
            tests.append(F.col("event").isin(partition_name(part.value), "mixed"))
        if part.field.column == "timestamp_ms" and part.op in ("<", "<=", ">", ">=", "==") and "hour" in columns and abs(part.value) < 1 << 62:
            hour, n = F.expr("try_cast(hour AS BIGINT)"), part.value // 3_600_000
            bound = {"<": hour <= n, "<=": hour <= n, ">": hour >= n, ">=": hour >= n, "==": hour == n}[part.op]
            tests.append(bound | (F.col("hour") == "unknown"))
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def partition_name(event_type: str) -> str:
    """Directory name of an event type; odd ones get a digest."""
    import hashlib

    if re.fullmatch(r"[A-Za-z0-9._-]{1,64}", event_type):
        return event_type
    return f"custom-{hashlib.sha256(event_type.encode()).hexdigest()[:16]}"


def _names(text: str) -> list[str]:
    out = []
    for name in (x.strip() for x in text.split(",")):
        try:
            out.append(P.field(name).column)
        except KeyError:
            raise QuerySyntaxError(f"there is no field {name}") from None
    return out


def _limit(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text) or not 1 <= int(text) <= MAX_LIMIT:
        raise QuerySyntaxError(f"expected a number of rows from 1 to {MAX_LIMIT}, not {text}")
    return int(text)


def _group(s: _State, keys: list[str], *aggregates: Column) -> DataFrame:
    return s.df.groupBy(*keys).agg(*aggregates)


def _pending(s: _State) -> list[str]:
    """The keys that an aggregate takes: those of a waiting group, else of a waiting window, else none."""
    keys = s.keys if s.keys is not None else ["window_start_ms"] if s.window_waits else []
    s.keys, s.window_waits, s.aggregated = None, False, True
    return keys


def _totals(column: str) -> Column:
    return F.sum(column).cast("bigint").alias(column)


def apply_stage(s: _State, text: str, following: str | None) -> None:
    name, _, rest = text.partition(" ")
    rest = rest.strip()
    if name == "select":
        s.df = s.df.select(*_names(rest))
    elif name == "group":
        keys = _names(rest)
        if s.windowed and "window_start_ms" not in keys:
            keys.append("window_start_ms")
        if following is not None and (following.startswith(_CALLS) or following == "count"):
            s.keys = keys
        else:
            s.df = _group(s, keys, F.count("*").alias("count"), _totals("packets"), _totals("bytes"))
            s.aggregated = True
            s.made.add("count")
    elif name in _AGGREGATES:
        target, _, alias = (x.strip() for x in rest.partition(" as "))
        if not alias or not _ALIAS.fullmatch(alias):
            raise QuerySyntaxError(f"expected {name} FIELD as NAME")
        column = target if target in s.made else _names(target)[0]
        if column not in s.made and not P.is_numeric(column):
            raise QuerySyntaxError(f"{name} needs a number field, not {target}")
        value = _AGGREGATES[name](column)
        s.df = _group(s, _pending(s), value.cast("double" if name == "avg" else "bigint").alias(alias))
        s.made.add(alias)
    elif text == "count":
        s.df = _group(s, _pending(s), F.count("*").alias("count"))
        s.made.add("count")
    elif name == "distinct":
        s.df = s.df.select(*_names(rest)[:1]).distinct() if "," not in rest else _fail("distinct takes one field")
    elif name == "window":
        width = net.duration_ms(rest, ("s", "m", "h"))
        if s.windowed or s.aggregated:
            raise QuerySyntaxError("window goes once, before any aggregate")
        if width is None or not 1000 <= width <= 86_400_000:
            raise QuerySyntaxError("a window lasts from 1s to 24h")
        start = (F.floor(F.col("timestamp_ms").cast("double") / F.lit(width)) * F.lit(width)).cast("bigint")
        s.df = s.df.withColumn("window_start_ms", start)
        s.windowed = s.window_waits = True
    elif name == "top":
        n, _, target = rest.partition(" ")
        column = _names(target)[0]
        counted = s.df.groupBy(column).agg(F.count("*").alias("count"))
        s.df = counted.orderBy(F.desc("count"), F.asc_nulls_last(column)).limit(_limit(n))
        s.aggregated = True
        s.made.add("count")
    elif text == "timeline":
        s.df = s.df.orderBy(F.asc_nulls_last("timestamp_ms"))
    elif name == "sort":
        target, _, way = rest.partition(" ")
        if way.strip() not in ("", "asc", "desc") or not target:
            raise QuerySyntaxError("expected sort FIELD asc or desc")
        column = target if target in s.made else _names(target)[0]
        if column not in s.df.columns:
            raise QuerySyntaxError(f"there is no {target} left to sort by")
        s.df = s.df.orderBy(F.desc_nulls_last(column) if way.strip() == "desc" else F.asc_nulls_last(column))
    elif name == "limit":
        s.df = s.df.limit(_limit(rest))
    else:
        raise QuerySyntaxError(f"there is no stage {name}")


def _fail(message: str) -> DataFrame:
    raise QuerySyntaxError(message)


def visible(df: DataFrame) -> DataFrame:
    return df.drop(*schema.HIDDEN)


def query(events: DataFrame, text: str, now_ms: int | None = None, result_rows: int | None = RESULT_ROWS) -> DataFrame:
    """The rows that the query asks of ``events``; ``result_rows`` None is for tables without bound."""
    filter_, *stages = parts_of(text)
    filter_ = filter_.removeprefix("where ").strip()
    node = P.parse(filter_, now_ms)
    df = with_virtual(with_keys(events), text)
    pruned = partitions_of(node, df.columns)
    if pruned is not None:
        df = df.where(pruned)
    if not isinstance(node, P.Everything):
        df = df.where(P.to_column(node))
    s = _State(df)
    for k, stage in enumerate(stages):
        apply_stage(s, stage, stages[k + 1] if k + 1 < len(stages) else None)
    out = visible(s.df)
    return out.limit(result_rows) if result_rows is not None else out


def flows(events: DataFrame, text: str, now_ms: int | None = None, result_rows: int | None = RESULT_ROWS) -> DataFrame:
    """The query over ended flows only, whatever it asks; a condition like any other, so it prunes partitions of a store."""
    ended = events.where(F.col("event") == "flow.end") if "event" in events.columns else events
    return query(ended.where(F.col("event_type") == "flow.end"), text, now_ms, result_rows)


def matching(events: DataFrame, text: str, now_ms: int | None = None) -> DataFrame:
    """The rows that match a bare predicate."""
    return visible(with_virtual(with_keys(events), text).where(P.to_column(P.parse(text, now_ms)))).select(*events.columns)
