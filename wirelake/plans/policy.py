"""The policy language: ``[rule ID version V] on EVENT where PREDICATE { action(...); }``.

Predicates are event predicates; actions are notice, tag, metric and log. A program is one pass over the
observations: each rule contributes an array of effects where it matches, and the arrays are exploded. Running
totals of metrics and the gate of notices follow from the effects.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.errors import QuerySyntaxError
from wirelake.functions.tables import written
from wirelake.operators.enrich import notice_gate
from wirelake.plans import pipeline
from wirelake.plans import predicate as P

#: Limits of a program, and what actions may say.
MAX_BYTES, MAX_RULES, MAX_ACTIONS, MAX_EFFECTS, MAX_METRICS, MAX_TEXT = 65_536, 256, 8, 128, 128, 512
SEVERITIES = ("info", "warning", "high", "critical")
LEVELS = ("debug", "info", "warning", "error")
ARGUMENTS = {"notice": ("severity", "message"), "tag": ("name", "value"), "metric": ("name", "value"), "log": ("level", "message")}
EVENT_OF = {"notice": "notice.policy", "tag": "policy.tag", "metric": "policy.metric", "log": "policy.log"}
_ID = re.compile(r"[A-Za-z0-9_.-]{1,64}")
_STRING = r'"(?:[^"\\]|\\.)*"'
_HEAD = re.compile(rf"\s*(?:rule\s+(?P<id>\S+)\s+version\s+(?P<version>{_STRING}|\S+)\s+)?on\s+(?P<event>\S+)\s+where\s(?P<test>(?:{_STRING}|[^\"{{])*)\{{", re.S)
_ACTION = re.compile(rf"\s*(?P<kind>[a-z]+)\s*\((?P<args>(?:{_STRING}|[^\"();])*)\)\s*(?:;|(?=\}}))", re.S)
_ARGUMENT = re.compile(rf"\s*(?P<key>[a-z]+)\s*:\s*(?P<value>{_STRING}|[^,\"]+?)\s*(?:,|$)", re.S)


@dataclass(frozen=True)
class Action:
    kind: str
    values: tuple[tuple[str, str | int], ...]


@dataclass(frozen=True)
class Rule:
    id: str
    version: str
    event: str
    predicate: P.Node
    source: str
    actions: tuple[Action, ...]


@dataclass(frozen=True)
class Program:
    rules: tuple[Rule, ...]
    version: str


def _text(word: str) -> str:
    value = json.loads(word) if word.startswith('"') else word
    if len(value.encode()) > MAX_TEXT or any(c in value for c in "\n\r\0"):
        raise QuerySyntaxError(f"the text of an action is one line of {MAX_TEXT} bytes at most")
    return value


def _action(kind: str, args: str) -> Action:
    if kind not in ARGUMENTS:
        raise QuerySyntaxError(f"there is no action {kind}; there are {', '.join(ARGUMENTS)}")
    if kind == "tag" and re.fullmatch(_STRING, args.strip(), re.S):
        return Action("tag", (("name", _text(args.strip())), ("value", "true")))
    given: dict[str, str] = {}
    at, args = 0, args.strip()
    while at < len(args):
        m = _ARGUMENT.match(args, at)
        if m is None or m["key"] in given:
            raise QuerySyntaxError(f"expected NAME: VALUE, each once, in {kind}({args})")
        given[m["key"]] = m["value"]
        at = m.end()
    if set(given) != set(ARGUMENTS[kind]):
        raise QuerySyntaxError(f"{kind} takes {' and '.join(ARGUMENTS[kind])}")
    values: dict[str, str | int] = {k: _text(given[k]) for k in ARGUMENTS[kind]}
    if kind == "metric":
        if not re.fullmatch(r"[0-9]+", str(values["value"])) or int(values["value"]) >= 1 << 63:
            raise QuerySyntaxError("a metric grows by a whole number")
        values["value"] = int(values["value"])
        if not _ID.fullmatch(str(values["name"])):
            raise QuerySyntaxError("a metric's name has letters, digits and _ . - only")
    for key, known in (("severity", SEVERITIES), ("level", LEVELS)):
        if key in values and values[key] not in known:
            raise QuerySyntaxError(f"{key} is one of {', '.join(known)}")
    return Action(kind, tuple(values.items()))


def parse(source: str, now_ms: int | None = None) -> Program:
    if len(source.encode()) > MAX_BYTES:
        raise QuerySyntaxError(f"a program has at most {MAX_BYTES} bytes")
    version = hashlib.sha256(source.encode()).hexdigest()
    rules: list[Rule] = []
    at, end = 0, len(source.rstrip())
    while at < end:
        m = _HEAD.match(source, at)
        if m is None:
            raise QuerySyntaxError("expected [rule ID version V] on EVENT where PREDICATE { ... }", source, at, at + 1)
        name = m["id"] or f"rule-{len(rules) + 1}"
        if not _ID.fullmatch(name) or not (m["event"] == "*" or _ID.fullmatch(m["event"])):
            raise QuerySyntaxError("bad rule or event name", source, m.start(), m.end())
        if any(r.id == name for r in rules):
            raise QuerySyntaxError(f"rule {name} stands twice", source, m.start(), m.end())
        at, actions = m.end(), []
        while not re.compile(r"\s*\}").match(source, at):
            a = _ACTION.match(source, at)
            if a is None:
                raise QuerySyntaxError("expected ACTION(...); or }", source, at, min(at + 1, len(source)))
            actions.append(_action(a["kind"], a["args"]))
            at = a.end()
        at = source.index("}", at) + 1
        if not 1 <= len(actions) <= MAX_ACTIONS:
            raise QuerySyntaxError(f"a rule has from 1 to {MAX_ACTIONS} actions")
        test = m["test"].strip()
        rules.append(Rule(name, _text(m["version"]) if m["version"] else version, m["event"], P.parse(test, now_ms), test, tuple(actions)))
        if len(rules) > MAX_RULES:
            raise QuerySyntaxError(f"a program has at most {MAX_RULES} rules")
    if len({dict(a.values)["name"] for r in rules for a in r.actions if a.kind == "metric"}) > MAX_METRICS:
        raise QuerySyntaxError(f"a program has at most {MAX_METRICS} metrics")
    return Program(tuple(rules), version)


def _effect(rule: Rule, rank: int, index: int, action: Action, version: str) -> Column:
    values = dict(action.values)
    label = values.get("severity") or values.get("level") or values.get("name")
    text = values.get("message") or (values["value"] if action.kind == "tag" else None)
    cells = {
        "effect": EVENT_OF[action.kind], "rule_id": rule.id, "rule_version": rule.version, "program_version": version,
        "rule_rank": rank, "action_index": index, "label": label, "text": text,
    }
    amount = F.lit(values["value"] if action.kind == "metric" else None).cast("bigint").alias("increment")
    return F.struct(*[F.lit(v).cast("int" if k in ("rule_rank", "action_index") else "string").alias(k) for k, v in cells.items()], amount)


def effects(events: DataFrame, program: Program) -> DataFrame:
    """Observations times the effects on them: one row for each action of each matching rule, in the rules' order.

    More than MAX_EFFECTS effects on one observation are an error when the rows are made.
    """
    names = " ".join(r.source for r in program.rules)
    rows = pipeline.with_virtual(pipeline.with_keys(events), names)
    lists = []
    for rank, rule in enumerate(program.rules):
        test = P.to_column(rule.predicate)
        if rule.event != "*":
            test = (F.col("event_type") == rule.event) & test
        lists.append(F.when(test, F.array(*[_effect(rule, rank, k, a, program.version) for k, a in enumerate(rule.actions)])))
    found = F.flatten(F.array_compact(F.array(*lists)))
    bounded = F.when(F.size(found) <= MAX_EFFECTS, found).otherwise(F.raise_error(F.lit(f"more than {MAX_EFFECTS} effects on an event; narrow the policies")))
    return rows.select("event_id", "flow_id", "event_type", "timestamp_ms", F.explode(bounded).alias("_e")).select("event_id", "flow_id", "event_type", "timestamp_ms", "_e.*")


def metric_totals(found: DataFrame, order: tuple[str, ...] = ("timestamp_ms", "event_id", "rule_rank", "action_index")) -> DataFrame:
    """The metric effects with the running total of their name.

    Totals run inside ranges of the order; each begins with the sums of the ranges before, so that a name is never in one task.
    """
    rows = found.where(F.col("effect") == "policy.metric")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "metrics")
    sums = ranged.groupBy("label", "_part").agg(F.sum("increment").alias("_sum"))
    earlier = W.partitionBy("label").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("label", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))  # names times partitions
    own = W.partitionBy("label", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), ["label", "_part"]).withColumn("total", (F.col("_before") + F.sum("increment").over(own)).cast("bigint")).drop("_part", "_before")


def gated(found: DataFrame) -> DataFrame:
    """The effects with passed: notices are gated by rule, action and flow; other effects always pass."""
    notices = notice_gate(found.where(F.col("effect") == "notice.policy"), ["rule_id", "action_index", "flow_id"])
    return notices.unionByName(found.where(F.col("effect") != "notice.policy").withColumn("passed", F.lit(True)))


def observations(found: DataFrame, parents: DataFrame) -> DataFrame:
    """The effects as observations beside their parents, counters null."""
    from wirelake.operators.enrich import derived

    keep = found.select("event_id", F.col("effect").alias("event_type"), "rule_id", "rule_version", "program_version", "label", "text", "increment")
    return derived(parents, keep, "effect")


def prometheus(found: DataFrame) -> str:
    """Counters as exposition text, one line a metric."""
    rows = found.where(F.col("effect") == "policy.metric").groupBy("label").agg(F.sum("increment").alias("n")).orderBy("label").collect()  # MAX_METRICS rows at most
    return "".join(f"wirelake_policy_{re.sub('[^A-Za-z0-9_]', '_', r['label'])}_total {r['n']}\n" for r in rows)

