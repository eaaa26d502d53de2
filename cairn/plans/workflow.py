"""A workflow as data: steps with operators and inputs, checked and compiled to one DataFrame plan.

An operator takes the DataFrames of its inputs and returns one; steps only describe, so a
workflow of any length is one plan that runs when its result is written. Input 0 is the raw table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.json_documents import documents

# What a step must state, and the kinds of action.
STEP_FIELDS = ["id", "layer", "tool", "action_type", "action", "input_type", "output_type", "output_path", "proposal_task"]
ACTION_TYPES = ["quantitative", "qualitative"]


@dataclass(frozen=True)
class Violation:
    step: int
    check: str
    detail: str


@dataclass
class Registry:
    """Operators by the name that a tool's command calls."""

    functions: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def operator(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.functions[name] = fn
            return fn

        return add


def called(command: str | None) -> str:
    return (command or "").strip().partition("(")[0].strip()


def check(plan: Sequence[Mapping], tools: Sequence[int] = ()) -> list[Violation]:
    """All violations in the order of the steps and checks: fields, ids from 1 without gaps, kind of action, tools, inputs of earlier steps."""
    found: list[Violation] = []
    seen = {0}
    for at, step in enumerate(plan, 1):
        if missing := sorted(set(STEP_FIELDS) - set(step)):
            found.append(Violation(at, "fields", ",".join(missing)))
            continue
        if step["id"] != at:
            found.append(Violation(at, "id", str(step["id"])))
        if step["action_type"] not in ACTION_TYPES:
            found.append(Violation(at, "action_type", str(step["action_type"])))
        if not isinstance(step["tool"], list) or not step["tool"]:
            found.append(Violation(at, "tool", "none"))
        elif tools and (unknown := [t for t in step["tool"] if t not in tools]):
            found.append(Violation(at, "tool", ",".join(map(str, unknown))))
        if later := [d for d in step["input_type"] if d not in seen]:
            found.append(Violation(at, "input", ",".join(map(str, later))))
        seen.add(step["id"])
    return found


def compile_plan(raw: DataFrame, plan: Sequence[Mapping], toolset: Sequence[Mapping], registry: Registry) -> dict[int, DataFrame]:
    """The DataFrame of every step. Each step must use one tool whose command is registered."""
    if broken := check(plan, [int(t["id"]) for t in toolset]):
        raise ValueError(f"step {broken[0].step}: {broken[0].check} {broken[0].detail}")
    by_id = {int(t["id"]): t for t in toolset}
    results = {0: raw}
    for step in plan:
        if len(step["tool"]) != 1:
            raise ValueError(f"step {step['id']} must use one tool")
        name = called(by_id[int(step["tool"][0])].get("command"))
        if name not in registry.functions:
            raise KeyError(f"no operator is registered for {name}")
        results[int(step["id"])] = registry.functions[name](*(results[int(d)] for d in step["input_type"]))
    return results


def step_violations(steps: DataFrame, tools: Sequence[int]) -> DataFrame:
    """The same checks for plans in a table: ``plan``, ``step``, ``check``, ``detail``, one pass without a shuffle.

    ``steps`` has plan, position (from 1), id, action_type, tools and inputs (arrays). An input must be 0 or an earlier position.
    """
    position = F.col("position")

    def joined(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: v.cast("string")), ","))

    unknown = F.filter("tools", lambda t: ~t.isin(*tools)) if tools else F.array().cast("array<bigint>")
    later = F.filter("inputs", lambda i: (i < 0) | (i >= position))
    found = [
        ("id", F.when(F.col("id").isNull() | (F.col("id") != position), F.coalesce(F.col("id").cast("string"), F.lit("none")))),
        ("action_type", F.when(F.coalesce(~F.col("action_type").isin(*ACTION_TYPES), F.lit(True)), F.coalesce("action_type", F.lit("none")))),
        ("tool", F.when(F.coalesce(F.size("tools"), F.lit(0)) < 1, F.lit("none")).otherwise(joined(unknown))),
        ("input", joined(later)),
    ]
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(n).alias("check"), d.alias("detail")) for n, d in found)), lambda x: x["detail"].isNotNull()))
    return steps.select("plan", position.alias("step"), each.alias("_v")).select("plan", "step", "_v.check", "_v.detail")


@dataclass
class Workflow:
    """What a folder says about a task: its description, its tools and its plan."""

    task: dict
    toolset: list[dict]
    plan: list[dict]


def _json_at(spark: SparkSession, path: str) -> object | None:
    """The one JSON document at a path, small enough to configure a run; None where there is nothing."""
    try:
        row = documents(spark, path).select(F.to_json("doc")).first()
    except AnalysisException:
        return None
    return None if row is None or row[0] is None else json.loads(row[0])


def load_workflow(spark: SparkSession, folder: str, pathway: Callable[[dict, list[dict]], list[dict]] | None = None) -> Workflow:
    """``task.json``, ``toolset.json`` and ``plan.json`` of a folder. A plan that isn't there is made by ``pathway``, checked, and written there."""
    task, toolset, plan = (_json_at(spark, f"{folder}/{name}.json") for name in ("task", "toolset", "plan"))
    if not isinstance(toolset, list):
        raise ValueError("the folder has no toolset")
    if plan is None:
        if pathway is None:
            raise ValueError("the folder has no plan")
        plan = pathway(task or {}, toolset)
        if broken := check(plan, [int(t["id"]) for t in toolset]):
            raise ValueError(f"step {broken[0].step}: {broken[0].check} {broken[0].detail}")
        spark.createDataFrame([(json.dumps(plan, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/plan.json")
    return Workflow(task or {}, toolset, plan)


def last_result(results: Mapping[int, DataFrame]) -> DataFrame:
    """The result of the last step."""
    return results[max(results)]


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: of the rows with equal key the last in ``order`` wins, whole. A partial aggregate, so a hot key leaves a task as one row."""
    values = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return best.select(*key, *(F.col(f"_v.{c}").alias(c) for c in values))


def merged(document: Column, field_name: str, value: Column) -> Column:
    """A map with one entry set, over what was there under its name."""
    others = F.map_filter(F.coalesce(document, F.create_map().cast("map<string,string>")), lambda k, v: k != field_name)
    return F.map_concat(others, F.create_map(F.lit(field_name), value))


def trace(used: DataFrame, entries: DataFrame, used_id: str = "evidence_id") -> DataFrame:
    """Used ids with what the entries say about them, with defaults for unknown ids; of entries with an equal id the last counts."""
    last = latest(entries.select("id", "_ord", "topic", "statement"), ["id"], ["_ord"])
    ids = used.select(used_id).where(F.col(used_id).isNotNull()).distinct()
    return ids.join(last, F.col(used_id) == F.col("id"), "left").select(used_id, F.coalesce("topic", F.lit("not_retrieved")).alias("topic"), F.coalesce("statement", F.lit("")).alias("statement"))
