"""Layered configuration: commands, projects and settings, right-most layer wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of project types and of task runners, ranks of severities.
PROJECT_ORDER = ("rust", "go", "python", "typescript", "javascript", "java")
RUNNERS = ("mise", "just", "make", "deno", "npm", "gradle")
SEVERITIES = {"error": 0, "critical": 0, "high": 1, "warning": 1, "moderate": 2, "info": 2, "low": 3}


def merged_commands(commands: DataFrame, *group: str) -> DataFrame:
    """Commands (group, name, layer, pos, ...) of all layers as one list by place: the
    last layer's command stands in the first one's place, new names follow at the end."""
    keys = [*group, "name"]
    rest = [c for c in commands.columns if c not in keys]
    one = commands.groupBy(*keys).agg(F.min(F.struct("layer", "pos")).alias("_first"), F.max_by(F.struct(*rest), F.struct("layer", F.col("pos") * -1)).alias("_last"))
    order = Window.partitionBy(*group).orderBy("_first") if group else Window.orderBy("_first")
    return one.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest if c not in ("layer", "pos")], (F.row_number().over(order) - 1).cast("long").alias("place"))


def merged_projects(projects: DataFrame) -> DataFrame:
    """Per id the right-most layer's values; null and empty ones don't override."""
    fields = [c for c in projects.columns if c not in ("id", "layer")]
    value = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("layer")))
    return projects.groupBy("id").agg(*[value(c).alias(c) for c in fields])


def overlaid(*layers: str) -> Column:
    """The value of the right-most layer's column that is neither null, '' nor 0."""
    def given(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(~text.isin("", "0", "0.0"), F.col(c))

    return F.coalesce(*[given(c) for c in reversed(layers)], F.col(layers[0]))


def applicable(commands: DataFrame, condition: str = "holds", cost: int | None = None) -> DataFrame:
    """Commands without a condition or whose condition holds (an error is false), within the cost."""
    kept = commands.where(F.col("when").isNull() | F.coalesce(F.col(condition), F.lit(False)))
    return kept if cost is None else kept.where(F.coalesce("cost", F.lit(0)) <= cost)


def first_choice(tasks: DataFrame, names: tuple[str, ...] = (), *group: str) -> DataFrame:
    """Per task (or group) the runner that comes first; with names, the first name that exists too."""
    rank = reduce(lambda a, kv: a.when(F.col("runner") == kv[1], kv[0]), enumerate(RUNNERS), F)
    ranked = tasks.withColumn("_priority", rank.otherwise(len(RUNNERS)))
    if names:
        at = reduce(lambda a, kv: a.when(F.col("task") == kv[1], kv[0]), enumerate(names), F)
        ranked = ranked.where(F.col("task").isin(*names)).withColumn("_name", at.otherwise(len(names)))
    else:
        ranked = ranked.withColumn("_name", F.lit(0))
    keys = list(group) or ["task"]
    rest = [c for c in tasks.columns if c not in keys]
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_name", "_priority")).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def by_severity(findings: DataFrame, top: int, *ties: str) -> DataFrame:
    """The top findings, worst first; unknown severities last."""
    known = F.create_map(*[x for k, v in SEVERITIES.items() for x in (F.lit(k), F.lit(v))])
    rank = F.coalesce(F.try_element_at(known, F.lower("severity")), F.lit(4))
    return findings.withColumn("severity_rank", rank).orderBy("severity_rank", *[F.col(t) for t in ties]).limit(top)


def project_type(types: DataFrame) -> DataFrame:
    """Of the detected types (column type) the one that takes precedence, else 'unknown'."""
    rank = reduce(lambda a, kv: a.when(F.col("type") == kv[1], kv[0]), enumerate(PROJECT_ORDER), F)
    return types.agg(F.coalesce(F.min_by("type", rank), F.lit("unknown")).alias("type"))


def joined_intelligence(parts: DataFrame) -> DataFrame:
    """Rows (place, stack, runtime, arch, gates, entry) as one: stacks joined by |, the
    first runtime, arch and entry, gates in order without repeats."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "stack", "runtime", "arch", "gates", "entry")))
    row = parts.agg(ordered.alias("p"))
    first = lambda c: F.get(F.filter(F.transform("p", lambda x: x[c]), lambda v: v.isNotNull()), F.lit(0))
    return row.select(
        F.array_join(F.filter(F.transform("p", lambda x: x["stack"]), lambda v: v.isNotNull()), "|").alias("stack"),
        first("runtime").alias("runtime"), first("arch").alias("arch"), first("entry").alias("entry"),
        F.array_distinct(F.flatten(F.filter(F.transform("p", lambda x: x["gates"]), lambda v: v.isNotNull()))).alias("gates"),
    )


def overall(results: DataFrame) -> DataFrame:
    """Whether all commands succeeded, and the exit code."""
    ok = F.coalesce(F.bool_and("success"), F.lit(True))
    return results.agg(ok.alias("success"), F.when(ok, 0).otherwise(1).alias("exit_code"))
