"""Configuration and evaluation specs from YAML or JSON text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LISTS = ("lint", "fmt", "build", "test", "run")
SPEC = "q string, expected array<struct<path: string, lo: bigint, hi: bigint, grade: double>>"


def parsed(text: str) -> dict:
    """YAML if that parser is there, else JSON (which is YAML too)."""
    try:
        import yaml
    except ImportError:
        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def layers(local: str | None = None, overall: str | None = None, embedded: str = "") -> list[dict]:
    """Embedded defaults, the user's file and the tree's file, as far as they exist."""
    out = [parsed(embedded)]
    for path in (overall, local):
        if path and Path(path).is_file():
            out.append(parsed(Path(path).read_text()))
    return out


def commands(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """All layers' commands: layer, pos, project (null for universal ones), kind, name, cmd, fix, check, when, cost, security."""
    rows = []
    for layer, config in enumerate(configs):
        groups = [(None, config), *[(k, v or {}) for k, v in (config.get("projects") or {}).items()]]
        for project, body in groups:
            for kind in LISTS:
                for pos, c in enumerate(body.get(kind) or []):
                    rows.append((layer, pos, project, kind, c["name"], c.get("cmd"), c.get("fix"), c.get("check"), c.get("when"), int(c.get("cost", 0)), bool(c.get("security"))))
    return spark.createDataFrame(rows, "layer int, pos int, project string, kind string, name string, cmd string, fix string, check string, `when` string, cost int, security boolean")


def projects(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """All layers' projects: layer, id, name, detect, stack, runtime."""
    rows = []
    for layer, config in enumerate(configs):
        for k, v in (config.get("projects") or {}).items():
            v = v or {}
            c = v.get("context") or {}
            rows.append((layer, k, v.get("name"), v.get("detect"), c.get("stack"), c.get("runtime")))
    return spark.createDataFrame(rows, "layer int, id string, name string, detect string, stack string, runtime string")


def eval_spec(spark: SparkSession, text: str) -> tuple[DataFrame, dict]:
    """(queries with expectations, options k and modes) of a spec; grades are 1 by default."""
    spec = parsed(text)
    rows = []
    for q in spec.get("queries") or []:
        expected = []
        for e in q.get("relevant") or []:
            lo, hi = e.get("lines") or (None, None)
            expected.append((e["path"], lo, hi, float(e.get("grade", 1))))
        rows.append((q["q"], expected))
    return spark.createDataFrame(rows, SPEC), {"k": int(spec.get("k") or 10), "modes": spec.get("modes")}
