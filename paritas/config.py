"""Comparisons from YAML or JSON files."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from typing import Any

from paritas.functions.normalize import rules_of
from paritas.sinks import writers
from paritas.sinks.interpolate import Output
from paritas.spec import Comparison, Mapping, Resource, Side, Strategy, Value

_PLACE = re.compile(r"\$\{env\.([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")
SECRETS = ("password", "secret", "token", "accesskey", "access_key", "apikey", "api_key", "credential")


def filled(value: Any, environment: dict[str, str] | None = None) -> Any:
    """value with ${env.NAME} and ${env.NAME:default} replaced in all its texts."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: filled(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, environment) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match[str]) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ValueError(f"the environment has no {m[1]}, and it has no default")
        return m[2]

    return _PLACE.sub(one, value)


def masked(value: Any, name: str = "") -> Any:
    """value with passwords and the like hidden, for messages."""
    if isinstance(value, dict):
        return {k: masked(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [masked(v, name) for v in value]
    if any(s in name.lower().replace("-", "_") for s in SECRETS) and value not in (None, ""):
        return "******"
    if isinstance(value, str):
        return re.sub(r"(?i)((?:password|pwd|token|secret)=)[^&;\s]+", r"\1******", re.sub(r"(://[^:/@\s]+:)[^@\s]+@", r"\1******@", value))
    return value


def load(path: str) -> dict[str, Any]:
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return filled(json.loads(text))
    import yaml

    return filled(yaml.safe_load(text) or {})


@dataclass(frozen=True)
class Job:
    comparison: Comparison
    task: writers.Task
    sinks: tuple[writers.Sink, ...]
    fail_on_sink_error: bool = True


def _value(entry: Any) -> Value:
    if isinstance(entry, str):
        return Value(column=entry)
    return Value(entry.get("column"), entry.get("expression"), entry.get("literal"), "literal" in entry)


def _resource(entry: dict[str, Any]) -> Resource:
    inner = entry.get("resource", entry)
    kind, path = inner.get("type", "table"), inner.get("path") or inner.get("name") or inner.get("table", "")
    connection = entry.get("connection", {})
    options = {str(k): str(v) for k, v in inner.get("options", {}).items()}
    if connection:  # behind JDBC, a table and an SQL text are both paths
        options |= {str(k): str(v) for k, v in connection.items() if k != "type"}
        kind = connection.get("type", "jdbc")
    return Resource(kind, path, options, partition_columns=tuple(inner.get("partitionColumns", ())))


def _side(entry: dict[str, Any], comparison: dict[str, Any], which: str, rules: list, own: list) -> Side:
    def pick(name: str, default: Any = None) -> Any:
        value = comparison.get(name, default)
        return value.get(which, default) if isinstance(value, dict) else value

    columns = pick("fields")
    return Side(
        _resource(entry), tuple(pick("keys", ()) or ()), tuple(columns) if columns else None, tuple(pick("exclude", ()) or ()), pick("filter"),
        pick("updateColumn"), pick("updatedFrom"), pick("updatedTo"), rules=rules_of([*rules, *own]),
    )


KNOWN = {"source", "target", "comparison", "strategy", "normalization", "outputs", "result", "task"}


def job(config: dict[str, Any]) -> Job:
    """A configuration as a job; raises ValueError with what is wrong."""
    if unknown := set(config) - KNOWN:
        raise ValueError(f"unknown sections {', '.join(sorted(unknown))}")
    if missing := {"source", "target", "comparison"} - set(config):
        raise ValueError(f"missing sections {', '.join(sorted(missing))}")
    c, n, s = config["comparison"], config.get("normalization", {}), config.get("strategy", {})
    mappings = tuple(Mapping(m["name"], _value(m["source"]), _value(m["target"]), m.get("key", False), m.get("compare", True)) for m in c.get("mappings", ()))
    sides = [_side(config[w], c, w, n.get("global", []), n.get(w, [])) for w in ("source", "target")]
    strategy = Strategy(
        s.get("mode", "checksum"), s.get("algorithm", "xor"), s.get("localCompare", "full"), tuple(s.get("prefer", ())), s.get("allowFallback", True),
        None if s.get("buckets") == "auto" else int(s.get("buckets", 0)), int(s.get("maxDifferences", 1_000_000)), s.get("validateUniqueKeys", True), s.get("strictNulls", False),
    )
    comparison = Comparison(*sides, strategy, mappings)
    task = writers.Task(str(config.get("task", {}).get("id", "task")), sides[0].resource.path, sides[1].resource.path, strategy.mode, strategy.algorithm)
    sinks = []
    for o in config.get("outputs", [{"format": "console", "type": "result"}]):
        options = {k: v for k, v in o.items() if k not in ("format", "type", "columns")}
        if "columns" in o:
            options["outputs"] = tuple(Output(x["name"], x["value"], x.get("type"), x.get("default")) for x in o["columns"])
        sinks.append(writers.make(f"{o['format']}:{o['type']}", **options))
    return Job(comparison, task, tuple(sinks), config.get("result", {}).get("failOnSinkError", True))


def template(advanced: bool = False) -> dict[str, Any]:
    """A configuration to start from."""
    out: dict[str, Any] = {
        "source": {"resource": {"type": "parquet", "path": "source.parquet"}},
        "target": {"resource": {"type": "parquet", "path": "target.parquet"}},
        "comparison": {"keys": ["id"]},
        "strategy": {"mode": "checksum", "algorithm": "xor"},
        "outputs": [{"format": "console", "type": "result"}],
    }
    if advanced:
        out["source"] = {"connection": {"type": "postgresql", "url": "${env.SOURCE_URL:jdbc:postgresql://localhost/db}", "password": "${env.SOURCE_PASSWORD:}"}, "resource": {"path": "public.orders"}}
        out["comparison"] |= {"exclude": ["updated_at"], "filter": {"source": "status = 'done'", "target": "status = 'done'"}}
        out["strategy"] |= {"localCompare": "row-hash", "buckets": 1024, "maxDifferences": 100000}
        out["normalization"] = {"global": [{"match": {"type": "decimal"}, "operation": "format_number", "params": {"precision": 2}}]}
        out["outputs"].append({"format": "json", "type": "diff-record", "path": "diff-${taskId}.json"})
    return out
