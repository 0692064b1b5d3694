"""Where differences and statistics go: console, JSON, CSV and tables. Distributed frames are written by executors."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any, Protocol, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.operators import diff as ops
from paritas.plans.planner import Result
from paritas.sinks.interpolate import Output, diff_places, project, result_places


@dataclass(frozen=True)
class Task:
    """What outputs tell of a run."""

    id: str = "task"
    source: str = "source"
    target: str = "target"
    strategy: str = ""
    algorithm: str = ""
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def attributes(self) -> dict[str, str]:
        return {"taskId": self.id, "sourceTable": self.source, "targetTable": self.target, "strategy": self.strategy, "algorithm": self.algorithm, "timestamp": self.started.strftime("%Y-%m-%d %H:%M:%S")}


class Sink(Protocol):
    """Gets a result, or the error that took its place.

    Where it has them, open(task) is called before the run, segments(task, trace) with what a bisection decides for each
    segment before the result, and close(task) at the end, whatever happened.
    """

    def result(self, task: Task, result: Result) -> None: ...

    def error(self, task: Task, error: BaseException) -> None: ...


class _Quiet:
    def error(self, task: Task, error: BaseException) -> None:
        """Nothing is written of a run that failed."""


@dataclass
class ConsoleDifferences(_Quiet):
    """Up to max_rows differences as JSON, in key order, and a notice if there are more."""

    max_rows: int = 100
    pretty: bool = True
    to: TextIO = field(default_factory=lambda: sys.stdout)

    def result(self, task: Task, result: Result) -> None:
        p = result.prepared
        rows = ops.records(result.top(self.max_rows + 1), p.keys, p.columns, p.target_names).toJSON().collect()
        for row in rows[: self.max_rows]:
            print(json.dumps({"event": "diff", **json.loads(row)}, indent=2 if self.pretty else None, ensure_ascii=False), file=self.to)
        if len(rows) > self.max_rows:
            print(json.dumps({"event": "truncated", "maxRows": self.max_rows}), file=self.to)


@dataclass
class ConsoleResult:
    pretty: bool = True
    to: TextIO = field(default_factory=lambda: sys.stdout)

    def result(self, task: Task, result: Result) -> None:
        stats = result.stats.first().asDict()
        text = f"{stats['total_differences']} differences, {stats['difference_percentage']:.2%} of the larger side"
        print(json.dumps({"event": "result", "status": stats["status"], "statistics": stats, "summary": text, "metadata": task.attributes()}, indent=2 if self.pretty else None), file=self.to)

    def error(self, task: Task, error: BaseException) -> None:
        print(json.dumps({"event": "error", "status": "ERROR", "summary": str(error), "metadata": task.attributes()}), file=self.to)


def _differences(result: Result, task: Task, outputs: Sequence[Output], merge: bool) -> DataFrame:
    p = result.prepared
    if not outputs:
        return result.records
    places = diff_places(p.keys, p.columns, task.attributes(), p.target_names)
    defaults = ops.record_columns(p.keys, p.columns, p.target_names) if merge else None
    return project(result.diff, outputs, places, defaults)


@dataclass
class JsonDifferences(_Quiet):
    """Differences as JSON lines, or with array as one file holding an array, which is for small results only."""

    path: str = "diff-record-${taskId}.json"
    outputs: tuple[Output, ...] = ()
    merge: bool = False
    array: bool = False
    array_rows: int = 100_000

    def result(self, task: Task, result: Result) -> None:
        rows, path = _differences(result, task, self.outputs, self.merge), self.path.replace("${taskId}", task.id)
        if not self.array:
            rows.write.mode("overwrite").json(path)
            return
        held = rows.limit(self.array_rows + 1).toJSON().collect()
        if len(held) > self.array_rows:
            raise ValueError(f"more than {self.array_rows} differences for one array; write JSON lines")
        with open(path, "w") as f:
            f.write("[" + ",\n ".join(held) + "]\n")


@dataclass
class JsonResult(_Quiet):
    path: str = "result-${taskId}.json"
    outputs: tuple[Output, ...] = ()

    def result(self, task: Task, result: Result) -> None:
        row = project(result.stats, self.outputs, result_places(task.attributes())) if self.outputs else result.stats
        with open(self.path.replace("${taskId}", task.id), "w") as f:
            json.dump(row.first().asDict(), f, default=str)


@dataclass
class CsvDifferences(_Quiet):
    path: str = "diff-record-${taskId}.csv"
    delimiter: str = ","
    header: bool = True

    def result(self, task: Task, result: Result) -> None:
        rows = result.records.select(F.upper("operation").alias("operation"), F.array_join("primary_key", ",", "").alias("primaryKey"), F.to_json("source_values").alias("sourceValues"), F.to_json("target_values").alias("targetValues"))
        rows.write.mode("overwrite").csv(self.path.replace("${taskId}", task.id), header=self.header, sep=self.delimiter, escape='"', quote='"')


@dataclass
class CsvResult(_Quiet):
    path: str = "result-${taskId}.csv"
    delimiter: str = ","

    def result(self, task: Task, result: Result) -> None:
        rows = result.stats.select(F.lit(task.id).alias("taskId"), F.col("total_differences").alias("totalDifferences"), F.col("source_missing_count").alias("sourceMissingCount"), F.col("target_missing_count").alias("targetMissingCount"), F.col("mismatch_count").alias("mismatchCount"))
        rows.coalesce(1).write.mode("overwrite").csv(self.path.replace("${taskId}", task.id), header=True, sep=self.delimiter)


def save(rows: DataFrame, table: str, options: dict[str, str] | None = None) -> None:
    """Appends rows to a table of the catalog, or with a url among options to one behind JDBC, created where missing."""
    if options and "url" in options:
        rows.write.mode("append").format("jdbc").options(**({"batchsize": "1000"} | options), dbtable=table).save()
    else:
        rows.write.mode("append").saveAsTable(table)


@dataclass
class TableDifferences(_Quiet):
    """Differences in the flat layout, both sides' values as text, or as typed outputs."""

    table: str
    outputs: tuple[Output, ...] = ()
    options: dict[str, str] = field(default_factory=dict)

    def result(self, task: Task, result: Result) -> None:
        p = result.prepared
        if self.outputs:
            rows = _differences(result, task, self.outputs, False)
        else:
            rows = ops.flat(result.diff, p.keys, p.columns, task.id)
            rows = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns])
        save(rows, self.table, self.options)


@dataclass
class TableResult:
    table: str
    options: dict[str, str] = field(default_factory=dict)

    def result(self, task: Task, result: Result) -> None:
        save(result_row(result.stats, task), self.table, self.options)

    def error(self, task: Task, error: BaseException) -> None:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        zero = {c: 0 for c in ("source_missing_count", "target_missing_count", "mismatch_count", "total_differences")}
        row = spark.range(1).select([F.lit(v).cast("long").alias(k) for k, v in zero.items()] + [F.lit("ERROR").alias("status")])
        save(result_row(row, task), self.table, self.options)


def result_row(stats: DataFrame, task: Task) -> DataFrame:
    return stats.select(
        F.lit(task.id).alias("nl_dq_execution_id"), F.lit(task.source).alias("src_table"), F.lit(task.target).alias("tgt_table"),
        F.col("total_differences").alias("diff_count"), F.col("source_missing_count").alias("src_missing"), F.col("target_missing_count").alias("tgt_missing"),
        "mismatch_count", F.col("status").alias("run_status"), F.lit(task.started.strftime("%Y-%m-%d %H:%M:%S")).alias("completed_at"),
    )


#: Sinks by format and kind of output; register() adds more.
SINKS: dict[str, Callable[..., Sink]] = {
    "console:diff-record": ConsoleDifferences, "console:result": ConsoleResult, "json:diff-record": JsonDifferences, "json:result": JsonResult,
    "csv:diff-record": CsvDifferences, "csv:result": CsvResult, "table:diff-record": TableDifferences, "table:result": TableResult,
}


def register(name: str, sink: Callable[..., Sink]) -> None:
    if name in SINKS:
        raise ValueError(f"there is a sink {name} already")
    SINKS[name] = sink


def make(name: str, **options: Any) -> Sink:
    if name not in SINKS:
        raise ValueError(f"no sink {name!r}; there are {', '.join(SINKS)}")
    return SINKS[name](**options)


def publish(sinks: Sequence[Sink], task: Task, run: Callable[[], Result], fail_on_sink_error: bool = True) -> Result:
    """Runs a comparison and hands its result, or its error, to all sinks; those that were opened are closed."""

    def told(sink: Sink, what: str, *more: Any) -> None:
        """Calls a sink, if it has what; its failure counts only where that is asked for."""
        try:
            if hasattr(sink, what):
                getattr(sink, what)(task, *more)
        except Exception:
            if fail_on_sink_error:
                raise

    opened: list[Sink] = []
    try:
        for sink in sinks:
            told(sink, "open")
            opened.append(sink)
        try:
            result = run()
        except Exception as error:
            for sink in sinks:
                sink.error(task, error)
            raise
        for sink in sinks:
            if hasattr(sink, "segments"):
                told(sink, "segments", result.trace())
            told(sink, "result", result)
        return result
    finally:
        for sink in opened:
            told(sink, "close")
