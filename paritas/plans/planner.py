"""Choice of a strategy, and the run of a comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paritas.operators import diff as ops
from paritas.operators import segments
from paritas.operators import stats as st
from paritas.sources.readers import Prepared, prepare
from paritas.spec import Comparison, Resource

#: Strategies, and other names for them.
ALIASES = {"join": "server-join", "checksum": "pushdown-checksum", "merge": "streaming-merge"}
STRATEGIES = ("pushdown-checksum", "server-join", "key-hash", "streaming-merge")


@dataclass(frozen=True)
class Abilities:
    """What a resource can do; sources that Spark reads can do all."""

    hashing: bool = True
    joining: bool = True
    scanning: bool = True


def domain(resource: Resource) -> str:
    """Resources of one domain can be joined where they are; for Spark these are all but those of other databases."""
    url = resource.options.get("url")
    return f"{resource.kind}:{url}" if url else "spark"


def choose(comparison: Comparison, source: Abilities = Abilities(), target: Abilities = Abilities()) -> str:
    """The first strategy of the preference that both sides can do; else, with fallback, any that they can."""
    strategy = comparison.strategy
    default = {"join": ("server-join",), "merge": ("streaming-merge",), "checksum": ("pushdown-checksum", "key-hash", "streaming-merge")}[strategy.mode]
    wanted = [ALIASES.get(p.lower(), p.lower()) for p in strategy.prefer] or list(default)
    if unknown := [w for w in wanted if w not in STRATEGIES]:
        raise ValueError(f"no strategy {', '.join(unknown)}; there are {', '.join(STRATEGIES)}")
    hashing, scanning = source.hashing and target.hashing, source.scanning and target.scanning
    tables = "sql" not in (comparison.source.resource.kind, comparison.target.resource.kind)
    near = domain(comparison.source.resource) == domain(comparison.target.resource)
    can = {
        "pushdown-checksum": hashing,
        "key-hash": hashing,
        "server-join": source.joining and target.joining and near and (tables or domain(comparison.source.resource) == "spark"),
        "streaming-merge": scanning,
    }
    if strategy.mode == "join" and not strategy.prefer:
        rest: list[str] = []
    else:
        rest = [s for s in STRATEGIES if s not in wanted] if strategy.fallback else []
    for name in [*wanted, *rest]:
        if can[name]:
            return name
    raise ValueError(f"neither {' nor '.join([*wanted, *rest])} can compare these sides")


def algorithm(asked: str, source_has_xor: bool = True, target_has_xor: bool = True) -> str:
    """xor only where both sides have it."""
    return asked if asked != "xor" or (source_has_xor and target_has_xor) else "concat"


@dataclass(frozen=True)
class Result:
    """Lazy frames of a comparison: differences with both sides' values, and a row of statistics."""

    strategy: str
    prepared: Prepared
    diff: DataFrame
    most: int = 1_000_000
    comparison: Comparison | None = None

    def checked(self) -> Result:
        """This result, or an error if it has more differences than the strategy allows; one job, which stops there."""
        ops.checked(self.diff, self.most)
        return self

    def held(self) -> Result:
        """This result, whose differences are kept once they have been read: for several outputs, after checked()."""
        self.diff.persist()
        return self

    def trace(self, factor: int = 8, levels: int = 3, threshold: int = 8_000) -> DataFrame:
        """What a bisection decides for each segment, by the canonical text that a checksum comparison reads."""
        p, c = self.prepared, self.comparison
        strict = c.strategy.strict_nulls if c else False
        texts = [ops.normalized(df, (*p.keys, *p.columns), rules, strict) for df, rules in ((p.source, c and c.source.rules), (p.target, c and c.target.rules))]
        return ops.bisection(*texts, p.keys, p.columns, factor, levels, threshold)

    @property
    def records(self) -> DataFrame:
        return ops.records(self.diff, self.prepared.keys, self.prepared.columns, self.prepared.target_names)

    @property
    def flat(self) -> DataFrame:
        return ops.flat(self.diff, self.prepared.keys, self.prepared.columns)

    @property
    def stats(self) -> DataFrame:
        return st.statistics(self.diff, self.prepared.source, self.prepared.target)

    def top(self, n: int) -> DataFrame:
        return st.top(self.diff, self.prepared.keys, n)


def _checksum(c: Comparison, p: Prepared, local: str) -> DataFrame:
    s = c.strategy
    buckets = segments.bucket_number(p.source.count()) if s.buckets is None else s.buckets
    return ops.checksum_diff(p.source, p.target, p.keys, p.columns, source_rules=c.source.rules, target_rules=c.target.rules, strict_nulls=s.strict_nulls, buckets=buckets, algorithm=algorithm(s.algorithm), local=local, equal=s.equal)


#: How each strategy gives the differences; register() replaces or adds one.
EXECUTORS: dict[str, Callable[[Comparison, Prepared], DataFrame]] = {
    "pushdown-checksum": lambda c, p: _checksum(c, p, c.strategy.local),
    "key-hash": lambda c, p: _checksum(c, p, "row-hash"),
    "server-join": lambda c, p: ops.join_diff(p.source, p.target, p.keys, p.columns, c.strategy.equal),
    "streaming-merge": lambda c, p: ops.merge_diff(p.source, p.target, p.keys, p.columns, c.strategy.validate_unique_keys),
}


def register(name: str, executor: Callable[[Comparison, Prepared], DataFrame]) -> None:
    EXECUTORS[name] = executor


def compare(spark: SparkSession, comparison: Comparison) -> Result:
    """Plans and declares the comparison; only what the strategy asks for runs at once: a check for repeated keys, or a count
    of rows for the number of buckets. checked() of the result holds it to the strategy's most differences.
    """
    name = choose(comparison)
    prepared = prepare(spark, comparison)
    return Result(name, prepared, EXECUTORS[name](comparison, prepared), comparison.strategy.max_differences, comparison)
