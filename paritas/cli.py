"""Command line: diff, probe, config generate and config validate."""

from __future__ import annotations

import argparse
import json
import sys

from paritas import config as cfg
from paritas.plans.planner import choose, compare
from paritas.session import session
from paritas.sinks.writers import publish
from paritas.sources.readers import probe, schema


def _written(value: dict, kind: str) -> str:
    if kind == "json":
        return json.dumps(value, indent=2)
    import yaml

    return yaml.safe_dump(value, sort_keys=False)


def run(argv: list[str] | None = None) -> int:
    """0: equal, or the command succeeded; 1: differences; 2: a wrong configuration or a failure."""
    parser = argparse.ArgumentParser(prog="paritas", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    diff = commands.add_parser("diff", help="compare two sides")
    diff.add_argument("-c", "--config", required=True)
    diff.add_argument("--dry-run", action="store_true", help="only count the rows of both sides")
    diff.add_argument("--verbose", action="store_true", help="print the plan")
    generate = commands.add_parser("generate", help="print a configuration to start from")
    generate.add_argument("--advanced", action="store_true")
    generate.add_argument("--format", choices=("yaml", "json"), default="yaml")
    validate = commands.add_parser("validate", help="check a configuration")
    validate.add_argument("-c", "--config", required=True)
    validate.add_argument("--connect", action="store_true", help="also read both schemas")
    args = parser.parse_args(argv)
    if args.command == "generate":
        print(_written(cfg.template(args.advanced), args.format))
        return 0
    try:
        loaded = cfg.load(args.config)
        job = cfg.job(loaded)
        if args.command == "validate":
            facts = {"valid": True, "strategy": choose(job.comparison), "config": cfg.masked(loaded)}
            if args.connect:
                spark = session("paritas-validate")
                facts["schemas"] = {w: schema(spark, s.resource).simpleString() for w, s in (("source", job.comparison.source), ("target", job.comparison.target))}
            print(json.dumps(facts, indent=2))
            return 0
        spark = session("paritas-diff")
        if args.dry_run:
            print(json.dumps(dict(zip(("source_rows", "target_rows"), probe(spark, job.comparison), strict=True))))
            return 0
        result = publish(job.sinks, job.task, lambda: compare(spark, job.comparison).checked().held(), job.fail_on_sink_error)
        if args.verbose:
            result.diff.explain("formatted")
        found = not result.diff.isEmpty()
        result.diff.unpersist()
        return int(found)
    except (ValueError, KeyError, TypeError, OSError) as error:
        print(json.dumps({"valid": False, "error": cfg.masked(str(error) or type(error).__name__)}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run())
