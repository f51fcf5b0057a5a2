"""Command line: validates the tables of a TOML document.

Exit codes: 0 all tables passed, 1 some failed, 2 an error.
"""

from __future__ import annotations

import argparse
import sys
import traceback

from pyspark.sql import SparkSession

from assayer.config import load_tables, parse_config
from assayer.errors import AssayError, ConfigError
from assayer.report import ConsoleReporter, JsonReporter, Reporter
from assayer.watch import watch


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("assayer", description=__doc__)
    parser.add_argument("-c", "--config", required=True, metavar="FILE", help="TOML document that declares tables and rules")
    parser.add_argument("-o", "--output", choices=("stdout", "json"), default="stdout")
    parser.add_argument("-p", "--path", help="folder or file for the JSON document; the current folder by default")
    parser.add_argument("-b", "--brief", action="store_true", help="only whether each table passed")
    parser.add_argument("-d", "--debug", action="store_true", help="show where an error comes from")
    parser.add_argument("-w", "--watch", action="store_true", help="run again whenever the file changes (stdout, one table)")
    return parser.parse_args(argv)


def run_once(spark: SparkSession, config: str, reporter: Reporter) -> bool:
    """Validates all tables; whether all passed."""
    tables = load_tables(config, spark)
    for k, table in enumerate(tables, 1):
        reporter.tell("table", number=k, of=len(tables), name=table.name)
    passed = 0
    for table in tables:
        result = table.validate()
        passed += result.passed
        reporter.tell("result", result=result)
    reporter.tell("end", passed=passed, failed=len(tables) - passed)
    return passed == len(tables)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    try:
        if args.watch:
            if args.output != "stdout":
                raise ConfigError("watching needs the stdout output")
            declared = parse_config(args.config)["table"]
            if len(declared) != 1:
                raise ConfigError("watching needs exactly one table")
        session = spark or SparkSession.builder.appName("assayer").getOrCreate()
        reporter = JsonReporter(args.path, args.brief) if args.output == "json" else ConsoleReporter(args.brief)
        if args.watch:
            watch(declared[0]["path"], lambda: run_once(session, args.config, reporter), waiting=lambda: reporter.tell("idle"))
            return 0
        return 0 if run_once(session, args.config, reporter) else 1
    except KeyboardInterrupt:
        return 0
    except (AssayError, OSError) as e:
        if args.debug:
            traceback.print_exc()
        print(f"Error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
