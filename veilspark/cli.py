"""Command line: redact files, or standard input, with Spark.

``python -m veilspark.cli [options] [input ...] [-o folder]``; without inputs lines are read from standard input and
written to standard output by the same compiled rules, without Spark.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence
from itertools import islice

from veilspark.operators.engine import VERSION, RedactConfig, Redactor, Stats

#: Lines of standard input redacted at once.
CHUNK = 4096


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Redact secrets and personal data in text.", add_help=False)
    p.add_argument("inputs", nargs="*", help="text files or folders (any path that Spark reads)")
    p.add_argument("-o", "--output", help="folder for the redacted text files")
    p.add_argument("-p", "--patterns", action="append", default=[], help="rule file; may be repeated")
    p.add_argument("--pattern-dir", help="folder of rule files")
    p.add_argument("-c", "--compliance", default="", help="profiles: hipaa,pci,gdpr,soc2,all")
    p.add_argument("-d", "--defaults", dest="defaults", action="store_true", default=True, help="with the built-in rules (default)")
    p.add_argument("-D", "--no-defaults", dest="defaults", action="store_false", help="without the built-in rules")
    p.add_argument("-j", "--threads", type=int, default=0, help="local executor threads, 0: all")
    p.add_argument("-m", "--mode", choices=("complete", "cascade"), default="complete")
    p.add_argument("-q", "--quiet", dest="stats", action="store_false", default=True, help="no statistics")
    p.add_argument("-s", "--stats", dest="stats", action="store_true", help="statistics on standard error (default)")
    p.add_argument("-H", "--hwinfo", action="store_true", help="show how Spark would run here")
    p.add_argument("-v", "--version", action="version", version=f"veilspark {VERSION}")
    p.add_argument("-h", "--help", action="help")
    return p


def load(args: argparse.Namespace) -> Redactor:
    from veilspark.operators.rules import RuleSet

    config = RedactConfig(pattern_dir=args.pattern_dir, compliance=tuple(x for x in args.compliance.split(",") if x), include_defaults=args.defaults, mode=args.mode)
    rules = config.rules() if args.defaults or args.pattern_dir or args.compliance else RuleSet()
    for path in args.patterns:
        rules = rules.union(RuleSet.from_file(path))
    for r in rules.rejects:
        print(f"{r.source}:{r.line}: {r.reason}", file=sys.stderr)
    if not len(rules):
        raise SystemExit("no rules")
    return Redactor(None, rules, config.policy())


def report(s: Stats) -> None:
    print(
        f"lines {s.lines_processed}, modified {s.lines_modified} ({s.modified_percent:.2f} %), matches {s.patterns_matched}, rules {s.patterns_loaded}, "
        f"{s.elapsed_seconds:.3f} s, {s.lines_per_second:.0f} lines/s, {s.mb_per_second:.1f} MB/s", file=sys.stderr,
    )


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.hwinfo:
        import os

        print(f"cores {os.cpu_count()}, master local[{args.threads or '*'}]")
        return 0
    redactor = load(args)
    if not args.inputs:
        source = iter(sys.stdin)
        while chunk := list(islice(source, CHUNK)):
            ends = ["\n" if x.endswith("\n") else "" for x in chunk]
            for text, end in zip(redactor.redact_values([x.removesuffix("\n") for x in chunk]), ends, strict=True):
                sys.stdout.write(f"{text or ''}{end}")
        if args.stats:
            report(redactor.totals)
        return 0
    if not args.output:
        raise SystemExit("inputs need an output folder (-o)")
    from pyspark.sql import SparkSession

    from veilspark.sources.lines import read_lines, write_lines

    spark = SparkSession.builder.master(f"local[{args.threads or '*'}]").appName("veilspark").getOrCreate()
    redactor.spark, began = spark, time.monotonic()
    done, seen = redactor.observed(read_lines(spark, list(args.inputs)), "value")
    write_lines(done, args.output)
    if args.stats:
        got = seen.get
        report(Stats(got["rows"], got["rows_modified"] or 0, got["patterns_matched"] or 0, 0, got["bytes_read"] or 0, got["bytes_written"] or 0, len(redactor.rules), time.monotonic() - began))
    return 0


if __name__ == "__main__":
    sys.exit(main())
