"""Command line: compare, columns, head, gen-data. Exit codes: 0 identical, 1 different, 2 error, 3 duplicate keys."""

from __future__ import annotations

import argparse
import csv
import json
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from .operators.diff import compare
from .plans import datagen
from .plans.options import DiffError, Options, parse_count, parse_list, parse_size, profiles, with_profile
from .sources import sinks
from .sources.tables import open_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reckon")
    sub = p.add_subparsers(dest="verb", required=True)
    c = sub.add_parser("compare", help="compare two tables")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("-k", "--key")
    c.add_argument("-c", "--compare")
    c.add_argument("-i", "--ignore")
    for flag in ("trim", "ignore-case", "empty-is-null"):
        c.add_argument(f"--{flag}", action="store_true")
    c.add_argument("--tolerance", type=float)
    c.add_argument("--max-rows", type=parse_count)
    c.add_argument("--delimiter")
    c.add_argument("--encoding")
    c.add_argument("--engine", dest="strategy")
    c.add_argument("--profile")
    c.add_argument("--config")
    c.add_argument("--out")
    c.add_argument("--json")
    c.add_argument("--export-dir")
    c.add_argument("--summary", action="store_true")
    c.add_argument("--no-compress", action="store_true")
    c.add_argument("--fail-on-dups", action="store_true")
    c.add_argument("--part-files", action="store_true", help="export folders of part files, written by the executors")
    c.add_argument("--timings", action="store_true", help="seconds of each phase on stderr")
    c.add_argument("--threads", type=int)
    c.add_argument("--memory", type=parse_size)
    for verb in ("columns", "head"):
        h = sub.add_parser(verb)
        h.add_argument("file")
        h.add_argument("--delimiter")
        h.add_argument("--encoding")
        if verb == "head":
            h.add_argument("-n", type=parse_count, default=10)
            h.add_argument("--csv", action="store_true")
    g = sub.add_parser("gen-data", help="write a pair of tables that differ in known ways")
    g.add_argument("folder")
    g.add_argument("--rows", type=parse_count, default=10_000)
    g.add_argument("--columns", type=int, default=datagen.BASE_COLUMNS)
    g.add_argument("--seed", type=int, default=7)
    g.add_argument("--format", choices=("csv", "ndjson", "parquet"), default="csv")
    return p


def options(args: argparse.Namespace) -> Options:
    """Defaults, then the profile, then flags; switches only ever turn on."""
    opt = Options()
    if args.profile or args.config:
        known = profiles(args.config)
        if args.profile:
            if args.profile not in known:
                raise DiffError(f"no such profile: {args.profile}")
            opt = with_profile(opt, known[args.profile])
    lists = {k: parse_list(v) for k in ("key", "compare", "ignore") if (v := getattr(args, k)) is not None}
    single = {k: v for k in ("tolerance", "max_rows", "delimiter", "encoding", "strategy") if (v := getattr(args, k)) is not None}
    switches = {k: True for k in ("trim", "ignore_case", "empty_is_null") if getattr(args, k)}
    return replace(opt, **lists, **single, **switches).validate()


def cmd_compare(spark: SparkSession, args: argparse.Namespace) -> int:
    opt = options(args)
    if args.summary and (args.out or args.json or args.export_dir):
        raise DiffError("--summary writes nothing; drop --out, --json and --export-dir")
    began = time.perf_counter()
    phases, at = {}, began

    def phase(name: str) -> None:
        nonlocal at
        now = time.perf_counter()
        phases[name], at = now - at, now

    result = compare(spark, args.a, args.b, opt)
    if not args.summary:
        result.hold()
    phase("open and plan")
    counts = result.counts
    phase("scan, join, count")
    if not args.summary:
        stem = lambda p: os.path.splitext(os.path.basename(p.rstrip("/")))[0]
        out = args.out or f"{stem(args.a)}__vs__{stem(args.b)}.html"
        with open(out, "w", encoding="utf-8") as f:
            f.write(sinks.render_html(result, args.a, args.b, time.perf_counter() - began, not args.no_compress))
        if args.json:
            with open(args.json, "w", encoding="utf-8") as f:
                json.dump(sinks.to_json(result, args.a, args.b, time.perf_counter() - began), f, ensure_ascii=False, indent=1)
        if args.export_dir:
            sinks.export(result, args.export_dir, not args.part_files)
        result.release()
        phase("sections and files")
    if args.timings:
        print("; ".join(f"{k} {v:.2f} s" for k, v in phases.items()), file=sys.stderr)
    print(sinks.summary_line(result, time.perf_counter() - began))
    if args.fail_on_dups and (counts["a_dup_keys"] or counts["b_dup_keys"]):
        return 3
    return 0 if result.identical else 1


def cmd_columns(spark: SparkSession, args: argparse.Namespace) -> int:
    t = open_table(spark, args.file, Options(delimiter=args.delimiter, encoding=args.encoding))
    print("\n".join(t.names))
    rows = t.count()
    print(f"{t.kind}, {len(t.names)} columns" + (f", {rows:,} rows" if rows is not None else ""), file=sys.stderr)
    return 0


def cmd_head(spark: SparkSession, args: argparse.Namespace) -> int:
    opt = Options(delimiter=args.delimiter, encoding=args.encoding)
    t = open_table(spark, args.file, opt)
    names, rows = list(dict.fromkeys(t.names)), t.head(args.n, opt)
    if args.csv:
        out = csv.writer(sys.stdout, lineterminator="\n")
        out.writerow(names)
        out.writerows([["" if x is None else x for x in r] for r in rows])
        return 0
    clip = lambda x: x if len(x) <= 32 else x[:31] + "…"
    cells = [[clip("" if x is None else str(x).replace("\n", " ")) for x in r] for r in [names, *rows]]
    widths = [max(map(len, col)) for col in zip(*cells, strict=True)]
    for r in cells:
        print("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip())
    return 0


def cmd_gen_data(spark: SparkSession, args: argparse.Namespace) -> int:
    for name, df in zip("ab", datagen.pair(spark, args.rows, args.columns, args.seed), strict=True):
        datagen.write(df, f"{args.folder}/{name}.{args.format}", args.format)
    return 0


def session(args: argparse.Namespace) -> SparkSession:
    """A session of so many threads and so much memory; both are checked by checked()."""
    b = SparkSession.builder.appName("reckon").config("spark.sql.session.timeZone", "UTC")
    if threads := getattr(args, "threads", None):
        b = b.master(f"local[{threads}]")
    if memory := getattr(args, "memory", None):
        b = b.config("spark.driver.memory", f"{max(512, memory >> 20)}m")
    return b.getOrCreate()


def checked(args: argparse.Namespace) -> None:
    for name in ("threads", "memory"):
        if (value := getattr(args, name, None)) is not None and value <= 0:
            raise DiffError(f"{name} must be more than 0")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        checked(args)
        return {"compare": cmd_compare, "columns": cmd_columns, "head": cmd_head, "gen-data": cmd_gen_data}[args.verb](spark or session(args), args)
    except Exception as e:  # 1 means "different", so nothing else may end with it
        text = str(e).strip() or type(e).__name__
        print(f"error: {text if isinstance(e, (DiffError, OSError)) else f'{type(e).__name__}: {text.splitlines()[0]}'}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
