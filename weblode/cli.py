"""Command line: collect inputs, extract, write. `python -m weblode.cli --help` lists the options."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from weblode.operators import registry, relational, sinks
from weblode.plans import engine
from weblode.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weblode", description="Finds every URL, path, host and endpoint in web content.")
    add = p.add_argument
    add("-f", "--file", action="append", default=[], help="file to read (repeatable)")
    add("-u", "--url", action="append", default=[], help="URL to fetch (repeatable)")
    add("-l", "--list", action="append", default=[], help="file that lists URLs (repeatable)")
    add("-d", "--dir", action="append", default=[], help="folder to read (repeatable)")
    add("--raw", action="store_true", help="read standard input as well")
    add("-o", "--output", help="write one stream to this path")
    add("-oD", "--output-dir", default="weblode_output", help="folder for the lists by category")
    add("--folders", action="store_true", help="write the lists as folders, by all tasks at once")
    add("-t", "--threads", type=int, default=0, help="tasks that extraction is spread over (0: as the inputs come)")
    add("-v", "--verbose", action="store_true", help="name every input that was left out, and why")
    add("--json", action="store_true", help="JSON Lines")
    add("--csv", action="store_true", help="CSV")
    add("--urls-only", action="store_true", help="plain URLs")
    add("--with-source", action="store_true")
    add("--with-params", action="store_true")
    add("--with-methods", action="store_true")
    add("--debug", action="store_true", help="add the detection to text lines")
    add("--scope", default="", help="keep URLs that contain this text")
    add("--exclude", default="", help="drop URLs that match this pattern")
    add("--include", default="", help="keep URLs that match this pattern")
    add("--max-size", type=int, default=files.MAX_MEGABYTES, help="megabytes a file may have")
    add("--timeout", type=float, default=10, help="seconds a fetch may take")
    add("--list-techniques", action="store_true")
    add("-q", "--quiet", action="store_true", help="no summary")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weblode").getOrCreate()
    if options.list_techniques:
        registry.techniques(spark).orderBy("id").show(100, truncate=False)
        return 0
    piped = sys.stdin.read() if options.raw or not (options.file or options.url or options.list or options.dir or sys.stdin is None or sys.stdin.isatty()) else None
    if not (options.file or options.url or options.list or options.dir or piped):
        parser().print_usage()
        return 1
    inputs = files.read_inputs(spark, options.url, options.list, options.file, options.dir, piped, options.max_size, options.timeout)
    docs = (inputs.docs.repartition(options.threads) if options.threads > 0 else inputs.docs).cache()
    rejected = inputs.rejected.cache()
    results = engine.extract(docs, options.scope, options.exclude, options.include).cache()
    parts = {"methods": options.with_methods, "params": options.with_params, "source": options.with_source, "debug": options.debug}
    single = options.json or options.csv or options.urls_only or options.output
    if single and options.output:
        write = sinks.write_json_lines if options.json else sinks.write_csv if options.csv else None
        write(results, options.output) if write else sinks.write_text(results, options.output, **({} if options.urls_only else parts))
    elif single:
        lines = sinks.as_json(results).toJSON().toLocalIterator() if options.json else (r[0] for r in _printed(results, options, parts).toLocalIterator())
        for line in lines:
            print(line)
    elif options.folders:
        sinks.write_category_folders(results, options.output_dir, methods=options.with_methods)
    else:
        for name, lines in sorted(sinks.write_files(results, options.output_dir, methods=options.with_methods).items()):
            if not options.quiet:
                print(f"{options.output_dir}/{name}  {lines:,}")
    if options.verbose:
        for row in rejected.toLocalIterator():
            print(f"[error] {row['file_name']}: {row['reason']}", file=sys.stderr)
    if not options.quiet and not (single and not options.output):
        total = relational.totals(docs, results, rejected).first()
        shown = [("inputs processed", total["processed"]), ("URLs", total["urls"]), ("errors", total["errors"])]
        shown += [(r["category"], r["urls"]) for r in relational.summary_lines(results).orderBy("place").collect()]
        for line in boxed("Extraction complete", [f"{name:20}{n:>10,}" for name, n in shown]):
            print(line)
    return 0


def boxed(title: str, lines: list[str]) -> list[str]:
    """Lines under a centred title, in a frame of the width they need."""
    width = max(map(len, (title, *lines)))
    rule = "─" * (width + 2)
    return [f"┌{rule}┐", f"│ {title:^{width}} │", f"├{rule}┤", *(f"│ {line:{width}} │" for line in lines), f"└{rule}┘"]


def _printed(results, options, parts):
    if options.csv:
        return sinks.as_csv(results).select(F.to_csv(F.struct(*sinks.CSV_COLUMNS)))
    return sinks.as_text(results, **({} if options.urls_only else parts))


if __name__ == "__main__":
    sys.exit(main())
