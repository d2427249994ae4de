"""Command line: process a file or folder of PDF documents."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Row, SparkSession

from ..functions.text import shortened
from ..operators import reports
from ..sources import files, sinks
from . import nets
from .config import METHODS, PRECISIONS, Settings
from .engine import Engine


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="sheafmill", description="Parse PDF documents in batches.")
    made.add_argument("target", nargs="+", help="PDF files, or folders that are searched")
    made.add_argument("-o", "--output-dir", default="output")
    made.add_argument("-m", "--method", choices=METHODS, default="auto", help="recognise pages, take their characters, or decide by document")
    made.add_argument("-l", "--lang", default="en", help="language of all documents")
    made.add_argument("--nets", help="module:function that makes the models, from the engine files and the settings")
    made.add_argument("--renderer", help="module:function that renders a page range")
    made.add_argument("--engines-dir", default="engines")
    made.add_argument("--encoder-precision", choices=PRECISIONS, default="fp16")
    made.add_argument("--rec-precision", choices=PRECISIONS, default="tf32")
    made.add_argument("--window-pages", type=int, default=64)
    made.add_argument("--batch-ratio", type=int, default=1, help="times the usual rows of a model's batch")
    made.add_argument("--warm-up-pages", type=int, default=1, help="blank pages that each model sees first; 0 for none")
    made.add_argument("--render-seconds", type=float, help="limit of one page range")
    made.add_argument("--no-formulas", dest="formulas", action="store_false")
    made.add_argument("--no-tables", dest="tables", action="store_false")
    made.add_argument("--no-render", dest="render", action="store_false", help="write the middle result and the content list only")
    made.add_argument("--bench", action="store_true", help="print the time of each stage")
    made.add_argument("--verbose", action="store_true", help="keep Spark's own messages")
    return made


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = vars(parser().parse_args(args))
    targets, bench, verbose, make, render = (options.pop(name) for name in ("target", "bench", "verbose", "nets", "renderer"))
    spark = spark or SparkSession.builder.appName("sheafmill").getOrCreate()
    if not verbose:
        spark.sparkContext.setLogLevel("ERROR")
    if not any(files.documents(spark, target).take(1) for target in targets):
        print(f"no PDF documents in {', '.join(targets)}", file=sys.stderr)
        return 1
    more = {"render": nets.named(render)} if render else {}

    def show(row: Row) -> None:
        print(f"{shortened(row.name, 46):<46} {row.pages:>6} {row.process_ms / 1000:>9.1f} s  {row.output_dir}")

    with Engine(spark, Settings(**options), make=nets.factory(make), **more) as engine:
        runs = engine.process_many(targets, show)
        print(sinks.panel("Summary", reports.run_summary(runs).first().asDict()))
        if bench:
            print(sinks.timing_table(engine.stage_report().collect(), "Stages"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
