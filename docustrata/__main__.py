"""Command line: extract TOKENS OUT [--type T]; calibrate CONFIG_DIR TYPE FIELD X1 Y1 X2 Y2 [--strategy S]; benchmark TOKENS."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from docustrata import api
from docustrata.operators.variants import run_summary
from docustrata.session import get_spark
from docustrata.sources import sinks
from docustrata.sources.tokens import enriched


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docustrata", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("tokens")
    e.add_argument("out")
    e.add_argument("--type", default="auto")
    c = sub.add_parser("calibrate")
    c.add_argument("folder")
    c.add_argument("doc_type")
    c.add_argument("field")
    c.add_argument("box", nargs=4, type=float)
    c.add_argument("--strategy", choices=("region", "anchor"), default="region")
    b = sub.add_parser("benchmark")
    b.add_argument("tokens")
    a = p.parse_args(argv)
    spark = get_spark()
    if a.command == "calibrate":
        change = spark.createDataFrame([(a.doc_type, a.field, *a.box, a.strategy)], "doc_type string, field string, rx1 double, ry1 double, rx2 double, ry2 double, strategy string")
        api.write_yaml(api.upsert(api.read_yaml(spark, a.folder), change), a.folder)
        return 0
    tokens = enriched(spark.read.parquet(a.tokens))
    if a.command == "extract":
        got = api.extract(tokens, a.type)
        sinks.write_json(sinks.result_json(got["fields"], got["review"]), a.out)
        return 0
    began = time.time()
    fields = api.extract(tokens)["fields"].persist()
    n = fields.select("doc_id").distinct().count()
    ms = (time.time() - began) * 1000 / max(1, n)
    run_summary(fields, fields.select("doc_id").distinct().withColumn("ms", F.lit(ms))).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
