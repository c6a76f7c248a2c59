"""python -m foliate run --pages PAGES.jsonl --results DIR: classify pages by rules and write the results."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliate import pipeline
from foliate.sources import pages as source
from foliate.sources import policies, sinks


def main() -> None:
    parser = argparse.ArgumentParser(prog="foliate")
    parser.add_argument("command", choices=["run"])
    parser.add_argument("--pages", required=True, help="page records as JSON lines or a folder of them")
    parser.add_argument("--results", required=True)
    parser.add_argument("--policies", help="folder of policy files; the mortgage policies without it")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("foliate").getOrCreate()
    rows = source.read_pages(spark, args.pages).select(F.col("source_file").alias("package"), F.col("page_index").alias("page"), F.col("raw_text").alias("raw"))
    result = pipeline.run(rows, policies.load(args.policies)) if args.policies else pipeline.run(rows)
    sinks.write_results(args.results, result.verdicts, sinks.documents(result.instances, result.ordering))


if __name__ == "__main__":
    main()
