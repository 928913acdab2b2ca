"""Command line: audit a data set, verify a summary, export schemas, trace lineage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="auditlake")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="exact duplicates of a data set as findings")
    a.add_argument("path")
    a.add_argument("--format", default="auto")
    a.add_argument("--output", help="a folder for all findings as JSON lines; without it all are printed")
    v = sub.add_parser("verify", help="check a signed summary")
    v.add_argument("summary")
    s = sub.add_parser("schemas", help="write the row types")
    s.add_argument("folder")
    t = sub.add_parser("trace", help="what lies downstream of a node")
    t.add_argument("nodes")
    t.add_argument("edges")
    t.add_argument("root")
    args = p.parse_args(argv)

    from auditlake.operators import governance, samples
    from auditlake.plans import engine
    from auditlake.sources import datasets, sinks

    if args.command == "verify":
        ok, why = governance.verify_summary(sinks.read_summary(args.summary))
        print(why)
        return 0 if ok else 1
    if args.command == "schemas":
        print("\n".join(sinks.export_schemas(args.folder)))
        return 0
    spark = SparkSession.builder.appName("auditlake").getOrCreate()
    if args.command == "trace":
        print(sinks.text_table(engine.trace(spark.read.json(args.nodes), spark.read.json(args.edges), args.root)))
        return 0
    path = datasets.unpacked(spark, args.path) if args.path.endswith(".zip") else args.path
    rows = datasets.load(spark, path, args.format)
    files = datasets.images(spark, path, content=True).select("path", F.sha2("content", 256).alias("digest"))
    found = samples.exact_duplicates(rows.join(files, "path"), F.col("digest")).select("finding_id", "asset", "severity", "disposition", "original_sample_id").orderBy("finding_id")
    if args.output:
        found.write.json(args.output)
        found = spark.read.schema(found.schema).json(args.output)
        print(sinks.text_table(found))
        print(f"{found.count()} findings in {args.output}")
    else:
        n = 0
        for n, r in enumerate(found.toLocalIterator(), 1):
            print("  ".join("" if v is None else str(v) for v in r))
        print(f"{n} findings")
    return 0


if __name__ == "__main__":
    sys.exit(main())
