"""Command line: ``python -m veilspark.cli detect|anonymize|deanonymize|scan|validate-policy|list-policies|list-detectors``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark import attach
from veilspark.functions import detectors, report, rewrite
from veilspark.functions.policy import list_policies, load_policy, validate_policy
from veilspark.operators import scan
from veilspark.sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="veilspark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("detect", "anonymize", "deanonymize", "scan"):
        p = commands.add_parser(name)
        p.add_argument("path", help="a text file, a directory, or - for standard input")
        p.add_argument("--detector", action="append", default=None)
        p.add_argument("--pattern", default="*.txt")
        p.add_argument("--recursive", action="store_true")
        if name == "detect":
            p.add_argument("--min-confidence", type=float, default=0.5)
        if name == "anonymize":
            p.add_argument("--policy", default="default_pii")
            p.add_argument("--out", help="folder for the results as JSON lines")
        if name == "deanonymize":
            p.add_argument("--mapping", required=True, help="a JSON object placeholder -> original")
    commands.add_parser("validate-policy").add_argument("policy")
    commands.add_parser("list-policies")
    commands.add_parser("list-detectors")
    return parser


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    if args.command in ("list-policies", "list-detectors"):
        print("\n".join(list_policies() if args.command == "list-policies" else detectors.list_detectors()))
        return 0
    if args.command == "validate-policy":
        problems = validate_policy(load_policy(args.policy))
        print("\n".join(problems) or "valid")
        return int(bool(problems))
    spark = attach(SparkSession.builder.appName("veilspark").getOrCreate())
    used = tuple(args.detector or ("regex",))
    if args.path == "-":
        texts = readers.read_stdin(spark).select(F.lit("-").alias("path"), "text")
    else:
        texts = readers.read_text_files(spark, args.path, args.pattern, args.recursive)
    if args.command == "scan":
        files = texts.withColumn("error", F.lit(None).cast("string")) if args.path == "-" else readers.scan_directory(spark, args.path, args.pattern, args.recursive)
        for row in files.where("error is not null").select("path", "error").toLocalIterator():
            print(json.dumps(row.asDict()))
        print(json.dumps(scan.scan_totals(scan.scan(files, "path", "text", used)).first().asDict()))
    elif args.command == "detect":
        found = report.report(F.col("text"), detectors.detect(F.col("text"), used, args.min_confidence))
        for row in texts.select("path", report.report_text(found).alias("r")).toLocalIterator():
            print(row["path"], row["r"], sep="\n")
    elif args.command == "anonymize":
        texts = readers.require_text(texts, "text")
        results = texts.select(sinks.result_json(rewrite.anonymize(F.col("text"), args.policy, detectors=used)).alias("value"))
        if args.out:
            results.write.text(args.out)
        else:
            for row in results.toLocalIterator():
                print(row["value"])
    else:
        with open(args.mapping, encoding="utf-8") as f:
            mapping = readers.parse_mapping(F.lit(f.read()))
        for row in texts.select(rewrite.deanonymize(F.col("text"), mapping).alias("t")).toLocalIterator():
            print(row["t"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
