"""Batch run: ``python -m roadworthy --tables DIR [--out DIR]``.

Reads the five logical tables (``voertuigen``, ``meldingen``,
``geconstateerde_gebreken``, ``gebreken``, ``brandstof`` as Parquet below
``--tables``), builds the fact once, writes the eight documents as JSON lines
and prints where they are.  ``--testdata DIR`` binds the generated test tables
instead.  The Spark session is the one ``spark-submit`` provides; thresholds
default to the original values.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from roadworthy import params as P
from roadworthy.operators.facts import rejected_values
from roadworthy.plans.pipeline import publish_all, publish_changed_all, run_statistics
from roadworthy.session import configure, shared_dir, temporary_dir
from roadworthy.sources.bindings import bind
from roadworthy.sources.fact_store import FactStore
from roadworthy.sources.ingest import assert_files, table_file_checks
from roadworthy.sources.publish import write_json
from roadworthy.sources.tables import DATASETS, load_sources


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="roadworthy")
    src_arg = ap.add_mutually_exclusive_group(required=True)
    src_arg.add_argument("--tables", help="folder with the five logical tables as Parquet")
    src_arg.add_argument("--testdata", help="folder with the generated test tables (bound per FIXTURES.md)")
    ap.add_argument("--out", help="output folder (default: below spark.checkpoint.dir)")
    ap.add_argument("--exposure", choices=("age", "coverage"), default="age")
    ap.add_argument("--on-bad", choices=("raise", "one"), default="raise",
                    help="one: replace junk quantities, prices and dates, and write them to rejected_values")
    ap.add_argument("--check-files", action="store_true",
                    help="with --tables: stop before the run if a table's files are missing or smaller than the original's least sizes")
    ap.add_argument("--only-changed", action="store_true",
                    help="with --out: rewrite only documents, and prefixes of them, whose content changed since the last run")
    ap.add_argument("--store", help="shared folder of the stored fact: only prefixes whose inputs changed since the last run are built again")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("roadworthy").getOrCreate()
    configure(spark)
    if args.check_files and args.tables:
        assert_files(table_file_checks(spark, args.tables, list(DATASETS.values())))
    src = load_sources(spark, args.tables) if args.tables else bind(spark, args.testdata)
    base = args.out or shared_dir(spark, "documents")
    with temporary_dir(spark, "run") as work:  # the run's intermediates go when its documents are written
        store = FactStore(spark, args.store) if args.store else None
        out = run_statistics(spark, src, P.DEFAULT, exposure=args.exposure, on_bad=args.on_bad, base_dir=work, store=store)
        if args.only_changed:
            done = publish_changed_all(spark, out, base, work)
            paths = {name: f"{base}/{name}" for name in done}
            print(json.dumps({"rewritten": done}, indent=2))
        else:
            paths = publish_all(spark, out, base)
    if args.on_bad != "raise":
        rejected = rejected_values(src.inspections, src.vehicles, src.defects)
        paths["rejected_values"] = write_json(rejected, f"{base}/rejected_values")
    print(json.dumps(paths, indent=2))
    return paths


if __name__ == "__main__":
    main()
