"""Print the physical plans of the headline steps as they look at scale.

Usage: python tools/plans.py [sf_dir] > PLANS.md

Automatic broadcast joins are switched off so the plans show the strategy the
large tables get on a cluster (at 100 TB no fact-side input is under the
broadcast threshold).  AQE is switched off for the printout so the static
plan with every exchange is visible.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    from roadworthy import params as P
    from roadworthy.operators import defects as D
    from roadworthy.operators import facts, lookup, segments
    from roadworthy.operators import fuel as FU
    from roadworthy.session import local_session
    from roadworthy.sources.bindings import bind

    spark = local_session(cores=8, shuffle_partitions=200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    src = bind(spark, sf_dir)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)
    typed = src.vehicles.select(F.col(P.KENTEKEN).alias("typed_plate"))
    steps = {
        "Fact build (A1-A5, J1-J3)": fact,
        "Brand segments (A6) on the fact": segments.brand_segments(fact, 1),
        "Defect breakdown by model (J4, A18)": D.model_breakdown(src.defects, fact),
        "Fuel by model (J5, A21)": FU.fuel_by_model(src.fuel, src.vehicles),
        "Lookup: 50 most recent reports per plate (W5)": lookup.recent_reports(
            typed, src.inspections),
    }
    print("# Physical plans at scale\n")
    print("Generated by `tools/plans.py` (automatic broadcast off, AQE off, 200 shuffle partitions).\n")
    for title, df in steps.items():
        print(f"## {title}\n\n```")
        text = df._jdf.queryExecution().executedPlan().toString()
        # the whitespace set of the strip helper prints raw; show it escaped
        text = text.replace(" \t\n\r\f\x0b", "<ws>")
        print(text)
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
