"""Time the survey at the published budget: four five-joint chains, 2,000,000 samples each, 0.03 m cells.

usage: python tools/survey_bench.py [--sf DIR] [--samples N] [--resolution M] [--coverage SHARE]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxfield.plans import spec_queries  # noqa: E402
from voxfield.plans.pipelines import run_survey  # noqa: E402
from voxfield.session import local_session  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("--samples", type=int, default=2_000_000)
    parser.add_argument("--resolution", type=float, default=0.03)
    parser.add_argument("--coverage", type=float, default=None, help="stop a chain at this share of valid cells")
    args = parser.parse_args()
    spark = local_session(8, 32, "16g")
    specs = spec_queries.base_specs(spark, args.sf)
    specs = specs.filter(F.size("chain.joints") == 5).orderBy("meta.variant_id").limit(4)
    start = time.time()
    survey = run_survey(specs, args.samples, args.resolution, target_coverage=args.coverage)
    rows = survey.maps.groupBy("variant_id").agg(
        F.count("*").alias("cells"), F.sum("attempts").alias("attempts"), F.sum("g_ws").alias("reachable")).collect()
    for r in rows:
        print(r.asDict(), flush=True)
    print(f"{time.time() - start:.1f} s, {(time.time() - start) / max(1, len(rows)):.1f} s a chain")
    spark.stop()


if __name__ == "__main__":
    main()
