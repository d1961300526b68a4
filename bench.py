"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default: all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "agg1_measurement_median", "agg1_measurement_mean", "flt15_selected_endpoint_window", "agg1_curation_summary",
    "agg2_bioactivity_by_molecule", "win1_duplicate_position", "agg9_rule_summary", "flt11_flagged_compounds",
    "ch13_quality_issues", "agg8_profile_summary", "agg12_regression_metrics", "win4_residual_diagnostics",
    "ml19_applicability_domain", "ml6_correlation_pairs", "ml15_ols_coefficients", "jn1_topk_tanimoto",
    "jn2_similarity_pairs", "jn2_activity_cliffs", "jn10_knn_distance", "win5_rank_bins", "agg4_scaffold_summary",
    "jn7_functional_groups",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from compoundry.plans.catalog import QUERIES
    from compoundry.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "compoundry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One short query first: class loading and code generation are not part of a query.
    QUERIES["flt19_substring_pattern"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
