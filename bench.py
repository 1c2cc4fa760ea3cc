"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surveyspark.queries import registry  # noqa: E402
from surveyspark.session import local_session  # noqa: E402

HEADLINE = [
    "majority_baseline", "label_encode", "kfold", "nb_predict", "permutation_importance",
    "permutation_importance_exact", "eval_feature_sets", "compare_sets", "similarity_topk",
    "parse_features", "explode_features", "build_requests", "variable_index", "stale_variables",
    "headline_aggregate", "per_target_rollup", "condition_effect", "signal_gap_spearman",
    "hit_rate", "coverage_profile", "cell_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    todo = registry.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in todo]
    todo[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not timed
    seconds = {}
    for name in names:
        start = time.perf_counter()
        todo[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
