"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query,
the best one counts), BENCH_QUERIES (comma-separated names instead of the headline list).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from vitalspan.plans import load_entries
from vitalspan.session import build_session

HEADLINE = [
    "km_by_risk_group", "cohort_attrition", "baseline_table", "baseline_repair_fill", "diagnosis_rollup_common", "lab_flags",
    "procedure_codes_common", "closest_vital", "multi_hot_diagnoses", "polygenic_features", "risk_score", "survival_labels",
    "interp_survival", "concordance", "td_auc", "auc_over_time", "brier_ipa", "calibration_20", "bootstrap_auc",
    "global_importance", "collapse_one_hot", "cumulative_contribution", "fingerprint_matches",
    "td_auc_continuous", "hazard_score_equations", "attribute_survival", "imputed_cells",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_entries()
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the executors
    times: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            entries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
