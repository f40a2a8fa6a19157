"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Each query is run to
completion into a sink that keeps nothing; ``load`` is the build of all 13 credit
tables from the source tables.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "indicators", "income_pivot", "expense_pivot", "loan_rollup", "reason_rollup", "v_dataset",
    "class_balance", "export_features", "export_summary", "coded_reasons", "expert_pd",
    "policy_route", "check_incomplete", "check_warnings", "check_domains", "check_references",
    "indicators_from_documents", "scorecard_metrics", "score_bands", "cutoffs", "bias_audit",
    "imputation_values", "stratified_sample", "rationale_merge", "contributions_expert",
    "max_amount",
]


def main() -> None:
    from riskframe.plans import warehouse
    from riskframe.plans.catalog import QUERIES
    from riskframe.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("riskframe-bench", cores=cores)
    spark.range(1000).count()

    seconds: dict[str, float] = {}
    start = time.perf_counter()
    t = dict(warehouse.tables(spark, sf_dir))       # names every table, so that each is built
    seconds["load"] = round(time.perf_counter() - start, 3)
    applications = t["application"].count()
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of load and headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "applications": applications,
        "load_applications_per_sec": round(applications / seconds["load"], 1),
        "cores": cores, "spark": spark.version,
        "driver_memory": spark.conf.get("spark.driver.memory")}))
    spark.stop()


if __name__ == "__main__":
    main()
