"""Times the headline queries: one discarded warm-up, then the median of runs. Prints one JSON line.

`build` is the part in which a query is planned and writes the tables that it reads several times; the rest is its
product. `saved_spmv` is one product with a matrix that is already saved; its `build` is what saving took, once.
`scaling` has the times of SCALED on 1, 2 and 4 threads, each in a process of its own; --no-scaling leaves it out."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = ("spmv", "spmv_zero_filled", "spmm", "cuts_v2_cols", "block_values", "hybrid_spmv", "hybrid_spmm", "partition_report", "csr_indptr", "weeks_spmm_wide", "block_spmm_wide")
SCALED = ("spmv", "hybrid_spmv")
RUNS, SCALED_RUNS = 5, 2
SCALING = ("1", "2", "4")


def saved_product(spark: SparkSession, sf_dir: str, runs: int) -> tuple[float, float]:
    """Seconds of one product with a saved matrix, and of saving it."""
    from stripmill.operators import blocks as B
    from stripmill.operators.saved import product, saving
    from stripmill.plans import catalogue
    from stripmill.sources import tables

    began = time.perf_counter()
    members, blocks = B.stored(catalogue._blocked(spark, sf_dir)[2])
    with saving(members, B.split(blocks, B.is_dense(catalogue.DENSITY))) as saved:
        inspected, took = time.perf_counter() - began, []
        for _ in range(runs + 1):
            began = time.perf_counter()
            product(saved, tables.suppliers_vector(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
    return median(took[1:]), inspected


def measured(sf_dir: str, cpus: str, names: tuple[str, ...], runs: int) -> dict:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from stripmill.plans.catalogue import QUERIES

    seconds, build = {}, {}
    for name in names:
        took, built = [], []
        for _ in range(runs + 1):
            began = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            built.append(time.perf_counter() - began)
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name], build[name] = round(median(took[1:]), 3), round(median(built[1:]), 3)
    product, inspected = saved_product(spark, sf_dir, runs)
    seconds["saved_spmv"], build["saved_spmv"] = round(product, 3), round(inspected, 3)
    return {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "build": build, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    if "--scaled" in sys.argv:
        found = measured(sf_dir, cpus, SCALED, SCALED_RUNS)
    else:
        found = measured(sf_dir, cpus, HEADLINE, RUNS)
        if "--no-scaling" not in sys.argv:
            # a JVM has one master, so each number of threads has a process of its own
            runs = {c: subprocess.run([sys.executable, __file__, "--scaled"], env={**os.environ, "BENCH_CPUS": c}, capture_output=True, text=True) for c in SCALING}
            found["scaling"] = {c: json.loads(run.stdout.strip().splitlines()[-1])["queries"] if run.returncode == 0 else None for c, run in runs.items()}
    print(json.dumps(found))


if __name__ == "__main__":
    main()
