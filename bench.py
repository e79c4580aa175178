"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from driftloom import catalog
from driftloom.plans import evaluate as E
from driftloom.sources.tables import posts

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["uniform_fds", "history_fds", "gaussian_fds", "kl_by_frame", "score_summary", "drift_predict", "velocity_field", "outlier_prune", "point_mass_grid", "timeline_frames", "lens_project", "lens_fit"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalog.QUERIES["history_fds"](spark, SF_DIR).collect()  # starts the JVM's and Python's workers
    for name in HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    # the models at the full grid: fit, all frame forecasts, scoring
    for m in (E.Uniform(), E.HistoricalAverage(0.1), E.GaussianHistory(0.05), E.DriftField(tune=True)):
        t = time.time()
        E.evaluate(posts(spark, SF_DIR), [m], E.Setting(100, 1.0, 1))
        took["eval_g100_" + type(m).__name__] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
