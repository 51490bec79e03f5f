"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is written to Spark's no-op sink, once to warm up and then $BENCH_RUNS times (default 2); the least time counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tidegauge.plans import catalog
from tidegauge.session import SETTINGS

QUERIES = [
    "bars_event_1h", "bars_line_1d", "bars_resampled_4h", "bar_upsert", "returns", "rolling_features", "rolling_scales", "volatility_event", "volatility_line", "bollinger", "rsi", "atr", "stochastic", "volume_indicators", "macd", "garch_volatility", "histogram_entropies",
    "permutation_entropy", "impute_interpolate", "outliers", "regime_labels", "regime_transitions", "regime_statistics", "regime_smoothed", "cluster_quality", "agreement", "walk_forward", "asof_join", "all_features", "kmeans_regimes", "gmm_regimes", "hmm_regimes", "garch_regimes", "classify_random_forest",
    "classify_boosted", "classify_svm_linear", "classify_svm_rbf", "classify_logistic", "ensemble_regimes", "ensemble_bayesian", "switching_regimes", "engine_features", "prediction_metrics",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(",")
    shared = tempfile.mkdtemp(prefix="spark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config(map=SETTINGS)
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "2"))):
            spark.catalog.clearCache()
            began = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
