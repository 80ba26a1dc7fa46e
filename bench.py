"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from relevara.plans import catalogue, judging
from relevara.plans import queries as core

QUERIES = core.QUERIES | catalogue.QUERIES | judging.QUERIES

HEADLINE = ("a03_pooled_ndcg", "a08_cells", "a15_aggregates", "a28_metrics_by_label_set", "a25_kappa", "j08_collisions", "w04_first_seen", "w05_holm", "a19_median_fill", "p13_strip_html", "p28_discount", "t01_bm25_top30", "c01_audit_class", "f02_upload_items", "w10_chunks")


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a23_id_mode"](spark, data).collect()  # starts the session; it makes none of the tables that queries share
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": data.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
