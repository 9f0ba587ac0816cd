"""Time the headline queries, each twice: ``queries`` has the first run of each in a new session, ``warm`` the second; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from lexibond.plans.queries import QUERIES

HEADLINE = ("top_pairs_documents", "top_pairs_parts", "top_pairs_conversations", "pairs_with_margins", "bigram_counts", "unigram_counts", "corpus_size", "llr_scores")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": "4m",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, warm = {}, {}
    for name in HEADLINE:
        for times in (took, warm):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm": warm, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
