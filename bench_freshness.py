"""Time from a click's arrival to its count in the version log, with a one-second trigger.

Prints one JSON line. Clicks are the events of ``$BENCH_SF_DIR``, written as JSON files one after another.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from clickloom.plans import inputs
from clickloom.session import build_session, scratch_path
from clickloom.sources.clicks import encode_events, parse_clicks, read_click_files
from clickloom.streaming import counts

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FILES = int(os.environ.get("BENCH_FILES", "10"))


def main() -> None:
    spark = build_session(
        "clickloom-freshness",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    clicks = inputs.clicks(spark, SF_DIR).withColumn("hot", F.lit(False))
    staged = scratch_path(spark, "staged")
    encode_events(clicks).select("value").repartition(FILES).write.text(staged)
    files = sorted(name for name in os.listdir(staged) if name.startswith("part-"))
    source, log = scratch_path(spark, "source"), scratch_path(spark, "log")
    os.makedirs(source)
    config = counts.CountingConfig(cutoff_ms=None, state_ttl_ms=60 * 86_400_000)
    job = counts.start_counting(
        parse_clicks(read_click_files(spark, source)), log, scratch_path(spark, "checkpoint"), config=config
    )
    visible, sent = [], 0
    for name in files:
        with open(os.path.join(staged, name)) as lines:
            sent += sum(1 for _ in lines)
        before = {p.batchId for p in job.recentProgress}
        started = time.perf_counter()
        os.rename(os.path.join(staged, name), os.path.join(source, name))
        while not any(p.batchId not in before and p.numInputRows for p in job.recentProgress):
            time.sleep(0.02)
            if job.exception() or time.perf_counter() - started > 120:
                raise RuntimeError(f"the job did not progress: {job.exception()}")
        visible.append(time.perf_counter() - started)
    job.stop()
    counted = counts.current_counts(counts.read_versions(spark, log)).agg(F.sum("click_count")).first()[0]
    print(
        json.dumps(
            {
                "metric": "click_to_visible_seconds",
                "value": round(statistics.median(visible[1:]), 3),
                "unit": "sec",
                "worst_after_first": round(max(visible[1:]), 3),
                "clicks_per_file": sent // len(files),
                "sent": sent,
                "counted": counted,
                "lost": sent - counted,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
