"""Seconds per headline query; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from noonday.plans import REGISTRY
from noonday.session import build_session

HEADLINE = (
    "report_flagship", "day_rollup", "ahi_weighted", "day_from_samples", "rolling_max_avg", "rolling_max_long", "threshold_episodes",
    "mask_sessions", "locf", "histogram_percentile", "percentile_exact", "wave_summary", "interval_join", "nearest_day",
    "pair_by_ordinal", "offset_range_join", "record_dedupe", "session_dedupe_fuzzy", "sleep_profile", "sleep_days",
    "settings_guard", "range_fanout", "leak_metrics", "family_rank", "recent_window_files", "candidate_score_topk",
    "parse_kv", "parse_delimited", "mode_classify", "explode_fixed_records", "decode_edf",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "noonday-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="noonday-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    # One small job first, so that the first query is not charged for starting up.
    REGISTRY["clinical_day"].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        REGISTRY[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
