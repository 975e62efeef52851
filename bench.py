"""Time the headline queries; print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated, or ``all``) choose what runs.
Every query runs to completion into a sink that discards rows; the first, unmeasured run
warms code generation and the file cache, the best of the following runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from snapgate.queries import QUERIES  # noqa: E402
from snapgate.session import local_session  # noqa: E402

HEADLINE = (
    "window_scan", "unseen_content_of_documents", "variant_extract", "typed_cast",
    "cast_evidence", "ref_flags_items", "ref_flags_items_shuffled", "lookup_enrich",
    "silver_products", "silver_orders", "silver_order_items", "column_profile",
    "column_profile_documents", "key_uniqueness", "full_row_duplicates", "exact_quantiles",
    "numeric_profile", "sequence_profile", "text_shape", "content_signature",
    "key_candidates_pair", "relationship_summary", "snapshot_diff", "dq_report_orders",
    "dq_report_items", "dq_report_keyless", "dq_report_silver_orders",
    "dq_report_silver_items", "dq_coverage", "dq_outcome", "upsert_state",
    "replace_window_state", "transpose_daily", "header_decode", "run_log_latest",
    "run_evidence",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session("bench", cpus, **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
    })
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        print(f"{name} first {times[0]:.2f} best {seconds[name]:.2f}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
