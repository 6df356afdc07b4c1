"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES a subset by name.
Every query runs in full: all its rows are produced and thrown away.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from postbag.plans.queries import QUERIES
from postbag.session import build_session

HEADLINE = (
    "filter_criteria",
    "filter_full_text",
    "thread_expand_multi",
    "thread_expand_shuffled",
    "thread_transcript",
    "max_emails",
    "html_text",
    "clean_content",
    "batch_fixed",
    "batch_text",
    "batch_fit",
    "chunk_fixed",
    "chunk_semantic",
    "chunk_semantic_full",
    "token_estimates",
    "infer_stub",
    "ask_messages",
    "ask_batches",
    "response_gate",
    "result_record",
    "run_stats",
    "gmail_json_scan",
    "stream_ask",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="postbag-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the Python workers and compiles the common code paths.
    QUERIES["infer_stub"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
