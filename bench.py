"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from marginalia.catalog import all_queries
from marginalia.sources.views import SCAN_PARTITIONS

HEADLINE = [
    "study_session_queue",
    "study_card_strength",
    "study_paper_stats",
    "quiz_list",
    "quiz_attempt_history",
    "grade_answer_sheet",
    "chunk_token_windows",
    "chunk_corpus",
    "text_boilerplate_rule",
    "clean_running_headers",
    "clean_narrative",
    "embed_hashed_words",
    "retrieve_dense_top_k",
    "retrieve_section_queries",
    "mine_vocabulary",
    "cards_cloze",
    "media_assembly",
    "cite_bibliography",
    "chapters_chosen_tier",
    "jobs_state",
    "report_source_pool",
    "deck_interleaved",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marginalia-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config(SCAN_PARTITIONS, cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    registered["study_due_page"](spark, folder).count()  # start the JVM and the scan once
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
