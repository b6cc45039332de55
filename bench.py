"""Times the headline queries on the given tables and prints one JSON line.

Every query runs to the end through a ``noop`` write.  A query's time includes building its plan and
whatever it writes for itself; the first of two runs warms the JVM up and does not count.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedmill.plans import catalog  # noqa: E402
from feedmill.session import local_session  # noqa: E402

HEADLINE = (
    "digest_recent digest_top_per_source digest_scored recent_articles lineage_24h fully_processed "
    "articles_with_summaries digest_parts subscriber_deliveries "
    "feed_entries ingest_candidates insert_labels content_duplicates quality_rejects "
    "page_text page_plain_text page_title word_counts summary_prompts parsed_responses score_articles embed_articles "
    "article_state running_retries dead_letters replay_plan subscription_changes missing_features "
    "knn_exact knn_by_label knn_cells semantic_search stream_state stream_ingest"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, partitions=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
