"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores (default 8). Each query
is timed from building its plan to having every row computed; results are not collected. ``ingest``
is the first and only build of the index and its statistics; later queries read it, as serving and
evaluation jobs do. ``encode_labelled`` likewise encodes the documents the router learns from, and
``relevance`` finds the labels, and ``candidates`` retrieves and featurises for the labelled queries.
"""

from __future__ import annotations

import json
import os
import time

from citesift.plans import tables as T
from citesift.plans.registry import QUERIES
from citesift.session import local_session

HEADLINE = [
    "chunk_documents",
    "hash_embed",
    "dense_topk",
    "dense_topk_vectors",
    "rank_features",
    "rerank_linear",
    "eval_rerank",
    "grounding_summary",
    "route_centroid",
    "f1_report",
    "ask_batch",
    "strat_split",
    "event_lines",
    "latency_summary",
    "event_rollup",
    "stream_index_table",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    started = time.perf_counter()
    work()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("citesift-bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times = {"ingest": timed(lambda: T.scorer(spark, sf_dir))}
    times["encode_labelled"] = timed(lambda: T.labelled_documents(spark, sf_dir))
    times["relevance"] = timed(lambda: T.relevance(spark, sf_dir))
    times["candidates"] = timed(lambda: T.features(spark, sf_dir))
    for name in HEADLINE:
        times[name] = timed(lambda: run(QUERIES[name](spark, sf_dir)))

    n_chunks = T.index(spark, sf_dir).count()
    encode = T.ENCODER.encode(T.index(spark, sf_dir).select("chunk_id", "text"))
    rate = n_chunks / timed(lambda: run(encode))
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "chunks": n_chunks,
                "embed_chunks_per_sec": round(rate),
            }
        )
    )


if __name__ == "__main__":
    main()
