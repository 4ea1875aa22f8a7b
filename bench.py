"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores). Every query is
run once, in full, into a no-op sink; BENCH_QUERIES may name other registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from askloom.plans import QUERIES
from askloom.session import local_session

HEADLINE = (
    "bm25_topk dense_topk hybrid_fuse rerank_topk retrieve_b3 chunk_windows doc_chunk_numbering minhash_dedup "
    "exact_jaccard_pairs upsert_chunks append_index select_qa_chunks qa_pairs_build clean_qa_chain hard_negatives "
    "alpha_oracle query_features12 verify_answers decompose_merge action_loop eval_per_query eval_aggregate bootstrap_p "
    "calibration_report latency_bench audit_stats split_exact stream_metrics stream_ingest_incremental"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = local_session("bench", cpus)
    # start the session's machinery (Python workers, code generation) before anything is timed
    start = time.perf_counter()
    QUERIES["bm25_topk"].run(spark, folder).write.format("noop").mode("overwrite").save()
    warm_up = round(time.perf_counter() - start, 3)
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28} {took[name]:8.2f}s", file=sys.stderr, flush=True)
    n_queries = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    rate = round(n_queries / took["hybrid_fuse"], 2) if took.get("hybrid_fuse") else None
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""), "hybrid_queries_per_sec": rate, "warm_up": warm_up}))
    spark.stop()


if __name__ == "__main__":
    main()
