"""Time the headline queries: one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

from marlstone.plans import QUERIES  # noqa: E402
from marlstone.plans.retrieval import stored  # noqa: E402
from marlstone.session import local_session  # noqa: E402

HEADLINE = ["bm25_topk", "bm25_topk_filtered", "hash_embed", "dense_topk", "hash_dense_topk", "rrf_fuse", "hybrid_search", "rerank_two_block", "eval_summary", "metadata_filter", "hazard_flags", "router_tasks", "usage_summary", "ttl_cache_hits", "throttle_schedule", "reconcile_discrepancy", "answer_turn", "term_document_frequency"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["metadata_filter"](spark, sf_dir).count()  # starts the session
    began = time.time()
    stored(spark, sf_dir)  # the index, which queries open from then on
    took = {"index_build": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
