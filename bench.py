#!/usr/bin/env python
"""Bench: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is run to completion through the ``noop`` sink (full execution, no
collection to the driver). ``index_build`` times cleaning, chunking, embedding
and writing the keyword/vector tables, ``ivf_build`` assigning the given
vectors to their cells; the searches then read these, as a deployed job would.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from hybridlake.plans.corpus import driver_index, driver_ivf  # noqa: E402
from hybridlake.plans.driver import QUERIES  # noqa: E402
from hybridlake.session import local_session  # noqa: E402

HEADLINE = ("clean_text", "chunk_records", "hash_embedding", "keyword_search", "knn_l2", "knn_cosine",
            "knn_ivf", "hybrid_search", "search_hits", "rag_prompts", "upsert_latest", "streaming_ingest")
WARMUP = ("chunk_records", "hash_embedding", "hybrid_search", "rag_prompts", "streaming_ingest")


def run(spark, name: str, sf: str) -> float:
    t = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="hybridlake-bench")
    warm = os.path.join(os.path.dirname(sf), "sf0.001")
    if os.path.isdir(warm) and warm != sf:
        for name in WARMUP:
            run(spark, name, warm)
    times: dict[str, float] = {}
    t = time.perf_counter()
    idx = driver_index(spark, sf)
    times["index_build"] = time.perf_counter() - t
    n_chunks = idx.records.count()
    t = time.perf_counter()
    driver_ivf(spark, sf)
    times["ivf_build"] = time.perf_counter() - t
    for name in HEADLINE:
        times[name] = run(spark, name, sf)
    m = re.search(r"sf([0-9.]+)$", sf)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(m.group(1)) if m else sf,
        "chunks": n_chunks,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
