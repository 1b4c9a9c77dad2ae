"""Print the executed physical plans of the key queries (writes PLANS.md).

Usage: python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from hybridlake.operators.keyword import keyword_search  # noqa: E402
from hybridlake.plans.corpus import driver_index, driver_queries  # noqa: E402
from hybridlake.plans.driver import QUERIES  # noqa: E402
from hybridlake.session import local_session  # noqa: E402

KEYS = ("keyword_search", "knn_l2", "knn_ivf", "hybrid_search", "search_hits", "upsert_latest",
        "history_window", "analyze_terms")


def tree(df) -> str:
    df.collect()  # runs this DataFrame's own adaptive plan to its final form
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("\n+- == Initial Plan ==")[0]  # keep the final adaptive plan only
    plan = re.sub(r"#\d+L?", "", plan)
    plan = re.sub(r"file:/\S+?(?=[,\]])", "<path>", plan)
    plan = re.sub(r", \[plan_id=\d+\]", "", plan)
    plan = re.sub(r"InMemoryFileIndex\(\d+ paths\)\[<path>, ", "", plan)
    plan = re.sub(r"Batched: true, |Format: Parquet, |DataFilters: \[[^\]]*\], ", "", plan)
    return "\n".join(line[:400] for line in plan.splitlines())


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# Executed plans of key queries\n")
    print(f"Generated by `tools/show_plans.py` on `{sf}` (local[8], AQE on; final adaptive plans).\n")
    one = driver_queries(spark, sf).filter(F.col("qid") == 3)
    print("## keyword_search for ONE query (postings join, term-bucket partition pruning)\n")
    print("```\n" + tree(keyword_search(driver_index(spark, sf), one)) + "\n```\n")
    for k in KEYS:
        print(f"## {k}\n")
        print("```\n" + tree(QUERIES[k](spark, sf)) + "\n```\n")


if __name__ == "__main__":
    main()
