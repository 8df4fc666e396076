"""Plan audit: for each query, count raw-table scans, shuffles, broadcasts,
sort-merge joins, nested-loop joins, Python stages and window-group limits
in the formatted physical plan, and report the parquet ReadSchema widths.

usage: python tools/plan_audit.py [sf_dir] [name ...]   (prints a markdown table)
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendspark.plans.registry import QUERIES, load_all  # noqa: E402
from trendspark.session import get_spark  # noqa: E402

PATTERNS = {
    "scans": r"^\(\d+\) Scan parquet",
    "shuffles": r"^\(\d+\) Exchange\b",
    "broadcasts": r"^\(\d+\) BroadcastExchange",
    "smj": r"^\(\d+\) SortMergeJoin",
    "nested_loop": r"^\(\d+\) BroadcastNestedLoopJoin",
    "python": r"^\(\d+\) (MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython)",
    "group_limit": r"^\(\d+\) WindowGroupLimit",
}


def audit(df) -> dict:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    out = {k: len(re.findall(p, text, re.M)) for k, p in PATTERNS.items()}
    widths = [len(m.split(",")) for m in re.findall(r"ReadSchema: struct<(.*)>", text)]
    out["max_read_cols"] = max(widths) if widths else 0
    return out


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    load_all()
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    cols = list(PATTERNS) + ["max_read_cols"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for n in names or sorted(QUERIES):
        try:
            a = audit(QUERIES[n](spark, sf))
        except Exception as e:  # noqa: BLE001
            print(f"| {n} | error: {str(e)[:60]} |")
            continue
        print(f"| {n} | " + " | ".join(str(a[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
