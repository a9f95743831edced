"""Print the final (adaptive) physical plan outline of registered queries.

usage: python tools/plans.py [sf_dir] name [name ...]
Each query is run into the ``noop`` sink first so the adaptive plan is final.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from floe.plans.catalog import QUERIES  # noqa: E402
from floe.session import build_session  # noqa: E402

KEEP = re.compile(r"Exchange|BroadcastHashJoin|SortMergeJoin|Window|HashAggregate|Scan|Generate|"
                  r"InMemoryTableScan|Project|Filter|Union|Sort|AQEShuffleRead")


def outline(df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            out.append(line[:160])
    return out


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in args:
        print(f"### {name}\n```")
        for line in outline(QUERIES[name](spark, sf)):
            print(line)
        print("```\n")


if __name__ == "__main__":
    main()
