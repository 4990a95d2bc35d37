"""Check registered queries against their DuckDB twins.

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from bidlake.session import build_session  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session("local[8]", 8, driver_memory="8g")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        t = time.time()
        if name not in sqls:
            n = queries[name](spark, sf_dir).count()
            print(json.dumps({"query": name, "rows_only": n, "sec": round(time.time() - t, 2)}))
            continue
        try:
            res = compare(spark, queries[name], sqls[name], sf_dir)
        except Exception as exc:  # report and continue
            res = {"error": repr(exc)[:600]}
        ok = res.get("hash_match") and res.get("cols_match")
        bad += not ok
        print(json.dumps({"query": name, "ok": bool(ok), "sec": round(time.time() - t, 2), **res}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
