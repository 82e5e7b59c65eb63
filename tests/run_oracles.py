"""Run every registered query against its DuckDB oracle (like the driver's check).

usage: python tests/run_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tabwise.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session(8)
    con = duck(sf)
    qs, ors = E.queries(), E.oracle_sql()
    summary = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in ors:
                r = compare(df, con, ors[name])
                ok = r["rows"][0] == r["rows"][1] and r["cols"] and r["hash"]
                summary[name] = "ok" if ok else "MISMATCH"
                if not ok:
                    print(name, r["rows"], r["spark_cols"], r["duck_cols"])
                    print("  spark:", sorted(map(str, r["s_rows"]))[:4])
                    print("  duck :", sorted(map(str, r["d_rows"]))[:4])
            else:
                n = df.count()
                summary[name] = f"rows-only ({n})"
        except Exception as e:  # report and continue
            summary[name] = f"ERROR {type(e).__name__}: {str(e)[:300]}"
        print(f"{name:28s} {summary[name]}  {time.time() - t:.1f}s", flush=True)
    bad = [k for k, v in summary.items() if v != "ok" and not v.startswith("rows-only")]
    print(json.dumps({"n": len(summary), "bad": bad}))


if __name__ == "__main__":
    main()
