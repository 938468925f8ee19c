"""Command line: python tests/run_checks.py <sf_dir> [query ...]; prints one line per query."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
import compare

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = compare.session(), compare.oracle(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n == w or n.startswith(w.rstrip("*")) and w.endswith("*") for w in wanted)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare.difference(df, con, oracles[name])
                status = "ok" if problem is None else f"DIFF {problem}"[:700]
            else:
                status = f"rows-only {len(df.collect())}"
        except Exception as exc:
            status = f"ERROR {type(exc).__name__} {str(exc)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {time.time() - start:6.1f}s {status}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
