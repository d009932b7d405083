"""Run registered queries against their DuckDB oracle: python tests/run_oracle.py [names]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck_connect  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from gazette.session import build_session  # noqa: E402


def main(argv):
    sf = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]")
    q, o = E.queries(), E.oracle_sql()
    names = argv or sorted(q)
    con = duck_connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = q[n](spark, sf)
            if n in o:
                info = compare(df, con, o[n])
            else:
                info = {"ok": True, "rows": (df.count(), None), "rows_only": True}
        except Exception as e:  # report and continue
            info = {"ok": False, "error": repr(e)[:400]}
        bad += not info["ok"]
        print(f"{'OK ' if info['ok'] else 'BAD'} {n:40s} {time.time()-t:6.2f}s {info}", flush=True)
    print(f"{len(names)-bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
