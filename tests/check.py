"""Command line twin of the oracle test: python -m tests.check [key ...]"""

import sys
import time

from __spark_entry__ import oracle_sql, queries
from grainguard.session import local_session
from tests.oracle import DATA, compare, connect


def main(sf="sf0.01"):
    spark = local_session(8)
    folder = f"{DATA}/{sf}"
    con = connect(folder)
    oracle, keys = oracle_sql(), sys.argv[1:] or list(queries())
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = queries()[key](spark, folder)
            result = compare(df, con, oracle[key]) if key in oracle else f"rows only: {df.count()}"
        except Exception as e:  # report and go on to the next key
            result = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(result) and not result.startswith("rows only")
        print(f"{'ok ' if not result else '** '}{key} {time.time() - start:.2f}s {result or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
