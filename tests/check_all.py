"""Run every registered query against its SQL: ``python tests/check_all.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402
from conftest import build_session  # noqa: E402


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(entry.queries())
    spark, connection, oracle = build_session(), connect(sf_dir), entry.oracle_sql()
    failed = 0
    for name in names:
        started = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in oracle:
                problems = differences(df, connection, oracle[name])
            else:
                problems = [] if df.toArrow().num_rows else ["no rows"]
        except Exception as error:  # report every query, whatever goes wrong
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracle else "rows only")
        print(f"{mark:9} {name:32} {time.time() - started:6.2f}s", *problems, sep="\n    " if problems else " ", flush=True)
    print(f"{failed} of {len(names)} differ", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
