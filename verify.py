"""Runs registered queries next to their SQL: `python verify.py [sf_dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time

from estatespark.session import build_session
from estatespark.verification.catalog import CHECKS
from estatespark.verification.compare import connect, differences


def main() -> int:
    arguments = sys.argv[1:]
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(CHECKS)
    spark = build_session(
        master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", spark__sql__shuffle__partitions=8, spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in names:
        check = CHECKS[name]
        start = time.time()
        try:
            if check.sql is None:
                result = f"rows only: {check.run(spark, sf_dir).count()}"
            else:
                found = differences(check.run(spark, sf_dir), connection, check.sql)
                result = "same" if found is None else f"DIFFERENT {found}"
                bad += found is not None
        except Exception as error:
            result = f"FAILED {type(error).__name__}: {str(error)[:300]}"
            bad += 1
        print(f"{name:28s} {time.time() - start:6.2f}s  {result}", flush=True)
    print(f"{len(names)} queries, {bad} not as expected")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
