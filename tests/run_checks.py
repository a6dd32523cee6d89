"""Compare registered queries with their SQL: ``python tests/run_checks.py <sf dir> [names]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as registered  # noqa: E402
from runlens.session import configure  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main(sf_dir: str, *names: str) -> int:
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false"
    )
    spark = configure(builder.config("spark.sql.shuffle.partitions", "8")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    checks, bad = registered.oracle_sql(), 0
    for name, job in registered.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = differences(job(spark, sf_dir), connection, checks[name])
        except Exception as problem:  # noqa: BLE001 - report and go on
            found = [f"{type(problem).__name__}: {str(problem)[:1500]}"]
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("     ", line, flush=True)
        bad += bool(found)
    print(f"{bad} differ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
