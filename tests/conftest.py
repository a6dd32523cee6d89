import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from runlens.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configure(SparkSession.builder.master("local[4]").appName("tests"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def runs_of(spark):
    """Build runs from dicts; missing fields are null and ``seq`` is the position."""
    from runlens import schemas

    def build(*rows):
        full = [
            (i, *[row.get(name) for name in schemas.RUN.names]) for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(full, f"seq bigint, {schemas.RUN.toDDL()}")

    return build


def done(score, **fields):
    return {"evaluation_status": "completed", "evaluation_score": score, **fields}
