import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from snapgate.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(
        "tests", 4,
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.checkpoint.dir": str(folder / "shared"),
            "spark.sql.catalogImplementation": "in-memory",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a small frame from literal rows."""
    return lambda data, ddl: spark.createDataFrame(data, ddl)


def collected(df, *columns):
    """Rows as plain tuples, sorted, for comparison."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
