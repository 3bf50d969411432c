import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).iterdir():
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return con


def same_rows(spark_df, duck_rel) -> None:
    """Equal columns and equal rows in any order; numbers to six digits."""
    columns = sorted(spark_df.columns)
    assert columns == sorted(duck_rel.columns)

    def rows(pdf):
        def plain(v):
            if v is None or v != v:
                return None
            if isinstance(v, (bool, str)):
                return v
            return round(float(v), 6) + 0.0

        return sorted(([plain(v) for v in r] for r in pdf[columns].astype(object).itertuples(index=False, name=None)), key=repr)

    got, want = rows(spark_df.toPandas()), rows(duck_rel.df())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if any(a != b and not (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a))) for a, b in zip(g, w))]
    assert not wrong, wrong[:3]
