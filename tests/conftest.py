import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    found = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with SQL in DuckDB over the tables of a folder."""
    import duckdb

    def compare(df, sql: str, sf_dir: str) -> None:
        c = duckdb.connect()
        for name in os.listdir(sf_dir):
            c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
        got, want = df.toPandas(), c.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [x[columns].astype(str).replace({"<NA>": "None", "nan": "None", "NaN": "None"}).values.tolist() for x in (got, want)]
        clean = [sorted([[v.removesuffix(".0") for v in r] for r in x]) for x in rows]
        assert clean[0] == clean[1]

    return compare
