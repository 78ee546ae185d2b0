"""Tables kept as sets of partitions, each set written whole by one run, lot or day (SNK-06, SET-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts as X


def _folder(path: str, scope: dict[str, str]) -> str:
    return "/".join([path.rstrip("/"), *(f"{k}={X.safe_name(v)}" for k, v in scope.items())])


def write_set(df: DataFrame, path: str, scope: dict[str, str], keys: tuple[str, ...]) -> DataFrame:
    """Writes df as the whole set of its scope, partitioned by keys, and returns its manifest: keys and n, also kept beside the table.

    What the scope held before goes, also partitions that df no longer has; other scopes stay untouched, so a rerun replaces its own rows and
    runs of the same day stand side by side. Spark's committer puts the folder in place at the end. An empty df leaves an empty set.
    """
    df.write.mode("overwrite").partitionBy(*keys).parquet(_folder(path, scope))
    manifest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    manifest.coalesce(1).write.mode("overwrite").parquet(_folder(f"{path.rstrip('/')}-manifest", scope))
    return df.sparkSession.read.schema(manifest.schema).parquet(_folder(f"{path.rstrip('/')}-manifest", scope))


def read_sets(spark, path: str, columns: str) -> DataFrame:
    """All sets of a table; columns: those of the rows, its scopes and keys, with their types."""
    return spark.read.schema(columns).option("basePath", path).parquet(path)
