"""JDBC reads and writes.

No driver jar and no database server come with the library: these functions build the options, and
only the two that end in ``read``/``write`` connect.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# URL form, default port and driver class per database.
DATABASES = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521, "oracle.jdbc.OracleDriver"),
    "vertica": ("jdbc:vertica://{host}:{port}/{database}", 5433, "com.vertica.jdbc.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
}


def connection(kind: str, host: str, database: str, user: str, password: str, port: int | None = None) -> dict[str, str]:
    if kind not in DATABASES:
        raise ValueError(f"unknown database type {kind!r}; known: {', '.join(sorted(DATABASES))}")
    template, default_port, driver = DATABASES[kind]
    url = template.format(host=host, port=port or default_port, database=database)
    return {"url": url, "driver": driver, "user": user, "password": password}


def source_options(table: str | None = None, query: str | None = None) -> dict[str, str]:
    """Options for a table, or for a subquery that the database evaluates."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    return {"dbtable": table if table else f"({query}) AS pushed"}


def bounds_query(table: str, column: str) -> str:
    return f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}"


def partition_options(column: str, low, high, partitions: int) -> dict[str, str]:
    """Stride options; an empty table (no bounds) is read in one partition."""
    if low is None or high is None:
        return {}
    return {
        "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def batch_size(rows: int, default: int = 10_000) -> int:
    """Rows per insert batch for a result of ``rows`` rows."""
    for below, size in ((1_000, 100), (10_000, 1_000), (100_000, 5_000)):
        if rows < below:
            return size
    return default


def write_options(table: str, rows: int | None = None) -> dict[str, str]:
    size = batch_size(rows) if rows is not None else 10_000
    return {"dbtable": table, "truncate": "true", "batchsize": str(size), "rewriteBatchedInserts": "true"}


def read(
    spark: SparkSession, conn: Mapping[str, str], table: str | None = None, query: str | None = None,
    partition_column: str | None = None, partitions: int = 8, fetch_size: int = 10_000,
) -> DataFrame:
    """A JDBC frame; with ``partition_column`` the bounds are asked first (one row) and read in parallel."""
    source = source_options(table, query)
    options = {**conn, **source, "fetchsize": str(fetch_size)}
    if partition_column:
        asked = bounds_query(source["dbtable"], partition_column)
        low, high = spark.read.format("jdbc").options(**conn).option("dbtable", f"({asked}) AS bounds").load().first()
        options |= partition_options(partition_column, low, high, partitions)
    return spark.read.format("jdbc").options(**options).load()


def write(df: DataFrame, conn: Mapping[str, str], table: str, rows: int | None = None) -> None:
    df.write.format("jdbc").mode("overwrite").options(**conn, **write_options(table, rows)).save()
