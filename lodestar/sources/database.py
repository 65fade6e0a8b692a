"""Databases over JDBC: parallel scans cut by the data, and what tables there are with their sizes.

Everything asked of a database here is small: a histogram of a key, or its own statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.spec import DRIVERS, jdbc_url

#: Rows that a task reads from a database, and cells of the histogram that cuts are made along, for each part.
ROWS_A_PART, CELLS_A_PART = 500_000, 32
#: Parts of a scan, at most: connections that the database sees at once are bounded by cores besides.
MAX_PARTS = 512

# Where databases keep the names, rows and columns of their tables; each query gives table_name, row_count, column_name.
STATISTICS: dict[str, str] = {
    "postgresql": "SELECT c.relname AS table_name, CAST(c.reltuples AS BIGINT) AS row_count, a.attname AS column_name FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid WHERE c.relkind IN ('r', 'p') AND a.attnum > 0 AND NOT a.attisdropped AND n.nspname NOT IN ('pg_catalog', 'information_schema')",
    "mysql": "SELECT t.table_name AS table_name, t.table_rows AS row_count, c.column_name AS column_name FROM information_schema.tables t JOIN information_schema.columns c ON c.table_schema = t.table_schema AND c.table_name = t.table_name WHERE t.table_schema = database() AND t.table_type = 'BASE TABLE'",
    "sqlserver": "SELECT t.name AS table_name, p.row_count AS row_count, c.name AS column_name FROM sys.tables t JOIN sys.columns c ON c.object_id = t.object_id JOIN (SELECT object_id, sum(row_count) AS row_count FROM sys.dm_db_partition_stats WHERE index_id IN (0, 1) GROUP BY object_id) p ON p.object_id = t.object_id",
    "oracle": "SELECT t.table_name AS table_name, t.num_rows AS row_count, c.column_name AS column_name FROM user_tables t JOIN user_tab_columns c ON c.table_name = t.table_name",
    "informix": "SELECT t.tabname AS table_name, CAST(t.nrows AS BIGINT) AS row_count, c.colname AS column_name FROM systables t JOIN syscolumns c ON c.tabid = t.tabid WHERE t.tabid > 99 AND t.tabtype = 'T'",
    "derby": "SELECT t.tablename AS table_name, CAST(NULL AS BIGINT) AS row_count, c.columnname AS column_name FROM sys.systables t JOIN sys.syscolumns c ON c.referenceid = t.tableid WHERE t.tabletype = 'T'",
}

# How the quotient of two whole numbers is rounded down where / doesn't do that.
QUOTIENTS = {"mysql": "{0} DIV {1}", "oracle": "floor({0} / {1})", "informix": "floor({0} / {1})"}


@dataclass(frozen=True)
class Database:
    """kind: one of PORTS, or jdbc with a url (and a driver) in the connection; dialect: whose statistics tables a jdbc url has."""

    kind: str
    connection: dict[str, Any]
    dialect: str = ""

    def reader(self, spark: SparkSession) -> DataFrameReader:
        c = self.connection
        reader = spark.read.format("jdbc").option("url", jdbc_url(self.kind, c)).option("fetchsize", "10000").option("queryTimeout", "300")
        if c.get("username"):
            reader = reader.option("user", c["username"]).option("password", c.get("password", ""))
        driver = c.get("driver") or DRIVERS.get(self.kind)
        return reader.option("driver", driver) if driver else reader

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return self.reader(spark).option("query", sql).load()


def from_(target: str) -> str:
    """A table, or a query as one."""
    return f"({target}) q" if target.lstrip().lower().startswith(("select", "with")) else target


def cuts(histogram: list[tuple[int, int]], parts: int) -> list[int]:
    """Cells at which parts of about equally many rows begin, the first left out, from (cell, rows) in order.

    A part ends where it has its share of the rows that are left for it and later ones; a
    cell that alone has more is a part of its own.
    """
    out: list[int] = []
    left, have, share = sum(n for _, n in histogram), 0, 0.0
    for cell, n in histogram:
        share = left / max(parts - len(out), 1)
        if have and have + n / 2 > share and len(out) < parts - 1:
            out.append(cell)
            left, have = left - have, 0
        have += n
    return out


def split_scan(spark: SparkSession, database: Database, target: str, key: str, parts: int | None = None) -> DataFrame:
    """The rows of a table or query, read by ranges of the whole-number column ``key``, as the database writes it.

    The database first gives the key's ends and number of rows, then how many rows each of a
    few cells between them has; ranges are cut along the cells so that each has about as many
    rows, however unevenly the keys lie.  Tables of up to ROWS_A_PART rows are read by one
    task.  Rows without a key are read by the first range.  ``parts``: this many ranges instead.
    """
    own = from_(target)
    ends = database.query(spark, f"SELECT min({key}) AS low, max({key}) AS high, count(*) AS n FROM {own}").first()
    low, high, n = (None if v is None else int(v) for v in ends)
    parts = parts or min(-(-(n or 0) // ROWS_A_PART), MAX_PARTS)
    if low is None or low == high or parts < 2:
        return database.reader(spark).option("dbtable", own).load()
    width = -(-(high - low + 1) // min(parts * CELLS_A_PART, high - low + 1))
    cell = QUOTIENTS.get(database.kind, "{0} / {1}").format(f"({key} - {_minus(low)})", width)
    counted = database.query(spark, f"SELECT cell, count(*) AS n FROM (SELECT {cell} AS cell FROM {own} WHERE {key} IS NOT NULL) c GROUP BY cell")
    histogram = sorted((int(r[0]), int(r[1])) for r in counted.collect())  # at most parts * CELLS_A_PART rows
    bounds = [low + c * width for c in cuts(histogram, parts)]
    edges = [None, *bounds, None]
    return _by_ranges(spark, database, own, key, list(zip(edges, edges[1:], strict=False)))


def _minus(value: int) -> str:
    return f"({value})" if value < 0 else str(value)


def predicates(key: str, ranges: list[tuple[int | None, int | None]]) -> list[str]:
    """SQL of half-open ranges; the one without a lower end takes null keys as well."""
    out = []
    for low, high in ranges:
        if low is None and high is None:
            out.append("1 = 1")
        elif low is None:
            out.append(f"({key} < {high} OR {key} IS NULL)")
        elif high is None:
            out.append(f"{key} >= {low}")
        else:
            out.append(f"({key} >= {low} AND {key} < {high})")
    return out


def _by_ranges(spark: SparkSession, database: Database, own: str, key: str, ranges: list[tuple[int | None, int | None]]) -> DataFrame:
    c = database.connection
    properties = {"fetchsize": "10000", "queryTimeout": "300"} | ({"user": c["username"], "password": c.get("password", "")} if c.get("username") else {})
    if driver := c.get("driver") or DRIVERS.get(database.kind):
        properties["driver"] = driver
    return spark.read.jdbc(jdbc_url(database.kind, c), own, predicates=predicates(key, ranges), properties=properties)


def table_infos(spark: SparkSession, database: Database, exact: bool = False) -> DataFrame:
    """(table, row_count, col_names, exact) of a database's tables, for ``catalog.suggest``.

    Row counts are the database's own estimates, which cost nothing; tables that it has none
    for, or with ``exact`` all, are counted there, one after the other.
    """
    found = database.query(spark, STATISTICS[database.dialect or database.kind])
    names = [c.lower() for c in found.columns]
    rows = found.toDF(*names).groupBy(F.col("table_name").alias("table")).agg(F.max("row_count").cast("long").alias("row_count"), F.sort_array(F.collect_list("column_name")).alias("col_names")).collect()  # one row a table
    out = []
    for r in rows:
        known = r["row_count"] is not None and r["row_count"] >= 0 and not exact
        n = r["row_count"] if known else int(database.query(spark, f"SELECT count(*) AS n FROM {_quoted(database, r['table'])}").first()[0])
        out.append((r["table"], n, r["col_names"], not known))
    return spark.createDataFrame(out, "table string, row_count long, col_names array<string>, exact boolean")


def _quoted(database: Database, name: str) -> str:
    mark = "`" if database.kind == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark
