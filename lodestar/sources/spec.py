"""A saved scan: where from, which columns, how many rows."""

from __future__ import annotations

import csv
import re
import time
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = ("csv", "json", "parquet", "excel", "orc", "text")
# Default ports and JDBC drivers.
PORTS = {"postgresql": 5432, "mysql": 3306, "sqlserver": 1433, "oracle": 1521, "informix": 9088}
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver", "informix": "com.informix.jdbc.IfxDriver"}
#: Lines by which a delimiter is guessed.
SNIFFED_LINES = 100


@dataclass(frozen=True)
class SourceSpec:
    """kind: a file kind, sqlite, table, or a database of PORTS or jdbc.

    options go to the Spark reader; for databases they may name splitBy (and parts), a
    column by which a parallel scan is cut, or partitionColumn, lowerBound, upperBound and
    numPartitions.
    """

    kind: str
    path: str = ""
    query: str = ""
    connection: dict[str, Any] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    strict: bool = True
    row_limit: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The rows, with columns and limit pushed towards the source where it can take them."""
        df = selected(self._read(spark), self.columns, self.strict)
        return df.limit(self.row_limit) if self.row_limit else df

    def preview(self, spark: SparkSession, rows: int = 11) -> DataFrame:
        return self.to_df(spark).limit(rows)

    def page(self, spark: SparkSession, number: int, size: int = 100, order: list[str] | None = None) -> tuple[DataFrame, int]:
        """One page of rows, from 1, and how many rows there are; by ``order``, or as the source gives them.

        A page deep inside takes reading all before it, as for any source without an index.
        """
        if number < 1 or size < 1:
            raise ValueError("pages are numbered from 1 and have a size")
        df = self.to_df(spark)
        total = df.count()
        rows = df.orderBy(*order) if order else df
        return rows.offset((number - 1) * size).limit(size), total

    def schema(self, spark: SparkSession) -> DataFrame:
        """(column, dtype, nullable)."""
        return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in self.to_df(spark).schema], "column string, dtype string, nullable boolean")

    def key(self) -> str:
        """16 hex digits that name this scan in caches."""
        import hashlib
        import json

        return hashlib.sha256(json.dumps([self.kind, self.path, self.query, self.connection, sorted(self.columns), self.row_limit, self.options], sort_keys=True, default=str).encode()).hexdigest()[:16]

    def _read(self, spark: SparkSession) -> DataFrame:
        if self.kind == "csv":
            return read_csv(spark, self.path, **self.options)
        if self.kind == "json":
            return spark.read.options(multiLine=True, **self.options).json(self.path)
        if self.kind in ("parquet", "orc", "text"):
            return spark.read.format(self.kind).options(**self.options).load(self.path)
        if self.kind == "excel":
            from lodestar.sources.excel import read_excel

            return read_excel(spark, self.path, **self.options)
        if self.kind == "sqlite":
            from lodestar.sources.sqlite import read_sqlite

            return read_sqlite(spark, self.path, self.query)
        if self.kind == "table":
            return spark.sql(self.query) if self.query else spark.table(self.path)
        return read_jdbc(spark, self.kind, self.connection, self.query, self.options)


def selected(df: DataFrame, columns: tuple[str, ...] | list[str], strict: bool = True) -> DataFrame:
    """The wanted columns; strict: a missing one is an error, else those that exist, or all if none does."""
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing and strict:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    have = [c for c in columns if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in have)) if have else df


def sniff(head: str) -> str:
    """The delimiter of a CSV head: what the sniffer says, or else the most frequent of the usual ones."""
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        first = head.split("\n", 1)[0]
        return max(",;\t|", key=first.count)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, header: str = "true", **options: str) -> DataFrame:
    """A CSV; the delimiter is guessed from its first lines, the encoding from all of them, which tasks look at where none is given.

    Text with a line that isn't UTF-8 is read as ISO-8859-1.  Spark reads the files, so that any store will do.
    """
    lines = spark.read.text(path)
    if encoding is None:
        encoding = "utf-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "iso-8859-1"
    if sep is None:
        head = [bytes(r[0]) for r in lines.select(F.col("value").cast("binary")).limit(SNIFFED_LINES).collect()]
        sep = sniff("\n".join(h.decode(encoding, "replace") for h in head) + "\n")
    return spark.read.csv(path, header=header == "true", inferSchema=True, sep=sep, encoding=encoding, **options)


def probe(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """(ok, message, columns, seconds) of a source: whether a row of it can be read; one row, no error."""
    began = time.time()
    try:
        df = spec.to_df(spark)
        df.limit(1).collect()
        ok, message, columns = True, "", len(df.columns)
    except Exception as e:  # whatever the source or its driver raises is the answer
        ok, message, columns = False, str(e).splitlines()[0][:500] if str(e) else type(e).__name__, None
    return spark.createDataFrame([(ok, message, columns, time.time() - began)], "ok boolean, message string, columns int, seconds double")


def jdbc_url(kind: str, c: dict[str, Any]) -> str:
    host, port, database = c.get("host", ""), c.get("port") or PORTS.get(kind), c.get("database", "")
    if kind == "postgresql":
        return f"jdbc:postgresql://{host}:{port}/{database}" + ("?sslmode=require" if c.get("ssl") else "")
    if kind == "mysql":
        return f"jdbc:mysql://{host}:{port}/{database}"
    if kind == "sqlserver":
        place = f"{host}\\{c['instance']}" if c.get("instance") else f"{host}:{port}"
        return f"jdbc:sqlserver://{place};databaseName={database}"
    if kind == "oracle":
        return f"jdbc:oracle:thin:@//{host}:{port}/{database}"
    if kind == "informix":
        return f"jdbc:informix-sqli://{host}:{port}/{database}:INFORMIXSERVER={c.get('instance') or host}"
    if kind == "jdbc":
        return c["url"]
    raise ValueError(f"unknown source kind: {kind}")


def connection_string(kind: str, c: dict[str, Any]) -> str:
    """scheme://user:password@host:port/database, with the password percent-encoded."""
    port = c.get("port") or PORTS.get(kind)
    return f"{kind}://{c.get('username', '')}:{quote(c.get('password', ''), safe='_.-~')}@{c.get('host', '')}:{port}/{c.get('database', '')}" + ("?sslmode=require" if c.get("ssl") else "")


def parse_connection(text: str) -> dict[str, Any]:
    """The fields of a connection string; empty fields where it has none."""
    m = re.match(r"\w+(?:\+\w+)?://([^:]+):([^@]*)@([^:/]+):(\d+)/([^?]+)(\?sslmode=require)?", text or "")
    if not m:
        return {"host": "", "port": None, "database": text.removeprefix("sqlite:///") if (text or "").startswith("sqlite:///") else "", "username": "", "password": "", "ssl": False}
    return {"host": m[3], "port": int(m[4]), "database": m[5], "username": m[1], "password": unquote(m[2]), "ssl": bool(m[6])}


def read_jdbc(spark: SparkSession, kind: str, c: dict[str, Any], query: str, options: dict[str, str]) -> DataFrame:
    """A query or table of a database; in parallel with partitionColumn in options, or with splitBy, a whole-number column along which ranges of about equally many rows are cut."""
    if "splitBy" in options:
        from lodestar.sources.database import Database, split_scan

        return split_scan(spark, Database(kind, c), query, options["splitBy"], int(options["parts"]) if "parts" in options else None)
    reader = spark.read.format("jdbc").option("url", jdbc_url(kind, c)).option("fetchsize", "10000").option("queryTimeout", "300")
    if c.get("username"):
        reader = reader.option("user", c["username"]).option("password", c.get("password", ""))
    if driver := c.get("driver") or DRIVERS.get(kind):
        reader = reader.option("driver", driver)
    split = "partitionColumn" in options
    target = f"({query}) q" if query.lstrip().lower().startswith("select") and split else query
    return reader.option("query" if query.lstrip().lower().startswith("select") and not split else "dbtable", target).options(**options).load()


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "error", **options: str) -> None:
    """csv, json, parquet or orc, by kind or by the path's ending."""
    kind = kind or path.rsplit(".", 1)[-1]
    if kind not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"can't write {kind}")
    df.write.mode(mode).options(**({"header": "true"} if kind == "csv" else {}), **options).format(kind).save(path)
