"""What tables there are, and which are worth checking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that tell what a table or column is about, and their points.
TABLES = {"personas": (["cliente", "paciente", "persona", "empleado", "user"], 2.0), "transacciones": (["venta", "factur", "orden", "pedido", "transaccion"], 2.0), "catalogos": (["producto", "inventario", "catalogo", "item"], 1.0), "financiero": (["nomina", "salario", "pago", "cheque"], 1.0)}
EXACT = {"email": (["email", "correo"], 1.0), "telefono": (["telefono", "phone", "celular"], 1.0)}
PARTS = {"fechas": (["fecha", "date"], 0.5), "nombres": (["nombre", "name"], 0.5)}


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, database, is_temporary) of the catalog."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return spark.createDataFrame([(t.name, t.database, t.isTemporary) for t in found], "table string, database string, is_temporary boolean")


def table_infos(spark: SparkSession, database: str | None = None, exact: bool = False) -> DataFrame:
    """(table, row_count, col_names, bytes, exact) of the catalog's tables, for ``suggest``.

    Row counts come from the statistics that ANALYZE TABLE leaves; without them they are the
    table's bytes over the bytes of a row of its types, which is a guess.  exact: count the
    rows, all tables in one job.
    """
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    frames = {t.name: spark.table(f"`{database}`.`{t.name}`" if database else f"`{t.name}`") for t in found if not (database and t.isTemporary)}  # views of the session are of no database
    counts: dict[str, int] = {}
    if exact and frames:
        each = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n, df in frames.items()]
        counts = {r["table"]: r["n"] for r in reduce(DataFrame.unionByName, each).collect()}  # one row a table
    rows = []
    for n, df in frames.items():
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        size, known = int(str(stats.sizeInBytes())), stats.rowCount()
        estimate = int(str(known.get())) if known.isDefined() else size // max(df._jdf.schema().defaultSize(), 1)
        rows.append((n, counts.get(n, estimate), df.columns, min(size, (1 << 63) - 1), n in counts))
    return spark.createDataFrame(rows, "table string, row_count long, col_names array<string>, bytes long, exact boolean")


def columns(spark: SparkSession, table: str) -> DataFrame:
    """(column, dtype, nullable) of a table."""
    return spark.createDataFrame([(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)], "column string, dtype string, nullable boolean")


def suggest(infos: DataFrame, top: int = 30) -> DataFrame:
    """(table, row_count, n_columns, score, tags) of infos (table, row_count, col_names), the best first.

    A point for each of 100, 1000 and over 10000 rows, and the points of what names tell.
    """
    low = F.transform("col_names", lambda c: F.trim(F.lower(c)))
    name = F.lower("table")
    score = sum((F.when(c, 1.0).otherwise(0.0) for c in (F.col("row_count") >= 100, F.col("row_count") >= 1000, F.col("row_count") > 10000)), F.lit(0.0))
    tags = []

    def add(tag: str, hit, points: float) -> None:
        nonlocal score
        hit = F.coalesce(hit, F.lit(False))
        score = score + F.when(hit, points).otherwise(0.0)
        tags.append(F.when(hit, F.lit(tag)))

    for tag, (words, points) in TABLES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(name, F.lit(w))
        add(tag, hit, points)
    for tag, (words, points) in EXACT.items():
        add(tag, F.arrays_overlap(low, F.array(*map(F.lit, words))), points)
    for tag, (words, points) in PARTS.items():
        add(tag, _any_part(low, words), points)
    add("id", F.exists(low, lambda c: (c == "id") | F.endswith(c, F.lit("_id"))), 0.5)
    out = infos.select("table", "row_count", F.size("col_names").cast("long").alias("n_columns"), score.alias("score"), F.array_join(F.filter(F.array(*tags), lambda t: t.isNotNull()), ",").alias("tags"))
    return out.orderBy(F.desc("score"), "table").limit(top)


def _any_part(low, words: list[str]):
    return F.exists(low, lambda c: F.contains(c, F.lit(words[0])) | F.contains(c, F.lit(words[1])))


def point_lookup(table: str, row: dict[str, object], most: int = 5) -> str:
    """SQL that finds one row again by its first non-null values."""
    def text(v: object) -> str:
        return str(v) if isinstance(v, int | float) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    keys = [(k, v) for k, v in row.items() if v is not None][:most]
    return f"SELECT * FROM {table} WHERE " + " AND ".join(f"`{k}` = {text(v)}" for k, v in keys) + " LIMIT 1"
