"""SQLite files as a Spark data source; the file must be on a path that all executors have."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUM": "double", "DEC": "double", "BOOL": "bigint"}


#: Whole numbers up to which a double is exact, and expressions of one statement.
EXACT, ASKS = 1 << 53, 500


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(integer: bool, real: bool, text: bool, blob: bool, wide: bool, otherwise: str) -> str:
    """The kind of a column that holds such values; wide: some of its whole numbers are no doubles."""
    if text or blob:
        return "binary" if not (integer or real or text) else "string"
    if real:
        return "string" if wide else "double"
    return ("double" if otherwise == "double" and not wide else "bigint") if integer else otherwise


def _value(kind: str):
    """From SQLite's values to those of a kind; a value that would lose something is an error, as the file has changed since it was looked at."""

    def whole(v):
        if type(v) is not int:
            raise ValueError(f"not a whole number any more: {v!r}")
        return v

    def number(v):
        if not isinstance(v, int | float) or float(v) != v:
            raise ValueError(f"not a number any more: {v!r}")
        return float(v)

    def text(v):
        return v.hex() if isinstance(v, bytes) else repr(v) if isinstance(v, float) else str(v)

    return {"bigint": whole, "double": number, "binary": bytes}.get(kind, text)


class Slice(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """options: path, and query or table; numPartitions splits tables by rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        """A column's kind is the narrowest that holds all its values without loss, whatever its declaration says; SQLite looks at them in one pass."""
        with self._connect() as db:
            if table := self.options.get("table"):
                declared = {r[1]: next((k for p, k in KINDS.items() if p in (r[2] or "").upper()), "string") for r in db.execute(f"PRAGMA table_info({_name(table)})")}
                names, rows = list(declared), _name(table)
            else:
                rows = f"({self.options['query']})"
                names, declared = [d[0] for d in db.execute(f"SELECT * FROM {rows} LIMIT 0").description], {}
            asks = [f"max(typeof({_name(n)}) = '{k}')" for n in names for k in ("integer", "real", "text", "blob")] + [f"max(typeof({_name(n)}) = 'integer' AND abs({_name(n)} / 2) > {EXACT // 2})" for n in names]
            found = [row for i in range(0, len(asks), ASKS) for row in db.execute(f"SELECT {', '.join(asks[i : i + ASKS])} FROM {rows}").fetchone()]
        kinds = [_kind(*map(bool, found[4 * i : 4 * i + 4]), wide=bool(found[4 * len(names) + i]), otherwise=declared.get(n, "string")) for i, n in enumerate(names)]
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True))

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, [f.dataType.simpleString() for f in schema])


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kinds: list[str]):
        self.options, self.kinds = dict(options), kinds

    def partitions(self) -> list[Slice]:
        parts = int(self.options.get("numPartitions", self.options.get("numpartitions", "1")))
        if not self.options.get("table") or parts < 2:
            return [Slice(0, -1)]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.options['table'])}").fetchone()
        if low is None:
            return [Slice(0, -1)]
        step = -(-(high - low + 1) // parts)
        return [Slice(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        casts = [_value(k) for k in self.kinds]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            if table := self.options.get("table"):
                where = f" WHERE rowid BETWEEN {partition.low} AND {partition.high}" if partition.high >= partition.low else ""
                cursor = db.execute(f"SELECT * FROM {_name(table)}{where}")
            else:
                cursor = db.execute(self.options["query"])
            for row in cursor:
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=True))


def read_sqlite(spark: SparkSession, path: str, query: str, partitions: int = 1) -> DataFrame:
    """A query or a table of a SQLite file."""
    spark.dataSource.register(SqliteSource)
    what = {"query": query} if query.lstrip().lower().startswith(("select", "with")) else {"table": query}
    return spark.read.format("sqlite").options(path=path, numPartitions=str(partitions), **what).load()
