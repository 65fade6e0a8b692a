"""A DataFrame with the column knowledge that checks need; schema only, no data access."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"

# Parts of column names that tell what a column holds.
ROLES: dict[str, list[str]] = {
    "name": ["nombre", "nomb", "name", "nombres", "full_name", "fullname", "first_name", "given_name", "primer_nombre", "segundo_nombre"],
    "surname": ["apellido", "apellid", "ape", "last_name", "surname", "apellidos"],
    "id": ["cedula", "cédula", "id", "identificacion", "identificación", "rut", "dni", "documento", "docu", "cc", "nro_documento", "num_doc", "numdoc", "nume"],
    "dob": ["fecha_nac", "fecha nac", "fecha de nacimiento", "birth", "nacimiento", "dob", "date_of_birth", "fecha_nacimiento", "fnac", "f_nac"],
    "address": ["direccion", "dirección", "address", "dir", "domicilio", "calle", "carrera", "direc"],
    "phone": ["telefono", "teléfono", "telef", "tel", "phone", "celular", "cel", "movil", "móvil", "contacto"],
    "email": ["email", "correo", "mail", "e-mail", "electronic_mail"],
}


def canonical(df: DataFrame, key: str | None = None) -> DataFrame:
    """NaN as null in float columns, and a row id: the caller's key, or a unique number."""
    nan = {f.name: F.when(~F.isnan(_col(f.name)), _col(f.name)) for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    df = df.withColumns(nan) if nan else df
    return spread(df.withColumn(ROW_ID, _col(key).cast("string") if key else F.monotonically_increasing_id().cast("string")))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if its files make fewer partitions than that: one file with few row groups is read by one task."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Table:
    """df: canonical rows; as_of: the SQL timestamp that stands for now."""

    df: DataFrame
    as_of: str | None = None
    counts: dict[str, int] = field(default_factory=dict)

    @cached_property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    def c(self, name: str) -> Column:
        return _col(name)

    def _of(self, *kinds: type) -> list[str]:
        return [f.name for f in self.df.schema if f.name != ROW_ID and isinstance(f.dataType, kinds)]

    @cached_property
    def numeric(self) -> list[str]:
        return self._of(T.NumericType)

    @cached_property
    def text(self) -> list[str]:
        return self._of(T.StringType)

    @cached_property
    def temporal(self) -> list[str]:
        return self._of(T.TimestampType, T.TimestampNTZType, T.DateType)

    @cached_property
    def comparable(self) -> list[str]:
        """Columns that can be grouped by."""
        return [f.name for f in self.df.schema if f.name != ROW_ID and not isinstance(f.dataType, T.MapType | T.VariantType)]

    def named(self, wanted: Iterable[str]) -> list[str]:
        """Those of the wanted columns that exist."""
        have = set(self.columns)
        return [c for c in wanted if c in have]

    def lower(self) -> dict[str, str]:
        return {c.lower(): c for c in self.columns}

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp") if self.as_of else F.current_timestamp()

    def roles(self, exclude: Iterable[str] = ()) -> dict[str, list[str]]:
        """Columns by what their names say they hold; one column can have several roles."""
        skip = set(exclude)
        return {role: [c for c in self.columns if c not in skip and any(p in c.lower().strip() for p in parts)] for role, parts in ROLES.items()}

    def failures(self, rule: str, parts: list[tuple[str, Column, Column]]) -> DataFrame | None:
        """(rule_name, column, row_id, value) of failing rows, in one scan; parts: column, condition, value."""
        if not parts:
            return None
        cells = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(bad, F.lit(False)).alias("bad"), v.cast("string").alias("value")) for c, bad, v in parts))
        rows = self.df.select(F.col(ROW_ID).alias("row_id"), F.explode(F.filter(cells, lambda x: x["bad"])).alias("cell"))
        return rows.select(F.lit(rule).alias("rule_name"), "cell.column", "row_id", "cell.value")


def matches(pattern: str, name: str) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None
