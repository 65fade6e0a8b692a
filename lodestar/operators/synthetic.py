"""Seeded synthetic tables, and corruptions of tables."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the profiles.
FIRST = ["Ana", "Carlos", "María", "Juan", "Sofía", "Luis", "Elena", "Pedro", "Laura", "Diego", "Valentina", "Andrés", "Camila"]
LAST = ["García", "Rodríguez", "Martínez", "López", "Hernández", "González", "Pérez", "Sánchez", "Ramírez", "Torres"]
DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "empresa.com", "outlook.com"]
PROFILES: dict[str, dict[str, tuple]] = {
    "ventas": {
        "id": ("int", 1, 100000),
        "cliente": ("name",),
        "email": ("email",),
        "producto": ("choice", "Laptop", "Mouse", "Teclado", "Monitor", "Audífonos", "Webcam", "Tablet", "Impresora"),
        "cantidad": ("int", 1, 10),
        "precio_unitario": ("float", 800, 300, 50, 5000),
        "fecha": ("date", "2024-01-01", "2025-12-31"),
        "region": ("choice", "Norte", "Sur", "Este", "Oeste", "Centro"),
        "categoria": ("choice", "Electrónica", "Computación", "Periféricos", "Accesorios"),
    },
    "rh": {
        "id_empleado": ("int", 1, 50000),
        "nombre": ("name",),
        "email": ("email",),
        "departamento": ("choice", "TI", "Ventas", "RH", "Finanzas", "Marketing", "Operaciones", "Legal"),
        "puesto": ("choice", "Analista", "Coordinador", "Gerente", "Director", "Practicante"),
        "salario": ("float", 45000, 20000, 15000, 150000),
        "fecha_ingreso": ("date", "2020-01-01", "2025-06-01"),
        "edad": ("int", 20, 70),
        "genero": ("choice", "M", "F", "Otro"),
    },
    "finanzas": {
        "id_transaccion": ("int", 1, 200000),
        "cuenta": ("string", "CTA-", 8),
        "tipo": ("choice", "Crédito", "Débito", "Transferencia", "Nómina"),
        "monto": ("float", 5000, 10000, -50000, 200000),
        "fecha": ("date", "2024-06-01", "2025-06-01"),
        "sucursal": ("choice", "CDMX Centro", "CDMX Sur", "Monterrey", "Guadalajara", "Querétaro", "Cancún"),
        "estatus": ("choice", "Completada", "Pendiente", "Rechazada", "Reembolsada"),
    },
    "salud": {
        "id_paciente": ("int", 1, 100000),
        "nombre": ("name",),
        "edad": ("int", 0, 100),
        "genero": ("choice", "M", "F"),
        "tipo_sangre": ("choice", "A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"),
        "diagnostico": ("choice", "Diabetes", "Hipertensión", "Infección respiratoria", "Fractura", "Gastroenteritis", "Consulta general", "Alergia"),
        "fecha_consulta": ("date", "2024-01-01", "2025-06-01"),
        "costo": ("float", 3500, 2000, 500, 50000),
    },
}


def draw(key: Column, salt: str, n: int | Column) -> Column:
    """A number from 0 to n - 1 that only depends on the key and the salt: partitioning and reruns don't change it."""
    return F.pmod(F.xxhash64(F.lit(salt), key), n if isinstance(n, Column) else F.lit(n))


def unit(key: Column, salt: str) -> Column:
    """A number in (0, 1)."""
    return (draw(key, salt, 1 << 53) + 0.5) / F.lit(float(1 << 53))


def _value(key: Column, salt: str, kind: str, *a) -> Column:
    pick = lambda values, s: F.element_at(F.array(*map(F.lit, values)), (draw(key, salt + s, len(values)) + 1).cast("int"))
    letters = lambda n, alphabet: F.concat(*(F.substr(F.lit(alphabet), (draw(key, f"{salt}{i}", len(alphabet)) + 1).cast("int"), F.lit(1)) for i in range(n)))
    if kind == "int":
        return (draw(key, salt, a[1] - a[0] + 1) + a[0]).cast("int")
    if kind == "float":
        mean, std, low, high = a
        normal = F.sqrt(-2 * F.log(unit(key, salt + "u"))) * F.cos(2 * F.pi() * unit(key, salt + "v"))
        return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round(mean + std * normal, 2)))
    if kind == "choice":
        return pick(a, "")
    if kind == "name":
        return F.concat_ws(" ", pick(FIRST, "f"), pick(LAST, "l"))
    if kind == "email":
        return F.concat(letters(8, "abcdefghijklmnopqrstuvwxyz"), F.lit("@"), pick(DOMAINS, "d"))
    if kind == "date":
        days = F.datediff(F.lit(a[1]).cast("date"), F.lit(a[0]).cast("date")) + 1
        return F.date_format(F.date_add(F.lit(a[0]).cast("date"), draw(key, salt, days).cast("int")), "yyyy-MM-dd")
    if kind == "string":
        return F.concat(F.lit(a[0]), letters(a[1], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    raise ValueError(f"unknown kind of column: {kind}")


def generate(spark: SparkSession, profile: str, rows: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """A table of a profile; equal seeds give equal rows."""
    base = spark.range(rows) if partitions is None else spark.range(0, rows, 1, partitions)
    return base.select(*(_value(F.col("id"), f"{seed}:{profile}:{c}:", *spec).alias(c) for c, spec in PROFILES[profile].items()))


def with_nulls(df: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """Each cell is null with probability ``rate``."""
    return df.select(*(F.when(F.rand(seed * 1000 + i) >= rate, F.col(f"`{c}`")).alias(c) for i, c in enumerate(df.columns)))


def with_duplicates(df: DataFrame, rate: float, seed: int = 2) -> DataFrame:
    """int(rows * rate) rows once more, evenly spread over the partitions as they are.

    Rows are numbered by partition and place in it, which takes a count of each partition's
    rows and no order of them all; ``df`` must come out the same when read twice.  The seed changes nothing.
    """
    number = F.monotonically_increasing_id()
    numbered = df.withColumn("_part", F.shiftright(number, 33)).withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = accumulate((n for _, n in counts[:-1]), initial=0)
    if int(sum(n for _, n in counts) * rate) == 0:
        return df
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    place = F.col("_before") + F.col("_at")
    again = numbered.join(F.broadcast(offsets), "_part").where(F.floor((place + 1) * F.lit(rate)) > F.floor(place * F.lit(rate)))
    return df.unionByName(again.select(*(F.col(f"`{c}`") for c in df.columns)))


def with_outliers(df: DataFrame, rate: float, seed: int = 3) -> DataFrame:
    """Numbers times 10 or -10 with probability ``rate``."""
    numbers = {f.name: f.dataType for f in df.schema if f.dataType.typeName() in ("integer", "long", "float", "double", "short", "byte")}
    changed = {}
    for i, (c, kind) in enumerate(numbers.items()):
        sign = F.when(F.rand(seed * 1000 + 2 * i) < 0.5, -10).otherwise(10)
        changed[c] = F.when(F.rand(seed * 1000 + 2 * i + 1) < rate, (F.col(f"`{c}`").cast("double") * sign).try_cast(kind)).otherwise(F.col(f"`{c}`"))
    return df.withColumns(changed) if changed else df


def with_typos(df: DataFrame, rate: float, seed: int = 4) -> DataFrame:
    """One character of texts of two or more is replaced with probability ``rate``."""
    changed = {}
    for i, f in enumerate(df.schema):
        if f.dataType.typeName() == "string":
            c = F.col(f"`{f.name}`")
            at = (F.floor(F.rand(seed * 1000 + 3 * i) * F.length(c)) + 1).cast("int")
            letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(F.rand(seed * 1000 + 3 * i + 1) * 26) + 1).cast("int"), F.lit(1))
            changed[f.name] = F.when((F.length(c) >= 2) & (F.rand(seed * 1000 + 3 * i + 2) < rate), F.overlay(c, letter, at, F.lit(1))).otherwise(c)
    return df.withColumns(changed) if changed else df


def corrupt(df: DataFrame, nulls: float = 0.0, duplicates: float = 0.0, outliers: float = 0.0, typos: float = 0.0, seed: int = 7) -> DataFrame:
    """Nulls, then duplicates, outliers and typos."""
    for rate, step in ((nulls, with_nulls), (duplicates, with_duplicates), (outliers, with_outliers), (typos, with_typos)):
        if rate:
            df = step(df, rate, seed)
    return df
