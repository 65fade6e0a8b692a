"""Named cached frames with a time to live and a budget of bytes; Spark's storage layer holds them."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.spec import SourceSpec

TTL = 1800.0
#: Bytes of memory and disk that all entries may take.
MAX_BYTES = 2 << 30


@dataclass
class Entry:
    """A cached frame; born and used: when it was made and last asked for."""

    df: DataFrame
    born: float
    used: float
    hits: int = 0

    def relation(self):
        """The storage layer's plan of the frame; a new frame over it, as the old one may have been planned before it was cached."""
        plan = self.df.select("*")._jdf.queryExecution().withCachedData()
        while plan.getClass().getSimpleName() != "InMemoryRelation":
            plan = plan.children().head()
        return plan

    def stored(self) -> tuple[int, int]:
        """Bytes in memory and on disk of what has been computed so far, as the block manager counts them."""
        number = self.relation().cacheBuilder().cachedColumnBuffers().id()
        found = [i for i in self.df.sparkSession.sparkContext._jsc.sc().getRDDStorageInfo() if i.id() == number]
        return sum(i.memSize() for i in found), sum(i.diskSize() for i in found)

    def expected(self) -> int:
        """Bytes that the entry has or will have: what is stored, or the optimiser's estimate before that."""
        return sum(self.stored()) or int(str(self.relation().stats().sizeInBytes()))


@dataclass
class FrameCache:
    """Entries by the key of their scan.

    Beyond ``max_bytes`` or ``most`` entries the least recently used ones go.  A frame that
    alone takes more than the budget is handed out uncached, so that it can't push out all
    others and isn't half kept.
    """

    ttl: float = TTL
    most: int = 32
    max_bytes: int = MAX_BYTES
    entries: dict[str, Entry] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0
    evictions: int = 0

    def get(self, spark: SparkSession, spec: SourceSpec, refresh: bool = False) -> DataFrame:
        """The rows of a scan, from the cache if they are there and young enough; refresh: read again."""
        now, key = time.monotonic(), spec.key()
        for k in [k for k, e in self.entries.items() if now - e.born > self.ttl or refresh and k == key]:
            self.drop(k)
        if key in self.entries:
            entry = self.entries[key]
            entry.used = now
            entry.hits += 1
            self.hits += 1
            return entry.df
        self.misses += 1
        return self.put(key, spec.to_df(spark), now)

    def put(self, key: str, df: DataFrame, now: float | None = None) -> DataFrame:
        """``df`` under ``key``, in place of what was there; computed at once, so that its size is known and not guessed.

        A frame that the optimiser expects to be over the budget isn't computed for this.
        """
        now = time.monotonic() if now is None else now
        if key in self.entries:
            self.drop(key)
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > self.max_bytes:
            self.evictions += 1
            return df
        entry = Entry(df.persist(StorageLevel.MEMORY_AND_DISK), now, now)
        self.entries[key] = entry
        df.write.format("noop").mode("overwrite").save()
        if entry.expected() > self.max_bytes:
            self.drop(key)
            self.evictions += 1
        self.fit(keep=key)
        return df

    def fit(self, keep: str | None = None) -> None:
        """Drops least recently used entries, but for ``keep``, until the rest is within both limits."""
        sizes = {k: e.expected() for k, e in self.entries.items()}
        for k in sorted(sizes, key=lambda k: self.entries[k].used):
            if sum(sizes.values()) <= self.max_bytes and len(sizes) <= self.most:
                break
            if k != keep:
                self.drop(k)
                self.evictions += 1
                del sizes[k]

    def drop(self, key: str) -> None:
        self.entries.pop(key).df.unpersist(blocking=True)

    def query(self, spark: SparkSession, spec: SourceSpec, sql: str, view: str = "data") -> DataFrame:
        """SQL over the cached rows, which are the view ``data``."""
        self.get(spark, spec).createOrReplaceTempView(view)
        return spark.sql(sql)

    def stats(self) -> dict[str, int]:
        """Entries, hits, misses, evictions, and the bytes in memory and on disk against the budget."""
        stored = [e.stored() for e in self.entries.values()]
        return {"entries": len(self.entries), "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "memory_bytes": sum(m for m, _ in stored), "disk_bytes": sum(d for _, d in stored), "max_bytes": self.max_bytes}

    def listing(self, spark: SparkSession) -> DataFrame:
        """(key, columns, memory_bytes, disk_bytes, hits, age_seconds), the last used first."""
        now = time.monotonic()
        rows = [(k, len(e.df.columns), *e.stored(), e.hits, now - e.born) for k, e in sorted(self.entries.items(), key=lambda x: -x[1].used)]
        return spark.createDataFrame(rows, "key string, columns int, memory_bytes long, disk_bytes long, hits long, age_seconds double")
