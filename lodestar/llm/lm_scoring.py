"""Probabilities of whole texts under a trigram model kept as an Elias-Fano trie.

Counts are gathered over all training documents, level by level: words, then pairs,
then triples whose two pairs are both in the model (no other triple can reach
the bound of triples).  The model has every word, and every pair and triple that occurs twice.
The trie keeps those with at least a fixed *share* of all tokens, so that it can't hold more than the
inverse of that share, however much text there is: at most 2**20 words and 2**22 pairs and
triples.  Such a trie is a file of a few dozen MB that executors fetch once and map into
memory.  Where it has all n-grams, texts are scored where they lie, without moving a token.

In larger inputs texts are written as slices once the words of the trie are numbered; a slice has
the numbers of these, and the hashes of the others, the light words.  N-grams of the trie are counted
from the numbers alone.  The rest, the light n-grams, among them all with a light word, are counted
and looked up in one shuffle: every slice sends its distinct n-grams that the trie doesn't have, those of one
light pair or light word to one bucket, and gets back how often the training texts have each, and how
often they have each light word.  What light n-grams take from the mass left for shorter contexts is summed
for every context.

N-grams travel sorted, all of a bucket as one value, so that neither rows nor most of their
leading bytes take room in a shuffle.

Words that training texts don't have are the class RARE.  So are, where all n-grams are in the
trie, words that occur once at most: they are in no pair.  A share of tokens (WORDS) can be set below
which words count as that class too.  Their own counts stay exact: they meet the counts of all words
in a join, and the probability of such a word is that of its class times the word's part of the class.

Levels hold, for a node's children, a monotone sequence of word numbers (each node's
numbers start after the last one's), discounted probabilities in logarithmic steps of
2**(-1/2048), and the mass that is left for shorter contexts; monotone pointers say which
children are whose.  The third level doesn't hold word numbers but places among the
successors of the middle word, which are small; a look-up finds the pair in the second
level first and then searches for its place.  Probabilities are rounded down before the
mass that is left is taken from them, so all continuations of a context still add up to one.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.shared import run_dir
from lodestar.llm.common import chunks, give_back, lists, remainder, saved, shuffles_removed, utf8
from lodestar.llm.elias_fano import Sequence
from lodestar.llm.windows import mix
from lodestar.llm.words import words_of

#: Inverse share of all tokens that words need to be numbered, and n-grams to be in the trie; and, if any, that words and n-grams need to be in the model.
NUMBERED, TRIE, WORDS, GRAMS = 1 << 20, 1 << 22, None, None
#: Training tokens for each bucket of n-grams (a task counts half as many at once), and bits of a word's number in what light ones are dealt by.
BUCKET_TOKENS, BITS = 1 << 20, 21
#: Occurrences that an n-gram needs at least, and what is taken off its count for continuations not seen.
LEAST, DISCOUNT = 2, 0.75
#: Logarithmic steps that halve a probability.
STEPS = 2048
#: The end of a text as a word, and word numbers with a meaning of their own.
END_WORD = 0x1D8AF066E3C4B257
RARE, END, BEGIN = 0, 1, 2
#: Hashes of light words have this bit, so that no number equals one.
_SIGN = np.int64(-1 << 63)
#: Bytes of text that a task works on at once.
SLICE_BYTES = 2 << 20
_PARTS = 1 << 20


def _code(p: np.ndarray) -> np.ndarray:
    """Probabilities as steps, rounded down (to a higher number of steps)."""
    return np.minimum(np.ceil(-np.log2(np.maximum(p, 1e-12)) * STEPS), 65535).astype(np.uint16)


_CHANCES = np.exp2(-np.arange(1 << 16) / STEPS)


def _chance(code: np.ndarray) -> np.ndarray:
    return _CHANCES[code]


@dataclass
class Level:
    """Children of the nodes of the level above, and of each the probability; left: the mass left for shorter contexts below each node; mass: the same, not in steps."""

    left: np.ndarray
    pointers: Sequence
    keys: Sequence
    chances: np.ndarray
    mass: np.ndarray | None = None

    @classmethod
    def of(cls, parents: int, parent: np.ndarray, key: np.ndarray, chance: np.ndarray) -> Level:
        """Children in order of ``parent`` and then ``key``."""
        code = _code(chance)
        many = np.bincount(parent, minlength=parents)
        left = np.maximum(1 - np.bincount(parent, _chance(code), parents), 0)
        last = np.flatnonzero(np.append(parent[1:] != parent[:-1], True)) if len(parent) else np.zeros(0, np.int64)
        start = np.zeros(len(last), np.int64)
        np.cumsum(key[last[:-1]] + 1, out=start[1:])
        run = np.cumsum(np.append(0, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(many)) + np.arange(parents + 1)  # strictly monotone: the place is added
        return cls(_code(left), Sequence.of(ends), Sequence.of(key + start[run] if len(key) else key), code, left)

    def without(self, taken: np.ndarray) -> Level:
        """The same children where others have ``taken`` some of the mass left below each node."""
        return replace(self, left=_code(np.maximum(self.mass - taken, 0)))

    def begin(self, node: np.ndarray) -> np.ndarray:
        return self.pointers[node] - node

    def find(self, nodes: int, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The place of each node's child ``key``, -1 where there is none; there are ``nodes`` nodes."""
        if not self.keys.n:
            return np.full(len(node), -1, np.int64)
        flag = np.zeros(nodes, bool)
        flag[node] = True
        distinct = np.flatnonzero(flag)  # pointers are read once for each node, not for each token
        table = np.zeros((3, nodes), np.int64)
        first, stop = self.begin(distinct), self.begin(distinct + 1)
        table[:, distinct] = first, stop, np.where(first > 0, self.keys[np.maximum(first - 1, 0)] + 1, 0)
        first, stop, start = table
        at, there = self.keys.successor(key + start[node])
        return np.where(there & (at >= first[node]) & (at < stop[node]), at, -1)


@dataclass
class Model:
    """words: hashes of the numbered words, ascending; number, count: of each; total, kinds: training tokens and distinct words, ends included; wide: other words are no class, but words of the model too."""

    total: int
    kinds: int
    texts: int
    words: np.ndarray
    number: np.ndarray
    counts: np.ndarray
    second: Level | None = None
    third: Level | None = None
    wide: bool = False

    def __post_init__(self) -> None:
        self.scale = self.total + 0.5 * (self.kinds + 1)
        self.chance = (self.counts + 0.5) / self.scale
        self.chance[BEGIN] = 0
        self.chance[RARE] = 0
        self.chance[RARE] = max(1 - self.chance.sum(), 0.5 / self.scale)
        self._shift = np.uint64(64 - max(len(self.words), 1).bit_length() - 2)
        self._first = np.searchsorted(self._slot(self.words), np.arange((1 << (64 - int(self._shift))) + 1)).astype(np.int32)

    @property
    def size(self) -> int:
        return len(self.counts)

    def least(self) -> int:
        """Occurrences that an n-gram of the model has."""
        return max(LEAST, -(-self.total // GRAMS)) if GRAMS else LEAST

    def heavy(self) -> int:
        """Occurrences that an n-gram of the trie has; those of the model that have fewer are light."""
        return max(self.least(), -(-self.total // TRIE))

    def buckets(self) -> int:
        """How many parts n-grams are dealt to."""
        return max(1, -(-self.total // BUCKET_TOKENS))

    def followed(self) -> np.ndarray:
        """How often each word number stands before another."""
        out = self.counts.astype(np.float64)
        out[RARE] = self.total - self.counts.sum()
        out[BEGIN] = self.texts
        return out

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        """The leading bits of hashes, in the order of the hashes."""
        return ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> self._shift).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words, each looked for among the few known ones that share its leading bits."""
        out = np.full(len(hashes), RARE, np.int64)
        slot = self._slot(hashes)
        at, stop = self._first[slot], self._first[slot + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            same = self.words[at[left]] == hashes[left]
            out[left[same]] = self.number[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


_SEQUENCE = ("low", "high", "ones")


def packed(model: Model) -> bytes:
    """The model as a file: the places of its arrays, then the arrays."""
    arrays = {k: getattr(model, k) for k in ("words", "number", "counts")}
    plain = {k: getattr(model, k) for k in ("total", "kinds", "texts", "wide")} | {"sequences": {}}
    for name in ("second", "third"):
        if (level := getattr(model, name)) is not None:
            arrays |= {f"{name}.left": level.left, f"{name}.chances": level.chances}
            for part in ("pointers", "keys"):
                s = getattr(level, part)
                plain["sequences"][f"{name}.{part}"] = [s.n, s.bits]
                arrays |= {f"{name}.{part}.{k}": getattr(s, k) for k in _SEQUENCE}
    places, body = {}, bytearray()
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), len(body)]
        body += a.tobytes() + bytes(-a.nbytes % 8)
    head = json.dumps(plain | {"arrays": places}).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + bytes(body)


def unpacked(data) -> Model:
    """The model over the bytes of a file, of which nothing is copied but running numbers."""
    first = 8 + int.from_bytes(data[:8], "little")
    head = json.loads(bytes(data[8:first]))
    arrays = {name: np.frombuffer(data, kind, n, first + at) for name, (kind, n, at) in head["arrays"].items()}
    sequence = lambda name: Sequence(*head["sequences"][name], *(arrays[f"{name}.{k}"] for k in _SEQUENCE))
    level = lambda name: Level(arrays[f"{name}.left"], sequence(f"{name}.pointers"), sequence(f"{name}.keys"), arrays[f"{name}.chances"]) if f"{name}.left" in arrays else None
    return Model(head["total"], head["kinds"], head["texts"], arrays["words"], arrays["number"], arrays["counts"], level("second"), level("third"), head["wide"])


def shared(spark: SparkSession, model: Model) -> str:
    """The name of a file with the model that Spark brings to every executor, from the shared folder."""
    name, data = f"trie-{uuid.uuid4().hex}", packed(model)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{run_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(data), _PARTS):
        out.write(bytearray(data[at : at + _PARTS]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


@lru_cache(maxsize=1)
def mapped(name: str) -> Model:
    """The model of an executor's file, mapped into memory: all workers read the same pages."""
    with open(SparkFiles.get(name), "rb") as f:
        return unpacked(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


@dataclass
class Tokens:
    """Words and ends of texts in order; hashes: of words, 0 for ends; first: the place of each text's first token, then the number of all."""

    hashes: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def tokens(column: pa.Array) -> Tokens:
    words = words_of(*utf8(column), lower=True)
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    hashes = np.zeros(first[-1], np.int64)
    ends = first[1:] - 1
    inside = np.ones(len(hashes), bool)
    inside[ends] = False
    hashes[inside] = words.hashes.view(np.int64)
    return Tokens(hashes, ends, first)


def _training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, limit=2 * SLICE_BYTES):
        word, n = np.unique(words_of(*utf8(b.column("text")), lower=True).hashes.view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(word, END_WORD)), pa.array(np.append(n, len(b)))], ["word", "n"])


@dataclass
class Read:
    """Tokens as word numbers; before: of the token before each; pair: places in the second level; which tokens begin a text; and the light words among tokens, in order."""

    tokens: Tokens
    number: np.ndarray
    before: np.ndarray
    begins: np.ndarray
    pair: np.ndarray | None
    triple: tuple[np.ndarray, np.ndarray] | None = None
    light: np.ndarray | None = None

    def found(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Tokens whose triple is in the third level, and its place; looked up once."""
        if self.triple is None:
            at, parent, own = triples(model, self)
            place = model.third.find(model.second.keys.n, parent, own)
            self.triple = at[place >= 0], place[place >= 0]
        return self.triple


def read(model: Model, column: pa.Array) -> Read:
    t = tokens(column)
    number = model.numbers(t.hashes)
    number[t.ends] = END
    return _followed_up(model, t, number)


def _followed_up(model: Model, t: Tokens, number: np.ndarray) -> Read:
    before = np.append(BEGIN, number[:-1])[: len(number)]
    begins = np.zeros(len(number), bool)
    begins[t.first[:-1]] = True
    before[begins] = BEGIN
    pair = model.second.find(model.size, before, number) if model.second else None
    return Read(t, number, before, begins, pair)


def triples(model: Model, r: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens whose own pair and the pair before are both known, that earlier pair, and the token's place among the successors of the word between."""
    earlier = np.append(-1, r.pair[:-1])[: len(r.pair)]
    earlier[r.begins] = -1
    at = np.flatnonzero((r.pair >= 0) & (earlier >= 0))
    flag = np.zeros(model.size, bool)
    flag[r.before[at]] = True
    middle, first = np.flatnonzero(flag), np.zeros(model.size, np.int64)
    first[middle] = model.second.begin(middle)
    return at, earlier[at], r.pair[at] - first[r.before[at]]


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: small or sorted numbers compress better so."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _joined_planes(parts: list[bytes], kind: str) -> np.ndarray:
    """The values of parts that ``_planes`` made, joined."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(np.frombuffer(x, np.uint8).reshape(size, -1).T.tobytes() for x in parts), kind)


def _binaries(values: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.array([_planes(values[i:j]) for i, j in zip(upto.tolist(), upto[1:].tolist(), strict=False)], pa.binary())


def _home(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key."""
    bucket = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
    return bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket, else as they are; and the place of each bucket's first, then the number of all."""
    bucket = _home(key, buckets)
    return np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def _values(column: pa.ChunkedArray, kind: str = "<i4") -> tuple[np.ndarray, np.ndarray]:
    """The values of a bucket's parts, joined, and where the parts begin and end."""
    parts = [x.as_py() for x in column]
    return _joined_planes(parts, kind), np.append(0, np.cumsum([len(x) // np.dtype(kind).itemsize for x in parts]))


def _summed(key: np.ndarray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of distinct keys, ascending, of each key which one it is, and the sums of their counts."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
    del ordered
    begins = np.flatnonzero(new)
    which = np.empty(len(key), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    counts = _values(counts)[0]
    return order[begins], which, np.add.reduceat(counts[order], begins, dtype=np.int64) if len(key) else np.zeros(0, np.int64)


def _training_grams(name: str, buckets: int):
    """By bucket the keys of pairs, or of triples where the model has its second level, and how often they occur in about half of BUCKET_TOKENS tokens of a task."""

    def dealt(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        order, upto = _bucket(key, buckets)
        columns = [pa.array(np.arange(buckets, dtype=np.int32)), _binaries(key[order], upto), _binaries(n[order].astype("<i4"), upto)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, many = mapped(name), [], 0
        for r, learnt in _reads(model, batches):
            if model.second:
                at, parent, own = triples(model, r)
                key = parent << 32 | own
                keys.append(key if learnt is None else key[learnt[at]])
            else:
                key = r.before << 32 | r.number
                own = np.ones(len(key), bool) if learnt is None else learnt
                keys.append(key[own & (r.before != RARE) & (r.number != RARE)] if model.wide else key[own])
            many += len(keys[-1])
            if many >= BUCKET_TOKENS // 2:
                yield dealt(keys)
                keys, many = [], 0
        if many:
            yield dealt(keys)
        give_back()

    return run


def _by_bucket(rows: DataFrame, buckets: int) -> GroupedData:
    """``rows`` by bucket, two of the ``buckets`` a task: a hash of so few numbers would give some tasks many and others none."""
    return rows.repartitionById(max(1, -(-buckets // 2)), "bucket").groupBy("bucket")


def _heavy(least: int):
    """The n-grams of a bucket that occur at least ``least`` times."""

    def run(table: pa.Table) -> pa.Table:
        key = _values(table.column("grams"), "<i8")[0]
        one, _, n = _summed(key, table.column("counts"))
        return pa.table([pa.array(key[one[n >= least]]), pa.array(n[n >= least])], ["gram", "n"])

    return run


def _counted(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the next level's n-grams of texts or slices, ascending, and their counts: at most TRIE rows."""
    grams = texts.mapInArrow(_training_grams(shared(texts.sparkSession, model), model.buckets()), "bucket int, grams binary, counts binary")
    with shuffles_removed(texts.sparkSession):
        got = _by_bucket(grams, model.buckets()).applyInArrow(_heavy(model.heavy()), "gram long, n long").toArrow()
    gram, n = (got.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(gram)
    return gram[order], n[order]


@dataclass
class Trained:
    """The counts of all words (word, n), the model, and, where the trie hasn't all n-grams, the rows that ``fit`` was given as slices."""

    words: DataFrame
    model: Model
    slices: DataFrame | None


def _own(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that are read: doc_id and held_out, if there, and text."""
    kinds = {"doc_id": "long", "held_out": "boolean", "text": "string"}
    return docs.select(*(F.col(c).cast(k).alias(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def fit(docs: DataFrame, learnt: str = "true") -> Trained:
    """The model of the rows of ``docs`` (text) for which ``learnt`` holds; an empty table gives one that knows no word."""
    docs = _own(docs).withColumn("learnt", F.expr(learnt))
    texts = docs.where("learnt").select("text")
    with shuffles_removed(docs.sparkSession):
        words = saved(texts.mapInArrow(_training_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word_counts")
        total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = words.where((F.col("n") >= total / (WORDS or NUMBERED)) | (F.col("word") == END_WORD)).toArrow()
    word, n = (known.column(c).to_numpy() for c in ("word", "n"))
    end = word == END_WORD
    ends = int(n[end].sum())
    word, n = word[~end], n[~end]
    order = np.lexsort((word, -n))  # frequent words get small numbers
    number = np.empty(len(word), np.int32)
    number[order] = np.arange(len(word)) + BEGIN + 1
    by_word = np.argsort(word)
    model = Model(total, kinds, ends, word[by_word], number[by_word], np.append(np.array([0, ends, 0], np.int64), n[order]), wide=not WORDS)
    slices, read_from = None, texts
    if model.heavy() > model.least() or model.wide and total / NUMBERED > model.least():
        with shuffles_removed(docs.sparkSession):
            slices = saved(_sliced_docs(docs, model), "slices")
        read_from = slices.select(*_READ)
    gram, pairs = _counted(read_from, model)
    parent = gram >> 32
    model.second = Level.of(model.size, parent, gram & 0xFFFFFFFF, (pairs - DISCOUNT) / model.followed()[parent])
    gram, n = _counted(read_from, model)
    parent = gram >> 32
    model.third = Level.of(len(pairs), parent, gram & 0xFFFFFFFF, (n - DISCOUNT) / pairs[parent])
    return Trained(words, model, slices)


@dataclass
class Asked:
    """Distinct light n-grams of tokens, by bucket; token: one that has each; at: the tokens that have one, and which; upto: the first of each bucket, then all."""

    token: np.ndarray
    at: np.ndarray
    which: np.ndarray
    upto: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, key: np.ndarray, dealt_by: np.ndarray, buckets: int) -> Asked:
        by_key = np.argsort(key)  # quicker than np.unique
        ordered = key[by_key]
        new = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
        first = by_key[new]
        order, upto = _bucket(dealt_by[first], buckets)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        which = np.empty(len(key), np.int32)
        which[by_key] = place[np.cumsum(new) - 1]
        return cls(at[first[order]], at, which, upto)

    def buckets(self) -> np.ndarray:
        """Of each n-gram."""
        return np.repeat(np.arange(len(self.upto) - 1), np.diff(self.upto))


@dataclass
class Asks:
    """Pairs and triples that are asked for; words: their light words, by bucket; first, second, third: their words as numbers, or as -1 - place among the bucket's words; context: a triple's pair as place among the bucket's pairs, or as -1 - place in the trie; home: of each light token the place where its word's own pairs are."""

    pairs: Asked
    triples: Asked
    words: np.ndarray
    upto: np.ndarray
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    context: np.ndarray
    home: np.ndarray


def asked(model: Model, r: Read, buckets: int) -> Asks:
    """Pairs and triples of tokens that the trie doesn't have.

    Pairs with a light word go where all of this word's go, those that begin with one where
    all that begin so go, so that its count and what is taken from it are found there.
    Triples that go on from a light pair go where that pair goes; those of a pair of the trie,
    which can be very many, are dealt out by a light word or each for itself.
    """
    rare, own, hashes, code = r.number == RARE, r.number, np.zeros(1, np.int64), np.zeros(0, np.int64)
    if r.light is not None and len(r.light):
        hashes, code = np.unique(r.light, return_inverse=True)
        own = r.number.copy()
        own[rare] = model.size + code
    before = np.append(BEGIN, own[:-1])[: len(own)]
    before[r.begins] = BEGIN
    numbered = lambda word: word < model.size
    hashed = lambda word: hashes[np.maximum(word - model.size, 0)]
    at = np.flatnonzero(r.pair < 0)
    x, y = before[at], own[at]
    dealt = np.zeros(len(own), np.int64)
    dealt[at] = np.where(numbered(x), np.where(numbered(y), x << BITS | y, hashed(y)), hashed(x))
    pairs = Asked.of(at, x << 32 | y, dealt[at], buckets)
    context = -1 - r.pair
    context[at] = pairs.which
    some = ~r.begins
    some[r.found(model)[0]] = False
    longer = np.flatnonzero(some)
    heavy, z = r.pair[longer - 1] >= 0, own[longer]
    single = np.where(numbered(z), (before[longer - 1] << BITS | own[longer - 1]) << BITS | z, hashed(z))
    triples = Asked.of(longer, (context[longer - 1] + model.second.keys.n) << 32 | z, np.where(heavy, single, dealt[longer - 1]), buckets)
    of_pair, of_triple = pairs.buckets(), triples.buckets()
    columns, of = [before[pairs.token], own[pairs.token], own[triples.token]], [of_pair, of_pair, of_triple]
    words, upto, home = np.zeros(0, np.int64), np.zeros(buckets + 1, np.int64), code
    if len(code):
        light = [~numbered(c) for c in columns]
        key, which = np.unique(np.concatenate([b[k] << 32 | c[k] - model.size for c, b, k in zip(columns, of, light, strict=True)]), return_inverse=True)
        words, upto = hashes[key & 0xFFFFFFFF], np.searchsorted(key >> 32, np.arange(buckets + 1))
        for c, b, k, w in zip(columns, of, light, np.split(which, np.cumsum([k.sum() for k in light])[:-1]), strict=True):
            c[k] = -1 - (w - upto[b[k]])
        home = np.searchsorted(key, _home(hashes, buckets).astype(np.int64) << 32 | np.arange(len(hashes)))[code]
    longest = context[triples.token - 1]
    longest = np.where(longest < 0, longest, longest - pairs.upto[of_triple])
    return Asks(pairs, triples, words, upto, *columns, longest, home)


@dataclass
class Light:
    """Of each token, how often its pair and its triple occur if they are light, and the mass left below the pair; if its word is light, how often that occurs, and the mass left below it."""

    pairs: np.ndarray
    left: np.ndarray
    triples: np.ndarray
    words: np.ndarray
    word_left: np.ndarray


def log_chances(model: Model, r: Read, light: Light | None = None) -> np.ndarray:
    """log10 of the probability of every token, of those of a class that of the class."""
    one, left = model.chance[r.number], _chance(model.second.left[r.before])
    if light and model.wide:
        rare, after = r.number == RARE, np.flatnonzero(r.before == RARE)
        one[rare] = (light.words[rare] + 0.5) / model.scale
        left[after] = light.word_left[after - 1]
    p = one * left
    known = r.pair >= 0
    p[known] += _chance(model.second.chances[r.pair[known]])
    earlier = np.append(-1, r.pair[:-1])[: len(r.pair)]
    earlier[r.begins] = -1
    longer = earlier >= 0
    if light:
        some = np.flatnonzero(light.pairs)
        followed = model.followed()[r.before[some]]
        if model.wide:
            followed = np.where(r.before[some] == RARE, light.words[some - 1], followed)
        p[some] += (light.pairs[some] - DISCOUNT) / followed
        p *= np.where(r.begins, 1, np.append(1, light.left[:-1])[: len(p)])
    p[longer] *= _chance(model.third.left[earlier[longer]])
    at, place = r.found(model)
    p[at] += _chance(model.third.chances[place])
    if light:
        some = np.flatnonzero(light.triples)
        n = light.pairs[some - 1]
        heavy = longer[some]
        n[heavy] = _occurrences(model, r.before[some[heavy] - 1], earlier[some[heavy]])
        p[some] += (light.triples[some] - DISCOUNT) / n
    return np.log10(p)


def _occurrences(model: Model, first: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """How often pairs of the trie with their first word occur, as their rounded probabilities say."""
    return _chance(model.second.chances[pair]) * model.followed()[first] + DISCOUNT


_PARTIAL = "row long, doc_id long, held_out boolean, n_tokens long, known long, rare long, base double, chance double"
_NOBODY = pa.schema([(x.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]]) for x in _PARTIAL.split(", ")])
_RARE = "words array<long>, times array<long>"


def _partial(model: Model, r: Read, docs: list[pa.Array], light: Light | None = None) -> pa.RecordBatch:
    """Documents (row, doc_id, held_out) with the parts of both scores that known words give, light ones among them."""
    base = np.log10((model.counts + 0.5) / model.scale)[r.number]
    owner, n = r.tokens.owner(), len(docs[0])
    rare = r.number == RARE
    known = ~rare & (model.counts[r.number] > 0)
    if light and model.wide:
        base[rare], known[rare] = np.log10((light.words[rare] + 0.5) / model.scale), light.words[rare] > 0
        rare = np.zeros(len(rare), bool)
    parts = [np.bincount(owner, np.where(rare, 0, base), n), np.bincount(owner, log_chances(model, r, light), n)]
    counts = [np.diff(r.tokens.first), np.bincount(owner[known], minlength=n), np.bincount(owner[rare], minlength=n)]
    columns = [*docs, *(pa.array(c.astype(np.int64)) for c in counts), *map(pa.array, parts)]
    return pa.RecordBatch.from_arrays(columns, _NOBODY.names)


def _rare_words(t: Tokens, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rare words of each text: the text, the word's hash, and how often it is there."""
    rare = number == RARE
    word, code = np.unique(t.hashes[rare], return_inverse=True)
    pair, times = np.unique(t.owner()[rare] * max(len(word), 1) + code, return_counts=True)
    return pair // max(len(word), 1), word[pair % max(len(word), 1)], times.astype(np.int64)


def _scored(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = mapped(name)
        for b in chunks(batches, limit=SLICE_BYTES):
            r = read(model, b.column("text"))
            scored = _partial(model, r, [b.column(c) for c in ("row", "doc_id", "held_out")])
            text, word, times = _rare_words(r.tokens, r.number)
            many = np.bincount(text, minlength=len(b))
            yield pa.RecordBatch.from_arrays([*scored.columns, lists(word, many), lists(times, many)], [*scored.schema.names, "words", "times"])

    return run


#: Columns of slices that hold their texts: documents learnt from, the place of each one's first token, and word numbers; light words are in a column of their own.
_READ = ["learnt", "first", "number"]
_SLICE = "slice string, row array<long>, doc_id array<long>, held_out array<boolean>, learnt array<boolean>, first array<int>, number binary, light binary, rare_row array<long>, rare_word array<long>, rare_times array<long>"


def _sliced(name: str):
    """Slices of texts as word numbers; and their light words in order, or else their rare words by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = mapped(name)
        for b in chunks(batches, limit=SLICE_BYTES):
            t = tokens(b.column("text"))
            number = model.numbers(t.hashes)
            number[t.ends] = END
            light = t.hashes[number == RARE] | _SIGN if model.wide else np.zeros(0, np.int64)
            text, word, times = (np.zeros(0, np.int64),) * 3 if model.wide else _rare_words(t, number)
            one = lambda values: lists(values, np.array([len(values)]))
            whole = [pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(c)) for c in ("row", "doc_id", "held_out", "learnt")]
            rare = [one(b.column("row").to_numpy()[text]), one(word), one(times)]
            columns = [pa.array([uuid.uuid4().hex]), *whole, one(t.first.astype(np.int32)), pa.array([_planes(number.astype("<i4"))]), pa.array([_planes(light)]), *rare]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "row", "doc_id", "held_out", "learnt", "first", "number", "light", "rare_row", "rare_word", "rare_times"])

    return run


def _sliced_docs(docs: DataFrame, model: Model) -> DataFrame:
    """Slices of ``docs`` (doc_id, held_out, learnt, text), rows numbered."""
    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sliced(shared(docs.sparkSession, model)), _SLICE)


def _read_slice(model: Model, row: pa.RecordBatch | pa.Table) -> tuple[Read, np.ndarray]:
    """The tokens of a slice's row, and which of them are learnt from."""
    first = np.array(row.column("first")[0].values, np.int64)
    number = _joined_planes([row.column("number")[0].as_py()], "<i4").astype(np.int64)
    t = Tokens(None, first[1:] - 1, first)
    r = _followed_up(model, t, number)
    if model.wide and "light" in row.schema.names:
        r.light = _joined_planes([row.column("light")[0].as_py()], "<i8")
    return r, np.array(row.column("learnt")[0].values.to_numpy(zero_copy_only=False), bool)[t.owner()]


def _reads(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Read, np.ndarray | None]]:
    """The tokens of texts or slices, a few MB at once, and which of them are learnt from, None for all."""
    for batch in batches:
        if "text" in batch.schema.names:
            yield from ((read(model, b.column("text")), None) for b in chunks(iter([batch]), limit=SLICE_BYTES))
        else:
            yield from (_read_slice(model, batch.slice(k, 1)) for k in range(len(batch)))


def _asking(name: str, buckets: int):
    """Of each slice and bucket the light n-grams, and how often the texts to be learnt from have them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = mapped(name)
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                r, learnt = _read_slice(model, row)
                a = asked(model, r, buckets)
                columns = [pa.array([row.column("slice")[0].as_py()] * buckets), pa.array(np.arange(buckets, dtype=np.int32)), _binaries(a.words, a.upto)]
                for grams, own in ((a.pairs, (a.first, a.second)), (a.triples, (a.context, a.third))):
                    n = np.bincount(grams.which, learnt[grams.at], len(grams.token))
                    columns += [_binaries(c.astype("<i4"), grams.upto) for c in (*own, n)]
                yield pa.RecordBatch.from_arrays(columns, _names(_ASK))
        give_back()

    return run


_ASK = "slice string, bucket int, words binary, first binary, second binary, n_pairs binary, context binary, third binary, n_triples binary"
_ANSWER = "slice string, bucket int, n_words binary, taken_words binary, n_pairs binary, taken_pairs binary, n_triples binary, contexts array<long>, taken array<double>"


def _keys(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number for each two: their own bits where both are small, else 63 bits of a hash."""
    out = first << 32
    out |= last
    light = np.flatnonzero((first < 0) | (last < 0))
    x, y = (v[light].view(np.uint64) for v in (first, last))
    out[light] = mix(mix(x) * np.uint64(0x9E3779B97F4A7C15) + y).view(np.int64) | _SIGN
    return out


def _answered(least: int):
    """How often the bucket's light words and n-grams occur, and 4 times what pairs take from its words' counts and triples from its pairs', for every slice; and a row of what they take from the contexts outside: pairs of the trie, and numbered words (as -1 - number)."""

    def run(table: pa.Table) -> pa.Table:
        words, upto_word = _values(table.column("words"), "<i8")

        def column(name: str) -> tuple[np.ndarray, np.ndarray]:
            """Word numbers, or light words, of n-grams."""
            value, upto = _values(table.column(name))
            light = np.flatnonzero(value < 0)
            part = np.searchsorted(upto, light, side="right") - 1
            value = value.astype(np.int64)
            value[light] = words[upto_word[part] - 1 - value[light]]
            return value, upto

        first, upto_pair = column("first")
        one, which_pair, n = _summed(_keys(first, column("second")[0]), table.column("n_pairs"))
        begins = first[one]
        del first, one
        word, which_word = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(word, begins), max(len(word) - 1, 0))
        light = begins < 0
        times = np.bincount(at[light], n[light], len(word)).astype("<i4")
        n[n < least] = 0
        quarters_word = np.bincount(at[light], np.where(n[light] > 0, 4 * (n[light] - DISCOUNT), 0), len(word)).astype("<i4")  # whole, as DISCOUNT is three quarters
        del at
        third, upto_triple = column("third")
        context = _values(table.column("context"))[0].astype(np.int32)
        inside = context >= 0
        context[inside] = which_pair[(np.repeat(upto_pair[:-1].astype(np.int32), np.diff(upto_triple)) + context)[inside]]
        del inside
        key = _keys(np.where(context < 0, len(n) - 1 - context, context).astype(np.int64), third)
        del third
        one, which_triple, m = _summed(key, table.column("n_triples"))
        of = context[one].astype(np.int64)
        del key, context, one
        m[m < least] = 0
        mass = np.where(m > 0, m - DISCOUNT, 0)
        quarters = np.bincount(of[of >= 0], 4 * mass[of >= 0], len(n)).astype("<i4")
        here, there = (n > 0) & ~light, (of < 0) & (m > 0)
        own, place = np.unique(np.concatenate((-1 - begins[here], -1 - of[there])), return_inverse=True)
        taken = np.bincount(place, np.concatenate((n[here] - DISCOUNT, mass[there])), len(own))
        rows, bucket = table.num_rows, table.column("bucket")[0].as_py()
        empty = pa.array([b""])
        columns = [(times[which_word], upto_word), (quarters_word[which_word], upto_word), (n[which_pair].astype("<i4"), upto_pair), (quarters[which_pair], upto_pair), (m[which_triple].astype("<i4"), upto_triple)]
        columns = [_binaries(*c) for c in columns]
        none = np.zeros(rows, np.int64)
        give_back()
        return pa.table(
            [
                pa.chunked_array([*table.column("slice").chunks, pa.array([None], pa.string())], pa.string()),
                pa.array([bucket] * (rows + 1), pa.int32()),
                *(pa.concat_arrays([c, empty.cast(pa.binary())]) for c in columns),
                lists(own, np.append(none, len(own))),
                lists(taken, np.append(none, len(own))),
            ],
            _names(_ANSWER),
        )

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _scored_slices(name: str, buckets: int):
    """Documents of a slice, as ``_partial`` has them, with the answers of all buckets."""

    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        if not slices.num_rows:  # one that isn't asked
            return _NOBODY.empty_table()
        model = mapped(name)
        r, _ = _read_slice(model, slices)
        give_back()
        answers = answers.sort_by("bucket")
        got = {c: _values(answers.column(c))[0] for c in _names(_ANSWER)[2:7]}
        a = asked(model, r, buckets)
        left = lambda kind: 1 - got[f"taken_{kind}"] / (4 * np.maximum(got[f"n_{kind}"], 1))
        light = Light(*(make(len(r.number)) for make in (np.zeros, np.ones, np.zeros, np.zeros, np.ones)))
        light.pairs[a.pairs.at] = got["n_pairs"][a.pairs.which]
        light.left[a.pairs.at] = left("pairs")[a.pairs.which]
        light.triples[a.triples.at] = got["n_triples"][a.triples.which]
        if model.wide:
            rare = r.number == RARE
            light.words[rare], light.word_left[rare] = got["n_words"][a.home], left("words")[a.home]
        docs = [slices.column(c)[0].values for c in ("row", "doc_id", "held_out")]
        scored = _partial(model, r, docs, light)
        del r, a, light, got
        give_back()
        return pa.Table.from_batches([scored])

    return run


def _with_light(slices: DataFrame, model: Model) -> DataFrame:
    """The partial scores of the documents of slices that are ``asked``, as ``_partial`` has them; all slices are counted."""
    spark, buckets = slices.sparkSession, model.buckets()
    asking = slices.select("slice", *_READ, "light").mapInArrow(_asking(shared(spark, model), buckets), _ASK)
    with shuffles_removed(spark):
        answers = saved(_by_bucket(asking, buckets).applyInArrow(_answered(model.least()), _ANSWER), "answers")
    sums = answers.where("slice is null").select(F.explode(F.arrays_zip("contexts", "taken")).alias("c")).groupBy("c.contexts").agg(F.sum("c.taken").alias("taken")).toArrow()  # at most a row for each word and pair of the trie
    context, taken = (sums.column(c).to_numpy() for c in ("contexts", "taken"))
    one = context < 0
    by_word, by_pair = np.zeros(model.size), np.zeros(model.second.keys.n)
    word = -1 - context[one]
    by_word[word] = taken[one] / model.followed()[word]
    place = context[~one]
    first = np.searchsorted(model.second.begin(np.arange(model.size + 1)), place, side="right") - 1
    by_pair[place] = taken[~one] / _occurrences(model, first, place)
    whole = replace(model, second=model.second.without(by_word), third=model.third.without(by_pair))
    wanted = slices.where("asked").select("slice", "row", "doc_id", "held_out", *_READ, "light")
    found = answers.where("slice is not null").drop("contexts", "taken")
    return wanted.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(_scored_slices(shared(spark, whole), buckets), _PARTIAL)


def scores(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, held_out, text).

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text ends with
    one more token.  base_score is the log10 probability under single words, score that of the
    model.  Null, empty and blank texts are their end alone; texts of any length are read
    whole; repeated rows are scored each for itself, a null doc_id stays null.  Words are kept
    as 64-bit hashes (two of 10**7 words share one with a chance of 3 in 10**6).  Other
    columns are ignored; an empty table gives an empty result.
    """
    model = trained.model
    if trained.slices is None:
        return _with_rare(*_in_place(_own(docs), model), trained)
    new = saved(_sliced_docs(_own(docs).withColumn("learnt", F.lit(False)), model), "slices")
    return _of_slices(trained.slices.withColumn("asked", F.lit(False)).unionByName(new.withColumn("asked", F.lit(True))), trained)


def _in_place(docs: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Partial scores, and the rare words (row, word, times), where the trie has all n-grams."""
    found = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scored(shared(docs.sparkSession, model)), f"{_PARTIAL}, {_RARE}")
    found = saved(found, "scored_documents")
    rare = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    return found.drop("words", "times"), rare


def _of_slices(slices: DataFrame, trained: Trained) -> DataFrame:
    """``scores`` of the documents of slices that are ``asked``."""
    if trained.model.wide:
        return _whole(_with_light(slices, trained.model), trained.model)
    rare = slices.where("asked").select(F.explode(F.arrays_zip("rare_row", "rare_word", "rare_times")).alias("w"))
    return _with_rare(_with_light(slices, trained.model), rare.select(F.col("w.rare_row").alias("row"), F.col("w.rare_word").alias("word"), F.col("w.rare_times").alias("times")), trained)


def _with_rare(found: DataFrame, rare: DataFrame, trained: Trained) -> DataFrame:
    """The scores from partial ones and the rare words of documents, which meet the counts of all words."""
    model = trained.model
    counts = trained.words.where((F.col("n") < model.total / (WORDS or NUMBERED)) & (F.col("word") != END_WORD))
    priced = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = F.log10((F.col("n") + 0.5) / F.lit(model.scale)) * F.col("times")
    sums = priced.groupBy("row").agg(F.sum(each).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    none = {"rare_base": 0.0, "rare_known": 0}
    of_class = F.lit(float(np.log10(model.chance[RARE])))
    found = found.join(sums, "row", "left").fillna(none)
    return _whole(found.withColumns({"known": F.col("known") + F.col("rare_known"), "base": F.col("base") + F.col("rare_base"), "chance": F.col("chance") + F.col("rare_base") - F.col("rare") * of_class}), model)


def _whole(found: DataFrame, model: Model) -> DataFrame:
    total = F.lit(model.total).cast("long").alias("train_tokens")
    return found.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), total, F.col("base").alias("base_score"), F.col("chance").alias("score"))


def language_scores(docs: DataFrame, modulus: int = 5, held_out: int = 1) -> DataFrame:
    """``scores`` of all ``docs`` (doc_id, text) under a model of those outside the held-out fold; rows without a doc_id are outside."""
    folded = docs.withColumn("held_out", F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)))
    trained = fit(folded, "not held_out")
    return scores(folded, trained) if trained.slices is None else _of_slices(trained.slices.withColumn("asked", F.lit(True)), trained)
