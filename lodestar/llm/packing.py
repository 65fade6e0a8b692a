"""Packing of documents into fixed windows, lexical neighbours together.

Documents are dealt by content to shards of about ``SHARD_TOKENS`` tokens: a tree of
two-means cuts, grown on a sample, sends documents with like words the same way, and only a
leaf that holds several shards' tokens is split by hash.  In a shard, an inverted index with BM25 weights,
with document frequencies and mean length of the whole corpus, returns for each seed document
the unused documents most like it;
they fill the rest of the seed's window greedily, best first, and the last one is cut to
fit.  Cut-off remainders go on as documents of their own, so all windows but a shard's
last are full; what is left at the end is laid out in windows of powers of two.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import CHUNK_BYTES, chunks, give_back, saved, utf8
from lodestar.llm.words import LOWER, words_of

WINDOW, END = 2048, 1
#: Mean tokens of a shard.
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: Dimensions that documents are projected to, and how many of them a term falls on.
DIMENSIONS, PLACES = 64, 4
#: Sampled documents that the tree is grown on: so many a leaf, and at most; leaves of the tree, at most.
LEAF_SAMPLE, TREE_SAMPLE, LEAVES = 64, 1 << 17, 1 << 13
#: Texts on which a tokenizer must give the same ids by stretches as whole, or it is given whole texts.
_PROBES = ["The Quick brown fox, jumps (over) 3 dogs!", "don't  stop\t'til\n\nit's done...", "x=1;y_2 #tag @me a-b--c foo.bar/baz", "na\u00efve \u00c0B \u0130x \u00fcber\u2026 \u4e2d\u6587", "\u0130... \u0130-- a\u0130_b \u0130# \u0130\u0130!", " lead and trail "]
#: Share of unused documents below which a shard's index is made smaller.
SPARSE = 0.7
#: Neighbours of a seed that are sorted at first.
FIRST = 64
#: Bytes of ids that a worker weighs at once; longer documents are weighed alone.
IDS_BYTES = 1 << 19
#: Stretches, and words without the signs after them, that a worker keeps.
_MEMO, _CORES = 1 << 20, 1 << 18
#: Special tokens begin so.
_SPECIAL = b"<|"
#: After letters, a run of these is one pre-token.
_SIGNS = "".join(sorted(set(string.punctuation) - {"'"}))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Tails(dict):
    """The ids of signs, encoded when they are first met."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, tail: str) -> bytes:
        self[tail] = ids = self.encode(tail)
        return ids


class Encoder:
    """Token ids of many texts; each stretch without ASCII white space is encoded once and kept by its hash.

    White space always ends a pre-token of the tokenizers meant here, and they lower-case, so
    a text's ids are those of its stretches, A-Z lower-cased, joined.  A stretch of letters is
    one pre-token, the signs after it another.  Others, told by ``_PROBES``, encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.cores: dict[str, bytes] = {}
        self.tails = _Tails(self.plain)
        self._forget()
        data = [t.encode() for t in _PROBES]
        ids, counts = self._stretches(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64))
        at = np.concatenate(([0], np.cumsum(counts)))
        self.by_stretches = all(self.plain(t) == ids[i:j].tobytes() for t, i, j in zip(_PROBES, at, at[1:], strict=False))

    def _forget(self) -> None:
        self.hashes, self.first, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Encodes stretches of letters, many at once; each ends at its first word-ending token."""
        out: dict[str, bytes] = {}
        lines = [words[k : k + 64] for k in range(0, len(words), 64)]
        for line, code in zip(lines, self.tokenizer.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(code.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(line):
                data, stops = ids.tobytes(), stops.tolist()
                out.update((w, data[i:j]) for w, i, j in zip(line, [0, *stops], stops, strict=False))
            else:
                out.update((w, self.plain(w)) for w in line)
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Takes up new stretches, in the order of their hashes."""
        cores = [w.rstrip(_SIGNS) for w in words]
        for have, most in ((self.cores, _CORES), (self.tails, 1 << 16)):
            if len(have) > most:
                have.clear()
        known = self.cores
        known.update(self._letters(list({c for c in cores if c not in known and c.isalpha() and c.lower().isalpha()})))  # a letter whose lower case has a mark joins the signs after it
        tails, plain = self.tails, self.plain
        found = [plain(w) if (ids := known.get(c)) is None else ids if len(c) == len(w) else ids + tails[w[len(c) :]] for w, c in zip(words, cores, strict=True)]
        counts = np.array([len(x) for x in found], np.int64) // 4
        first = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(found), "<u4")))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.counts = (np.insert(have, at, new) for have, new in ((self.hashes, hashes), (self.first, first), (self.counts, counts)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as joined UTF-8, and how many each text has.

        Texts that might hold a special token, whose case counts, are encoded whole.
        """
        raw = data.tobytes()
        if not self.by_stretches:
            parts = [np.frombuffer(self.plain(raw[i:j].decode()), "<u4") for i, j in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            return np.concatenate([np.zeros(0, "<u4"), *parts]), np.array([len(p) for p in parts], np.int64)
        ids, counts = self._stretches(data, offsets)
        if _SPECIAL not in raw:
            return ids, counts
        upto, offs = np.concatenate(([0], np.cumsum(counts))).tolist(), offsets.tolist()
        texts = [raw[i:j] for i, j in zip(offs, offs[1:], strict=False)]
        parts = [np.frombuffer(self.plain(t.decode()), "<u4") if _SPECIAL in t else ids[a:b] for t, a, b in zip(texts, upto, upto[1:], strict=False)]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = words_of(data, offsets, lower=True)
        by_hash = np.argsort(w.hashes)  # quicker than np.unique, whose first places need a stable sort; any place will do
        ordered = w.hashes[by_hash]
        new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        own, at = ordered[new], by_hash[new]
        which = np.empty(len(ordered), np.int32)
        which[by_hash] = np.cumsum(new) - 1
        if len(self.hashes) + len(own) > _MEMO:
            self._forget()
        place = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
        new = self.hashes[place] != own if len(self.hashes) else np.ones(len(own), bool)
        if new.any():
            raw = LOWER[data].tobytes()
            self._learn(own[new], [raw[i:j].decode() for i, j in zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, own)
        counts = self.counts[place][which]
        begins = self.first[place][which]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(begins - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[w.first])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for b in chunks(batches, limit=2 * CHUNK_BYTES):
            ids, counts = code.encode(*utf8(b.column("text")))
            stops = np.cumsum(counts)
            ids = np.insert(ids, stops, end).astype(kind)
            offsets = np.concatenate(([0], stops + np.arange(1, len(stops) + 1))) * ids.itemsize
            column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), column], ["doc_id", "ids"])

    return run


@dataclass
class Corpus:
    """Documents, their mean length, and the BM25 weight of every term over all of them."""

    mean: float
    idf: np.ndarray
    documents: int
    tokens: int

    @classmethod
    def of(cls, n: int, tokens: int, df: np.ndarray) -> Corpus:
        return cls(max(tokens / max(n, 1), 1.0), _idf(n, df), n, tokens)


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column's documents, joined, and their offsets."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def term_counts(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) for the distinct terms of each document."""
    bits = 8 * ids.itemsize
    kind = np.uint32 if len(offsets) <= 1 << (32 - bits) else np.uint64
    key = np.repeat(np.arange(len(offsets) - 1, dtype=kind), np.diff(offsets)) << kind(bits) | ids
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return (key[at] >> kind(bits)).astype(np.int64), key[at].astype(ids.dtype).astype(np.int64), np.diff(np.append(at, len(key)))


def _frequencies(kind: str):
    """(term, n) of a partition: the documents with a term; -1 counts documents, -2 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(1, np.int64), 0, 0
        for b in chunks(batches, "ids", IDS_BYTES):
            ids, offsets = _joined(b.column("ids"), kind)
            n += len(b)
            tokens += len(ids)
            own = np.bincount(term_counts(ids, offsets)[1], minlength=len(df))
            own[: len(df)] += df
            df = own
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], at)), pa.int64()), pa.array(np.concatenate(([n, tokens], df[at])), pa.int64())], ["term", "n"])

    return run


def corpus_of(ids: DataFrame, kind: str, size: int) -> Corpus:
    """The statistics of all documents of ``ids``; the driver gets one row a term."""
    got = {r["term"]: r["n"] for r in ids.select("ids").mapInArrow(_frequencies(kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(size, np.int64)
    for term, n in got.items():
        if term >= 0:
            df[term] = n
    return Corpus.of(got.get(-1, 0), got.get(-2, 0), df)


@lru_cache(maxsize=1)
def _directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """PLACES dimensions of every term, and its signs there."""
    rng = np.random.default_rng(7)
    return rng.integers(DIMENSIONS, size=(PLACES, size)), rng.choice(np.array([-1, 1], np.float32), (PLACES, size))


def vectors(ids: np.ndarray, offsets: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Documents as unit vectors whose products stand for their BM25: a sparse random projection of the square roots of term weights."""
    doc, term, tf = term_counts(ids, offsets)
    n, lengths = len(offsets) - 1, np.diff(offsets)
    weights = np.sqrt(corpus.idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B / corpus.mean * lengths))[doc]))
    place, sign = _directions(len(corpus.idf))
    first = doc * DIMENSIONS
    out = sum(np.bincount(first + place[k][term], sign[k][term] * weights, n * DIMENSIONS) for k in range(PLACES)).reshape(n, DIMENSIONS).astype(np.float32)
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Tree:
    """Cuts by a direction and a bound; below is the node for products under the bound, above the other; leaves are negative."""

    ways: np.ndarray
    bounds: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        node = np.zeros(len(x), np.int64) if len(self.bounds) else np.full(len(x), -1, np.int64)
        while (at := np.flatnonzero(node >= 0)).size:
            k = node[at]
            node[at] = np.where(np.einsum("ij,ij->i", x[at], self.ways[k]) < self.bounds[k], self.below[k], self.above[k])
        return -1 - node


def grown(x: np.ndarray, tokens: np.ndarray, leaves: int) -> Tree:
    """A tree of ``leaves`` leaves with about equally many tokens of the sample, each cut between two means."""
    rng = np.random.default_rng(11)
    ways, bounds, below, above = [], [], [], []
    open_nodes, n_leaves = [(np.arange(len(x)), leaves, None)], 0
    while open_nodes:
        rows, k, place = open_nodes.pop()
        if k == 1:
            mine, n_leaves = -1 - n_leaves, n_leaves + 1
        else:
            mine = len(bounds)
            own = x[rows]
            way = np.zeros(x.shape[1], np.float32)
            if len(rows) > 1:
                a, b = own[rng.choice(len(rows), 2, replace=False)]
                for _ in range(8):
                    near = own @ (a - b) >= 0
                    if near.all() or not near.any():
                        break
                    a, b = (m / max(float(np.linalg.norm(m)), 1e-9) for m in (own[near].mean(axis=0), own[~near].mean(axis=0)))
                way = a - b
            at = own @ way
            order = np.argsort(at, kind="stable")
            upto = np.cumsum(tokens[rows][order])
            cut = int(np.searchsorted(upto, upto[-1] * (k // 2) / k)) if len(rows) else 0
            bound = at[order[min(cut, len(rows) - 1)]] if len(rows) else np.float32(0)
            ways.append(way)
            bounds.append(bound)
            below.append(0)
            above.append(0)
            low = at < bound
            open_nodes += [(rows[low], k // 2, (below, mine)), (rows[~low], k - k // 2, (above, mine))]
        if place:
            place[0][place[1]] = mine
    return Tree(np.array(ways, np.float32).reshape(-1, x.shape[1]), np.array(bounds, np.float32), np.array(below, np.int64), np.array(above, np.int64))


def _sampled(kind: str, corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "ids", IDS_BYTES):
            ids, offsets = _joined(b.column("ids"), kind)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors(ids, offsets, corpus)], pa.binary()), pa.array(np.diff(offsets), pa.int64())], ["x", "tokens"])

    return run


def _leaves(kind: str, corpus: Corpus, tree: Tree):
    """The documents with their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "ids", IDS_BYTES):
            leaf = tree(vectors(*_joined(b.column("ids"), kind), corpus))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(leaf)], ["doc_id", "ids", "leaf"])

    return run


def dealt(ids: DataFrame, kind: str, corpus: Corpus, shard_tokens: int) -> DataFrame:
    """``ids`` with the shard of every document.

    The tree has a leaf for each shard, or LEAVES.  The sample that it is grown on tells how
    much a leaf holds (copies can't be cut apart); one of several shards' tokens is split by
    hash.  Which documents meet depends on the sample, which ids are packed doesn't.
    """
    leaves = max(1, min(LEAVES, round(corpus.tokens / shard_tokens)))
    share = min(1.0, min(LEAF_SAMPLE * leaves, TREE_SAMPLE) / max(corpus.documents, 1))
    some = ids.where(F.pmod(F.xxhash64("doc_id", F.crc32("ids"), F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = some.select("ids").mapInArrow(_sampled(kind, corpus), "x binary, tokens long").toArrow()
    x = np.array([np.frombuffer(v.as_buffer(), np.float32) for v in rows.column("x")], np.float32).reshape(-1, DIMENSIONS)
    sizes = rows.column("tokens").to_numpy()
    order = np.lexsort((*x.T, sizes))  # the same tree however the rows arrive
    x, sizes = x[order], sizes[order]
    tree = grown(x, sizes, leaves)
    held = np.bincount(tree(x), sizes, leaves) * (corpus.tokens / max(sizes.sum(), 1) / shard_tokens)  # in shards, about
    parts = np.where(held > 2, np.rint(held), 1).astype(np.int64)
    named = ids.mapInArrow(_leaves(kind, corpus, tree), "doc_id long, ids binary, leaf long")
    shards = ids.sparkSession.createDataFrame(pd.DataFrame({"leaf": np.arange(leaves), "first": np.cumsum(parts) - parts, "parts": parts}))  # LEAVES rows at most
    return named.join(F.broadcast(shards), "leaf").select("doc_id", "ids", (F.col("first") + F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.col("parts"))).alias("shard"))


class Index:
    """Postings with BM25 weights over the documents of one shard, weighed as in ``corpus`` (these documents, if None)."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        lengths = np.array([len(d) for d in docs], np.float32)
        base = np.int64(1) << 32
        pairs, counts = np.unique(np.concatenate([d.astype(np.int64) * base + i for i, d in enumerate(docs)]), return_counts=True)
        terms, self.owners = pairs // base, (pairs % base).astype(np.int32)
        self.terms, self.first = np.unique(terms, return_index=True)
        self.last = np.append(self.first[1:], len(terms))
        df = (self.last - self.first).astype(np.float32)
        idf = corpus.idf[self.terms] if corpus else _idf(n, df)
        mean = corpus.mean if corpus else max(float(lengths.mean()), 1.0)
        tf = counts.astype(np.float32)
        self.weights = np.repeat(idf, self.last - self.first) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.owners] / mean))
        self.n = n
        order = np.argsort(self.owners.astype(np.uint16) if n <= 1 << 16 else self.owners, kind="stable")  # short numbers are sorted by digits
        self.of_doc = np.searchsorted(self.owners[order], np.arange(n + 1))
        self.doc_terms = np.searchsorted(self.terms, terms)[order].astype(np.int32)

    def only(self, docs: np.ndarray) -> Index:
        """The postings of some documents, ascending, with the weights that they have; documents are numbered anew."""
        out = object.__new__(Index)
        place = np.full(self.n, -1, np.int32)
        place[docs] = np.arange(len(docs), dtype=np.int32)
        stays = place[self.owners] >= 0
        upto = np.append(0, np.cumsum(stays))
        out.n, out.terms, out.first, out.last = len(docs), self.terms, upto[self.first], upto[self.last]
        out.owners, out.weights = place[self.owners[stays]], self.weights[stays]
        many = np.diff(self.of_doc)
        out.doc_terms = self.doc_terms[np.repeat(place >= 0, many)]
        out.of_doc = np.append(0, np.cumsum(many[docs]))
        return out

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the distinct terms of one."""
        spans = self.doc_terms[self.of_doc[doc] : self.of_doc[doc + 1]]
        first, counts = self.first[spans], self.last[spans] - self.first[spans]
        at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.bincount(self.owners[at], self.weights[at], self.n)


def _powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _best_first(scores: np.ndarray, own: np.ndarray) -> Iterator[int]:
    """Documents with a score of 0 or more, best first, of equal ones the earlier; the first FIRST are sorted alone, which mostly fill a window."""
    near = np.flatnonzero(scores >= 0)
    if len(near) > 4 * FIRST:
        bound = np.partition(scores[near], len(near) - FIRST)[len(near) - FIRST]
        top = near[scores[near] >= bound]
        yield from own[top[np.argsort(-scores[top], kind="stable")]].tolist()
        near = near[scores[near] < bound]
    yield from own[near[np.argsort(-scores[near], kind="stable")]].tolist()


def fill(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); all full but for the last, cut in powers of two."""
    out: list[list[tuple[int, int, int]]] = []
    at = [0] * len(docs)
    left = np.array([len(d) for d in docs], np.int64)
    for i in range(len(docs)):  # whole windows of one document
        while left[i] >= window:
            out.append([(i, at[i], window)])
            at[i] += window
            left[i] -= window
    index = Index(docs, corpus)
    open_docs = left > 0
    seeds = np.argsort(-left, kind="stable").tolist()
    tail: list[tuple[int, int, int]] = []
    own = np.arange(len(docs))  # the documents that the index has
    for seed in seeds:
        while open_docs[seed]:
            now, room = [], window
            still = open_docs[own]
            if still.sum() < SPARSE * len(own):  # postings of used documents would be read for nothing
                index, own = index.only(np.flatnonzero(still)), own[still]
                still = open_docs[own]
            at_seed = int(np.searchsorted(own, seed))
            scores = index.scores(at_seed)
            scores[~still] = -1
            scores[at_seed] = np.inf
            for i in _best_first(scores, own):
                take = int(min(room, left[i]))
                now.append((i, at[i], take))
                at[i] += take
                left[i] -= take
                open_docs[i] = left[i] > 0
                room -= take
                if not room:
                    break
            if room:
                tail = now
            else:
                out.append(now)
    for size in _powers_of_two(sum(p[2] for p in tail)):
        now = []
        while size:
            doc, start, length = tail[0]
            take = min(size, length)
            now.append((doc, start, take))
            size -= take
            tail = ([(doc, start + take, length - take)] if length > take else []) + tail[1:]
        out.append(now)
    return out


def _pack(window: int, kind: str, corpus: Corpus | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "ids"], kind="stable", na_position="last")
        ids = [np.frombuffer(x, kind).astype("<u4") for x in pdf["ids"]]
        shard, names = int(pdf["shard"].iloc[0]), pdf["doc_id"].tolist()
        rows = []
        for k, sequence in enumerate(fill(ids, window, corpus)):
            offset = 0
            for i, start, length in sequence:
                piece = ids[i][start : start + length]
                rows.append((names[i], start, length, zlib.crc32(piece.tobytes()), len(ids[i]), (shard << 32) | k, offset))
                offset += length
        del pdf, ids
        give_back()
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids and ``end``; null and blank texts are ``end`` alone.  Every
    id lies in exactly one piece; texts of any length are encoded whole and fill windows of
    their own.  Sequences hold ``window`` ids, but for a shard's last ones, which hold a power
    of two.  Of equally near neighbours the one of smaller doc_id, then ids, comes first.
    Repeated rows are packed each for itself; a null doc_id stays null.  Other columns are
    ignored; an empty table gives an empty result.
    """
    path = tokenizer or vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 4)).first()[0] or 0
    alone = size <= 3 * shard_tokens
    terms = max(end + 1, encoder(path).size)
    kind = "<u2" if terms <= 1 << 16 else "<u4"  # how ids travel
    ids = texts.mapInArrow(_encode(path, end, kind), "doc_id long, ids binary")
    if alone:
        corpus, shared = None, ids.withColumn("shard", F.lit(0).cast("long"))
    else:
        ids = saved(ids, "packing-ids")
        corpus = corpus_of(ids, kind, terms)
        shared = dealt(ids, kind, corpus, shard_tokens)
    return shared.groupBy("shard").applyInPandas(_pack(window, kind, corpus), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
