"""Secrets by patterns and by character Markov models.

Besides assignments, access keys and long hex strings, any long run of key characters is
scored by the log-likelihood ratio of two Markov chains over its characters, one trained on
random strings and one on ordinary identifiers; the cut between the two is set on labelled
strings that neither chain has seen.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import chunks, utf8
from lodestar.llm.spans import span_table

BASE, EXTRA = ["assign", "access", "hex"], ["random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
#: Labelled strings, random ones and ordinary ones, of which half set the cut.
STRINGS, SEED = 8_000, 23
#: What the pairs of characters of all documents weigh together, against those of made-up names: however much text there is.
CORPUS_WEIGHT = 1e7
#: Length of a candidate; share of ordinary strings that may pass the cut on the mean log-likelihood ratio of their pairs of characters.
SHORTEST, FALSE = 20, 0.001
#: Ordinary identifiers, besides those made of the corpus's own words.
ORDINARY = "configuration handler default request response session manager controller service container application environment development production background message transaction database connection repository interface implementation annotation dependency injection validation exception iterator collection document element attribute property listener callback function parameter argument variable constant reference pointer buffer stream channel socket network protocol version release snapshot checkpoint benchmark example template component container_name user_id file_path_2 max_retry_count_3 http_status_404 utf8_encoded_text_v2 the quick brown fox jumps over lazy dogs".split()

_ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Cut off the ends of a candidate.
_EDGES = "=-_/+"
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)


_CODES = np.full(256, -1)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def pairs(words: list[str]) -> np.ndarray:
    """Counts of neighbouring characters inside words."""
    codes = _CODES[np.frombuffer("\n".join(words).encode(), np.uint8)]
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    n = len(ALPHABET)
    return np.bincount(codes[:-1][both] * n + codes[1:][both], minlength=n * n).reshape(n, n).astype(float)


def random_strings(n: int = STRINGS, seed: int = SEED) -> list[str]:
    """Labelled random strings over the alphabets of common keys, also such that happen to hold letters only."""
    rng = np.random.default_rng(seed)
    kinds = [ALPHABET[52:62] + "abcdef", ALPHABET[26:52] + "234567", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", ALPHABET[:62], ALPHABET[:52]]
    return ["".join(rng.choice(list(kinds[i % len(kinds)]), rng.integers(SHORTEST, 45))) for i in range(n)]


def ordinary_strings(n: int = STRINGS, seed: int = SEED) -> list[str]:
    """Labelled names of the kinds that people make up: words joined in many styles, dates, versions, paths, runs."""
    rng = np.random.default_rng(seed)

    def some(*options):
        return options[rng.integers(len(options))]

    def words(k):
        return [some(*ORDINARY) for _ in range(k)]

    def number():
        return str(some(rng.integers(100), rng.integers(10_000), rng.integers(10**6)))

    def date():
        sign = some("-", "-", "", "_", "/")
        day = sign.join([str(rng.integers(1990, 2030)), f"{rng.integers(1, 13):02}", f"{rng.integers(1, 29):02}"])
        return day + some("", "", f"T{rng.integers(24):02}{some('-', '')}{rng.integers(60):02}{some('-', '')}{rng.integers(60):02}{some('', 'Z')}")

    def one():
        kind = rng.integers(10)
        if kind < 4:
            w = words(rng.integers(2, 6)) + ([number()] if rng.random() < 0.4 else [])
            return some("_", "-", "/", "", "=").join(w)
        if kind == 4:
            return "".join(w.title() if i else w for i, w in enumerate(words(rng.integers(3, 6)))) + some("", number())
        if kind == 5:
            return some("_", "-").join(w.upper() for w in words(rng.integers(2, 5))) + some("", "_" + number())
        if kind == 6:
            return some("-", "_").join([date(), *words(rng.integers(1, 3))][:: some(1, -1)])
        if kind == 7:
            return some("-", "_").join([some("ISO-8859-1", "UTF-8", "RFC-2616", "SHA-256", "x86_64", "v2", "RC1", "py3", "C3PO", "H264", "MP4", "A4", "B2B"), *words(2), some("UTF-8", "to-UTF-16", "v10", "x64", "2D", "3D"), *words(1)])
        if kind == 8:
            return some("IMG", "DSC", "order", "ticket", "file", "page", "id") + some("_", "-") + f"{rng.integers(10**9):012}" + some("", "_") + words(1)[0]
        return some(*ALPHABET) * 28 if rng.random() < 0.5 else some("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789" * 3, "1234567890abcdefghij", "lalalalalalalalalalala", "hahahahahahahahahahaha")

    out: list[str] = []
    while len(out) < n:
        if len(x := one()) >= SHORTEST:
            out.append(x)
    return out


_JOINS = [lambda a, c: f"{a}_{c}", lambda a, c: a.lower() + c.title(), lambda a, c: f"{a}-{c}", lambda a, c: f"{a}/{c}", lambda a, c: f"{a}_{len(c) * 7 % 100}", lambda a, c: f"{a}.{c}", lambda a, c: f"{a.upper()}_{c.upper()}", lambda a, c: f"{a}=/{c}{len(a)}"]
#: Letters, and the longest piece of a run of them that is a word.
_LETTERS, _LONGEST = np.zeros(256, bool), 24
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def identifier_pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of neighbouring characters in the words of texts (2 letters or more) and in identifiers made of neighbouring words, the i-th of a text by the i-th of ``_JOINS``, and so on around."""
    n = len(data)
    inside = _LETTERS[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    starts = np.flatnonzero(inside & (place % _LONGEST == 0))
    gone = np.concatenate(([0], np.cumsum(~inside)))
    stops = np.append(starts[1:], n) if len(starts) else starts
    text = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.minimum(stops, offsets[text + 1])
    ends = starts + np.minimum(stops - starts, _LONGEST)
    broken = gone[ends] - gone[starts] > 0  # what follows the letters of a word isn't in it
    after = np.flatnonzero(~inside)
    ends[broken] = after[np.searchsorted(after, starts[broken])]
    long = ends - starts > 1
    starts, ends, text = starts[long], ends[long], text[long]
    size, total = ends - starts, np.zeros(len(ALPHABET) ** 2)
    order = np.arange(len(starts)) - np.searchsorted(text, text)  # a word's number in its text
    joined = np.flatnonzero(text[1:] == text[:-1])  # words with another one after them
    kind = order[joined] % len(_JOINS)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        np.add(total, np.bincount(_CODES[x] * len(ALPHABET) + _CODES[y], minlength=len(total)), out=total)

    def letters(words: np.ndarray, change) -> None:
        """The pairs inside words, once changed."""
        many = size[words] - 1
        own = np.repeat(starts[words] - np.cumsum(many) + many, many) + np.arange(many.sum())
        opening = np.repeat(starts[words], many) == own
        add(*change(data[own], data[own + 1], opening))

    def upper(x: np.ndarray) -> np.ndarray:
        return x & 0xDF

    def lower(x: np.ndarray) -> np.ndarray:
        return x | 0x20

    def same(x, y, opening):
        return x, y

    letters(np.arange(len(starts)), same)
    letters(joined[(kind != 1) & (kind != 6)], same)
    letters(joined[(kind != 1) & (kind != 4) & (kind != 6)] + 1, same)
    letters(joined[kind == 1], lambda x, y, opening: (lower(x), lower(y)))
    letters(joined[kind == 1] + 1, lambda x, y, opening: (np.where(opening, upper(x), lower(x)), lower(y)))
    letters(joined[kind == 6], lambda x, y, opening: (upper(x), upper(y)))
    letters(joined[kind == 6] + 1, lambda x, y, opening: (upper(x), upper(y)))
    last, following = data[ends[joined] - 1], data[starts[joined + 1]]
    for k, sign in ((0, "_"), (2, "-"), (3, "/"), (5, ".")):
        own, sign = kind == k, np.full((kind == k).sum(), ord(sign), np.uint8)
        add(last[own], sign)
        add(sign, following[own])
    own = kind == 1
    add(lower(last[own]), upper(following[own]))
    own, sign = kind == 6, np.full((kind == 6).sum(), ord("_"), np.uint8)
    add(upper(last[own]), sign)
    add(sign, upper(following[own]))

    def number(before: np.ndarray, value: np.ndarray) -> None:
        tens, ones = (value // 10 + 48).astype(np.uint8), (value % 10 + 48).astype(np.uint8)
        add(before, np.where(value > 9, tens, ones))
        add(tens[value > 9], ones[value > 9])

    own, sign = kind == 4, np.full((kind == 4).sum(), ord("_"), np.uint8)
    add(last[own], sign)
    number(sign, size[joined[own] + 1] * 7 % 100)
    own, sign = kind == 7, np.full((kind == 7).sum(), ord("="), np.uint8)
    add(last[own], sign)
    add(sign, np.full(len(sign), ord("/"), np.uint8))
    add(np.full(len(sign), ord("/"), np.uint8), following[own])
    number(data[ends[joined[own] + 1] - 1], size[joined[own]])
    return total


def _identifier_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(ALPHABET) ** 2)
    for b in chunks(batches):
        total += identifier_pairs(*utf8(b.column("text")))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


@dataclass
class Markov:
    """The log-likelihood ratio of each pair of neighbouring characters, random against ordinary, and the cut on a string's mean."""

    ratios: np.ndarray
    cut: float = 0.0

    def ratio(self, word: str) -> float:
        x = _CODES[np.frombuffer(word.encode(), np.uint8)]
        return float(self.ratios[x[:-1], x[1:]].mean())


def fit(docs: DataFrame) -> Markov:
    """Two chains and the cut between them.

    Ordinary samples are the words of all ``docs``, of which only counts of character pairs
    reach the driver, and made-up names; the words weigh CORPUS_WEIGHT, however many
    there are.  Random samples are drawn.  The cut passes a share of FALSE of the names that
    the chains haven't seen.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    got = texts.mapInArrow(_identifier_pairs, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    ordinary = np.zeros(len(ALPHABET) ** 2)
    for r in got:
        ordinary[r["pair"]] = r["n"]
    ordinary *= CORPUS_WEIGHT / max(ordinary.sum(), 1.0)
    joined = [f(a, c) for i, (a, c) in enumerate(zip(ORDINARY, ORDINARY[1:] + ORDINARY[:1], strict=True)) for f in _JOINS]
    names, runs = ordinary_strings(), [c * 500 for c in ALPHABET]
    ordinary = ordinary.reshape(len(ALPHABET), -1) + 5 * pairs(joined + names[::2] + runs)
    logs = []
    for counts in (pairs(random_strings()), ordinary):
        smooth = counts + 0.5
        logs.append(np.log(smooth / smooth.sum(axis=1, keepdims=True)))
    model = Markov(logs[0] - logs[1])
    model.cut = max(0.0, float(np.quantile([model.ratio(x.strip(_EDGES)) for x in names[1::2] if len(x.strip(_EDGES)) >= SHORTEST], 1 - FALSE)))
    return model


def finder(model: Markov) -> Callable[[str], list[tuple[str, int, int, int]]]:
    """A function from a text to all its spans: kind, start, end and the start of what is secret in it."""

    def values(text: str) -> list[tuple[str, int, int, int]]:
        out = [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
        taken = sorted((a, b) for _, a, b, _ in out)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max, initial=0))
        for m in _CANDIDATE.finditer(text):
            word = m[0].strip(_EDGES)
            if len(word) >= SHORTEST and reach[bisect_left(starts, m.end())] <= m.start() and model.ratio(word) > model.cut:
                out.append(("random", m.start(), m.end(), m.start()))
        return out

    return values


def secret_spans(docs: DataFrame, model: Markov) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of ``docs``.

    assign, access and hex are the leftmost non-overlapping matches of their patterns that
    are long enough; random are other runs of key characters that the model prefers as
    random.  Spans are kind:start:end in code points, by start, then kind; base_sha256 is
    over the first three kinds.  Null texts are empty; texts of any length are searched
    whole; of spans with one start, those of the kind listed first come first, and a ratio
    just at the cut is no hit.  Repeated rows are searched each for itself, a null doc_id
    stays null, other columns are ignored; an empty table gives an empty result.
    """

    def make():
        values = finder(model)
        return lambda text: [(k, a, b) for k, a, b, _ in values(text)]

    return span_table(docs, make, BASE, EXTRA, by_start=True)


def masked(docs: DataFrame, model: Markov, mask: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with the value of each secret in ``text`` replaced, and n_chars to match, if present.

    Null texts stay null, empty ones empty; all rows and columns stay, repeated rows and those
    with a null doc_id are masked each for itself, texts of any length whole, overlapping
    values once; an empty table gives an empty result.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = finder(model)
        for b in chunks(batches):
            out = []
            for text in b.column("text").to_pylist():
                if text is not None:
                    done, parts = 0, []
                    for start, end in sorted((v, e) for _, _, e, v in values(text)):
                        if start >= done:
                            parts += [text[done:start], mask]
                        done = max(done, end)
                    text = "".join(parts) + text[done:]
                out.append(text)
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            changed = pa.array(out, pa.string())
            if "n_chars" in cols:
                keep = pa.compute.is_null(cols["n_chars"])
                sizes = pa.array([None if t is None else len(t) for t in out], pa.int64())
                same = pa.compute.equal(changed, cols["text"].cast(pa.string()))
                cols["n_chars"] = pa.compute.if_else(pa.compute.or_(keep, pa.compute.fill_null(same, True)), cols["n_chars"], sizes.cast(cols["n_chars"].type))
            cols["text"] = changed
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, schema)
