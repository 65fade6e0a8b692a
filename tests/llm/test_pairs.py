"""Near-duplicates, repeated bytes and decontamination against brute force."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tests.llm.conftest import ODD_TEXTS, prose

from lodestar.llm.decontaminate import LEAST, MASKS, SHORT, SHORT_MASKS, WINDOW, contaminated
from lodestar.llm import near_dedup, suffix_dedup
from lodestar.llm.near_dedup import near_duplicates, sketch
from lodestar.llm.suffix_dedup import SPAN, repeated_bytes


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def brute_components(rows, width):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(zip((i for i, _ in rows), sets, strict=True), 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize(("width", "block"), [(2, 256), (5, 256), (2, 2)])
def test_near_duplicates(frame, width, block):
    base, hub = prose(10, 200), prose(11, 120)
    texts = [base, *(edited(base, k, k) for k in range(0, 24, 2)), *(edited(hub, 3, 90 + k) for k in range(25)), hub, hub.upper(), prose(12, 50), "one", "ONE", "", None, "a b"]
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    rows = list(zip(order, texts, strict=True))
    want, sets = brute_components(rows, width)
    got = {r["doc_id"]: r for r in near_duplicates(frame(texts, order), width, block=block).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert {i: got[i]["n_shingles"] for i in order} == {i: len(s) for (i, _), s in zip(rows, sets, strict=True)}


def test_documents_of_several_texts(frame):
    """Texts of one doc_id, here with equally many shingles, link whatever they are linked with."""
    a, b, c = prose(70, 60), prose(71, 60), prose(72, 60)
    rows = [(1, a), (2, b), (5, edited(a, 1, 1)), (5, edited(b, 1, 2)), (7, c), (7, edited(b, 1, 3)), (8, c), (9, prose(73, 60))]
    want, _ = brute_components(rows, 2)
    assert want == {1: 1, 2: 1, 5: 1, 7: 1, 8: 1, 9: 9}
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame([t for _, t in rows], [i for i, _ in rows]), 2).collect()} == want


def test_common_counts():
    r = random.Random(4)
    for k in range(1, 9):
        sets = [sorted(r.sample(range(40), r.randint(0, 20))) for _ in range(k)]
        got = near_dedup._common(np.array([x for s in sets for x in s], np.int64), np.repeat(np.arange(k), [len(s) for s in sets]), k, np.arange(k))
        assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(k) for j in range(k) if i != j)


def test_near_duplicates_odd(odd, frame):
    rows = near_duplicates(odd, 5).collect()
    assert len(rows) == odd.count()
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert {r["component_id"] for r in rows if r["doc_id"] in (12, 13)} == {3}  # row 3 has the same text once more
    assert near_duplicates(frame([]), 5).count() == 0


def test_every_coordinate_fills():
    for n in (1, 2, 7, 1000):
        s = sketch([np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    s = sketch([a * np.uint64(7919), b * np.uint64(7919)])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def brute_bytes(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - SPAN + 1):
                w = t[p : p + SPAN]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - SPAN + 1):
                if first[t[p : p + SPAN]] < i:
                    gone[p : p + SPAN] = b"\1" * SPAN
        out.append((i, len(t), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("together", [2, 4096])
def test_repeated_bytes(frame, together):
    shared, line = prose(20, 30), "All rights reserved by the honourable company of examples and samples.\n"
    texts = [prose(21, 60), prose(22, 10) + shared + prose(23, 10), shared[20:] + prose(24, 20), line + prose(25, 20), prose(26, 20) + line, line + line, prose(21, 60), "-" * 400, "-" * 170 + "x", "é" * 40 + shared[:60], shared[:49], shared[:50], "", None, *(prose(30 + k, 5) + line + prose(60 + k, 5) for k in range(12))]
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    got = sorted((tuple(r) for r in repeated_bytes(frame(texts, ids), together).collect()), key=str)
    assert got == brute_bytes(list(zip(ids, texts, strict=True)))


def test_repeated_bytes_odd(odd, frame):
    got = sorted((tuple(r) for r in repeated_bytes(odd).collect()), key=str)
    assert got == brute_bytes([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert repeated_bytes(frame([])).count() == 0


def test_contaminated(spark, frame):
    items = [prose(40, 15), prose(41, 40), prose(42, 25), "too short", None, prose(43, 8)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[0].split()
    three = " ".join("zz" if i in (3, 7, 11) else x for i, x in enumerate(w))
    four = " ".join("zz" if i in (2, 5, 8, 11) else x for i, x in enumerate(w))
    half = " ".join(items[1].split()[10:30])
    texts = [prose(50, 80), prose(51, 20) + " " + items[0].upper() + ". " + prose(52, 20), three, four, prose(53, 9) + " " + half, items[5], "", None, items[2][: len(items[2]) // 3]]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(texts), bench).collect()}
    assert got == {(1, 0), (2, 0), (4, 1), (5, 5)}
    row = contaminated(frame(texts), bench).where("doc_id = 2").first()
    assert (row["matched"], row["item_tokens"], row["doc_at"]) == (12, 15, 0)


def test_masks_hit_every_admitted_alignment():
    for n in range(LEAST, WINDOW + 1):
        masks = MASKS + SHORT_MASKS if n <= SHORT else MASKS
        for changed in combinations(range(n), n - math.ceil(0.8 * n)):
            assert any(not set(changed) & {i + o for o in m} for m in masks for i in range(n - m[-1])), (n, changed)


def test_contaminated_short_items(spark, frame):
    five, ten, four = prose(60, 5), prose(61, 10), prose(62, 4)
    bench = spark.createDataFrame([(5, five), (10, ten), (4, four)], "item_id long, text string")

    def changed(text, places):
        return " ".join("zz" if i in places else x for i, x in enumerate(text.split()))

    texts = [f"{prose(63, 6)} {t} {prose(64, 6)}" for t in (changed(five, {0}), changed(five, {2}), changed(five, {4}), changed(five, {1, 2}), changed(ten, {4, 5}), changed(ten, {4, 5, 6}), four)]
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(frame(texts), bench).collect()} == {(0, 5), (1, 5), (2, 5), (4, 10)}


def test_contaminated_odd(odd, spark):
    bench = spark.createDataFrame([(1, ODD_TEXTS[12]), (None, ODD_TEXTS[12]), (3, "")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in contaminated(odd, bench).collect()]
    assert sorted(got, key=str) == sorted([(i, k) for i in (12, 13, 3) for k in (1, None)], key=str)
    assert contaminated(odd.limit(0), bench).count() == 0
    assert contaminated(odd, bench.limit(0)).count() == 0


def test_contaminated_runs_no_python(frame, spark):
    bench = spark.createDataFrame([(1, prose(40, 20))], "item_id long, text string")
    plan = contaminated(frame([prose(40, 20)]), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_a_text_of_too_many_segments_is_an_error(monkeypatch):
    batch = pa.RecordBatch.from_pylist([{"d": 5, "h1": 1, "h2": 2, "zip": zstandard.compress(b" ".join(b"word%d" % k for k in range(200)))}])
    assert sum(len(b) for b in suffix_dedup._anchor_rows(iter([batch]))) > 3
    monkeypatch.setattr(suffix_dedup, "_SHARED", 2)
    with pytest.raises(ValueError, match="document 5"):
        list(suffix_dedup._anchor_rows(iter([batch])))
