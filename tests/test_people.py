"""Similarities, blocking, components and the rules over people."""

import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar import queries
from lodestar.functions import joins
from lodestar.functions import similarity as sim
from lodestar.functions.graph import components
from lodestar.operators import entity
from lodestar.plans.run import run_checks

PEOPLE = [("Juan Perez", "1012345678", "1990-05-01"), ("Juan Peres", "1012345679", "1990-05-02"), ("Jaun Perez", "1012345670", "1990-05-03"), ("Maria Lopez", "2098765432", "1985-03-10"), ("Maria Lopes", "2098765431", "1985-03-11"), ("Carlos Ruiz", "3055555555", "1970-12-12"), ("Carlos Ruiz", "3055555555", "1970-12-12"), ("Ana Diaz", "4011111111", "1995-07-07"), (None, None, None)]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=70), st.text("abcd", max_size=70))
def test_common_subsequence(a, b):
    assert sim.common(a, b) == lcs(a, b) == sim.common(b, a)


def test_similarities():
    assert sim.normalised("  José   ÁLVAREZ ") == "jose alvarez"
    assert sim.name_similarity("Perez Juan", "juan perez") == 1
    assert sim.indel("1012345678", "1012345679") == 0.9
    assert sim.id_similarity("A-123", "B-123") < sim.id_similarity("A-123", "A-124")
    assert sim.name_similarity("", "x") == 0
    assert 0.85 < sim.weighted("juan perez", "juan peres") < 1
    for a, b in combinations(["juan", "juan perez lopez", "perez", "x", "maria de la o"], 2):
        assert 0 <= sim.weighted(a, b) <= 1 and abs(sim.weighted(a, b) - sim.weighted(b, a)) < 1e-9


def test_bounded_similarity_keeps_what_reaches_the_bound(spark):
    names = ["juan perez", "perez juan", "juan peres", "ana diaz", "diego ruiz", "maria de la o", "o maria", "juana", "José Pérez", None, ""]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for kind in ("name", "id", "text", "sorted"):
        rows = pairs.select("a", "b", sim.similarity(kind)("a", "b").alias("x"), sim.similarity(kind, 0.7)("a", "b").alias("y")).collect()
        assert all((r["x"] is None) == (r["y"] is None) for r in rows)
        assert all(r["x"] == r["y"] or (r["y"] == 0 and r["x"] < 0.7) for r in rows if r["x"] is not None)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 200), (200, 150), (5, 5), (300, 39)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 300: 21, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rules_over_people(spark):
    df = spark.createDataFrame(PEOPLE, "nombre string, cedula string, fecha_nacimiento string")
    report = run_checks(df, "similar_dob,fuzzy_id_match,fuzzy_name_match,person_composite_similarity,personas_similares")
    got = {f.rule_name: f for f in report.findings}
    assert not any(f.errored for f in report.findings), [f.details for f in report.findings]
    dob = got["similar_dob"]
    assert (dob.failed, dob.total, dob.details[0]["groups"]) == (5, 9, 2)
    ids = got["fuzzy_id_match"]
    assert (ids.failed, ids.details[0]["groups"]) == (5, 2)
    assert got["fuzzy_name_match"].details[0]["groups"] == 2
    assert got["person_composite_similarity"].failed >= 4
    assert got["personas_similares"].details[1]["field_means"].keys() == {"name", "id", "dob"}


def test_chosen_columns(spark):
    df = spark.createDataFrame(PEOPLE, "nombre string, cedula string, fecha_nacimiento string")
    for mode in ("rapido", "profundo"):
        f = run_checks(df, "personas_similares", {"personas_similares": {"mode": mode, "columns": ["nombre", "cedula"], "threshold": 0.85}}).findings[0]
        assert not f.errored and f.failed == 5
    f = run_checks(df, "personas_similares", {"personas_similares": {"mode": "profundo", "threshold": 0.8, "max_block": None}}).findings[0]
    assert f.failed >= 4


def test_no_people(spark):
    report = run_checks(spark.range(3).selectExpr("id as x"), "grupo:personas")
    assert all(f.passed and not f.errored for f in report.findings)


def crowd(n, seed=5):
    """People of one block, some without a date or a document, and one in ten nearly the same as an earlier one."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and i % 10 == 0:
            name, number, day = r.choice(out)
            out.append((name + r.choice("aeiou"), number and number[:-1] + str(r.randrange(10)), day))
        else:
            name = "m" + "".join(r.choice("abcdefghij") for _ in range(9))
            out.append((name, None if i % 13 == 0 else str(r.randrange(10**9, 10**10)), None if i % 17 == 0 else "nothing" if i % 19 == 0 else f"19{60 + i % 40}-0{1 + i % 9}-1{i % 7}"))
    return out


def test_candidates_of_a_large_block_are_whole(spark):
    people = crowd(250)
    df = spark.createDataFrame([(str(i), "m", *p) for i, p in enumerate(people)], "node string, block string, name string, id string, dob string")
    weights = {f: entity.COMPOSITE[f] for f in ("name", "id", "dob")}
    for least in (0.9, 0.6):
        links = lambda pairs, least=least: {(r["node_a"], r["node_b"]): r["sim"] for r in entity.composite(pairs, weights, "levenshtein").where(f"sim >= {least}").collect()}
        everything = links(df.alias("a").selectExpr(*(f"{c} as {c}_a" for c in df.columns if c != "block")).crossJoin(df.selectExpr(*(f"{c} as {c}_b" for c in df.columns if c != "block"))).where("node_a < node_b"))
        assert links(entity.near_pairs(df, weights, least, method="levenshtein")) == everything
        assert len(everything) > 10


def test_similar_people_of_a_large_block(spark):
    """No row of a block is left out, unless a cut is asked for."""
    strangers = [(f"m{i:04d}" * 3, str(10**9 + 7919 * i), f"19{60 + i % 40}-0{1 + i % 9}-1{i % 7}") for i in range(600)]
    twins = [("mzzz zorrilla", "9912345678", "1999-03-01"), ("mzzz zorrila", "9912345679", "1999-03-02")]
    df = spark.createDataFrame([*strangers, *twins], "nombre string, cedula string, fecha_nacimiento string")
    for mode in ("rapido", "profundo"):
        f = run_checks(df, "personas_similares", {"personas_similares": {"mode": mode, "threshold": 0.9}}).findings[0]
        assert any("zorrilla" in (r["value"] or "") for r in f.failures.collect())
    f = run_checks(df, "personas_similares", {"personas_similares": {"columns": ["nombre", "cedula"], "threshold": 0.9}}).findings[0]
    assert any("zorrilla" in (r["value"] or "") for r in f.failures.collect())


def test_composite_links_over_all_people(spark, tmp_path):
    """Against all pairs of the whole table, in both forms of the query."""
    spark.range(700).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    p = queries.source(spark, str(tmp_path), "people_d").selectExpr("concat_ws('|', nombre, cedula, fecha_nacimiento) as node", "left(nombre, 1) as block", "nombre as name", "cedula as id", "fecha_nacimiento as dob").distinct()
    for name, method, least in (("q_composite_links", "levenshtein", 0.7), ("q_composite_links_all", "indel", 0.8)):
        scored = entity.composite(entity.blocked_pairs(p), {f: entity.COMPOSITE[f] for f in ("name", "id", "dob")}, method)
        want = sorted(tuple(r) for r in scored.where(f"sim >= {least} and sim < 1").selectExpr("name_a", "name_b", "id_a", "id_b", "round(sim, 3)").collect())
        got = sorted((r["na"], r["nb"], r["ca"], r["cb"], r["sim"]) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == want and len(got) > 100


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return 1 - row[-1] / max(len(a), len(b))


def test_close_pairs_miss_none(spark):
    """Candidates against all pairs: edits, changed order, added, joined, repeated and one-letter words."""
    r = random.Random(5)
    syllables = "ma ri a lo pez gar ci ana juan car los pe dro san chez ro dri guez li na be to".split()

    def edited(text):
        i, kind = r.randrange(len(text) + 1), r.random()
        return text[:i] + r.choice("abcxyz é") + text[i:] if kind < 0.4 else text[:i] + text[i + 1 :] if kind < 0.8 else " ".join(r.sample(text.split(), len(text.split())))

    values = {"ana maria maria maria", "ana maria constantino", "j p", "jo p", "a", "b", "aaaa aaaa", "aaa aaaa", "maria", "maria lopez garcia sanchez"}
    for _ in range(60):
        text = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4)))
        values.add(text)
        for _ in range(r.randint(0, 3)):
            values.add(text := edited(text))
    values = sorted(v for v in values if v.strip())
    df = spark.createDataFrame([(v, "k") for v in values], "node string, block string")
    for kind, method, least in (("name", "indel", 0.88), ("name", "indel", 0.8), ("id", "indel", 0.7), ("name", "levenshtein", 0.88)):
        measure = levenshtein if method == "levenshtein" else sim.KINDS[kind]
        got = {(x["node_a"], x["node_b"]) for x in entity.close_pairs(df, kind, method, least).select("node_a", "node_b").collect()}
        assert {(a, b) for a, b in combinations(values, 2) if measure(a, b) >= least} <= got
        assert all(a < b for a, b in got)


def test_close_pairs_of_a_large_block(spark):
    """Of thousands of names in one block, only a small share of the pairs is made."""
    r = random.Random(6)
    names = sorted({f"{''.join(r.choices('aeioulnrst', k=6))} {''.join(r.choices('bcdfgmpvz', k=2))}{''.join(r.choices('aeiou', k=2))}{i % 997}" for i in range(3000)})
    pairs = entity.close_pairs(spark.createDataFrame([(n, "m_") for n in names], "node string, block string"), "name", "indel", 0.88).count()
    assert pairs < 0.03 * len(names) * (len(names) - 1) / 2


def test_many_large_blocks_are_shuffled(spark, monkeypatch):
    """Blocks over the split are sent to all executors only while they are few; pairs are the same."""
    rows = spark.range(600).select(F.col("id").cast("string").alias("node"), (F.col("id") % 2).alias("block"))
    monkeypatch.setattr(entity, "SPLIT", 40)
    pairs = lambda: {tuple(r) for r in entity._meeting(rows, rows).select("node_a", "node_b").collect()}
    few = pairs()
    monkeypatch.setattr(entity, "small", lambda df: joins.small(df, 1))
    assert pairs() == few and len(few) == 2 * 300 * 299 // 2


def strangers(n, seed):
    """Names of two words of a stock that grows with them, in one block, and numbers; one in ten like an earlier one."""
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 10))) for _ in range(n)]
    out = []
    for i in range(n):
        if out and i % 10 == 0:
            name, own, day = r.choice(out)
            at = r.randrange(len(name))
            own = own and (own[:3] + r.choice("0123456789") + own[4:] if r.random() < 0.5 else own[:-1])
            out.append((name[:at] + r.choice("aeiou") + name[at + r.randrange(2) :], own, day if r.random() < 0.5 else None))
        else:
            out.append(("m" + r.choice(stock) + " " + r.choice(stock), None if i % 23 == 0 else str(r.randrange(10**9, 10**10)), None if i % 3 == 0 else f"19{60 + i % 40}-0{1 + i % 9}-1{i % 7}"))
    return out


def all_pairs(df):
    side = lambda end: df.selectExpr(*(f"{c} as {c}_{end}" for c in df.columns if c != "block"))
    return side("a").crossJoin(side("b")).where("node_a < node_b")


@settings(max_examples=200, deadline=None)
@given(st.text("0123", max_size=9), st.text("0123", max_size=9), st.sampled_from([0.7, 0.75, 0.8, 0.9]))
def test_similar_numbers_share_a_subsequence(a, b, least):
    """Whatever is as similar as the bound meets at a subsequence of the length that both lengths give."""
    import math

    def parts(t, share):
        n = len(t)
        spare = n - max(1, math.ceil(share * n - 1e-9))
        return {"".join(t[i] for i in range(n) if i not in gone) for k in range(spare + 1) for gone in combinations(range(n), k)} if n else set()

    if sim.indel(a, b) >= least and a and b:
        needed = math.ceil((len(a) + len(b)) * least / 2 - 1e-9)
        assert any(len(p) == needed for p in parts(a, least / (2 - least)) & parts(b, least / (2 - least)))


@pytest.mark.parametrize(("method", "least", "weights"), [("indel", 0.8, {"name": 0.4, "id": 0.35, "dob": 0.25}), ("levenshtein", 0.8, {"name": 0.4, "id": 0.35, "dob": 0.25}), ("indel", 0.8, {"name": 0.4, "id": 0.35}), ("indel", 0.82, {"name": 0.3, "id": 0.25, "dob": 0.15}), ("indel", 0.9, {"name": 0.3, "id": 0.25, "dob": 0.05})])
def test_people_without_dates_meet_by_names_and_numbers(spark, method, least, weights):
    """The same links as over all pairs, where dates are missing, not there at all, or of little weight."""
    people = strangers(130, 7) + [("mpepe gil", "123", None), ("mpepe gil", "1230", None), ("m", "1", None), ("mé gil", None, None), ("me gil", "", None), ("mx y", "12345678901234567890", None), ("mx y", "12345678901234567891", None)]
    df = spark.createDataFrame([(str(i), "m", *p) for i, p in enumerate(people)], "node string, block string, name string, id string, dob string")
    df = df.select("node", "block", *weights)
    assert entity.part_bounds(weights, least, [f for f in weights if f == "dob" and entity.days_apart(weights, least, 3) is None])
    links = lambda pairs: {(r["node_a"], r["node_b"]): r["sim"] for r in entity.composite(pairs, weights, method).where(f"sim >= {least}").collect()}
    made = entity.near_pairs(df, weights, least, method=method)
    want = links(all_pairs(df))
    assert links(made) == want and len(want) > 6
    assert made.count() == made.select("node_a", "node_b").distinct().count() < 137 * 136 // 2 // 4


def test_pairs_of_a_large_block_grow_with_its_rows(spark):
    """Not with their square: four times the people of one block make at most some seven times the pairs."""
    weights = {"name": 0.4, "id": 0.35, "dob": 0.25}
    made = []
    for n in (500, 2000):
        people = [(name, number, None) for name, number, _ in strangers(n, 3) if number]
        df = spark.createDataFrame([(str(i), "m", *p) for i, p in enumerate(people)], "node string, block string, name string, id string, dob string")
        made.append(entity.near_pairs(df, weights, 0.8).count())
    assert made[0] > 45 and made[1] < 7 * made[0] and made[1] < 0.001 * 2000 * 1999 / 2


def test_rows_of_a_large_block_are_repeated_for_cells_only(spark, monkeypatch):
    """Pairs of a block are cells of a square, sent to tasks by a shuffle; neither side is broadcast whole."""
    monkeypatch.setattr(entity, "SPLIT", 30)
    rows = spark.range(100).select(F.col("id").alias("node"), F.lit("m").alias("block"))
    met = entity._meeting(rows, rows)
    assert sorted(tuple(r) for r in met.collect()) == [(a, b) for a in range(100) for b in range(a + 1, 100)]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


def test_each_pair_of_similar_people_is_scored_once(spark, monkeypatch):
    """However many blocks two people share, and for all that is made of their links."""
    scored, near = spark.sparkContext.accumulator(0), entity.near_pairs

    def counted(rows, *args):
        @F.udf("long")
        def seen(x):
            scored.add(1)
            return x

        return near(rows, *args).withColumn("keys_a", F.when(seen.asNondeterministic()("node_a").isNotNull(), F.col("keys_a")))

    monkeypatch.setattr(entity, "near_pairs", counted)
    rows = [(f"maria lopez{i % 5}", str(1012345000 + i), f"1990-05-1{i % 3}") for i in range(40)]
    f = run_checks(spark.createDataFrame(rows, "nombre string, cedula string, fecha_nacimiento string"), "personas_similares", {"personas_similares": {"mode": "profundo", "threshold": 0.8}}).findings[0]
    assert not f.errored, f.details
    assert len(f.failures.collect()) == 40
    shared = sum((a[1][:-1] == b[1][:-1]) + 2 for a, b in combinations(rows, 2))  # by name, year and perhaps number
    assert 40 * 39 // 2 < scored.value <= shared


def test_undated_people_meet_as_values_that_reach_the_threshold(spark):
    """Names alike and numbers far apart make no pairs of rows; and the links are those of all pairs."""
    r = random.Random(8)
    people = [(str(i), "m", f"maria lopez{i % 10}", str(r.randrange(10**9, 10**10)), None) for i in range(300)]
    people += [(f"x{i}", "m", "maria lopez1", "1234567890" if i % 2 else "1234567891", None if i < 4 else "1990-01-01") for i in range(6)]
    df = spark.createDataFrame(people, "node string, block string, name string, id string, dob string")
    weights = entity.MODES["rapido"]
    for method in ("levenshtein", "indel"):
        links = lambda pairs, method=method: {(x["node_a"], x["node_b"]): x["sim"] for x in entity.composite(pairs, weights, method).where("sim >= 0.88").collect()}
        made = entity.near_pairs(df, weights, 0.88, method=method)
        assert made.count() < 100  # 46,665 pairs have similar names
        assert links(made) == links(all_pairs(df)) and len(links(made)) >= 15


def test_people_meet_within_days_or_by_names_and_numbers_alone(spark):
    """Where a birth date helps but isn't needed, few of a block's pairs are made, and the links are those of all pairs."""
    people = [(name, number, day or f"19{60 + i % 40}-0{1 + i % 9}-1{i % 7}") for i, (name, number, day) in enumerate(strangers(300, 11)) if number]
    people += [("mana lopez", "1234567890", "1990-01-01"), ("mana lopez", "1234567890", "1970-05-05"), ("mana lopes", "1234567890", "1970-05-07"), ("", "1234567890", "1970-05-08"), ("mana lopez", "", "1980-05-08")]
    weights = {f: entity.COMPOSITE[f] for f in ("name", "id", "dob")}
    frame = lambda rows: spark.createDataFrame([(str(i), "m", *p) for i, p in enumerate(rows)], "node string, block string, name string, id string, dob string")
    assert entity.days_apart(weights, 0.7, 3) is None and not entity.part_bounds(weights, 0.7, ["dob"])
    for method in ("levenshtein", "indel"):
        links = lambda pairs, method=method: {(x["node_a"], x["node_b"]): x["sim"] for x in entity.composite(pairs, weights, method).where("sim >= 0.7").collect()}
        df = frame(people)
        made = entity.near_pairs(df, weights, 0.7, method=method)
        assert links(made) == links(all_pairs(df)) and len(links(made)) > 10
        assert made.count() == made.select("node_a", "node_b").distinct().count() < len(people) ** 2 // 20
        some = frame([(name, number, None if i % 9 == 0 else day) for i, (name, number, day) in enumerate(people)])
        assert links(entity.near_pairs(some, weights, 0.7, method=method)) == links(all_pairs(some))
