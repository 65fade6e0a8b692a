"""Personal data and secrets against plain regular expressions."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import pii, secrets


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.2@+ -()9%_é:/4", max_size=60))
def test_pii_equals_its_patterns(text):
    find = test_pii_equals_its_patterns.find = getattr(test_pii_equals_its_patterns, "find", None) or pii.finder()
    order = {k: i for i, k in enumerate(pii.BASE)}
    got = sorted((s for s in find(text) if s[0] in order), key=lambda s: (order[s[0]], s[1]))
    assert got == brute_pii(text)


def test_pii_additions():
    found = {(k, t) for text in ("IBAN: GB82 WEST 1234 5698 7654 32.", "ssh://root:pw@host.example/x", "account no. 12345678 then", "IBAN GB82 WEST 1234 5698 7654 33") for k, a, b in pii.finder()(text) if k in pii.EXTRA for t in [text[a:b]]}
    assert found == {("account", "GB82 WEST 1234 5698 7654 32"), ("address", "ssh://root:pw@host.example/x"), ("account", "12345678")}


def brute_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, e) for a, _, k, e in sorted(out)]


@pytest.fixture(scope="module")
def model(spark):
    from tests.llm.conftest import SCHEMA, prose

    return secrets.fit(spark.createDataFrame([(i, prose(i, 200) + " the quick brown fox jumped over lazy dogs", None, None, None) for i in range(40)], SCHEMA))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apiKEY", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "ſecret", "é", "x"]), max_size=14))
def test_secrets_equal_their_patterns(model, parts):
    text = "".join(parts)
    base = sorted((a, secrets.BASE.index(k), k, b) for k, a, b, _ in secrets.finder(model)(text) if k in secrets.BASE)
    assert [(k, a, b) for a, _, k, b in base] == brute_secrets(text)


def test_random_strings_are_told_from_identifiers(model):
    """At least 0.9 of random strings of every alphabet, letters only too, and few ordinary names, none of which the model has seen."""
    values = secrets.finder(model)
    drawn = [w.strip("=-_/+") for w in secrets.random_strings(700, seed=99)]
    hits = {k: [any(values(f"see {w} there")) for w in drawn[k::7] if len(w) >= secrets.SHORTEST] for k in range(7)}
    assert all(np.mean(h) >= 0.9 for h in hits.values()), {k: np.mean(h) for k, h in hits.items()}
    names = [w for w in secrets.ordinary_strings(1000, seed=98) if len(w.strip("=-_/+")) >= secrets.SHORTEST]
    assert np.mean([any(k == "random" for k, *_ in values(w)) for w in names]) < 0.02
    usual = ["configuration_handler_2_default", "the-quick-brown-fox-jumped-over-2-dogs", "src/alpha/beta/gamma/delta/file2", "iota_kappa_lambda_omicron_7", "2024-01-15T10-30-00Z-log", "ISO-8859-1-to-UTF-8-converter", "internationalization-and-localization", "zzzzzzzzzzzzzzzzzzzzzzzz"]
    assert not any(values(w) for w in usual)


def test_long_hostile_texts(model):
    """Millions of characters of what anchors and patterns look for, in linear time."""
    find, values = pii.finder(), secrets.finder(model)
    assert [s for s in find("0" * 5000 + ".1.1.1") if s[0] == "ip"] == [("ip", 0, 5006)]
    assert [s for s in find("1" * 5000 + ".1.1.1") if s[0] == "ip"] == []
    for text in ("0123456789" * 200_000, "a@" * 1_000_000, "@" * 2_000_000, "+1 " * 500_000, "1.1." * 500_000, "http://a:b" * 200_000):
        began = time.process_time()
        find(text)
        assert time.process_time() - began < 20
    for text in (("0a" * 20 + " AKIA" + "Q7" * 20 + " ") * 20_000, "token=" * 200_000, "x" * 2_000_000):
        began = time.process_time()
        values(text)
        assert time.process_time() - began < 20


def test_span_tables(odd, frame, model):
    for out, brute, base in ((pii.personal_data(odd), brute_pii, pii.BASE), (secrets.secret_spans(odd, model), brute_secrets, secrets.BASE)):
        rows = out.collect()
        assert len(rows) == odd.count()
        assert sum(r["doc_id"] is None for r in rows) == 1
    texts = ["mail a@b.co and token = abcdef12", None, "", "+1 (555) 123-4567 password: 'hunter2x'"]
    got = {r["doc_id"]: r for r in secrets.secret_spans(frame(texts), model).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_secrets(t or "")).encode()).hexdigest()
    assert pii.personal_data(frame([])).count() == 0


def test_masked(frame, model):
    random.seed(1)
    got = {r["doc_id"]: r for r in secrets.masked(frame(["token = abcdef12 end", None, "clean text"]), model).collect()}
    assert got[0]["text"] == "token = [secret] end" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] is None and got[2]["text"] == "clean text" and got[2]["n_chars"] == 10


def test_pairs_of_all_documents(frame):
    """The chains are learnt from all documents, however many: their own counts, and the same model from twice the documents."""
    import random
    import re

    import numpy as np

    r = random.Random(3)
    texts = ["", "a", "ab", "one two é x yy", "q" * 49 + " rest", "k" * 24 + "m"] + ["".join(r.choice("abCD ef GHI.é1_zzz") for _ in range(r.randrange(60))) for _ in range(2300)]
    data = [t.encode() for t in texts]
    want = np.zeros((len(secrets.ALPHABET),) * 2)
    for text in texts:
        words = re.findall(r"[A-Za-z]{2,24}", text)
        want += secrets.pairs(words + [secrets._JOINS[i % 8](a, c) for i, (a, c) in enumerate(zip(words, words[1:], strict=False))])
    got = secrets.identifier_pairs(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
    assert (got == want.reshape(-1)).all()
    once, twice = secrets.fit(frame(texts)), secrets.fit(frame(texts + texts))
    assert np.allclose(once.ratios, twice.ratios) and abs(once.cut - twice.cut) < 1e-9
