import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


ODD_TEXTS = [None, "", " ", "\n\t ", "x", "é", "a" * 5000, "ab " * 3000, "word", "\x00\x1c  z", "İ Σ ſ K", "🙂 🙂", prose(1, 400), prose(1, 400), prose(2, 30) + "\n" + prose(2, 30)]


@pytest.fixture
def frame(spark):
    """A documents table of texts, with ids 0, 1, ... or as given."""

    def make(texts, ids=None, **more):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, None, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def odd(frame):
    """Null, empty, blank, long and repeated texts, a null id and a repeated row, with a clashing extra column."""
    df = frame([*ODD_TEXTS, "no id here", prose(1, 400)], [*range(len(ODD_TEXTS)), None, 3])
    from pyspark.sql import functions as F

    return df.unionByName(df.where("doc_id = 12")).withColumn("label", F.lit("x")).withColumn("n", F.lit(1)).withColumn("h1", F.lit(None).cast("string"))


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, label int")

    return make
