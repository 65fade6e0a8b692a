"""The corpus operators as registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import quality_classifier, quality_rules, secrets, toxicity
from lodestar.llm.common import spread, table, training_labels
from lodestar.llm.decontaminate import contaminated
from lodestar.llm.divergence import divergences
from lodestar.llm.html_text import extracted
from lodestar.llm.lexical_search import indexed, ranked
from lodestar.llm.lm_scoring import language_scores
from lodestar.llm.near_dedup import near_duplicates
from lodestar.llm.packing import packed
from lodestar.llm.pii import personal_data
from lodestar.llm.suffix_dedup import repeated_bytes



def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that operators read."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of all documents from their maximum-scoring segments."""
    docs = documents(spark, sf_dir)
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, training_labels(spark, sf_dir, "toxic")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by anchor expansion."""
    return personal_data(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a 50-byte string of an earlier document covers."""
    return repeated_bytes(documents(spark, sf_dir))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(spread(table(spark, sf_dir, "pages")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with 80 % of their two-word shingles in common."""
    return near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by patterns and Markov models."""
    docs = documents(spark, sf_dir)
    return secrets.secret_spans(docs, secrets.fit(docs))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, and the item."""
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of all documents from their compressed sizes."""
    docs = documents(spark, sf_dir)
    return quality_classifier.quality_scores(docs, quality_classifier.fit(docs, training_labels(spark, sf_dir, "quality")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of all documents and the isolation forest's verdict."""
    docs = documents(spark, sf_dir)
    return quality_rules.quality_verdicts(docs, quality_rules.fit(docs, training_labels(spark, sf_dir, "quality")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens, lexical neighbours together."""
    return packed(documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart."""
    return divergences(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return ranked(indexed(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under single words and under a trigram model."""
    return language_scores(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_near_dedup": op5_near_dedup,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_divergence": op11_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_lm_scoring": op13_lm_scoring,
}

# DuckDB SQL of the operators that decide by equality alone; the others learn models or pack greedily
# and are tested against plain versions, held-out labels and round trips.
ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100) x),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT w.doc_id, i, unnest(range(50)) AS k FROM w JOIN f USING (s) WHERE w.doc_id > m) x),
b AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d) y),
m AS (SELECT b.doc_id, b.p, b.x, gone.p IS NOT NULL AS g FROM b LEFT JOIN gone ON b.doc_id = gone.doc_id AND b.p = gone.p),
r AS (SELECT *, lag(g, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM m),
k AS (SELECT doc_id, count(*) FILTER (WHERE g) AS n_removed, count(*) FILTER (WHERE g AND NOT before) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT g), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, t[i] || ' ' || t[i + 1] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM w WHERE len(t) > 1) x UNION ALL SELECT doc_id, t[1] FROM w WHERE len(t) = 1) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS c FROM s GROUP BY g),
p AS (SELECT doc_id, g, n FROM (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY c, s.g) AS r FROM s JOIN df USING (g) JOIN n USING (doc_id)) z WHERE r <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM (SELECT c.a, c.b, na, nb, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY 1, 2, 3, 4) q WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT DISTINCT x, x FROM both_ways UNION SELECT both_ways.y, r.root FROM r JOIN both_ways ON both_ways.x = r.node),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.node = d.doc_id
""",
    "op7_decontamination": r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents), b AS (SELECT DISTINCT item_id, text FROM benchmark),
dt AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM d) x),
bt AS (SELECT item_id, n, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS k FROM (SELECT item_id, t, len(t) AS n FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM b) x WHERE len(t) >= 5) y),
m AS (SELECT doc_id, item_id, n, i - k AS shift, k FROM dt JOIN bt USING (t)),
c AS (SELECT doc_id, item_id, n, shift, count(*) AS matched FROM m GROUP BY ALL HAVING count(*) >= ceil(0.8e0 * least(n, 15))),
h AS (SELECT c.doc_id, c.item_id, c.n, c.shift, c.matched, a.k, count(*) AS inside FROM c JOIN m a ON a.doc_id = c.doc_id AND a.item_id = c.item_id AND a.shift = c.shift JOIN m z ON z.doc_id = c.doc_id AND z.item_id = c.item_id AND z.shift = c.shift AND z.k BETWEEN a.k AND a.k + least(c.n, 15) - 1 GROUP BY ALL),
g AS (SELECT doc_id, item_id, n, shift, matched FROM h GROUP BY ALL HAVING max(inside) >= ceil(0.8e0 * least(n, 15)))
SELECT doc_id, item_id, matched, CAST(n AS BIGINT) AS item_tokens, CAST(shift AS BIGINT) AS doc_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) AS r FROM g) x WHERE r = 1
""",
    "op11_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
x AS (SELECT lang, source, r, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM x JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, ln, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) q LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v) AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM o) z WHERE part = 'pair' OR r <= 50
""",
    "op12_lexical_search": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS dn, sum(len(t)) AS l FROM t WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, term, len AS n, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS len, unnest(t) AS term FROM t) x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(dn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * dn) // l)))) AS score FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM c WHERE score > 0) z WHERE k <= 10
""",
}
