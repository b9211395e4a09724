"""Text functions, sources, sinks and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as fx
from papyra.sources import readers, sinks
from papyra.streaming import incremental


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first()["x"]


def test_plain_functions(spark):
    assert one(spark, "A　b  c\n", fx.squeeze) == "A b c" and one(spark, " 　", fx.compact) == ""
    assert one(spark, "Ｆｕｌｌ ①", fx.search_key) == "full 1" and one(spark, None, fx.search_key) is None
    assert one(spark, "a😀", fx.utf16_units) == 3
    assert one(spark, " a \n \n\n b", fx.paragraphs) == ["a", "b"]
    for text, n in (("一", 1), ("十", 10), ("十二", 12), ("三十", 30), ("九十九", 99), ("百", None), ("", None), (None, None)):
        assert one(spark, text, fx.chinese_number) == n
    assert one(spark, "前，，后", lambda c: fx.suspicious_context(c, 1)) == "前，，"[:3]
    assert one(spark, "汉字ab", fx.han_share) == 0.5 and one(spark, "", fx.han_share) == 0


def test_answer_letters_refuse(spark):
    labels = F.array(*map(F.lit, "ABCD"))
    for value, single, want in (("C", True, ["C"]), ("D、A", False, ["A", "D"]), ("AB", True, None), ("AA", False, None), ("E", True, None), ("", True, None), (None, True, None), ("A或B", False, None)):
        assert one(spark, value, lambda c, s=single: fx.answer_letters(c, labels, F.lit(s))) == want, value


def test_similarity_equals_python(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abc 汉") for _ in range(rng.randint(0, 40))), "".join(rng.choice("abc 汉") for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", fx.containment(F.col("a"), F.col("b"), 3).alias("c"), fx.shingle_coverage(F.col("a"), F.col("b"), 4).alias("s")).collect()
    for r in got:
        a, b = r["a"], r["b"]
        ga, gb = {a[i : i + 3] for i in range(len(a) - 2)}, {b[i : i + 3] for i in range(len(b) - 2)}
        assert r["c"] == pytest.approx(1.0 if a in b else len(ga & gb) / max(1, len(ga)))
        sh = [a[i : i + 4] for i in range(0, len(a) - 3, 4)]
        assert r["s"] == pytest.approx(1.0 if not sh else sum(x in b for x in sh) / len(sh))


def test_markup_splitting_and_tokens(spark):
    v = one(spark, "<p>A &amp; B<script>x()</script><a href='u.htm'>c</a></p><p>d", fx.visible)
    assert (v["text"], v["links"]) == ("A & Bc\nd", ["u.htm"])
    assert one(spark, "&amp;lt; &amp &#65;", fx.unescape) == "&lt; &amp A"
    text = "One sentence. Two😀! " + "x" * 50 + " 三。四"
    parts = one(spark, text, lambda c: fx.split_lossless(c, F.lit(20)))
    assert "".join(parts) == text and all(fx._units(p) <= 20 for p in parts)
    assert one(spark, "", lambda c: fx.split_lossless(c, F.lit(5))) == [""]
    p = one(spark, "fill ____ in $x$ [3]", fx.protect)
    assert p["masked"] == "fill ⟦0⟧ in ⟦1⟧ ⟦2⟧"
    back = spark.createDataFrame([(p["masked"], p["kept"]), ("⟦1⟧ ⟦0⟧ ⟦2⟧", p["kept"])], "m string, k array<string>").select(fx.restore("m", "k").alias("x")).collect()
    assert [r["x"] for r in back] == ["fill ____ in $x$ [3]", None]
    assert [o["text"] for o in one(spark, "A. one  B. $B. x$ two  C. three", fx.labelled_options)] == ["one", "$B. x$ two", "three"]
    assert one(spark, "A. one  C. three", fx.labelled_options) == []
    assert one(spark, r"\frac{a+1}{\frac12}", fx.plain_fractions) == "(a+1)/(1/2)"
    link = lambda x: spark.createDataFrame([("http://h/a/b.htm", x)], "b string, l string").select(fx.same_origin_link("b", "l").alias("x")).first()["x"]
    assert link("../c.png") == "http://h/c.png" and link("http://other/c") is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "n": 1,\n "more": null}')
    (tmp_path / "ok.jsonl").write_text('{"id": "x"}\n{"id": "y"}\n')
    (tmp_path / "twice.jsonl").write_text('{"id": "x"}\n{"id": "x"}\n')
    (tmp_path / "blank.jsonl").write_text('{"id": "x"}\n\n{"id": "y"}\n')
    assert readers.json_objects(spark, readers.listed_paths(str(tmp_path), ["a.json"]), "id string, n int").first()["n"] == 1
    assert readers.json_lines(spark, str(tmp_path / "ok.jsonl"), "id string", "id").count() == 2
    for bad in ("twice", "blank"):
        with pytest.raises(Exception, match="repeated key|blank line"):
            readers.json_lines(spark, str(tmp_path / f"{bad}.jsonl"), "id string", "id").collect()
    for bad in ("../x", "/etc/x", "s3://b/x"):
        with pytest.raises(ValueError, match="leaves the root"):
            readers.listed_paths("root", [bad])
    assert readers.fingerprints(spark, str(tmp_path), "*.jsonl").count() == 3
    with pytest.raises(ValueError, match="3 files, 4 expected"):
        readers.recursive(spark, str(tmp_path), "*.jsonl", 4)
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert {r["v"] for r in readers.first_of_sources([a, b], "k").collect()} == {"a", "c"}
    assert {r["v"] for r in readers.first_of_sources([a, b], "k", authoritative=True).collect()} == {"b", "c"}


def test_svg_layers(spark):
    svg = '<svg><g transform="translate(10,5)"><text x="1" y="2px" font-size="12">ab <tspan>c</tspan></text></g></svg>'
    df = spark.createDataFrame([(1, svg), (2, "<svg><text x='1'>broken"), (3, None)], "k int, m string")
    assert [tuple(r) for r in readers.svg_spans(df, "k", "m").collect()] == [(1, 1, 1.0, 2.0, 12.0, "ab c")]
    assert [tuple(r) for r in readers.svg_spans_strict(df, "k", "m").collect()] == [(1, 1, 11.0, 7.0, 12.0, "ab c")]


def test_publication_is_checked_and_switched_once(spark, tmp_path):
    root = str(tmp_path / "out")
    good = spark.createDataFrame([(1,)], "id int")
    assert sinks.current(spark, root) is None
    sinks.publish(spark, root, "v1", {"t_pub": good}, {"none": good.limit(0)}, expected=None)
    assert sinks.current(spark, root) == "v1"
    with pytest.raises(ValueError, match="bad"):
        sinks.publish(spark, root, "v2", {"t_pub": good}, {"bad": good}, expected="v1")
    with pytest.raises(ValueError, match="not v0"):
        sinks.publish(spark, root, "v3", {"t_pub": good}, {}, expected="v0")
    assert sinks.current(spark, root) == "v1" and spark.read.parquet(f"{root}/v1/t_pub").count() == 1
    sinks.publish(spark, root, "v4", {"t_pub": good}, {}, expected="v1")
    assert sinks.current(spark, root) == "v4"


def test_reports_and_upserts(spark, tmp_path):
    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "code string, n int")
    assert sinks.json_report(f, str(tmp_path / "r")) == {"a": 2, "b": 1}
    state, news = spark.createDataFrame([(1, "old", 1), (2, "keep", 1)], "k int, v string, t int"), spark.createDataFrame([(1, "new", 2)], "k int, v string, t int")
    assert sorted(tuple(r) for r in sinks.upserted(state, news, ["k"], ["t"]).collect()) == [(1, "new", 2), (2, "keep", 1)]
    assert sinks.responses(spark.createDataFrame([(1, None)], "k int, v string"), "k").first()["body"] == '{"k":1,"v":null}'


def test_pending_and_quarantine(spark):
    work = spark.createDataFrame([("a", "h1", True), ("b", "h2", True), ("c", "h3", False), ("d", "h4", True)], "id string, hash string, ok boolean")
    done, bad = spark.createDataFrame([("a", "h1"), ("d", "old")], "id string, hash string"), spark.createDataFrame([("b", "h2")], "id string, hash string")
    assert [r["id"] for r in incremental.pending(work, done, bad, ["id", "hash"], F.col("ok")).collect()] == ["d"]  # a new hash reopens it
    good, refused = incremental.accepted(spark.createDataFrame([("x", "汉"), ("x", ""), ("x", "x"), ("x", "latin"), ("x", "汉⟦0⟧"), ("x", None)], "s string, t string"), "s", "t")
    assert good.count() == 1 and sorted(r["reason"] for r in refused.collect()) == ["empty", "empty", "leftover marker", "no ideographs", "unchanged"]


def test_streams(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int").coalesce(1).write.parquet(f"{src}/1")
    spark.createDataFrame([(1, "z", 2), (1, "z", 2)], "k int, v string, t int").coalesce(1).write.parquet(f"{src}/2")
    stream = incremental.file_stream(spark, f"{src}/*", "k int, v string, t int", 1)
    q = incremental.merge_stream(stream, root, ["k"], ["t"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in incremental.read_state(spark, root).select("k", "v", "t").collect()) == [(1, "z", 2), (2, "b", 1)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 02:00:00", "b", 4.0)], "ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{src}-events")
    counts = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{src}-events"), "ts", "kind", "v")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["kind"], r["n"], r["total"]) for r in spark.table("win").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_sqlite_tables_are_read_and_never_written(spark, tmp_path):
    import sqlite3

    from papyra.sources.database import _open, sqlite_table

    path = str(tmp_path / "bank.db")
    with sqlite3.connect(path) as c:
        c.execute('create table "odd ""name" (id integer primary key, label text, share real, raw blob)')
        c.executemany('insert into "odd ""name" values (?, ?, ?, ?)', [(i * 3, None if i % 5 == 0 else f"标{i}", i / 4, bytes([i % 256])) for i in range(1000)])
        c.execute("create table empty (x integer)")
    got = sqlite_table(spark, path, 'odd "name', 7)
    assert got.dtypes == [("id", "bigint"), ("label", "string"), ("share", "double"), ("raw", "binary")]
    assert got.count() == got.select("id").distinct().count() == 1000 and got.rdd.getNumPartitions() == 7
    assert got.where("label is null").count() == 200 and sqlite_table(spark, path, "empty").count() == 0
    with pytest.raises(sqlite3.OperationalError):
        _open(path).execute("delete from empty")
    with pytest.raises(Exception, match="no table"):
        sqlite_table(spark, path, "absent").count()


def test_a_state_batch_rewrites_its_buckets_only(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "state")
    first = spark.createDataFrame([(i, "a", 1) for i in range(200)], "k int, v string, t int")
    first.write.parquet(f"{src}/1")

    def run():
        stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", True).parquet(str(src))
        incremental.merge_stream(stream, root, ["k"], ["t"], str(tmp_path / "cp"), buckets=8).awaitTermination(120)
        return incremental._manifest(spark, root)

    one = run()
    spark.createDataFrame([(7, "b", 2), (7, "old", 0)], first.schema).write.parquet(f"{src}/2")
    two = run()
    assert len(one["buckets"]) == 8 and sum(one["buckets"][b] != two["buckets"][b] for b in one["buckets"]) == 1
    state = incremental.read_state(spark, root)
    assert state.count() == 200 and [r["v"] for r in state.where("k = 7").collect()] == ["b"]
