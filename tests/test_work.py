"""Record files, subwords, accents and whole jobs against plain versions on small fixtures."""

from __future__ import annotations

import gzip
import json
import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators import jobs, subwords
from spanforge.sources import records

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

# record files


def test_record_files(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, None if i % 5 == 0 else f"t{i} é", [rnd.randrange(-(1 << 63), 1 << 63) >> rnd.randrange(64) for _ in range(rnd.randrange(30))], [b"", bytes([i % 256])] * (i % 3), 0.5 * i) for i in range(300)]
    kind = "id long, name string, numbers array<long>, parts array<binary>, x float"
    folder = f"file://{tmp_path}/records"
    written = records.write_records(spark.createDataFrame(rows, kind).repartition(3), folder, file_records=64)
    assert sum(r.records for r in written.collect()) == 300 and written.count() > 3
    back = records.read_records(spark, folder, kind)
    assert sorted((r.id, r.name, list(r.numbers), [bytes(p) for p in r.parts], r.x) for r in back.collect()) == rows
    # other features, in other forms
    assert sorted((r.id, r.missing) for r in records.read_records(spark, folder, "missing array<long>, id array<int>").selectExpr("id[0] as id", "missing").collect()) == [(i, []) for i in range(300)]
    empty = f"file://{tmp_path}/none"
    records.write_records(spark.createDataFrame([], kind), empty)
    assert records.read_records(spark, empty, kind).collect() == []
    with pytest.raises(ValueError, match="no feature"):
        records.write_records(spark.createDataFrame([({"a": 1},)], "m map<string,int>"), f"{folder}2")


@pytest.mark.parametrize("damage", ["byte", "length", "end", "missing"])
def test_damaged_record_files_are_an_error(spark, tmp_path, damage):
    folder = f"file://{tmp_path}/records"
    path = records.write_records(spark.range(20).coalesce(1).selectExpr("id", "repeat('x', 50) as t"), folder).first().path.removeprefix("file://")
    with gzip.open(path) as f:
        data = f.read()
    size = len(data) // 20
    bad = {"byte": data[:100] + bytes([data[100] ^ 1]) + data[101:], "length": data[: 3 * size] + b"\x09" + data[3 * size + 1 :], "end": data[:-3], "missing": data[:-size]}[damage]
    with gzip.open(path, "wb") as f:
        f.write(bad)
    with pytest.raises(Exception, match="damaged|breaks off|were written"):
        records.read_records(spark, folder, "id long").collect()


# subwords


def pieces(spark, model, texts, **options):
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "page string, i int, text string")
    out = subwords.segment_subwords(rows, model, **options) if len(texts) > 1 else subwords.subwords(rows, model, **options)
    return [[t.piece for t in r.tokens] for r in out.orderBy("i").collect()]


def test_tokens_behind_and_without_a_space(spark):
    assert pieces(spark, BYTES, ["Tokyo"]) == [["ĠTokyo"]]
    assert pieces(spark, BYTES, ["Tokyo"], prefix=False) == [["Tok", "yo"]]
    assert pieces(spark, BYTES, ["Tokyo Bay", " developed "]) == [["ĠTokyo", "ĠBay"], ["Ġdeveloped"]]
    assert pieces(spark, BYTES, ["Paper", "."]) == [["ĠPaper"], ["."]]
    assert pieces(spark, PIECES, ["Tokyo"])[0][0].startswith("▁")
    assert not pieces(spark, PIECES, ["Tokyo"], prefix=False)[0][0].startswith("▁")
    assert "".join(pieces(spark, PIECES, ["を食べた。"], prefix=False)[0]).replace("▁", "") != ""


@pytest.mark.parametrize(("model", "prefix"), [(BYTES, True), (BYTES, False), (PIECES, True), (PIECES, False)])
def test_places_of_tokens(spark, model, prefix):
    rnd = random.Random(4)
    texts = ["", None, " ", "a", "naïve  café\n", " x", "日本語 🤩🤩 ok", "don't 12.5"] + ["".join(rnd.choice("ab é日🤩 .1") for _ in range(rnd.randrange(60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in subwords.subwords(rows, model, prefix=prefix).collect():
        at = 0
        for t in r.tokens:
            assert t.start <= at <= t.end  # side by side, or within one character
            at = t.end
        assert at == len(r.text)
        assert sum(r.sizes) == len(r.tokens) and len(r.sizes) == (r.text.count(" ") + 1 if r.text else 0)
        plain = [t for t in r.tokens if t.piece.isascii() and not t.piece.startswith("<0x")]
        assert all(r.text[t.start : t.end] == t.piece for t in plain)


# accents


def test_accents_of_all_planes(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in points if not unicodedata.category(chr(c)).startswith(("Lo", "Co", "Cn")) or unicodedata.decomposition(chr(c))] + [(c, chr(c)) for c in (0xAC01, 0xD7A3, 0x4E00, 0x1D15E, 0x1D160)], "c int, t string")
    got = {r.c: r.plain for r in rows.select("c", text.strip_accents("t").alias("plain")).collect()}
    want = dict(duckdb.sql("select c, strip_accents(chr(c::integer)) from (select unnest(range(1, 1114112)) c) where c < 55296 or c > 57343").fetchall())
    assert len(got) > 10_000 and all(want[c] == t for c, t in got.items())
    few = spark.createDataFrame([("é é ș ế ǟ ガ कि",)], "t string").select(text.strip_accents("t", "Mn").alias("x")).first().x
    assert few == "e e s e a カ कि"


# jobs


def test_candidates_of_articles(spark):
    links = spark.createDataFrame([("A", "Tokyo", "Tokyo", 0.5), ("A", "tokyo ", "Tokyo City", 0.5), ("A", "x", "X", 0.001), ("A", "two", "B", 0.9), ("A", "two", "C", 0.9), ("B", "Paris", "Paris", 0.2)], "page string, name string, title string, link_prob double")
    titles = spark.createDataFrame([("A old",), ("B",), ("none",)], "title string")
    moves, model = spark.createDataFrame([("A old", "A")], "src string, dest string"), spark.createDataFrame([("Paris", "Paris (city)")], "src string, dest string")
    got = sorted(tuple(r) for r in jobs.title_candidates(titles, links, link_moves=moves, model_moves=model).collect())
    assert got == [("A old", "tokyo", "Tokyo City"), ("B", "paris", "Paris (city)")]
    translations = spark.createDataFrame([("Paris", "Pariis"), ("Tokyo", "Tokio")], "title string, translated string")
    names = {"ee": spark.createDataFrame([("Pariis", "Pariis"), ("Tokio", "Tokio"), ("Tokio", "Pealinn")], "title string, name string")}
    got = sorted(tuple(r) for r in jobs.candidates_in(titles, "en", "ee", {"en": links}, translations, names, link_moves=moves).collect())
    assert got == [("B", "pariis", "Pariis")]
    with pytest.raises(ValueError):
        jobs.candidates_in(titles, "de", "de", {"en": links})
    with pytest.raises(ValueError):
        jobs.candidates_in(titles, "en", "fr", {"en": links}, translations, names)


def test_linked_entities(spark):
    docs = [(1, "A", "in New York City and york".split()), (2, "B", "New York City".split()), (3, "C", []), (4, "A", None), (5, "A", "new york new york".split())]
    candidates = [("A", "new york", "NY"), ("A", "new york city", "NYC"), ("A", "york", "York"), ("B", "city", "City"), ("B", "new", "New")]
    vocab = [("NY",), ("York",), ("City",), ("New",)]
    got = sorted(tuple(r) for r in jobs.link_entities(spark.createDataFrame(docs, "page int, article string, words array<string>"), spark.createDataFrame(candidates, "title string, name string, entity string"), spark.createDataFrame(vocab, "title string")).collect())
    # the longest name takes its words though its entity isn't known
    assert got == [(1, 5, 6, "York"), (2, 0, 1, "New"), (2, 2, 3, "City"), (5, 0, 2, "NY"), (5, 2, 4, "NY")]


def test_evaluation_by_file(spark, tmp_path):
    def question(i, *answers):
        return {"id": i, "question": "?", "answers": [{"text": a, "answer_start": 0} for a in answers]}

    data = {"data": [{"title": "T", "paragraphs": [{"context": "c", "qas": [question("a", "der Hund", "Katze"), question("b", "x y"), question("c", "z"), question("d")]}]}]}
    predicted = {"a": "Hund!", "b": "y der", "d": "something"}
    (tmp_path / "predicted.json").write_text(json.dumps(predicted))
    for name, want in (("dev-context-de-question-en.json", (100 / 3, (1 + 2 / 3) * 100 / 3, 3)), ("dev-v1.1.json", (0.0, (2 / 3 + 2 * 0.5 * 0.5) * 100 / 3, 3))):
        (tmp_path / name).write_text(json.dumps(data))
        got = jobs.evaluate_files(spark, f"{tmp_path}/{name}", f"{tmp_path}/predicted.json").first()
        assert got.total == want[2] and abs(got.exact_match - want[0]) < 1e-9 and abs(got.f1 - want[1]) < 1e-9
    data["data"] *= 2
    (tmp_path / "dev-v1.1.json").write_text(json.dumps(data))
    with pytest.raises(Exception, match="more than once"):
        jobs.evaluate_files(spark, f"{tmp_path}/dev-v1.1.json", f"{tmp_path}/predicted.json").collect()


def test_joins_by_unique_id(spark):
    results = spark.createDataFrame([(1, 0.5), (2, 0.7), (9, 0.1)], "unique_id int, score double")
    features = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "unique_id int, example_index int")
    examples = spark.createDataFrame([(10, "x"), (11, "y")], "example_index int, text string")
    assert sorted((r.unique_id, r.example_index, r.text) for r in jobs.results_of_examples(results, features, examples).collect()) == [(1, 10, "x"), (2, 10, "x")]
    with pytest.raises(Exception, match="more than once"):
        jobs.results_of_examples(results, features.union(features), examples).collect()


def test_tags_of_sentences(spark):
    spans = spark.createDataFrame([("d", 0, 2, "PER"), ("d", 2, 4, "PER"), ("d", 4, 5, "NIL"), ("d", 6, 7, "LOC"), ("d", 7, 8, "ORG")], "doc string, start int, end int, label string")
    words = spark.createDataFrame([("d", i, i // 3, f"w{i}", "O") for i in range(9)], "doc string, pos int, sentence int, word string, label string")
    got = [r.pred for r in jobs.sentence_tags(spans, words).orderBy("pos").collect()]
    assert got == ["I-PER", "I-PER", "B-PER", "I-PER", "O", "O", "I-LOC", "I-ORG", "O"]


def test_shared_tokens(spark):
    from spanforge.operators.scores import token_f1

    rows = [(["a", "a", "b"], ["a", "c", "a", "a"]), ([], []), (["x"], []), (None, ["x"]), (["q", "r"], ["r", "q"]), (["a"], ["b"])]
    frame = spark.createDataFrame(rows, "p array<string>, g array<string>").withColumn("i", F.monotonically_increasing_id())
    got = [r.f for r in frame.select("i", token_f1(F.col("p"), F.col("g")).alias("f")).orderBy("i").collect()]
    assert got == [4 / 7, 0.0, 0.0, 0.0, 1.0, 0.0]


# tables to look up, streams


def test_lookups_leave_the_table_where_it_is(spark, tmp_path):
    from spanforge.sources import files, sinks

    rows = spark.range(2000).selectExpr("concat('k', id % 700) as key", "id")
    sinks.write_buckets(rows, "lookup_rows", f"file://{tmp_path}/b", "key", 6)
    try:
        keys = spark.createDataFrame([("k3",), ("k699",), ("none",), (None,)], "key string")
        found = files.looked_up(spark.table("lookup_rows"), keys, "key")
        assert sorted(r.id for r in found.collect()) == [3, 699, 703, 1399, 1403]
        plan = found._jdf.queryExecution().executedPlan().toString()
        initial = plan[plan.find("Initial Plan") :] if "Initial Plan" in plan else plan
        assert initial.count("Exchange hashpartitioning(key") == 1  # of the keys alone
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else plans don't tell
        shown = spark.sql("explain formatted select * from lookup_rows where key = 'k5'").first()[0]
        assert "SelectedBucketsCount: 1 out of 6" in shown, shown
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("drop table lookup_rows")


def test_step_means_over_batches(spark, tmp_path):
    from spanforge.streaming import metrics

    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, None if i % 13 == 0 else float(i)) for i in range(230)] + [("n", 1000 + i, None) for i in range(10)]
    kind = "model string, place long, value double"
    for part in (rows[:90], rows[90:91], rows[91:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = metrics.all_available(metrics.step_means(stream, 10), f"{tmp_path}/c", f"{tmp_path}/out")
    want = {}
    for m in "abn":
        own = [v for x, _, v in rows if x == m]
        for i in range(len(own) // 10):
            some = [v for v in own[10 * i : 10 * i + 10] if v is not None]
            want[m, i] = (10, round(sum(some) / len(some), 9) if some else None)
    assert {(r.model, r.step): (r.n, None if r["mean"] is None else round(r["mean"], 9)) for r in got.collect()} == want
