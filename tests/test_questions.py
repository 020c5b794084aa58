"""Question inputs and further file forms on rows of our own."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators import linking, packing, questions
from spanforge.sources import files, sinks
from test_sources import put, rows


def test_more_files(spark, tmp_path):
    path = put(tmp_path, "t.json", json.dumps([{"sent": "a b", "start": 0, "end": 1, "labels": ["x"]}, {"sent": "c", "start": 0, "end": 1, "labels": []}]))
    assert rows(files.typing_spans(spark, path)) == [(0, "a b", 0, 1, ["x"]), (1, "c", 0, 1, [])]
    names = spark.createDataFrame([("file:///d/train-v2.0.json",), ("xquad.de.json",), ("x/test-context-es-question-vi.json",), ("other.json",)], "p string")
    got = [tuple(r.s) if r.s else None for r in names.select(files.question_set("p").alias("s")).collect()]
    assert got == [("squad", "en", "en", "en"), ("xquad", "de", "de", "en"), ("mlqa", "vi", "es", "es"), None]
    assert rows(files.question_titles(spark, put(tmp_path, "q.json", json.dumps({"data": [{"title": "New_York"}, {"title": "Rome"}]})))) == [("New York",), ("Rome",)]
    lines = "-DOCSTART- (1 EU)\nEU\tB\tx\tx\tx\tx\nsays\n\nNew\tB\tx\tx\tx\tx\nYork\tI\tx\tx\tx\tx\nRome\tB\tx\tx\tx\tx\n-DOCSTART- (2 b)\nend\n"
    words, spans = files.mention_lines(spark, put(tmp_path, "m.tsv", lines))
    assert rows(spans.drop("file")) == [("1", 0, 0, 1), ("1", 1, 3, 5), ("1", 2, 5, 6)]
    assert rows(words.drop("file")) == [("1", 0, "EU"), ("1", 1, "says"), ("1", 2, ""), ("1", 3, "New"), ("1", 4, "York"), ("1", 5, "Rome"), ("2", 0, "end")]
    with pytest.raises(Exception, match="no mention tag"):
        files.mention_lines(spark, put(tmp_path, "bad.tsv", "-DOCSTART- (1 EU)\nEU\tQ\tx\tx\tx\tx\n"))[1].collect()
    (tmp_path / "p" / "in").mkdir(parents=True)
    entity = "ENTITY\t1\t2\t3\t4\t5\t6\tmention: New York\n"
    candidate = "CANDIDATE\t1\t2\t3\t4\turl:" + "h" * 29 + "{}\n"
    (tmp_path / "p" / "in" / "7").write_text(entity.replace("mention: ", "123456789") + candidate.format("New_York") + candidate.format("York") + entity)
    assert rows(files.entity_candidates(spark, f"file://{tmp_path}/p")) == [("7", 0, "New York", ["New York", "York"]), ("7", 1, "New York", [])]
    sinks.write_bio(files.lines(spark, put(tmp_path, "io.txt", "a x x x I-PER\nb x x x I-PER\n\nc x x x I-LOC\nd x x x O")), f"file://{tmp_path}/bio")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/bio").collect()] == ["a x x x B-PER", "b x x x I-PER", "", "c x x x B-LOC", "d x x x O"]


def test_answers_in_texts(spark):
    kind = "text string, at array<int>, n array<int>, start int, end int"
    data = [("ab cd ef", [0, 3, None, 6], [2, 2, 1, 2], 6, 7), ("ab cd ef", [None, 3, 6], [2, 2, 2], 5, 6), ("ab cd", [0, None], [2, 1], 5, 6), ("ab", [0], [2], 0, 0)]
    got = [r.x for r in spark.createDataFrame(data, kind).select(text.answer_text("text", "at", "n", "start", "end", 5).alias("x")).collect()]
    assert got == ["cd ef", "ab cd", "ab cd", ""]
    data = [("Smith", "Steve Smith's house"), ("steve smith ' s", "Steve Smith's house"), ("caf\u00e9 \U0001f600 x", "The caf\u00e9 \U0001f600x."), ("none", "Some text"), ("", "Some"), (" text", "Some text")]
    frame = spark.createDataFrame(data, "answer string, text string")
    assert [r.x for r in frame.select(text.projected_answer("answer", "text").alias("x")).collect()] == ["Smith", "Steve Smith's house", "caf\u00e9 \U0001f600x", "Some text", "Some", "Some text"]
    assert frame.filter("answer like 'steve%'").select(text.projected_answer("answer", "text", lower=True).alias("x")).first().x == "Steve Smith's"


def test_linked_sentences_and_contexts(spark):
    kind = "page int, sent int, text string, links array<struct<title:string,start:int,end:int>>, start int, end int"
    frame = spark.createDataFrame([(1, 0, "In NewYork city, now. Rome", [("NY", 3, 6), ("R", 22, 26)], 0, 22), (1, 1, "In NewYork city, now. Rome", [("NY", 3, 6), ("R", 22, 26)], 22, 26)], kind)
    got = questions.linked_sentences(frame).orderBy("sent").collect()
    assert got[0].tokens == ["In", "New", "York", "city", ",", "now", "."] and [tuple(e) for e in got[0].entities] == [("NY", 1, 2)]
    assert got[1].tokens == ["Rome"] and [tuple(e) for e in got[1].entities] == [("R", 0, 1)]
    assert questions.linked_sentences(frame, least=2).count() == 1

    def plain(sizes, start, end, most):
        if sum(sizes) <= most:
            return 0, len(sizes)
        used = sum(sizes[start:end])
        for side in (x for _ in sizes for x in "lr"):
            at = start - 1 if side == "l" else end
            if not 0 <= at < len(sizes):
                continue
            if used + sizes[at] > most:
                break
            used += sizes[at]
            start, end = (at, end) if side == "l" else (start, at + 1)
        return start, end

    cases = [([1, 2, 1, 3, 1, 1], 2, 3, 6), ([1, 1], 0, 1, 5), ([2, 2, 2, 2], 0, 1, 6), ([1, 1, 1, 9], 0, 2, 4), ([5, 5], 0, 1, 3)]
    frame = spark.createDataFrame([(i, 0, s, a, b, m) for i, (s, a, b, m) in enumerate(cases)], "doc int, sentence int, sizes array<int>, start int, end int, m int")
    for i, (s, a, b, m) in enumerate(cases):
        r = questions.grown_context(frame.filter(F.col("doc") == i), m).first()
        assert (r["from"], r.to) == plain(s, a, b, m), i


def test_question_windows(spark):
    context = [f"w{i}" for i in range(12)]
    frame = spark.createDataFrame([(1, ["what", "is", "it"], context, 6, 7), (2, ["what"], context[:2], None, None)], "id int, question array<string>, context array<string>, start int, end int")
    for double in (False, True):
        got = questions.question_windows(frame, 11 if not double else 12, 4, 2, double).orderBy("id", "window").collect()
        assert [(r.id, r.w_start) for r in got] == [(1, 0), (1, 4), (1, 8), (2, 0)]
        assert all(len(r.tokens) == len(r.segments) <= 12 and r.tokens[r.offset] == f"w{r.w_start}" for r in got)
        assert got[1].tokens[got[1].start : got[1].end + 1] == ["w6", "w7"] and (got[0].start, got[0].end) == (0, 0) == (got[3].start, got[3].end)


def test_cloze(spark):
    kind = "qid string, context string, query string, entities array<struct<start:int,end:int>>, answers array<struct<start:int,end:int>>"
    frame = spark.createDataFrame([("q", "Ann met Bob.@highlight Bob left", "@placeholder went\naway", [(8, 11), (0, 3), (23, 26)], [(23, 26)]), ("n", "no one", "@placeholder", [], [])], kind)
    got = questions.cloze_features(frame, 50, 10, 10).collect()
    assert len(got) == 1 and got[0].tokens[got[0].placeholder] == "@placeholder"
    assert [(got[0].tokens[e.start : e.end], e.answer) for e in got[0].entities] == [(["[ENTITY]", "Ann", "[ENTITY]"], False), (["[ENTITY]", "Bob", "[ENTITY]"], False), (["[ENTITY]", "Bob", "[ENTITY]"], True)]
    assert got[0].tokens.count("@highlight") == 1
    small = questions.cloze_features(frame, 14, 4, 10)
    assert all(w.tokens[e.start] == "[ENTITY]" == w.tokens[e.end - 1] and len(w.tokens) <= 14 for w in small.collect() for e in w.entities) and small.count() > 1
    r = questions.cloze_inputs(questions.cloze_features(frame, 50, 10, 10), 4, 5).first()
    assert r.entity_ids == [1, 1, 1, 1, 0, 0] and r.labels == [0, 0, 1, 0, 0] and r.positions[0] == [1, -1, -1, -1] and len(r.positions) == 4


def test_subword_links_and_padding(spark):
    docs = spark.createDataFrame([(1, ["new", "york", "er", "in", "new", "york"], [False, False, True, False, False, False])], "page int, words array<string>, sub array<boolean>")
    names = spark.createDataFrame([("new york",), ("yorker",), ("er",)], "name string")
    assert rows(linking.greedy_links(docs, names, 3, "sub")) == [(1, 1, 3, "yorker"), (1, 4, 6, "new york")]
    frame = spark.createDataFrame([(1, [1], [5]), (2, [1, 2], [6, 7]), (3, [9], [8])], "id int, a array<int>, b array<int>")
    assert rows(packing.padded_batches(frame, "id", 2, {"a": 0, "b": -1})) == [(1, [1, 0], [5, -1], 0), (2, [1, 2], [6, 7], 0), (3, [9], [8], 1)]
