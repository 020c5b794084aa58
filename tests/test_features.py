"""Task features on rows of our own."""

from pyspark.sql import functions as F

from spanforge.operators import decode, features, scores, windows


def test_marked_sequences(spark):
    rows = spark.createDataFrame([(1, ["on"], ["a", "day"], [], ["time"])], "id int, left array<string>, mention array<string>, right array<string>, labels array<string>")
    r = features.typing_features(rows, ["person", "time"]).first()
    assert r.tokens == ["[CLS]", "on", "[ENTITY]", "a", "day", "[ENTITY]", "[SEP]"] and r.tokens[r.start : r.end] == ["[ENTITY]", "a", "day", "[ENTITY]"] and r.hot == [0, 1]
    kind = "id int, tokens array<string>, head_start int, head_end int, tail_start int, tail_end int"
    words = "Bob works at Big Lab now".split()
    for row in [(1, words, 0, 1, 3, 5), (2, words, 3, 5, 0, 1)]:
        r = features.relation_features(spark.createDataFrame([row], kind)).first()
        assert r.tokens[r.head.start : r.head.end] == ["[HEAD]", *words[row[2] : row[3]], "[HEAD]"]
        assert r.tokens[r.tail.start : r.tail.end] == ["[TAIL]", *words[row[4] : row[5]], "[TAIL]"]
    r = features.passage_features(spark.createDataFrame([(1, ["q"], ["x", "y"])], "id int, a array<string>, b array<string>"), double=True).first()
    assert r.tokens[r.b_offset] == "x" and len(r.tokens) == len(r.segments) and r.segments == [0, 0, 0, 0, 1, 1, 1]
    labels = spark.createDataFrame([("b",), ("no_relation",), ("a",), ("b",)], "label string")
    assert [tuple(r) for r in features.label_list(labels, "no_relation").orderBy("id").collect()] == [(0, "no_relation"), (1, "a"), (2, "b")]


def test_links_and_categories(spark):
    kind = f"text string, links array<{features._LINK}>, sent_start int, sent_end int"
    rows = spark.createDataFrame([("See category:Cars and Rome.", [("category:Cars", "Category:Cars", 4, 17), ("Rome", "Category:Rome", 22, 26)], 4, 24)], kind)
    r = features.blank_categories(rows).first()
    assert r.text == "See " + " " * 13 + " and Rome." and [x.text for x in r.links] == ["Rome"]
    assert [(x.text, x.start, x.end) for x in features.links_of_sentences(rows).first().links] == [("category:Cars", 0, 13)]


def test_spans_and_contexts(spark):
    m = spark.createDataFrame([("d", 0, 0, 2, 20), ("d", 1, 9, 10, 20), ("d", 2, 19, 20, 20)], "doc string, mention int, start int, end int, n int")
    got = {r.mention: (r["from"], r.to) for r in features.mention_contexts(m, 6).collect()}
    assert all(b - a == 6 for a, b in got.values()) and got[0] == (0, 6) and got[2] == (14, 20)
    rows = spark.createDataFrame([(1, "the big cat sat".split(), 0, 3, ["cat"]), (2, ["x"], 0, 0, ["y"])], "id int, tokens array<string>, start int, end int, answer array<string>")
    assert sorted(tuple(r) for r in features.improved_span(rows).collect()) == [(1, 2, 2), (2, 0, 0)]
    docs = spark.createDataFrame([(1, " a b\tcd ")], "doc_id int, text string")
    assert windows.char_words(docs).first().chars == [-1, 0, 0, 1, 1, 2, 2, 2]
    things = spark.createDataFrame([(1, 2, 4), (1, 5, 9)], "k int, start int, end int")
    around = spark.createDataFrame([(1, 0, 1, 6)], "k int, window int, w_start int, w_end int")
    assert [tuple(r) for r in windows.inside(around, things, ["k"]).select("start", "end").collect()] == [(1, 3)]


def test_vectors_and_choices(spark):
    rows = spark.createDataFrame([(1, [1.0, 4.0]), (1, [3.0, None]), (2, None)], "id int, v array<double>")
    assert sorted(tuple(r) for r in features.mean_vectors(rows, "id", "v").collect()) == [(1, 0, 2.0), (1, 1, 4.0)]
    assert sorted(tuple(r) for r in features.max_vectors(rows, "id", "v").collect()) == [(1, 0, 3.0), (1, 1, 4.0)]
    c = spark.createDataFrame([("d", 0, "A", 0.5), ("d", 1, "B", 0.9), ("d", 2, "C", 0.9)], "doc string, mention int, title string, score double")
    assert [tuple(r) for r in features.global_step(c).collect()] == [("d", 1, "B", 0.9)]
    spans = spark.createDataFrame([(1, "x", 2.0), (1, "x", 3.0), (1, "y", 1.0)], "id int, text string, score double")
    assert sorted((r.rank, r.text, r.score) for r in decode.distinct_answers(spans, 5).collect()) == [(1, "x", 3.0), (2, "y", 1.0)]
    means = scores.running_mean(spark.createDataFrame([(1, 2.0), (2, 4.0)], "i int, v double"), "i", "v")
    assert sorted(tuple(r) for r in means.collect()) == [(1, 2.0), (2, 3.0)]
    assert spark.range(1).select(features.masked_scores(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(False), F.lit(True))).alias("x")).first().x == [-1e32, 2.0]


def test_more_features(spark):
    from spanforge.operators import packing

    kind = "id int, mentions array<struct<entity:int,start:int,end:int>>"
    got = {r.id: (r.entity_ids, r.positions) for r in features.entity_features(spark.createDataFrame([(1, [(5, 2, 4), (6, 7, 8)]), (2, [])], kind), 1, 3).collect()}
    assert got == {1: ([5], [[2, 3, -1]]), 2: ([0], [[-1, -1, -1]])}
    kind = "question array<struct<start:int,end:int>>, context array<struct<start:int,end:int>>, context_start int"
    assert [tuple(m) for m in features.sided_mentions(spark.createDataFrame([([(0, 2), (3, 6)], [(5, 6), (6, 8)], 5)], kind)).first().mentions] == [(0, 2), (6, 8)]
    docs = spark.createDataFrame([("d", 10, [(4, 6), (8, 9)]), ("e", 3, [])], "doc string, n int, mentions array<struct<start:int,end:int>>")
    assert sorted(tuple(r) for r in features.split_document(docs, 5).collect()) == [("d", 0, 0, 4), ("d", 1, 4, 10), ("e", 0, 0, 3)]
    assert sorted(tuple(r) for r in features.split_document(docs, 5, compat=True).collect())[0] == ("d", 0, 0, 5)
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "id int, label string")
    assert [(r.id, r.label) for r in features.likely_labels(spark.createDataFrame([(7, [0.0, 3.0])], "id int, logits array<double>"), labels).collect()] == [(7, "b")]
    row = spark.range(1).select(packing.replacement(5, 8, F.lit("k")).alias("r"), packing.replacement(5, 8, F.lit("k")).alias("s"), packing.warmup_rate(F.lit(5), 10, 20).alias("up"), packing.warmup_rate(F.lit(15), 10, 20).alias("down")).first()
    assert row.r == row.s and 5 <= row.r < 8 and (row.up, row.down) == (0.5, 0.5)
