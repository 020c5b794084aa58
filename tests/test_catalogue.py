"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from compare import oracle_rows, rows_of

from spanforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    columns, rows = rows_of(catalogue.queries()[name], spark, SF)
    assert columns
    if name in catalogue.oracle_sql():
        assert (columns, rows) == oracle_rows(catalogue.oracle_sql()[name], SF)


def test_greedy_link_by_brute_force(spark):
    from spanforge.operators.linking import greedy_links

    docs = spark.createDataFrame([("p", "a b c a b d".split()), ("q", ["x"]), ("r", [])], "page string, words array<string>")
    names = spark.createDataFrame([("a b",), ("b c",), ("c",), ("a b c",), ("d",)], "name string")
    got = sorted(tuple(r) for r in greedy_links(docs, names, 3).collect())
    assert got == [("p", 0, 3, "a b c"), ("p", 3, 5, "a b"), ("p", 5, 6, "d")]


def test_align_skips_spans_until_texts_agree(spark):
    from spanforge.operators.disambiguation import align

    mentions = spark.createDataFrame([("d", 0, "Tokyo."), ("d", 1, "Japan")], "doc string, mention long, text string")
    spans = spark.createDataFrame([("d", 0, 1, "Asia"), ("d", 2, 3, "tokyo"), ("d", 4, 5, "Osaka"), ("d", 6, 7, "JAPAN")], "doc string, start long, end long, text string")
    assert sorted(tuple(r) for r in align(mentions, spans).collect()) == [("d", 0, 2, 3), ("d", 1, 6, 7)]
    assert align(mentions, spans.limit(0)).count() == 0


def test_text_functions(spark):
    from spanforge.functions import text as T

    row = spark.createDataFrame([("  The  Cat, a dog! ", "🤩ab", "a:b:en", "%41+b")], "a string, b string, k string, u string").select(
        T.collapse_spaces("a").alias("spaces"), T.normalize_answer("a").alias("answer"), T.blank_astral("b").alias("blank"), T.split_last("k").alias("key"), T.unquote("u").alias("u"), T.position_ids(T.F.lit(3), T.F.lit(5), 4).alias("ids"), T.position_ids(T.F.lit(3), T.F.lit(3), 2).alias("none"), T.sentence_spans(T.F.lit("Hi. You there? ok")).alias("spans"), T.padded(T.F.array(T.F.lit(1), T.F.lit(2)), 3).alias("padded"), T.softmax(T.F.array(T.F.lit(0.0), T.F.lit(0.0))).alias("half")
    ).first()
    assert (row.spaces, row.answer, row.blank, tuple(row.key), row.u) == (" The Cat, a dog!", "cat dog", " ab", ("a:b", "en"), "A+b")
    assert (row.ids, row.none, [tuple(s) for s in row.spans], row.padded, row.half) == ([3, 4, -1, -1], [-1, -1], [(0, 4), (4, 15), (15, 17)], [1, 2, 0], [0.5, 0.5])


def test_packing_examples_moves_entities(spark):
    from spanforge.operators.packing import examples

    kind = "page int, bin int, sent int, words array<int>, entities array<struct<title:string,start:int,end:int>>"
    rows = spark.createDataFrame([(1, 0, 0, [1, 2, 3], [("A", 0, 2)]), (1, 0, 1, [4, 5], [("B", 1, 2)]), (1, 1, 2, [6], [])], kind)
    got = {r.bin: (r.words, [tuple(e) for e in r.entities]) for r in examples(rows).collect()}
    assert got == {0: ([1, 2, 3, 4, 5], [("A", 0, 2), ("B", 4, 5)]), 1: ([6], [])}
    assert examples(rows, keep_empty=False).count() == 1
