"""Joins on both sides of their switch by size, and operators over tables with clashing columns."""

from __future__ import annotations

import random

import pytest

from spanforge.llm import common, mixing, ngram_join, pieces, pii, token_counts, warc


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    rows = [(i, None if i % 31 == 4 else " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(0, 400))), [None, "a", "b", "c"][min(3, i % 9)]) for i in range(250)]
    rows += [(3, "x y z", "a")] * 3 + [(None, "u v", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_is_the_same_beyond_small_tables(spark, docs, monkeypatch):
    wide = docs.withColumnsRenamed({}).selectExpr("*", "doc_id as n_chars")
    small = sorted(map(tuple, mixing.mix(docs, shard_words=600).collect()), key=repr)
    texts = sorted(map(tuple, mixing.mixed_documents(wide).collect()), key=repr)
    monkeypatch.setattr(common, "SMALL_ROWS", -1)
    plan = mixing.mix(docs, shard_words=600)
    assert sorted(map(tuple, plan.collect()), key=repr) == small
    assert sorted(map(tuple, mixing.mixed_documents(wide).collect()), key=repr) == texts


CLASHING = "doc_id long, text string, row_id int, spans string, hits int, token_ids string, n_tokens int, same string, tree binary, start int, kind string, `end` int"


@pytest.mark.parametrize("operator", [pii.find_pii, pieces.round_trip, token_counts.edit_counts])
def test_clashing_columns_change_nothing(spark, operator):
    texts = ["mail a@b.org or +49 30 1234567", "", None, "plain words only", "4111 1111 1111 1111 at 10.0.0.1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[4])]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    wide = spark.createDataFrame([(*r, 1, "s", 2, "t", 3, "u", b"v", 4, "w", 5) for r in rows], CLASHING)
    assert sorted(map(repr, operator(wide).collect())) == sorted(map(repr, operator(plain).collect()))


def test_decoding_and_archives_with_clashing_columns(spark):
    tokens = pieces.encode(spark.createDataFrame([(1, "some words", "x", 2)], "doc_id long, text string, decoded string, row int"))
    assert [(r.doc_id, r.decoded) for r in pieces.decode(tokens.selectExpr("*", "'x' as decoded", "1 as text")).collect()] == [(1, "some words")]
    pages = [(1, "http://x/1", "<p>a</p>" * 200), (2, "http://x/2", "<p>a</p>" * 200), (3, None, None)]
    plain = spark.createDataFrame(pages, "page_id long, url string, html string")
    wide = plain.selectExpr("*", "1 as payload", "'q' as record_type", "2 as path", "3 as refers_to", "4 as leader")
    assert sorted(map(tuple, warc.round_trip(wide).collect()), key=repr) == sorted(map(tuple, warc.round_trip(plain).collect()), key=repr)


def _near(n):
    """Texts of which every tenth has a near copy and every seventh a copy, null ids and repeated rows among them."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randrange(9999)}" for _ in range(60)), "a") for i in range(n)]
    rows += [(n + i, rows[i][1] + " end", "b") for i in range(0, n, 10)] + [(2 * n + i, rows[i][1], "c") for i in range(0, n, 7)]
    return rows + [(0, rows[0][1], "a")] * 2 + [(None, rows[1][1], None), (None, rows[10][1], "d"), (5 * n, None, "e")]


def test_near_duplicates_beyond_small_tables(spark, monkeypatch):
    df = spark.createDataFrame(_near(200), "doc_id long, text string, source string")
    links, kept = (sorted(map(tuple, f(df).collect()), key=repr) for f in (ngram_join.jaccard_join, ngram_join.keep_one))
    monkeypatch.setattr(common, "SMALL_ROWS", -1)
    assert sorted(map(tuple, ngram_join.jaccard_join(df).collect()), key=repr) == links
    plan = ngram_join.keep_one(df)
    assert sorted(map(tuple, plan.collect()), key=repr) == kept
    # texts that a sieve of the keys rules out go past the join
    assert "told(xxhash64(" in plan._jdf.queryExecution().executedPlan().toString()


def test_driver_sends_few_rows(spark):
    small = spark.range(60_000).selectExpr("id as key", "id * 2 as value")
    big = spark.range(7).selectExpr("id * 20000 as key", "id")
    joined = common.join_small(big, small, ["key"], "left", spread=big["id"])
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in joined.collect()) == [(k * 20000, k, k * 40000 if k < 3 else None) for k in range(7)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_sifted_joins_are_the_same(spark, monkeypatch, how):
    small = spark.createDataFrame([(i if i else None, f"k{i % 3}" if i % 4 else None, i) for i in range(0, 900, 3)], "a long, b string, value long")
    big = spark.createDataFrame([(i if i else None, f"k{i % 3}" if i % 4 else None, "x" * i) for i in range(1000)], "a long, b string, text string")
    monkeypatch.setattr(common, "SMALL_ROWS", -1)
    plain, sifted = (sorted(map(tuple, common.join_small(big, small, ["a", "b"], how, spread=big["text"], sift=s).select("a", "b", "text", "value").collect()), key=repr) for s in (False, True))
    assert sifted == plain and len(plain) == (1000 if how == "left" else 300)


def test_a_sieve_is_packed_by_tasks(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    def no_rows(*_):
        raise AssertionError("a row for each slot goes to the driver")

    passing = common.sieve(spark.range(3000), F.xxhash64("id"), "some")
    want = np.zeros(common.SLOTS, np.uint64)
    for r in passing.collect():
        want[r.slot] = np.int64(r.bits).view(np.uint64)
    monkeypatch.setattr(type(passing), "toArrow", no_rows)
    monkeypatch.setattr(DataFrame, "toArrow", no_rows)
    assert (common.packed(passing) == want).all() and want.any()
