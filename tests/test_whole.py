"""Queries over whole texts, where others of the catalogue read the first words only."""

import random
from collections import defaultdict

from spanforge.plans import catalogue

SF = "/root/testdata/sf0.001"


def _coreferences(mentions, persons):
    """Each mention against all others of its document."""
    by = defaultdict(list)
    for doc, mention, text, top in mentions:
        by[doc].append((mention, text, top))
    out = []
    for doc, rows in by.items():
        for a, text, _ in rows:
            for b, whole, top in rows:
                at = whole.find(text)
                if a != b and text != whole and top in persons and at >= 0 and f" {whole} "[at] == " " and f" {whole} "[at + len(text) + 1] == " ":
                    out.append((doc, a, b))
    return sorted(out)


def test_coreferences_by_brute_force(spark):
    from spanforge.operators.disambiguation import coreferences

    rnd = random.Random(1)
    rows = [(d, i, text := " ".join(rnd.choice(["an", "dan", "a", "ana", "b", ""]) for _ in range(rnd.randint(1, 4))), text) for d in range(12) for i in range(12)]
    persons = {r[3] for r in rows if rnd.random() < 0.7}
    rows += [(20, 0, "an", "x"), (20, 1, "dan an", "dan an"), (20, 2, "an dan", "an dan")]
    got = coreferences(spark.createDataFrame(rows, "doc long, mention long, text string, top string"), spark.createDataFrame([(t,) for t in persons | {"dan an", "an dan"}], "title string"))
    assert sorted(tuple(r) for r in got.collect()) == _coreferences(rows, persons | {"dan an", "an dan"})


def test_coreferences_of_whole_documents(spark):
    hits = [(r.page, r.start, r.name.lower(), r.name.lower()) for r in catalogue.queries()["greedy_link"](spark, SF).collect()]
    want = _coreferences(hits, {t for _, _, t, _ in hits if len(t) > 5})
    got = sorted(tuple(r) for r in catalogue.queries()["coreferences_whole"](spark, SF).collect())
    assert got == want and max(max(r[1:]) for r in got) > 1000
    text, n, sums = {(d, m): t for d, m, t, _ in hits}, defaultdict(int), defaultdict(float)
    for d, m, o in want:
        n[d, m] += 1
        sums[d, m, text[d, o]] += 1 / (o + 1)
    priors = {(r.doc, r.mention, r.title): r.prior for r in catalogue.queries()["coref_prior_whole"](spark, SF).collect()}
    assert priors.keys() == sums.keys() and all(abs(p - sums[k] / n[k[:2]]) < 1e-6 for k, p in priors.items())


def test_shared_tokens_of_long_answers(spark):
    import time
    from collections import Counter

    from pyspark.sql import functions as F

    from spanforge.operators.scores import shared_tokens

    rnd = random.Random(2)
    some = [[rnd.choice("abcde") for _ in range(rnd.randint(0, 9))] for _ in range(60)]
    rows = [(i, a, rnd.choice(some)) for i, a in enumerate(some)] + [(99, None, ["a"])]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>").withColumn("n", shared_tokens(F.col("a"), F.col("b")))
    assert {r.id: r.n for r in df.collect()} == {i: None if a is None else (Counter(a) & Counter(b)).total() for i, a, b in rows}
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: i.cast("string")).alias("a"))
    began = time.time()
    assert long.select(shared_tokens(F.col("a"), F.slice("a", 5, 40_000)).alias("n")).first().n == 39_996
    assert time.time() - began < 30  # by the square of the tokens it takes minutes


def test_scores_of_whole_answers(spark):
    import re
    from collections import Counter

    tokens = lambda t: [w for w in re.sub(r"[!-/:-@\[-`{-~]", "", t.lower()).split() if w not in ("a", "an", "the")]
    got = {r.qid: r for r in catalogue.queries()["answer_scores_whole"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        g, p = tokens(r.text or ""), tokens((r.text or "").split("\n", 1)[-1])
        same = (Counter(g) & Counter(p)).total()
        answered = bool((r.text or "").split())
        assert (got[r.doc_id].answered, got[r.doc_id].exact) == (answered, float(answered and g == p))
        assert abs(got[r.doc_id].f1 - (2 * same / (len(g) + len(p)) if answered and same else 0)) < 2e-6


def test_packing_and_spans_by_production_values(spark):
    lines = {r.doc_id: [len(x.split()) for x in r.text.split("\n")] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    packed = {(r.page, r.sent): r.bin for r in catalogue.queries()["pack_sentences_full"](spark, SF).collect()}
    want = {}
    for page, sizes in lines.items():
        at = used = 0
        for sent, n in enumerate(sizes):
            if 1 <= n <= 510:
                at, used = (at + 1, n) if used + n > 510 else (at, used + n)
                want[page, sent] = at
    assert packed == want and any(64 < lines[page][sent] for page, sent in packed)
    spans = catalogue.queries()["enumerate_spans_full"](spark, SF)
    assert spans.count() == sum(max(0, n - k) for sizes in lines.values() for n in sizes for k in range(16)) and spans.filter("end - start = 16").count() > 0


def test_greedy_links_of_whole_documents(spark):
    names = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = (r.text or "").split()
        names |= {" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, i = (r.text or "").split(), 0
        while i < len(w):
            k = next((k for k in (3, 2, 1) if i + k <= len(w) and " ".join(w[i : i + k]) in names), 0)
            if k:
                want.append((r.doc_id, i, i + k, " ".join(w[i : i + k])))
            i += k or 1
    assert sorted(tuple(r) for r in catalogue.queries()["greedy_link"](spark, SF).collect()) == sorted(want)


def test_subword_links(spark):
    from spanforge.operators.linking import greedy_links

    docs = spark.createDataFrame([("p", ["To", "kyo", "Bay", "a", "To"], [False, True, False, False, False]), ("q", [], [])], "page string, words array<string>, inner array<boolean>")
    names = spark.createDataFrame([("Tokyo",), ("Tokyo Bay",), ("kyo",), ("To",), ("a To",)], "name string")
    assert sorted(tuple(r) for r in greedy_links(docs, names, 3, "inner").collect()) == [("p", 0, 3, "Tokyo Bay"), ("p", 3, 5, "a To")]


def test_greedy_spans_by_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    by = defaultdict(list)
    for r in rows:
        if r["event_type"] != "view":
            start = r["event_id"] % 50
            by[r["user_id"]].append((-r["value"], start, start + 1 + r["event_id"] % 4, r["event_type"]))
    want = []
    for user, spans in by.items():
        taken = []
        for minus, a, b, label in sorted(spans):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                want.append((user, a, b, label, -minus))
    got = sorted((r.user_id, r.start, r.end, r.label, r.score) for r in catalogue.queries()["greedy_spans"](spark, SF).collect())
    assert got == sorted(want)


def test_places_in_order(spark):
    from pyspark.sql import functions as F

    from spanforge.operators.ordering import in_order

    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(40)]), i, rnd.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(7)
    got = sorted((r.place, r.k, r.i, r.s) for r in in_order(df, "k", F.desc("i"), sums={"s": F.col("v")}).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [(k, i) for _, k, i, _ in got] == [(k, i) for k, i, _ in want] and [p for p, *_ in got] == list(range(500))
    run = 0
    for (_, _, v), (*_, s) in zip(want, got, strict=True):
        run += v or 0
        assert s == run
    assert in_order(df.limit(0), "k").count() == 0


def test_words_of_characters_of_long_texts(spark):
    from spanforge.operators.windows import char_words

    text = "ab c\n" * 8000
    got = char_words(spark.createDataFrame([(1, text), (2, ""), (3, "  ")], "doc_id int, text string")).collect()
    chars = {r.doc_id: r.chars for r in got}
    assert chars[1] == [2 * (i // 5) + (i % 5 >= 3) for i in range(40_000)] and chars[2] == [] and chars[3] == [-1, -1]


def test_whole_word_masks_by_brute_force(spark):
    import hashlib
    from collections import Counter

    from spanforge.operators.packing import masked_groups

    rnd = random.Random(3)
    rows = [(d, i, bool(i and rnd.random() < 0.5), rnd.random() < 0.05) for d in range(30) for i in range(rnd.choice([1, 2, 5, 40, 90]))]
    rows += [(100, i, i > 0, False) for i in range(10)]  # one word that never fits
    got = defaultdict(dict)
    for r in masked_groups(spark.createDataFrame(rows, "doc_id long, pos int, subword boolean, entity boolean"), 0.2).collect():
        got[r.doc_id][r.pos] = r
    draw = lambda *k: int(hashlib.md5("-".join(map(str, k)).encode()).hexdigest()[:8], 16) / 2**32
    action = lambda u: "mask" if u < 0.8 else "random" if u < 0.9 else "keep"
    seen = Counter()
    for d in got:
        own = [r for r in rows if r[0] == d]
        groups = []
        for _, i, inner, entity in own:
            if inner and groups:
                groups[-1].append((i, entity))
            else:
                groups.append([(i, entity)])
        left = max(1, round(len(own) * 0.2)) - sum(r[3] for r in own)
        want = {r[1]: action(draw("action", d, r[1])) for r in own if r[3]}
        for g in sorted((g for g in groups if not any(e for _, e in g)), key=lambda g: hashlib.md5(f"{d}-{g[0][0]}".encode()).hexdigest()):
            if len(g) <= left:
                left -= len(g)
                want |= {i: action(draw("action", d, g[0][0])) for i, _ in g}
        if not want:
            want = {int(draw("forced", d) * max(1, len(own) - 2)): "mask"}
        assert {i: r.action for i, r in got[d].items() if r.masked} == want
        seen.update(want.values())
    assert len(got) == 31 and seen["mask"] > seen["random"] > 0 and seen["keep"] > 0


def test_small_text_functions(spark):
    from spanforge.functions import text as T

    rows = spark.createDataFrame([("the a’s end–the", "الكتاب الجديد", "我在 北京.", "un Él «la» casa"), ("a", "", "", "LA")], "en string, ar string, zh string, es string")
    got = [tuple(r) for r in rows.select(T.normalize_answer("en"), T.normalize_answer("en", unicode_marks=True), T.normalize_answer("ar", "ar"), T.normalize_answer("zh", "zh"), T.normalize_answer("es", "es")).collect()]
    assert got == [("’s end–", "as endthe", "كتاب جديد", "我 在 北 京", "él casa"), ("", "", "", "", "")]
    r = spark.range(1).select(
        T.needs_prefix_space(T.F.lit("ab cd"), T.F.lit(3)).alias("a"), T.needs_prefix_space(T.F.lit("ab cd"), T.F.lit(1)).alias("b"), T.is_subword(T.F.lit("Ġx"), "bytes").alias("c"), T.is_subword(T.F.lit("x"), "pieces").alias("d"), T.inclusive_positions(T.F.lit(2), T.F.lit(3), 4).alias("e")
    ).first()
    assert tuple(r) == (True, False, False, True, [2, 3, -1, -1])


def test_files_by_kind(spark, tmp_path):
    import pytest

    from spanforge.sources import files, sinks
    from spanforge.operators.vocabulary import abstracts

    (tmp_path / "v.tsv").write_text("[PAD]\t0\nA b\t7\n")
    assert [tuple(r) for r in files.vocabulary(spark, f"file://{tmp_path}/v.tsv").orderBy("id").collect()] == [(0, "[PAD]", None, 0), (1, "A b", None, 7)]
    with pytest.raises(ValueError):
        files.vocabulary(spark, "v.bin")
    assert files.answer_language("/x/dev-context-de-question-en.json") == ("de", True) and files.answer_language("/x/dev-v2.0.json") == ("en", False)
    for i in (1, 2):
        sinks.write_examples(spark.range(3), f"file://{tmp_path}/e{i}", {"longest": i})
    with pytest.raises(ValueError):
        files.example_sets(spark, [f"file://{tmp_path}/e1", f"file://{tmp_path}/e2"], ["longest"])
    assert abstracts(spark.createDataFrame([(True,), (False,), (None,)], "abstract boolean")).count() == 1
