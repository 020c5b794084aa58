"""Dumps, sentences, names of any length, choices and orders against plain versions on small fixtures."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
import regex

from spanforge.operators import disambiguation, linking, names, sampling, sentences
from spanforge.sources import dump

# dumps


def test_paragraphs_of_wikitext(spark):
    text = "\n".join([
        "{{Infobox|a={{b|c={{{1|x}}}}}|d}}'''Japan''' is an [[island country|island]] in [[East Asia]].<ref name=x>no [[link]]</ref><ref name=y />",
        "== Heading ==",
        "[[File:a.png|thumb|a [[Nested|picture]] of [[it]]]]{| class=t",
        "| [[cell]] {| inner |} ",
        "|}",
        "* See [[:Category:Asia]], [[tokyo#History|Tokyo]] and [https://x.y/z the site].<!-- [[hidden]] -->",
        "[[Category:Countries]]",
        "a single ] and { stay, &lt; too",
    ])
    pages = spark.createDataFrame([(1, "Japan", text), (2, "Empty", ""), (3, "Null", None), (4, "Bare", "{{stub}}")], "page_id long, title string, text string")
    got = [(r.page_id, r.paragraph, r.text, [tuple(x) for x in r.links]) for r in dump.paragraphs(pages).orderBy("page_id", "paragraph").collect()]
    assert got == [
        (1, 0, "Japan is an island in East Asia.", [("island", "Island country", 12, 18), ("East Asia", "East Asia", 22, 31)]),
        (1, 1, "See :Category:Asia, Tokyo and the site.", [(":Category:Asia", "Category:Asia", 4, 18), ("Tokyo", "Tokyo", 20, 25)]),
        (1, 2, "a single ] and { stay, < too", []),
    ]
    assert all(t[s:e] == x for _, _, t, links in got for x, _, s, e in links)


def test_dump_in_many_splits(spark, tmp_path):
    path = f"file://{tmp_path}/dump"
    rnd = random.Random(3)
    rows = [(i, 0 if i % 9 else 1, f"T {i} & <x>", f"T {i + 1} & <x>" if i % 7 == 0 else None, "".join(rnd.choice("abc<&\"\n [[x]]") for _ in range(rnd.randrange(0, 3000)))) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, ns int, title string, redirect string, text string")
    dump.write_dump(pages, path, files=2)
    sizes = {}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64m", "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = dump.read_dump(spark, path)
            sizes[size] = got.rdd.getNumPartitions()
            assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sizes["20k"] > sizes["64m"]


def test_redirects_and_meanings(spark):
    rows = [(1, 0, "A", None, "see [[b]] and [[c|C]]"), (2, 0, "B", "C", ""), (3, 0, "D", None, "#REDIRECT [[C#part]]"), (4, 0, "E", None, "{{ Disambig |x}}"), (5, 1, "Talk:A", None, "[[b]]"), (6, 0, "F", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, ns int, title string, redirect string, text string")
    assert sorted(tuple(r) for r in dump.moved_titles(pages).collect()) == [("B", "C"), ("D", "C")]
    assert [r.page_id for r in pages.filter(dump.is_disambiguation()).collect()] == [4]
    assert sorted((r.page_id, r.pos, r.text, r.title) for r in dump.links(pages).collect()) == [(1, 1, "b", "C"), (1, 2, "C", "C")]


# sentences


def spans(spark, text, *args):
    docs = spark.createDataFrame([("p", "en", text)], "page string, lang string, text string")
    return [(r.start, r.end) for r in sentences.sentences(docs, *args).orderBy("sentence").collect()]


def test_sentences_with_characters_beyond_the_plane(spark):
    text = "This is an English sentence. The non-BMP characters 🤩 should be handled properly."
    assert spans(spark, text, "en") == [(0, 29), (29, 81)]
    assert spans(spark, text, "trained") == [(0, 28), (29, 81)]


def plain_breaks(text: str) -> list[tuple[int, int]]:
    """Annex 29's rules for sentences, place by place."""
    kinds = []
    for c in text:
        if c in "\r\n\x85  ":
            k = "P"
        elif c in sentences.STOPS:
            k = "A"
        elif regex.match(f"[{sentences.ENDS}]", c):
            k = "S"
        elif regex.match(r"[\p{Ps}\p{Pe}\p{Pi}\p{Pf}'\"]", c):
            k = "C"
        elif regex.match(r"[\p{Zs}\t\x0B\x0C]", c):
            k = "_"
        elif regex.match(r"\p{Nd}", c):
            k = "N"
        elif regex.match(r"\p{Uppercase}", c):
            k = "U"
        elif regex.match(r"\p{Lowercase}", c):
            k = "L"
        elif regex.match(r"\p{Alphabetic}", c):
            k = "O"
        elif regex.match(f"[{sentences.GOES_ON}]", c):
            k = "G"
        else:
            k = "X"
        kinds.append(k)
    cuts = []
    for i in range(1, len(text)):
        before, here = "".join(kinds[:i]), kinds[i]
        if text[i - 1] == "\r" and text[i] == "\n":
            continue
        if before[-1] == "P":
            cuts.append(i)
            continue
        m = regex.search(r"([AS])(C*)(_*)$", before)
        if not m:
            continue
        if here == "P" or here == "_" or (here == "C" and not m[3]):
            continue
        if here in "GAS":
            continue
        if m[1] == "A":
            if not m[2] and not m[3] and (here == "N" or here == "U" and before[-2:-1] in ("U", "L")):
                continue
            if regex.match(r"[^OULPAS]*L", "".join(kinds[i:])):
                continue
        cuts.append(i)
    return list(itertools.pairwise([0, *cuts, len(text)])) if text else []


def test_sentences_by_the_rules(spark):
    rnd = random.Random(7)
    signs = ["a", "b", "A", "B", "1", ".", ".", "!", "?", " ", " ", "\n", "\r\n", ")", "\"", ",", "日", "。", "-", "«", "3.4", "U.S. "]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(0, 40))) for _ in range(400)] + ["", "He said: \"Go.\" Then left.", "3.4 is. 5 is", "etc.) and so on. (No.) Yes"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(9999, "en", None)], "page int, lang string, text string")
    got: dict[int, list] = {}
    for r in sentences.sentences(docs, "fr").orderBy("page", "sentence").collect():
        got.setdefault(r.page, []).append((r.start, r.end))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_breaks(t), t
    assert 9999 not in got


def test_abbreviations_are_learned_and_heeded(spark):
    parts = ["He met Dr. Smith there. ", "There she saw Dr. Jones again. ", "Again it was late there. ", "Late there sat a cat again."]
    rows = [(i, "en", "".join(parts)) for i in range(40)] + [(99, "de", "Dr. Meier ging. Er kam."), (98, None, "Dr. X. Y")]
    docs = spark.createDataFrame(rows, "page int, lang string, text string")
    known = sentences.abbreviations(docs)
    assert [(r.lang, r.word) for r in known.filter("lang = 'en'").collect()] == [("en", "dr")]
    text = docs.filter("page = 7")
    ends = list(itertools.accumulate(map(len, parts), initial=0))
    assert [(r.start, r.end) for r in sentences.sentences(text, "en", known).orderBy("sentence").collect()] == list(itertools.pairwise(ends))
    assert len(sentences.sentences(text, "ja", known).collect()) == 6  # a locale without abbreviations
    assert [(r.start, r.end) for r in sentences.sentences(text, "trained", known).orderBy("sentence").collect()] == [(a, a + len(p.strip())) for a, p in zip(ends, parts)]


# names


def test_names_of_any_length(spark):
    rnd = random.Random(11)
    words = [rnd.choice("abcde") for _ in range(400)]
    known = {" ".join(words[i : i + n]) for i, n in [(3, 1), (10, 2), (20, 7), (50, 33), (51, 33), (100, 64)]} | {"q", "a  b"[:1]}
    docs = [("p", words), ("q", words[60:90] + [None] + words[90:]), ("e", []), ("n", None), ("p2", words[100:164])]
    frame = spark.createDataFrame(docs, "page string, words array<string>")
    table = spark.createDataFrame([(n,) for n in known] + [("",), ("q",)], "name string")
    want = sorted((p, s, s + n, name) for p, w in docs for name in known for n in [len(name.split(" "))] for s in range(len(w or []) - n + 1) if None not in w[s : s + n] and " ".join(w[s : s + n]) == name)
    assert sorted(tuple(r) for r in linking.name_hits(frame, table).collect()) == want
    assert max(e - s for _, s, e, _ in want) == 64
    assert sorted(tuple(r) for r in linking.name_hits(frame, table, 2).collect()) == [x for x in want if x[2] - x[1] <= 2]
    links, at = [], {}
    for p, s, e, name in sorted(want, key=lambda x: (x[0], x[1], -x[2])):
        if s >= at.get(p, 0):
            links.append((p, s, e, name))
            at[p] = e
    assert sorted(tuple(r) for r in linking.greedy_links(frame, table).collect()) == sorted(links)
    assert names.name_runs(frame, table.limit(0)).collect() == []


# choices and orders


def test_global_choices(spark):
    rnd = random.Random(5)
    rows = [(p, f"m{m}", f"t{rnd.randrange(9)}", rnd.randrange(1, 6)) for p in range(6) for m in range(rnd.randrange(1, 6)) for _ in range(4)]
    topics = [(f"t{i}", f"k{j}") for i in range(9) for j in range(3) if (i + j) % 3 == 0 or rnd.random() < 0.2]
    want = set()
    for p in range(6):
        table: dict[str, dict[str, int]] = {}
        for q, m, t, s in rows:
            if q == p:
                own = table.setdefault(m, {})
                own[t] = max(own.get(t, 0), s)
        for n in itertools.count(1):
            if not table:
                break
            _, m, t = min((-s / sum(own.values()), m, t) for m, own in table.items() for t, s in own.items())
            want.add((p, m, t, table.pop(m)[t], n))
            for own in table.values():
                for other in own:
                    own[other] += 3 * len({k for x, k in topics if x == other} & {k for x, k in topics if x == t})
    got, rounds = disambiguation.global_choices(spark.createDataFrame(rows, "page int, mention string, title string, score int"), spark.createDataFrame(topics, "title string, topic string"), 3)
    assert {tuple(r) for r in got.collect()} == want and rounds == max(x[4] for x in want)
    none, rounds = disambiguation.global_choices(spark.createDataFrame([], "page int, mention string, title string, score int"), spark.createDataFrame(topics, "title string, topic string"))
    assert none.collect() == [] and rounds == 0


def test_drawn_order(spark):
    sizes, rates = {"a": 400, "b": 150, "c": 1}, {"a": 0.6, "b": 0.3, "c": 0.1}
    rnd = random.Random(2)
    u = {(d, k): rnd.random() for d, n in sizes.items() for k in range(n)}
    rows = spark.createDataFrame([(d, k, x) for (d, k), x in u.items()] + [("none", 1, 0.5)], "dataset string, key int, u double")
    table = spark.createDataFrame(list(rates.items()), "dataset string, rate double")
    at, times = dict.fromkeys(sizes, 0), []
    for (d, k), x in sorted(u.items()):
        at[d] += math.floor(-math.log(x) * sampling.STEPS / rates[d])
        times.append((at[d], d, k))
    want = [(d, k) for _, d, k in sorted(times)]
    got = [(r.dataset, r.key) for r in sampling.drawn_order(rows, table, "key", chance=rows["u"]).orderBy("place").collect()]
    assert got == want
    # by seeds: each dataset in order of its keys, and about by rate while none is used up
    got = [(r.dataset, r.key, r.place) for r in sampling.drawn_order(rows.drop("u"), table, "key", seed=4).orderBy("place").collect()]
    assert [p for *_, p in got] == list(range(551))
    assert all([k for d, k, _ in got if d == x] == list(range(n)) for x, n in sizes.items())
    first = [d for d, *_ in got[:300]]
    assert 0.5 < first.count("a") / (first.count("a") + first.count("b")) < 0.8


def plain_buffer(rows, size, seed, part):
    rng = np.random.default_rng([seed, part])
    held, out = rows[:size], []
    if len(rows) > size:
        for row, slot in zip(rows[size:], rng.integers(0, size, len(rows) - size).tolist(), strict=True):
            out.append(held[slot])
            held[slot] = row
    return out + [held[i] for i in rng.permutation(len(held))]


@pytest.mark.parametrize(("n", "size"), [(0, 3), (2, 3), (50, 1), (50, 7), (50, 50), (50, 200)])
def test_shuffle_buffer(spark, n, size):
    rows = spark.range(n).coalesce(1).selectExpr("id", "cast(id as string) as t")
    want = plain_buffer(list(range(n)), size, 3, 0)
    assert [r.id for r in sampling.shuffle_buffer(rows, size, 3).collect()] == want
    assert [r.t for r in sampling.shuffle_buffer(rows, size, 3, skip=4, workers=3, worker=2).collect()] == [str(x) for x in want[4:][2::3]]
    with pytest.raises(ValueError):
        sampling.shuffle_buffer(rows, 0)
