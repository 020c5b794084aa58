"""Substring deduplication, collocations and token alignment against plain versions, with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest

from spanforge.llm import alignment, collocations, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# substrings


def plain_dedup(rows, length):
    starts = collections.defaultdict(set)
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    for (i, *_), w in zip(rows, words, strict=True):
        if i is not None:
            for p in range(len(w) - length + 1):
                starts[tuple(w[p : p + length])].add(i)
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = set()
        if i is not None:
            for p in range(len(w) - length + 1):
                if min(starts[tuple(w[p : p + length])]) < i:
                    gone |= set(range(p, p + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept)), " ".join(kept)))
    return out


def passages(seed: int, n: int, length: int) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("uvwxyz") + rnd.choice("klm")
    shared = [[word() for _ in range(rnd.randrange(length - 2, 3 * length))] for _ in range(6)]
    rows: list[tuple] = []
    for i in range(n):
        w: list[str] = []
        for _ in range(rnd.randrange(0, 5)):
            w += [word() for _ in range(rnd.randrange(0, length))]
            if rnd.random() < 0.7:
                own = rnd.choice(shared)[rnd.choice([0, 0, 3]) :]
                if rnd.random() < 0.3:
                    own = list(own)
                    own[rnd.randrange(len(own))] = "edit"
                w += own[: rnd.choice([None, None, length, length + 1])]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "z " * 400), (n + 4, "z\t" * 300), (n + 5, "z y " * 200), (None, rows[3][1]), (None, rows[4][1]), (2, rows[5][1]), rows[6], (-5, rows[7][1]), (n + 6, rows[8][1]), (n + 7, rows[8][1]), (n + 8, "z " * (length - 1))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 50), (3, 7)])
def test_substrings(spark, seed, length):
    rows = passages(seed, 60, length)
    docs = spark.createDataFrame([(i, t, "x", 7, [1]) for i, t in rows], "doc_id long, text string, mark string, start int, runs array<int>")  # columns that clash
    want = plain_dedup(rows, length)
    got = [tuple(r) for r in substrings.dedup_substrings(docs, length=length).collect()]
    assert sorted(got, key=repr) == sorted((w[:4] for w in want), key=repr)
    assert sum(w[2] > 0 for w in want) > 20 and any(0 < w[2] < w[1] for w in want)
    kept = sorted((r.doc_id, r.text) for r in substrings.without_repeats(docs, length=length).filter("doc_id is not null and text is not null").collect())
    assert kept == sorted((i, k if n else t) for (i, t), (_, _, n, _, k) in zip(rows, want, strict=True) if i is not None and t is not None)


def test_spans_lie_at_their_source(spark):
    rows = [r for r in passages(4, 50, 50) if r[0] is not None]
    first = dict(reversed(rows))
    rows = list(first.items())
    words = {i: WORD.findall(t or "") for i, t in rows}
    removed = {w[0]: w[2] for w in plain_dedup(rows, 50)}
    covered = collections.defaultdict(set)
    for r in substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.source < r.doc_id and r.n_words >= 50
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.source][r.source_start : r.source_start + r.n_words]
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    assert {i: len(c) for i, c in covered.items()} == {i: n for i, n in removed.items() if n}


def test_substrings_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup_substrings(none).collect() == [] and substrings.repeated_spans(none).collect() == []


def test_anchors_by_numpy():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 41):
        assert substrings.leftmost_least(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]
    hashes = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    hashes[200:240] = hashes[20:60]
    one = substrings.Rolling(hashes)
    assert (one.spans(np.array([20, 25]), 20) == one.spans(np.array([200, 205]), 20)).all() and len(np.unique(one.spans(np.arange(0, 180), 20))) == 180


# collocations


def plain_collocations(rows, least, top):
    count = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    count[lang if lang is not None else "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(100 * b >= 80 * a for q, b in found.items() if inside(q)):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "block"), [(3, 2000, 1 << 20), (30, 5, 2000)])
def test_collocations(spark, least, top, block):
    rnd = random.Random(least)
    phrases = ["new york", "New York City", "the", "of the", "straße é", "a b c d", "x", "x x x", "state\tof  the art"]
    rows = [("".join(rnd.choice(phrases) + rnd.choice([" ", " ", ", ", ".\n", " ! "]) for _ in range(rnd.randrange(0, 60))), rnd.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("x " * 3000, "fr"), (" .,; ", "en"), rows[0], rows[0]]
    docs = spark.createDataFrame([(t, x, "id", 1) for t, x in rows], "text string, lang string, word string, n int")  # columns that clash
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top, block=block).collect())
    assert got == plain_collocations(rows, least, top) and len(got) > 5


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_a_full_sieve_loses_nothing(spark, monkeypatch):
    rows = [(f"a b c d e{i % 3}", "en") for i in range(40)]
    monkeypatch.setattr(collocations, "_passes", lambda bits, keys: np.ones(len(keys), bool))
    got = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5).collect())
    assert got == plain_collocations(rows, 5, 2000)


# alignment


def plain_alignment(texts, a_path=alignment.BYTE_BPE, b_path=alignment.PIECES):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    sign = alignment.byte_of_sign()
    with open(a_path) as f:
        entry = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    docs = []
    for text in texts:
        raw = (" " + text).encode() if text else b""
        a = [(i, bytes(sign[c] for c in entry[i])) for i in a_model.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in b_model.encode(text) if text else []:
            p = b_model.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        spans = []
        for side in (a, b):
            ends = list(itertools.accumulate(len(x) for _, x in side))
            spans.append([(e - len(x), e, i) for (i, x), e in zip(side, ends, strict=True)])
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        groups, left = [], [[], []]
        for e in sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}):
            groups.append("|".join(",".join(str(i) for s, t, i in side if t <= e and t > (left[0] or [0])[-1]) for side in spans))
            left[0].append(e)
        docs.append((len(a), len(b), groups, links))
    held = collections.Counter(p for *_, links in docs for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(na, nb, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha(";".join(g)) if g else "") for na, nb, g, links in docs]


TEXTS = [None, "", " ", "  ", "a", "Hello world", " leading", "two  spaces\n\nand\tlines ", "<|endoftext|> and <s> </s> <unk>", "naïve café ﬁ½　x", "日本語のテキスト です", "🤩 ok 🤩🤩", "a▁b", "x\x00y z", "don't we'll I'm", "tab\t tab \t", " nbsp  x y", "1234567 89.5", "a" * 3000, "word " * 500, "Hello world", "é" * 40 + " é"]


@pytest.mark.parametrize("head", [1 << 20, 5, 0])
def test_alignment(spark, head):
    rnd = random.Random(3)
    texts = TEXTS + [" ".join(rnd.choice(["the", "anthropology", "Größe", "x1", "über-", "(a)", "日本", "\n"]) for _ in range(rnd.randrange(1, 40))) for _ in range(30)]
    docs = spark.createDataFrame([(None if i % 11 == 5 else i, t, i, [i]) for i, t in enumerate(texts)], "doc_id long, text string, row int, a array<int>")  # columns that clash
    got = [tuple(r) for r in alignment.align_tokens(docs, head=head).collect()]
    want = [(None if i % 11 == 5 else i, *x) for i, x in enumerate(plain_alignment(texts))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {w[0] for w in want if w[1] == 0} >= {0, 1, 12}


def test_groups_and_their_products(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in alignment.alignments(docs).orderBy("doc_id", "start").collect():
        got[r.doc_id].append(r)
        assert [tuple(p) for p in r.pairs] == list(itertools.product(r.a_ids, r.b_ids))
    for i, (_, _, n, _, _, _, digest) in enumerate(plain_alignment(TEXTS)):
        assert len(got[i]) == n
        assert (sha(";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in got[i])) if n else "") == digest
        assert all(a.stop == b.start for a, b in itertools.pairwise(got[i]))


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_head_is_bounded(spark):
    counts = spark.createDataFrame([(i, i, n) for i, n in enumerate([1, 1, 1, 2, 3, 4, 4, 7, 9])], "a int, b int, docs long")
    for head in range(11):
        least = alignment._head_from(counts, head)
        assert sum(n >= least for n in [1, 1, 1, 2, 3, 4, 4, 7, 9]) <= max(head, 0) if least else head >= 9
