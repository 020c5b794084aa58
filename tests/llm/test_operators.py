"""Each operator against a plain version on small fixtures, with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import licenses, lm, mixing, neighbours, ngram_join, pieces, pii, quality, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def texts(seed: int, n: int = 60) -> list[str | None]:
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(60)) for _ in range(4)]
    out: list[str | None] = [None, "", " \t\n", "a b", "a\tb", "é ü\n" * 20, "z " * 3000]
    for _ in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = f"q{rnd.randrange(30)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts(1))) + [(None, texts(1)[8]), (5, texts(1)[5])]
    return rows, spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, sid string, size long")  # columns that clash


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_by_numpy():
    from spanforge.llm.words import hash_spans, words_of

    column = pa.array(["", "a  b\x0bc", " é x ", "b"])
    w = words_of(column)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == ["a", "b", "c", "é x", "b"]
    h = w.hashes()
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    assert w.first.tolist() == [0, 0, 3, 4, 5]
    assert len(hash_spans(w.data, w.starts[:0], w.ends[:0])) == 0


def test_license_scan(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{body} Licensed under the Apache License, Version 2.0. {body}"), (2, "released UNDER the mit-license"), (3, body), (4, None), (5, ""), (6, licenses.TEMPLATES[3][1].replace("publish", "print")), (2, "other text of the same document here"), (7, f"x {licenses.TEMPLATES[7][1]} y")]
    got = {(r.doc_id, r.license) for r in licenses.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, "apache-2.0"), (2, "mit"), (6, "mit"), (7, "cc-by-nc-4.0")}
    assert licenses.license_scan(empty(spark)).count() == 0
    more = spark.createDataFrame([(None, licenses.TEMPLATES[2][1], 1, "x", "y"), (None, None, 2, "x", "y")], "doc_id long, text string, template int, hash string, license string")  # columns that clash
    assert [tuple(r)[:5] for r in licenses.license_scan(more).collect()] == [(None, "mit", 2, 1, 1)]
    with pytest.raises(ValueError):
        licenses.license_scan(more, templates=[("x", "four words are few")])
    assert licenses.license_scan(more, templates=[]).count() == 0


def test_license_recall_over_offsets(spark):
    rows = [(i, " ".join(f"v{i}x{j}" for j in range(i)) + " " + text + " end of it") for i, (_, text) in enumerate(licenses.TEMPLATES * 4)]
    found = {(r.doc_id, r.template) for r in licenses.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {(i, i % len(licenses.TEMPLATES)) for i in range(len(rows))} <= found


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, None if i == 3 else "w " * rnd.randrange(0, 300), [None, "b", "a", "é", "c"][i % 5] if i % 3 else "a") for i in range(400)] + [(7, "w w", "tiny"), (7, "w w", "tiny"), (None, "w", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_words=5000).toPandas()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in size if s is not None], key=lambda s: s.encode()) + [None]
    left, target, weight = sum(size.values()), {}, {s: i % 3 + 1 for i, s in enumerate(order)}
    while True:
        free = [s for s in order if s not in target]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for s in order:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert own.source_size.unique().tolist() == [size[s]] and own.target.iloc[0] == pytest.approx(target[s])
        assert own.taken.sum() == pytest.approx(target[s], rel=0.02, abs=3)
        assert s != "tiny" or own.taken.sum() == 12
    again = mixing.mix(df.repartition(7), shard_words=5000).toPandas()
    key = lambda f: sorted(map(str, f[["doc_id", "size", "taken"]].itertuples(index=False)))
    assert key(got) == key(again)
    whole = mixing.mixed_documents(df, shard_words=5000)
    assert sum(len(WORD.findall(r.text)) for r in whole.collect()) == got.taken.sum()
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def _greedy(weights: list[int], seats: int) -> list[int]:
    have = [0] * len(weights)
    for _ in range(seats):
        have[max(range(len(weights)), key=lambda i: (weights[i] / (2 * have[i] + 1), -i))] += 1
    return have


def test_mix_by_blocks(spark):
    """Quotas of sources and shards by the plain loop with blocks of 256 words, and just the words of the runs."""
    rnd = random.Random(11)
    rows = [(i, " ".join(f"{i}.{j}" for j in range(rnd.randrange(0, 900))) + " ", "abc"[min(2, i % 7)], len(str(i)), "x") for i in range(300)]
    rows += [(7000, "q " * 700, "a", 1, "x")] * 5 + [(None, None, "b", 1, "x"), (None, "only words\n here", None, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, size string")  # columns that clash
    sized = df.select("doc_id", "source", mixing.word_count().alias("size"), mixing.F.xxhash64("text").alias("mark"))
    sources, shards = mixing.shard_quotas(sized, 17, 256, 20_000)
    own = sorted(sources.collect(), key=lambda r: (r.source is None, r.source or ""))
    total = sum(r.source_size for r in own)
    least = _greedy([r.target for r in own], total // 256)
    assert [r.quota for r in own] == least
    for r in own:
        parts = sorted((x for x in shards.collect() if x.source == r.source), key=lambda x: x.shard)
        assert len(parts) <= r.n_shards and [x.quota for x in parts] == _greedy([x.shard_size for x in parts], r.quota)
        assert sum(x.passes * x.shard_size + x.length for x in parts) == pytest.approx(r.target, rel=0.01, abs=1)
    got = mixing.mix(df, shard_words=20_000).toPandas()
    mixed = mixing.mixed_documents(df, shard_words=20_000)
    assert mixed.schema == df.schema
    words, back = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        found = WORD.findall(r.text)
        assert r.text.strip(" \n") and found and (r.text in {t for _, t, *_ in rows} or (r.n_chars == len(r.text) and r.text == r.text.strip()))
        back[r.source] += len(found)
        words.update(w for w in found if "." in w)
    for source, n in back.items():
        assert n == pytest.approx(next(r.target for r in own if r.source == source), rel=0.01, abs=1)
    assert sum(back.values()) == got.taken.sum()
    # each document's words in the run are in sequence, cut at most at the ends of runs
    cut = sum(len({words[f"{i}.{j}"] for j in range(len(WORD.findall(t or "")))}) > 1 for i, t, *_ in rows if i is not None and i < 300)
    assert 0 < cut <= 2 * sum(1 for _ in shards.collect())


def test_sainte_lague(spark):
    rnd = random.Random(5)
    weights = [rnd.choice([0, 1, 5, 5, 40, 333]) for _ in range(30)]
    df = spark.createDataFrame([(i, w, s) for s in (1, 17, 100, 1001) for i, w in enumerate(weights)], "k int, w long, seats long")
    got = collections.defaultdict(dict)
    for r in mixing.sainte_lague(df, ["seats"], "w", "seats", "k", "n").collect():
        got[r.seats][r.k] = r.n
    for seats in (1, 17, 100, 1001):
        have = _greedy(weights, seats)
        assert [got[seats][i] for i in range(len(weights))] == have


@pytest.fixture(scope="module")
def unigram_model(tmp_path_factory):
    """The public pieces as a unigram model with finite scores, so that the library runs Viterbi over the same table."""
    spm_pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = spm_pb.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_pieces_equal_the_library(unigram_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=unigram_model)
    encoder = pieces.Encoder(pieces.load(unigram_model))
    rnd = random.Random(6)
    some = ["", " ", "  a  b ", "The cat, 2.0\nsat!", "x" + " " * 20 + "y"] + ["".join(rnd.choice("the and ofin%& é.\n") for _ in range(80)) for _ in range(300)]
    ids, offsets = encoder.encode(some)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [library.encode(t) for t in some]


def test_pieces_round_trip(spark):
    rows = [(1, "🤩é龘\x00 a"), (1, "🤩é龘\x00 a"), (2, None), (3, ""), (None, "  two  spaces\n"), (4, "nospace" * 3000), (5, "a b " * 4000)]
    got = pieces.round_trip(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r.same and r.n_tokens == len(r.token_ids) for r in got)
    assert pieces.round_trip(empty(spark)).count() == 0
    back = pieces.decode(pieces.encode(spark.createDataFrame(rows, DOCS), keep=("text",)), keep=("text",)).collect()
    assert len(back) == len(rows) and all(r.decoded == r.text for r in back)


def _suffix_brute(w: list[str], least: int) -> tuple[int, int, int]:
    covered, longest, found = set(), 0, set()
    n = len(w)
    lcp = [[0] * (n + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, i, -1):
            lcp[i][j] = lcp[i + 1][j + 1] + 1 if w[i] == w[j] else 0
            if (k := lcp[i][j]) >= least:
                covered |= {*range(i, i + k), *range(j, j + k)}
                longest = max(longest, k)
                if i == 0 or w[i - 1] != w[j - 1]:
                    found.add(tuple(w[i : i + k]))
    return len(covered), longest, len(found)


def test_quality_by_brute_force():
    rnd = random.Random(1)
    some = ["", "  ", "a", "a a a a a a a a", "x y\nx y\n\nx y\n", "\n\n", "é|ü\r\nq\r\nq\r\n"] + ["".join(rnd.choice("ab \n|é#") for _ in range(rnd.randint(0, 300))) for _ in range(150)]
    got = quality.measure(pa.array(some), 2, 0.3, 0.2)
    for i, t in enumerate(some):
        w, lines, grams, covered = WORD.findall(t), t.split("\n"), collections.defaultdict(list), set()
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].append(k)
        for places in grams.values():
            if len(places) > 1:
                covered |= {p + d for p in places for d in range(3)}
        dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), *_suffix_brute(w, 2))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_repeats")) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert got["base_failed"][i] == failed and got["kept"][i] == (not failed and want[5] <= 0.3 * len(w) and want[6] <= 0.2 * len(w))


def test_quality_rows(spark, docs):
    rows, df = docs
    got = quality.quality(df).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in quality.keep_good(df).collect()}
    assert quality.quality(empty(spark)).count() == 0


def _brute_neighbours(rows, k=20):
    """By (query's place in rows): its k nearest as (vec_id, score), among all other rows of as many components."""
    sound = {n: np.array(v, float) for n, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for n, q in sound.items():
        if (i := rows[n][0]) is not None and i % 20 == 0:
            far = [((-float((q * v).sum()), rows[m][0] is None, rows[m][0] or 0), rows[m][0]) for m, v in sound.items() if m != n and len(v) == len(q)]
            out[n] = [(i, -key[0]) for key, i in sorted(far)[:k]]
    return out


def test_nearest(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(600, 12))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 12), (740, [float("nan")] + [1.0] * 11), (760, [None] + [1.0] * 11), (780, [1.0, 2.0])]
    rows += [(0, x[0].tolist()), (40, x[3].tolist()), (7, (2 * x[9]).tolist()), (None, (3 * x[9]).tolist()), (None, (3 * x[9]).tolist())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row int, rank int")  # columns that clash
    got = collections.Counter()
    for r in neighbours.nearest(df, factor=1.0, shard_rows=150, pass_queries=11).collect():
        got[r.query_id, r.rank, r.vec_id, round(r.score, 9)] += 1
    want = collections.Counter()
    for n, found in _brute_neighbours(rows).items():
        want.update((rows[n][0], rank, i, round(s, 9)) for rank, (i, s) in enumerate(found, 1))
    assert got == want and sum(want.values()) == 32 * 20
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_nearest_keeps_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.1])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 0.9), (0, 2, 1, 0.5)]


def test_vantage_tree_of_equal_distances():
    x = np.eye(3000)
    tree = neighbours.VantageTree(x, 1.0)
    q = x[:7] * 2.0
    found, *_ = tree.search(q, 3, 1.0)
    assert [max(f, key=lambda i: q[n] @ x[i]) for n, f in enumerate(found)] == list(range(7))
    leaves = [n[0] for n in tree.nodes if len(n) == 1]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(map(len, leaves)) <= neighbours.LEAF


@pytest.mark.parametrize(("n", "factor", "scale"), [(60, 1.0, 1.0), (200, 0.2, 1.0), (200, 1.0, 1e160), (700, 1.0, 0.3), (3000, 1.0, 1.0)])
def test_nearest_breaks_ties_by_id(spark, n, factor, scale):
    width = min(n, 200)
    x = np.zeros((n, width))
    x[np.arange(n), np.random.default_rng(1).integers(0, width, n)] = scale
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    np.random.default_rng(n).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df.repartition(4), factor=factor, shard_rows=1500).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, n, 20):
            score = (x[i] * x).sum(axis=1)
            want = [(int(j), float(score[j])) for j in np.lexsort((np.arange(n), -score)) if j != i][:20]
            assert got[i] == want


@pytest.mark.parametrize("shard_rows", [neighbours.SHARD_ROWS, 1000])
def test_nearest_recall(spark, shard_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    x, ids = np.stack(pdf.embedding.to_list()).astype(float), pdf.vec_id.to_numpy()
    got = neighbours.nearest(df, shard_rows=shard_rows).toPandas().groupby("query_id").vec_id.apply(set)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
        total += 20
    assert hits / total >= 0.95


def test_warc(spark):
    big = "<p>é" * 400
    noise = "".join(chr(32 + (i * 7919) % 90) for i in range(200_000))
    rows = [(1, "http://a b", big), (5, None, big), (3, "x", None), (4, "y", ""), (None, "z", big), (9, "s", "short"), (8, "s", "short"), (5, "dup", big), (7, "r", noise), (6, "m", "\x1f\x8b\x08 magic" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for split in (64, 1000, 1 << 20):
        got = warc.round_trip(df, split_bytes=split).collect()
        want = []
        for i, _, h in rows:
            raw = (h or "").encode()
            revisit = h == big and i != 5
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 300) for i in range(30)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    read = warc.read_warc(warc.archives(spark, f"file://{tmp_path}/w"), split_bytes=700)
    assert sorted(bytes(r.payload).decode() for r in read.collect()) == sorted(h for _, _, h in rows)
    assert read.filter("declared_digest <> payload_digest").count() == 0


def test_lm(spark, docs):
    rows, df = docs
    got = collections.defaultdict(list)
    for r in lm.score_texts(df).collect():
        got[r.doc_id].append(r)
    other = {(r.doc_id, round(r.score, 9), round(r.base_score, 9), r.n_known) for r in lm.score_texts(df, broadcast_bytes=-1, segment_bytes=2000).collect()}
    same = {(r.doc_id, round(r.score, 9), round(r.base_score, 9), r.n_known) for r in lm.score_texts(df, segment_bytes=2000).collect()}
    assert other == same
    tokens = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), n) and abs(r.base_score - base) < 1e-6 and r.score < 0 for r in got[i])
    assert lm.score_texts(empty(spark)).count() == 0


def test_lm_messages_go_to_groups_of_segments(spark, docs, monkeypatch):
    import numpy as np

    from spanforge.llm import common

    assert [lm.group_bits(b) for b in (0, 3, 6, 8, 10, 12, 14)] == [0, 3, 6, 6, 6, 8, 10]
    # a message for each group of sorted keys, and each segment's keys in one of them
    keys = np.sort(lm.mix(np.arange(5000, dtype=np.uint64)))
    assert len(lm._by_segment(keys, lm.group_bits(12))) == 256 and len(lm._by_segment(keys, 12)) > 2500
    raw = {s: lm.Filter.build(keys[a:b], np.arange(a, b) % 9 + 1) for s, a, b in lm._by_segment(keys, 12)[100:116]}
    asked = np.concatenate([keys[a:b] for s, a, b in lm._by_segment(keys, 12)[90:130]])
    alone = [lm.Filter.single(12, s, raw[s]).levels(np.array([k]))[0] if (s := int(k >> np.uint64(52))) in raw else 0 for k in asked]
    assert lm.Filter.several(12, raw).levels(asked).tolist() == alone and any(alone)
    # hundreds of segments, few groups and buckets: the same scores, and no texts are written or shuffled twice
    _, df = docs
    n = len(common._written)
    monkeypatch.setattr(lm, "LEAST_GROUPS", 2)
    far = lm.score_texts(df, broadcast_bytes=-1, segment_bytes=200)
    rows = sorted((repr(r.doc_id), round(r.score, 9), round(r.base_score, 9), r.n_known, r.held_out) for r in far.collect())
    assert "ReusedExchange" in far._jdf.queryExecution().executedPlan().toString()
    assert [p.rpartition("/")[2][:9] for p in common._written[n:]] == ["lm-counts"]
    assert rows == sorted((repr(r.doc_id), round(r.score, 9), round(r.base_score, 9), r.n_known, r.held_out) for r in lm.score_texts(df, segment_bytes=200).collect())


def test_lm_scores_by_a_plain_model(spark):
    """Counts of pairs by a dictionary, quantised as the filter's levels are; the filter adds rare false hits only."""
    rnd = random.Random(21)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnop") * rnd.choice([1, 1, 2]) for _ in range(rnd.randrange(0, 120)))) for i in range(400)] + [(None, "A b"), (9, None)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [*(t or "").lower().split(), "</s>"]
    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = words(t)
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    least = lambda c: math.ceil(round(lm.B ** math.floor(math.log(c, lm.B) + 1e-9), 9)) if c else 0

    def score(t):
        total = 0.0
        for h, w in zip(["<s>", *words(t)[:-1]], words(t), strict=True):
            before = one["</s>"] if h == "<s>" else one[h]
            base = (one[w] + 0.1) / (n + 0.1 * (v + 1))
            total += math.log10((min(least(two[h, w]), before) + lm.BETA * base) / (before + lm.BETA))
        return total

    got = sorted((r.score for r in lm.score_texts(spark.createDataFrame(rows, DOCS)).collect()))
    want = sorted(score(t) for _, t in rows)
    gaps = [abs(a - b) / abs(b) for a, b in zip(got, want, strict=True)]
    assert max(gaps) < 0.03 and sum(gaps) / len(gaps) < 0.003


def test_lm_filter_levels():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = rnd.choice([1, 2, 3, 10, 1000], len(keys))
    f = lm.Filter.single(0, 0, lm.Filter.build(keys, counts))
    level = f.levels(keys)
    assert (lm.LEAST_OF_LEVEL[level] >= np.where(counts < 5, counts, counts / lm.B)).all()
    assert (lm.LEAST_OF_LEVEL[level] > counts).mean() < 0.02
    assert (f.levels(rnd.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.02


def test_lm_beats_unigrams_on_held_out_texts(spark):
    got = lm.score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score > got.base_score).mean() > 0.8


def _classes(rows):
    def grams(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    s, n = [grams(t) for _, t in rows], len(rows)
    links, up = [0] * n, list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    members = collections.defaultdict(list)
    for i in range(n):
        members[top(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], least[top(i)] if links[i] else rows[i][0], links[i]) for i in range(n)), key=repr)


@pytest.mark.parametrize("members", [1024, 7])
def test_ngram_join(spark, docs, members, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
    rows, df = docs
    assert sorted((tuple(r) for r in ngram_join.jaccard_join(df).collect()), key=repr) == _classes(rows)


def test_ngram_join_edges(spark, docs):
    rows, df = docs
    assert ngram_join.jaccard_join(empty(spark)).count() == 0
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len({c for i, c, n in _classes(rows) if n}) + sum(not n for _, _, n in _classes(rows))
    bands, per = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**per) ** bands >= 0.999


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _spans(t):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if not (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    rnd = random.Random(3)
    parts = ["a@b.c", "_d@e.f-g", " ", "+1 (386) 555-3733", "4041894974608795", "4041 8949 7460 8795", "1.2.3.4.5", "300.1.1.1", "007.0255.1.2", "é🤩", "@", "..", "-", "x", "12", "\n", "+12.34(5)67890 ", "0"]
    some = [None, "", "1" * 5000, "a" * 5000 + "@", "a@" * 50] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    some += [f"phone: +1 (386) 555-37{i:02d} ok" for i in range(8)] + ["phone: 386-555-9911 ok", "size: 386-555-1212 ok"]
    df = spark.createDataFrame(list(enumerate(some)), DOCS)
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, t in enumerate(some):
        want = _spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
    assert {i: r.spans for i, r in got.items() if r.n_found} == {len(some) - 2: "phone:7:19"}
    hidden = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert hidden[len(some) - 2] == "phone: <phone> ok" and hidden[0] is None and hidden[1] == "" and hidden[len(some) - 1] == some[-1]
    assert pii.find_pii(empty(spark)).count() == 0


def test_token_counts_follow_edits():
    c = token_counts.Counter(token_counts.load_ranks())
    rnd = random.Random(4)
    signs = ["a", "bc", " ", "  ", "\n", "\n\n", "'", "'s", "1", "23", "!", "é", "🤩", " ", "龘", "x'll", "."]
    some = lambda n: "".join(rnd.choice(signs) for _ in range(n))
    for _ in range(1500):
        text = some(rnd.choice([0, 1, 2, 5, 15, 40, 120]))
        tree = c.trees([text])[0]
        for _ in range(3):
            at = sorted(rnd.randint(0, len(text)) for _ in range(2 * rnd.choice([0, 1, 1, 2, 3])))
            edits = [(a, b, some(rnd.choice([0, 0, 1, 2, 5]))) for a, b in zip(at[::2], at[1::2], strict=True)]
            (text,), _ = token_counts.apply_all([tree], [text], [edits], c.pattern, c.count)
            assert tree.total == len(c.coding.encode_ordinary(text)) and tree.sums[0, 1] == len(text)


def test_token_counts_rows(spark):
    rows = [(None, None), (1, ""), (1, "hey!!! a@b.co x"), (2, "word " * 5000)]
    got = token_counts.edit_counts(spark.createDataFrame(rows, DOCS)).toPandas()
    c = token_counts.Counter(token_counts.load_ranks())
    want = [len(c.coding.encode_ordinary(t)) for t in ("<doc>", "<doc>", "<doc>hey! <email> x", "<doc>" + "word " * 5000)]
    assert sorted(got.n_tokens) == sorted(want) and got.n_again.max() < 200
    assert token_counts.edit_counts(empty(spark)).count() == 0


def test_kept_trees(spark):
    from pyspark.sql import functions as F

    rows = [(1, "one two  three"), (2, None), (None, "x" * 100), (3, "")]
    trees = token_counts.build_trees(spark.createDataFrame(rows, DOCS))
    edits = F.expr("array(named_struct('start', 4L, 'end', 7L, 'text', 'twenty-two'), named_struct('start', 0L, 'end', 0L, 'text', null))")
    c = token_counts.Counter(token_counts.load_ranks())
    once = token_counts.update_trees(trees.withColumn("edits", edits))
    for _ in range(2):  # the second time over trees that have edits behind them
        got = once.collect()
        assert len(got) == 4 and all(r.n_tokens == len(c.coding.encode_ordinary(r.text)) and r.n_edits == 2 for r in got)
        once = token_counts.update_trees(once.withColumn("edits", edits))


def test_pipeline(spark):
    import corpus_pipeline

    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, frame, "")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(frame).filter("kept").collect()}
    one = corpus_pipeline.near_duplicates(spark, kept, "")
    classes = _classes([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c, _ in classes})
    hidden = corpus_pipeline.personal_data(spark, one, "")
    for r in pii.find_pii(hidden).collect():
        assert not (r.n_email or r.n_phone or r.n_ip)
    mixed = corpus_pipeline.mix_sources(spark, hidden, "")
    assert mixed.columns == frame.columns
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert last.same.all() and len(last) == mixed.count()


def test_pipeline_stages_of_odd_rows(spark):
    """Each stage over nulls, empty and long texts, repeated rows, clashing columns and nothing at all."""
    import corpus_pipeline

    rnd = random.Random(31)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(5)) for _ in range(n))
    rows = [(i, prose(80) + " mail me.at@x.org", ["en", None][i % 2], ["web", "book", None][i % 3], 7) for i in range(30)]
    rows += [(100, None, None, None, None), (None, "", "en", "web", 0), (101, " \n", "en", "web", 2), (None, prose(90), "en", None, 9), (102, prose(6000), "de", "web", 1), (103, "z" * 30_000, "en", "web", 1)]
    rows += [rows[3], rows[3], rows[4]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    for docs in (frame, frame.limit(0)):
        left = sum(1 for _ in docs.collect())
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            found = out.collect()
            assert bool(found) == bool(left) or name == "quality_rules"
            if name != "to_pieces":
                assert out.schema.simpleString() == frame.schema.simpleString()
                docs = spark.createDataFrame(found, frame.schema) if found else docs.limit(0)
            else:
                assert all(r.same for r in found)
    more = spark.createDataFrame([(1, prose(60), "s", "x", 3, "y")], "doc_id long, text string, source string, size string, target long, shard string")  # columns that clash
    for call in (mixing.mixed_documents, pii.masked, ngram_join.keep_one, quality.keep_good):
        assert [tuple(r) for r in call(more).collect()] == [tuple(r) for r in more.collect()], call


@pytest.mark.parametrize("hub", [1000, 3])
def test_components(spark, hub, monkeypatch):
    from spanforge.llm import components

    monkeypatch.setattr(components, "HUB", hub)
    rnd = random.Random(9)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 200 + i) for i in range(1, 20)]
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    want = {x: top(x) for p in pairs if p[0] != p[1] for x in p}
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


def test_pii_context_runs_over_other_hits(spark):
    seeds = [f"phones: +1 386 555-37{i:02d} and tel2: +1 386 555-38{i:02d} end" for i in range(8)]
    some = seeds + ["tel2: 386-555-9911 end", "phones: 386-555-9912, 386-555-9913", "phones: (386) 555-9914 and so on", "size: (386) 555-9915 end"]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(some)), DOCS)).collect()}
    assert {i: r.spans for i, r in got.items() if r.n_found} == {8: "phone:6:18", 9: "phone:8:20", 10: "phone:8:22"}
    text = " ".join(f"w{i}" for i in range(60)) + "\t12 345 678\n9a"
    df = spark.createDataFrame([(text,)], "text string")
    for kind in pii.PATTERNS:
        turns = df.select(pii._hits(kind, pii.F.lit(True)).alias("h")).first().h
        at = 0
        for t in turns:
            at += t.gap
            if t.match is not None:
                assert text[at : at + len(t.match)] == t.match and t.tail == text[max(0, at - 80) : at]
                assert t.head == text[at + len(t.match) :][:80]
                at += len(t.match)


def test_ngram_join_recall_on_tables(spark):
    """All links of the smallest tables' documents by the plain count, near copies in large groups, and a bucket whose sets differ from its head."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in frame.collect()]
    rnd = random.Random(14)
    base = [f"w{rnd.randrange(9000)}" for _ in range(300)]
    for i in range(330):
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9000)}"
        rows.append((10_000 + i, " ".join(w)))
    boiler = [f"b{i}" for i in range(60)]  # a passage that many texts share, which makes none of them alike
    rows += [(20_000 + i, " ".join([*boiler, *[f"y{i}.{j}" for j in range(60)]])) for i in range(150)]
    want = {i: (c, n) for i, c, n in _classes(rows)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()}
    assert got.keys() == want.keys() and all(got[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want) and all(got[20_000 + i][1] == 0 for i in range(150))


def test_ngram_join_reads_each_set_once(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(None if i % 2 else 7, " ".join(rnd.choice("abcdefgh") for _ in range(40))) for i in range(12)]
    rows = [(i, t + end) for i, t in rows for end in ("", " z")]
    read, plain = [], ngram_join._of_set
    monkeypatch.setattr(ngram_join, "_of_set", lambda found, n: read.append(found.count()) or plain(found, n))
    got = sorted((tuple(r) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == _classes(rows) and read == [24]


def test_nearest_by_number_of_components(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=(64, 8)[i % 3 == 0]).tolist()) for i in range(150)] + [(160, rnd.normal(size=65).tolist())]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), factor=1.0, shard_rows=40, pass_queries=3).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    vectors = {i: np.array(v) for i, v in rows}
    assert set(got) == set(range(0, 150, 20))
    for q, found in got.items():
        want = sorted((i for i, v in vectors.items() if i != q and len(v) == len(vectors[q])), key=lambda i: (-(vectors[i] @ vectors[q]), i))[:20]
        assert [i for _, i in sorted(found)] == want


def test_pii_finds_planted_identifiers_without_seeds(spark):
    """Numbers that no fixed pattern finds, in contexts of found ones; other numbers of the same look in contexts of their own stay."""
    rnd = random.Random(12)
    words = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(n))
    number = lambda: f"{rnd.randrange(200, 999)}-{rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
    rows, planted = [], 0
    for i in range(200):
        lead = ["phone:", "call me at", "tel: home"][i % 3]
        seed = i % 4 > 0
        rows.append((i, f"{words(5)} {lead} {'+1 ' if seed else ''}{number()} {words(6)}"))
        planted += not seed
    rows += [(1000 + i, f"{words(4)} {rnd.choice(['part', 'order', 'size:', 'lot: no'])} {number()} {words(4)}") for i in range(200)]
    got = {r.doc_id: r.n_found for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    caught, wrong = sum(got[i] for i in range(200) if i % 4 == 0), sum(n for i, n in got.items() if i >= 1000)
    assert caught == planted and wrong == 0


def test_pii_long_runs_of_marks(spark):
    import time

    rows = [(1, "a1bc" + "." * 40_000 + "d5ef"), (2, "x@" + "." * 40_000)]
    began = time.time()
    assert [r.n_spans for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()] == [0, 0]
    assert time.time() - began < 60


def test_shared_folder_is_cleared(spark, tmp_path):
    from spanforge.llm import common

    kept = common.materialize(spark.range(3).toDF("a"), "some")
    path = common._written[-1].removeprefix("file://")
    assert kept.count() == 3 and common.clean_up(spark) >= 1
    import os

    assert not os.path.exists(path) and common.clean_up(spark) == 0


@pytest.mark.parametrize("split", [1 << 20, 700])
def test_damaged_archives_are_an_error(spark, tmp_path, split):
    rnd = random.Random(1)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "".join(rnd.choice("abcdefghij") for _ in range(900 + i))) for i in range(5)], "page_id long, url string, html string")
    files = warc.write_warc(pages.coalesce(1), f"file://{tmp_path}/w").collect()
    whole = max(files, key=lambda r: r.length)
    with open(whole.path.removeprefix("file://"), "rb") as f:
        data = f.read()
    starts = [i for i in range(len(data)) if warc._begins(warc._Window(whole.path), i)]

    def read(content: bytes) -> int:
        path = tmp_path / f"{rnd.random()}.warc.gz"
        path.write_bytes(content)
        return warc.read_warc(spark.createDataFrame([(f"file://{path}", len(content))], "path string, length long"), split_bytes=split).count()

    assert read(data) == len(starts)
    third = starts[2]
    damaged = [data[:-9], data[: third + 40], data[: third + 300] + bytes([data[third + 300] ^ 4]) + data[third + 301 :], data[:third] + b"x" + data[third + 1 :], data[:third] + b"junk" + data[third:], b"junk" + data, data[: third + 10] + b"\xff\xff" + data[third + 12 :]]
    for content in damaged:
        with pytest.raises(Exception, match="damaged|no record begins"):
            read(content)
