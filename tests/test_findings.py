"""What a review found: each test failed before the change that it came with."""

from __future__ import annotations

from spanforge.functions import text as T
from spanforge.sources import dump


def test_paragraphs_keep_digits_at_their_ends(spark):
    pages = spark.createDataFrame([(1, "a", "0 or 10\n12 of 21\n \n 28.6 is 2 ")], "page_id long, title string, text string")
    assert [r.text for r in dump.paragraphs(pages).orderBy("paragraph").collect()] == ["0 or 10", "12 of 21", "28.6 is 2"]


def test_prefix_places_without_shuffle(spark, tmp_path):
    from spanforge.plans import catalogue, formats  # noqa: F401

    texts = ["a b", " a  b ", "é\n𝄞 c", "", None, "x" * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue._QUERIES["prefix_places"](spark, str(tmp_path))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = [(i, k, s) for i, t in enumerate(texts) if t for k, s in enumerate(s for s in range(len(t) + 1) if s == 0 or t[s - 1] == " ")]
    assert sorted(tuple(r) for r in rows.collect()) == want
    told = spark.createDataFrame([(t, s) for t in texts if t for s in range(len(t) + 1)], "text string, start int").filter(T.needs_prefix_space("text", "start"))
    assert sorted(tuple(r) for r in told.collect()) == sorted((texts[i], s) for i, _, s in want)


def test_word_spans_without_shuffle(spark):
    from spanforge.operators import windows

    sizes = [[1, 2, 1, 4, 1], [], [5, 1], None, [1] * 300, [3], [5]]
    rows = windows.word_spans(spark.createDataFrame([(i, 0, s) for i, s in enumerate(sizes)], "doc_id long, sentence int, sizes array<int>"), 4, 32)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, own in enumerate(sizes):
        own = own or []
        found = [(sum(own[:a]), sum(own[:b]), a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1) if sum(own[a:b]) <= 4]
        width = -(-len(found) // -(-len(found) // 32)) if found else 1
        want += [(i, 0, *x, k // width) for k, x in enumerate(found)]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)


def test_lines_of_files_in_splits(spark, tmp_path):
    from spanforge.sources import files

    texts = {"a": "".join(f"line {i} é\r\n" for i in range(4000)) + "last", "b": "x\n\ny\n", "c": "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = files.lines(spark, f"file://{tmp_path}")
        assert rows.rdd.getNumPartitions() > 3
        got = sorted((r.file[-1], r.line, r.text) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(n, i, x) for n, t in texts.items() for i, x in enumerate(t.replace("\r\n", "\n").removesuffix("\n").split("\n"))]


def test_max_context_shuffles_windows_only(spark):
    from spanforge.operators import windows

    rows = [(1, 0, 0, 128), (1, 1, 64, 128), (1, 2, 128, 28), (2, 0, 5, 3), (2, 1, 10, 4), (2, 2, 10, 4), (3, 0, 0, 0), (None, 0, 0, 2)] + [(4, i, 3 * i, 9) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, window int, start int, size int")
    best = {}
    for d, w, s, n in rows:
        for x in range(n):
            best.setdefault((d, s + x), []).append((-(min(x, n - 1 - x) + 0.01 * n), w))
    got = windows.max_context(df)
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString() and "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*k, min(v)[1]) for k, v in best.items()), key=repr)


def test_tokens_of_many_texts_are_placed_together():
    import numpy as np

    from spanforge.operators import subwords

    held = [b" a", b"b", "é".encode()[:1], "é".encode()[1:], b" ", b"cd"]
    texts, found = ["ab a", "é cd", "b"], [([0, 1, 0], 1), ([4, 2, 3, 4, 5], 1), ([1], 0)]
    got = subwords._placed(texts, found, np.array([len(h) for h in held]))
    want = [[0, 1, 0, 4, 2, 3, 4, 5, 1], [0, 1, 2, 0, 0, 0, 1, 2, 0], [1, 2, 4, 0, 1, 1, 2, 4, 1], [3, 5, 1], [2, 1, 3, 2, 1], [2, 2, 1]]
    assert [x.tolist() for x in got] == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_choices_shuffle_mentions_once(spark):
    from spanforge.operators import disambiguation

    # pages that batches of Arrow cut, one of them longer than a batch; a mention that is there twice
    rows = [(p, f"m{m:05}", [f"t{p % 3}", f"t{m % 5 + 3}"], [3, 2 + m % 2], [["x"], ["x", "y"] if m % 2 else []]) for p, n in enumerate([1, 300, 2, 7] * 3) for m in range(n)]
    df = spark.createDataFrame(rows + rows[:1], "page long, mention string, titles array<string>, scores array<long>, topics array<array<string>>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = disambiguation.choices_in_rounds(df, 2)
        assert _plan(got).count("Exchange") == 1
        got = {tuple(r) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for p in {r[0] for r in rows}:
        table = {r[1]: (dict(zip(r[2], r[3], strict=True)), dict(zip(r[2], r[4], strict=True))) for r in rows if r[0] == p}
        n = 0
        while table:
            n += 1
            _, m, t = min((-s / sum(own.values()), m, t) for m, (own, _) in table.items() for t, s in own.items())
            own, topics = table.pop(m)
            want.add((p, m, t, own[t], n))
            for scores, theirs in table.values():
                for x in scores:
                    scores[x] += 2 * len(set(theirs[x]) & set(topics[t]))
    assert got == want


def test_masks_without_shuffle(spark, tmp_path):
    from spanforge.plans import catalogue, inputs  # noqa: F401

    spark.createDataFrame([(1, "Some words, and thirty-one more."), (2, ""), (3, None), (4, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, n in (("mask_words", 6), ("mask_whole_words", 12)):
        rows = catalogue._QUERIES[name](spark, str(tmp_path))
        assert "Exchange" not in _plan(rows)
        rows = rows.collect()
        assert len(rows) == n and {r.doc_id for r in rows if r.masked} == {1, 4} and all(r.masked == (r.action is not None) for r in rows)


def test_shared_tokens_in_bounded_memory():
    import tracemalloc
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from spanforge.operators import scores

    rnd = np.random.default_rng(1)
    a, b = ([None if i == 3 + k else rnd.integers(0, 30, rnd.integers(0, 40)).tolist() for i in range(50)] for k in range(2))
    got = scores._shared_hashes.func(pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))).to_pylist()
    assert got == [None if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)]
    long = pa.ListArray.from_arrays(pa.array(np.arange(0, 3_000_001, 1000, dtype=np.int32)), pa.array(rnd.integers(0, 1 << 60, 3_000_000)))
    tracemalloc.start()
    assert scores._shared_hashes.func(long, long).to_pylist() == [1000] * 3000
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_coreferences_without_shuffle(spark, tmp_path):
    from spanforge.plans import catalogue

    texts = ["Ann Lee met Ann and Lee Ann. Then Ann Lee left, Lee Annan too", "", None, "x Y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("coreferences", "coref_prior"):
        assert "Exchange" not in _plan(catalogue._QUERIES[name](spark, str(tmp_path)))
    # mentions: 0 Ann Lee, 3 Ann, 5 Lee Ann Then Ann Lee, 11 Lee Annan
    got = sorted(tuple(r) for r in catalogue._QUERIES["coreferences"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, 5), (0, 3, 0), (0, 3, 5)]
    got = sorted(tuple(r) for r in catalogue._QUERIES["coref_prior"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, "lee ann then ann lee", 0.166667), (0, 3, "ann lee", 0.5), (0, 3, "lee ann then ann lee", 0.083333)]


def test_checksums_of_records_with_a_long_one():
    import time

    from spanforge.sources import records

    def plain(data):
        crc = 0xFFFFFFFF
        for x in data:
            crc ^= x
            for _ in range(8):
                crc = crc >> 1 ^ (records.POLYNOMIAL if crc & 1 else 0)
        crc ^= 0xFFFFFFFF
        return ((crc >> 15 | crc << 17) + records.MASK) & 0xFFFFFFFF

    parts = [bytes(i * 7 + k & 255 for i in range(n)) for k, n in enumerate([0, 1, 3, 4, 5, 8, 511, 512, 513, 1024, 2049])]
    assert records.masked_crcs(parts).tolist() == [plain(p) for p in parts] == [records._masked_crc(p) for p in parts]
    start = time.process_time()  # one long record took a step for each of its bytes
    records.masked_crcs([b"x" * 2_000_000, b"y"])
    assert time.process_time() - start < 1.5
    values = [b"", b"a" * 127, b"b" * 128, b"c"]
    assert records.decode(records.encode({"x": (1, values)})) == {"x": values}


def test_tag_files_shuffle_a_row_for_each_sentence(spark, tmp_path):
    from spanforge.sources import sinks

    path = f"file://{tmp_path}/tags"
    docs = spark.createDataFrame([(2, ["c O O"]), (1, ["a O O", "b I-PER O"]), (3, []), (4, None)], "sentence long, lines array<string>")
    sinks.write_tag_lists(docs, path)
    assert "".join(p.read_text() for p in sorted((tmp_path / "tags").glob("part-*"))) == "a O O\nb I-PER O\n\nc O O\n\n"
    rows = [(2, 0, "c", "O", "O"), (1, 1, "b", "I-PER", "O"), (1, 0, "a", "O", "O")]
    sinks.write_tags(spark.createDataFrame(rows, "sentence long, pos int, word string, gold string, pred string"), f"{path}2")
    assert "".join(p.read_text() for p in sorted((tmp_path / "tags2").glob("part-*"))) == "a O O\nb I-PER O\n\nc O O\n\n"


def test_tags_of_sentences_without_shuffle(spark, tmp_path):
    from spanforge.operators import jobs, sequences
    from spanforge.plans import catalogue, work  # noqa: F401

    spark.createDataFrame([(0, "a Bc Def go " * 9), (1, ""), (2, None), (3, "Ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue._QUERIES["tags_of_sentences"](spark, str(tmp_path))
    assert "Exchange" not in _plan(rows) and "Exchange" not in _plan(catalogue._QUERIES["iob_entities"](spark, str(tmp_path)))
    rows = sorted(tuple(r) for r in rows.collect())
    assert len(rows) == 37 and rows[:4] == [(0, 0, 0, "a", "O", "O"), (0, 0, 1, "Bc", "I-PER", "I-PER"), (0, 0, 2, "Def", "I-LOC", "I-LOC"), (0, 0, 3, "go", "O", "O")]
    assert rows[36] == (3, 0, 0, "Ab", "I-PER", "O") and rows[21][3:] == ("Bc", "I-PER", "O")  # spans that begin at 0 and 21 are NIL
    # lists of tags as the rows of words have them, documents that begin and end inside entities among them
    lists = [["I-A", "I-A", "B-A", "O", None, "I-B", "I-A"], [], ["I-A"], None, ["O"], ["B-A", "I-B", "I-B", "B-B"], ["I-B", ""]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc int, labels array<string>").coalesce(1)
    words = df.selectExpr("doc", "posexplode(labels) as (pos, label)")
    assert sorted(map(tuple, sequences.entity_lists(df).selectExpr("doc", "inline(entities)").collect())) == sorted(map(tuple, sequences.entities(words, ["doc"], "pos").select("doc", "start", "end", "type").collect()))
    # spans in any order and places with gaps; an empty span covers nothing
    spans = spark.createDataFrame([(1, 6, 9, "X"), (1, 3, 3, "Y"), (1, 2, 4, "X"), (1, 4, 6, "X"), (2, 0, 1, None), (3, 0, 9, "X")], "doc int, start int, end int, label string")
    words = spark.createDataFrame([(d, p, 0, "w", "O") for d in (1, 2, None) for p in (9, 8, 6, 5, 4, 3, 0)], "doc int, pos int, sentence int, word string, label string")
    got = {(r.doc, r.pos): r.pred for r in jobs.sentence_tags(spans, words).collect()}
    want = {(1, 0): "O", (1, 3): "I-X", (1, 4): "B-X", (1, 5): "I-X", (1, 6): "B-X", (1, 8): "I-X", (1, 9): "O"}
    assert got == want | {(d, p): "O" for d in (2, None) for _, p in want}


def test_names_of_many_lengths_are_tried_at_heads(spark, monkeypatch):
    import numpy as np

    from spanforge.operators import names

    # all lengths from 1 to 200: texts without heads cost a look for each size of a head, not for each length
    table = spark.createDataFrame([(" ".join(f"n{n}" if i % 2 else "n" for i in range(n + 1)),) for n in range(1, 200)], "name string")
    looked = spark.sparkContext.accumulator(0)
    plain = names._may_be_names

    def counted(bits, one, two):
        looked.add(len(one))
        return plain(bits, one, two)

    monkeypatch.setattr(names, "_may_be_names", counted)
    other = [str(x) for x in np.random.default_rng(1).integers(0, 50, 3000)]
    docs = spark.createDataFrame([("a", other), ("b", table.first().name.split(" ")), ("c", " ".join(r.name for r in table.tail(2)).split(" "))], "page string, words array<string>").coalesce(1)
    got = sorted(tuple(r) for r in names.name_runs(docs, table).select("page", "start", "n").collect())
    assert got == [("b", 0, 2), ("c", 0, 199), ("c", 199, 200)]
    assert 3000 < looked.value < 20 * 3600


def test_sentences_shuffle_no_text(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    from spanforge.operators import sentences

    # what follows the last space tells the same word as the whole piece did
    rnd = random.Random(3)
    signs = ["a", "É", "Σ", ".", ".", " ", "\t", "\n", "\r\n", " ", "\xa0", "(", "'", "1"]
    pieces = spark.createDataFrame([(i, "".join(rnd.choices(signs, k=rnd.randrange(9)))) for i in range(4000)], "i int, piece string").withColumn("core", F.rtrim("piece", F.lit(sentences._BLANK)))
    before = F.regexp_extract(F.lower("piece"), r"(?s)(?:^|[\x20\x09-\x0D\p{Ps}\p{Pi}'\"])(\p{L}[\p{L}.]*)\.[\p{Zs}\t]*$", 1)
    told = pieces.select(before.alias("before"), sentences._last_word("piece", "core").alias("after"), F.length(F.regexp_replace("piece", r"[\p{Z}\s]+$", "")).alias("back"), F.length("core").alias("n")).collect()
    assert all(r.before == r.after and r.back == r.n for r in told) and len({r.after for r in told}) > 20
    # breaks are where they were, and no piece of text is shuffled
    texts = ["".join(x) for x in itertools.product(["a", "B.", "c!", "。", ""], [" ", "\n", "\U0001f600", "\x85", "; "], ["d.", "E;", "؝", "5"], ["", " f"])]
    docs = spark.createDataFrame([(i, "en" if i % 3 else None, t) for i, t in enumerate(texts)], "page int, lang string, text string")
    for locale in ("en", "el"):
        marked = F.regexp_replace(F.translate("text", "\U0001f600", "  "), sentences.break_pattern(locale), "$0" + sentences._MARK)
        plain = docs.select(F.filter(F.split(marked, sentences._MARK), lambda x: x != "").alias("was"), sentences._pieces(F.col("text"), locale).alias("now")).collect()
        assert all(r.was == r.now for r in plain) and any(len(r.now) > 1 for r in plain)
    known = spark.createDataFrame([("en", "b"), ("en", "d")], "lang string, word string")
    rows = sentences.sentences(docs, "trained", known)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert "piece" not in plan[windows[-1] + 1]  # what is dealt by pages
    assert "Exchange hashpartitioning(lang" not in _plan(rows)


def test_spans_count_words_once(spark, tmp_path):
    from spanforge.plans import catalogue

    spark.createDataFrame([(1, "a b c\n\nd"), (2, ""), (3, None), (4, " \n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue._QUERIES["enumerate_spans_full"](spark, str(tmp_path))
    assert _plan(rows).count("regexp_extract_all") == 1
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 0, 1), (1, 0, 0, 2), (1, 0, 0, 3), (1, 0, 1, 2), (1, 0, 1, 3), (1, 0, 2, 3), (1, 2, 0, 1)]


def test_mentions_of_lines_in_splits(spark, tmp_path):
    import collections
    import random

    from spanforge.sources import files

    rnd = random.Random(3)
    texts = {}
    for name, end in zip("abcd", ["\n", "", "\r\n \n", "\n\n"], strict=True):
        lines = ["I before a name", "w\tI\tx\tx\tx\tx"] if name != "b" else []
        for d in range(60):
            # names come again, one is missing, and words of five fields are no mentions
            lines.append(rnd.choice([f"-DOCSTART- ({d}", f"-DOCSTART-\t({d % 7} x", " -DOCSTART- (é", "-DOCSTART-"]))
            lines += [rnd.choice(["", "word", "a\tb\tc\td\te", "w\tB\tx\tx\tx\tx", "w\tI\tx\tx\tx\tx", " w\tI\tx\tx\tx\tx\ty "]) for _ in range(rnd.randrange(90))]
        texts[name] = ("\r\n" if name == "c" else "\n").join(lines) + end
        (tmp_path / name).write_bytes(texts[name].encode())
    want = set()
    for name, text in texts.items():
        words, begun, doc, spans = collections.Counter(), collections.Counter(), None, {}
        for x in text.split("\n"):
            x = x.removesuffix("\r").strip(" ")
            if x.startswith("-DOCSTART-"):
                doc = x.split()[1][1:] if len(x.split()) > 1 else doc
                continue
            f = x.split("\t")
            if len(f) >= 6:
                begun[doc] += f[1] == "B"
                own = spans.setdefault((name, doc, begun[doc] - 1), [words[doc], 0])
                own[1] += 1
            words[doc] += 1
        want |= {(*k, s, s + n) for k, (s, n) in spans.items()}
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "70"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spans = files.mention_lines(spark, f"file://{tmp_path}")[1]
        assert "FileScan text" not in _plan(spans)  # no line is shuffled
        got = [(r.file[-1], r.doc, r.mention, r.start, r.end) for r in spans.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) and set(got) == want
