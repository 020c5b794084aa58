"""Readers and writers on small files of our own."""

import bz2
import json

from spanforge.operators import mentions, sequences, vocabulary
from spanforge.sources import files, sinks
from spanforge.streaming import metrics


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_vocab_files(spark, tmp_path):
    tsv = put(tmp_path, "v.tsv", "[PAD]\t0\n[UNK]\t0\nJapan\t100\n")
    assert rows(files.vocab_tsv(spark, tsv)) == [(0, "[PAD]", 0), (1, "[UNK]", 0), (2, "Japan", 100)]
    table = spark.createDataFrame([(0, "[PAD]", None, 0), (3, "テレビ", "ja", 142), (3, "TV", "en", 142)], "id int, title string, lang string, count long")
    sinks.write_vocab(table, f"file://{tmp_path}/out")
    assert rows(files.vocab_json(spark, f"file://{tmp_path}/out")) == rows(table)
    keys = put(tmp_path, "k.json", json.dumps({"[PAD]": 0, "en:A:B": 4, "ja:日本": 5}))
    assert rows(files.tokenizer_vocab(spark, keys)) == [(0, "[PAD]", None, None), (4, "A:B", "en", None), (5, "日本", "ja", None)]


def test_vocabulary_edges(spark):
    links = spark.createDataFrame([("A",)] * 3 + [("B",)] * 2 + [("C",), ("Category:x",)], "title string")
    got = rows(vocabulary.entity_vocab(links, 6, min_count=2, first=["C", "Z"]))
    assert got == [(0, "[PAD]", 0), (1, "[UNK]", 0), (2, "[MASK]", 0), (3, "C", 1), (4, "A", 3), (5, "B", 2)]
    vocab = spark.createDataFrame([(0, "[PAD]", None, 0), (1, "A", "en", 2), (2, "B", None, 1)], "id int, title string, lang string, count long")
    assert rows(vocabulary.rekey(vocab)) == [(0, "[PAD]"), (1, "en:A"), (2, "None:B"), (3, "[MASK2]")]
    asked = spark.createDataFrame([("A", "en"), ("B", None), ("A", "fr")], "title string, lang string")
    assert rows(vocabulary.entity_ids(asked, vocab, 9)) == [("A", "en", 1), ("A", "fr", 9), ("B", None, 2)]


def test_sitelinks(spark, tmp_path):
    items = [{"id": "Q1", "type": "item", "sitelinks": {"enwiki": {"site": "enwiki", "title": "Spain"}, "jawiki": {"site": "jawiki", "title": "スペイン"}, "x": {"site": "enquote", "title": "no"}}}, {"id": "P1", "type": "property", "sitelinks": {}}]
    path = tmp_path / "dump.json.bz2"
    path.write_bytes(bz2.compress(("[\n" + ",\n".join(map(json.dumps, items)) + "\n]\n").encode()))
    links = files.sitelinks(spark, f"file://{path}", ["en", "ja"])
    assert rows(links) == [("Q1", "Spain", "en"), ("Q1", "スペイン", "ja")]
    assert rows(vocabulary.translate_titles(links, "en", "ja")) == [("Spain", "スペイン")]


def test_tagged_lines(spark, tmp_path):
    text = "-DOCSTART- -X- O O\n\nEU NNP I-ORG\nis V O\n\n\nPeter NNP I-PER\n-DOCSTART- -X-\n\nBonn NNP I-LOC\n"
    got = sequences.sentences(files.lines(spark, put(tmp_path, "t.txt", text))).select("doc", "sent", "word", "label")
    assert rows(got) == [(1, 0, "EU", "I-ORG"), (1, 0, "is", "O"), (1, 1, "Peter", "I-PER"), (2, 0, "Bonn", "I-LOC")]


def test_relations(spark, tmp_path):
    one = {"id": "1", "token": "Bob works at the Big Lab .".split(), "subj_start": 0, "subj_end": 0, "obj_start": 4, "obj_end": 5, "relation": "org"}
    two = one | {"id": "2", "subj_start": 4, "subj_end": 5, "obj_start": 0, "obj_end": 0}
    got = rows(files.relation_json(spark, put(tmp_path, "r.json", json.dumps([one, two]))))
    assert [(i, s.replace(" ", ""), r) for i, s, r in got] == [("1", "<ent>Bob<ent>worksatthe<ent2>BigLab<ent2>.", "org"), ("2", "<ent2>Bob<ent2>worksatthe<ent>BigLab<ent>.", "org")]
    blocks = put(tmp_path, "k.txt", '1\t"<e1>A</e1> of <e2>B</e2> ."\norg(e1,e2)\n\n2\t" <e1>C</e1> x <e2>D</e2>"\nno\n')
    assert rows(files.relation_blocks(spark, blocks)) == [("1", "<ent>A<ent> of <ent2>B<ent2>.", "org(e1,e2)"), ("2", "<ent>C<ent> x <ent2>D<ent2>", "no")]


def test_typing(spark, tmp_path):
    row = {"annot_id": "a", "y_str": ["time", "odd"], "mention_span": "the -LRB- day", "left_context_token": ["on"], "right_context_token": []}
    assert rows(files.typing_json(spark, put(tmp_path, "o.json", json.dumps(row)))) == [("a", "on <ent> the ( day <ent>", ["time"])]


def test_questions(spark, tmp_path):
    data = {"data": [{"title": "A_B%20C", "paragraphs": [{"context": "x y", "qas": [{"id": "1", "question": "q?", "answers": [{"text": "x", "answer_start": 0}]}, {"id": "2", "question": "r?", "answers": [], "is_impossible": True}]}]}]}
    got = files.questions(spark, put(tmp_path, "q.json", json.dumps(data, indent=1))).select("qid", "title", "is_impossible", "answers.text")
    assert rows(got) == [("1", "A B C", False, ["x"]), ("2", "A B C", True, [])]
    data = {"data": [{"passage": {"text": "ab cd", "entities": [{"start": 3, "end": 4}]}, "qas": [{"id": "1", "query": "@placeholder", "answers": [{"start": 3, "end": 4, "text": "cd"}]}]}]}
    (row,) = files.cloze(spark, put(tmp_path, "c.json", json.dumps(data))).collect()
    assert [tuple(e) for e in row.entities] == [(3, 5, "cd")] and row.answers[0].end == 5


def test_candidates(spark, tmp_path):
    line = "d1\tx\tR&amp;D\tl\tr\tCANDIDATES\t1,0.2,Alpha, Inc\t2,0.7,Beta\t9,1,2,Gold, x"
    none = "d1\tx\tNone\tl\tr\tCANDIDATES\tEMPTYCAND\t-1,,"
    last = "d1\tx\tM\tl\tr\tCANDIDATES\tEMPTYCAND\t-1,a,Title"
    got = files.candidates_tsv(spark, put(tmp_path, "a.tsv", "\n".join([line, none, last]))).orderBy("mention").collect()
    assert [(r.mention, r.text, r.gold, [c.title for c in r.candidates]) for r in got] == [(0, "R&D", "Gold, x", ["Beta", "Alpha, Inc"]), (1, "M", "Title", [])]
    prior = files.prior_tsv(spark, put(tmp_path, "p.tsv", "Rome\t10\t1,0.57,Rome_(city), Italy\t2,0.43,Roma\n"))
    assert rows(mentions.prior_counts(prior, spark.createDataFrame([("Rome", 0.5)], "name string, link_prob double"))) == [("Rome", "Roma", 4, 20), ("Rome", "Rome (city), Italy", 5, 20)]
    assert rows(files.redirects_tsv(spark, put(tmp_path, "r.tsv", "a\tb\nbad\n"))) == [("a", "b")]
    assert rows(files.predictions(spark, put(tmp_path, "pr.json", '{"1": "x", "2": ""}'))) == [("1", "x"), ("2", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    sinks.write_lookup(df, f"file://{tmp_path}/l", "id")
    assert rows(spark.read.parquet(f"file://{tmp_path}/l")) == rows(df)
    sinks.write_examples(df, f"file://{tmp_path}/e", {"max_seq_length": 8})
    assert spark.read.json(f"file://{tmp_path}/e/metadata").first().asDict() == {"number_of_items": 2, "max_seq_length": 8}
    sinks.write_lines(df, f"file://{tmp_path}/t", "id", "title")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/t").collect()) == ["1\ta", "2\tb"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = metrics.window_means(metrics.event_stream(spark, f"file://{tmp_path}/in"), late="10000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): (r.n, round(r["mean"], 6)) for r in spark.table("means").collect()}
    want = {(r.start, r.event_type): (r.n, round(r["mean"], 6)) for r in metrics.window_means(events).collect()}
    assert got == want
