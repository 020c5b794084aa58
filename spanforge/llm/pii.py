"""PII (operator 9), with DataFrame functions only: fixed patterns, and contextual extraction that starts from them.

The fixed patterns find e-mail addresses, IP addresses, card and phone numbers in whole texts. These
are the seeds. The words around a seed make lexical patterns (a lead ending in : = or #, two words
before, such a lead and any word behind it, a word before and a word after), and the same
patterns around other identifier-like words give a bipartite graph of patterns and instances. Rounds
of scoring go over it: a pattern's confidence is the share of its distinct instances that are
held for identifiers of the kind, an instance's score what its confident patterns say together; found instances count with their score in the next round. Instances that end
above a threshold and have the kind's look are added as spans.

Positions come without Python: the gaps between matches (split) and the matches (extract) alternate,
so that a running sum of their lengths gives code point offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import join_small, materialize, wanted

KINDS = ("email", "ip", "card", "phone")
_S = r"\x20\x09-\x0D"
_LOCAL = r"[A-Za-z0-9._%+-]"
_GROUP = rf"\(?[0-9][0-9().-]*+(?![^{_S},;:!?])"
#: Same matches as the plain forms, in linear time: no start inside a run that has failed before, no giving back.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": rf"(?<![^{_S}])[^{_S}0-9@]*+[0-9@][^{_S}]*+",
    # digit groups with single spaces between them: several words that may be one identifier
    "groups": rf"(?<![^{_S}]){_GROUP}(?:\x20{_GROUP})++",
}
#: What an instance found by context must look like, by kind.
LOOKS = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9A-Fa-f]+(?:[.:]+[0-9A-Fa-f]+){2,}$", "card": r"^[0-9](?:[\x20-]?[0-9]){11,}$", "phone": r"^[0-9(](?:[\x20().-]*[0-9]){6,14}$"}
_EDGE = r"[\"'()\[\]{}<>,;:.!?]"
CONTEXT = 80
MIN_PRECISION, MIN_SUPPORT, MIN_SCORE, ROUNDS = 0.6, 3, 0.6, 3


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, though ``f`` names it in lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _hits(kind: str, guard: Column) -> Column:
    """Gaps and matches of one pattern, in turn, with the text before and after each match; a text without a match has none.

    Context runs over other matches of the kind: a gap and a match have two characters at least, so
    that CONTEXT / 2 of them on each side are enough.
    """
    near = CONTEXT // 2
    pairs = F.zip_with(F.split("text", PATTERNS[kind], -1), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    ends = lambda ps: F.transform(ps, lambda p: F.right(F.concat(p["gap"], F.coalesce(p["match"], F.lit(""))), F.lit(CONTEXT)))
    starts = lambda ps: F.transform(ps, lambda p: F.left(F.concat(p["gap"], F.coalesce(p["match"], F.lit(""))), F.lit(CONTEXT)))

    def turns(ps: Column, behind: Column, ahead: Column) -> Column:
        def turn(p: Column, i: Column) -> Column:
            tail = F.concat(F.array_join(F.slice(behind, F.greatest(F.lit(1), i + 1 - near), F.least(i, F.lit(near))), ""), p["gap"])
            head = F.array_join(F.slice(ahead, i + 2, F.lit(near + 1)), "")
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["gap"]).cast("long").alias("gap"), F.right(tail, F.lit(CONTEXT)).alias("tail"), F.left(head, F.lit(CONTEXT)).alias("head"), p["match"].alias("match"))

        return F.transform(ps, turn)

    numbered = _let(pairs, lambda ps: F.when(F.size(ps) > 1, _let(ends(ps), lambda behind: _let(starts(ps), lambda ahead: turns(ps, behind, ahead)))))
    return F.coalesce(F.when(guard, numbered), F.expr("cast(array() as array<struct<kind:string,i:int,gap:bigint,tail:string,head:string,match:string>>)"))


def _luhn(digits: Column) -> Column:
    total = F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), lambda a, d: F.struct(_add(a, d).alias("sum"), F.when(d == "", a["i"]).otherwise(a["i"] + 1).alias("i")))
    return total["sum"] % 10 == 0


def _add(a: Column, d: Column) -> Column:
    n = F.coalesce(d.try_cast("int"), F.lit(0))
    return a["sum"] + F.when(a["i"] % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)


def _valid() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    small = F.forall(F.split("match", r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(F.col("kind") == "ip", small)
        .when(F.col("kind") == "card", F.length(digits).between(13, 19) & _luhn(F.when(F.length(digits).between(13, 19), digits).otherwise("1")))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), f"[{_S}]+"), lambda w: w != "")


def occurrences(raw: DataFrame) -> DataFrame:
    """From (row_id, hits): row_id, kind (or other), start, end, key and lexical patterns of each base span, and of each other identifier-like word clear of them."""
    turns = raw.select("row_id", F.inline("hits"))
    own = Window.partitionBy("row_id", "kind").orderBy("i")
    width = F.coalesce(F.length("match"), F.lit(0)).cast("long")
    end = F.sum(F.col("gap") + width).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = turns.withColumn("end", end).withColumn("start", end - width).withColumnRenamed("head", "after").filter("match is not null").filter(_valid())
    # of other words, what is inside the punctuation around them; groups keep the bracket in front
    other, groups = F.col("kind").isin("other", "groups"), F.col("kind") == "groups"
    bare = F.when(groups, F.col("match")).otherwise(F.regexp_replace("match", f"^{_EDGE}+", ""))
    front = F.length("match") - F.length(bare)
    # only a run's first mark is tried, so that a long run inside a word takes no time
    inner = F.regexp_replace(bare, f"(?<!{_EDGE}){_EDGE}++$", "")
    found = found.withColumn("key", F.when(other, inner).otherwise(F.col("match"))).withColumn("start", F.when(other, F.col("start") + front).otherwise(F.col("start"))).withColumn("end", F.when(other, F.col("start") + F.length("key")).otherwise(F.col("end")))
    found = found.filter(~other | (F.length("key") >= 6))
    order = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    base_end = F.max(F.when(~other, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(~other, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = found.withColumn("clear", ~other | ((F.coalesce(base_end, F.lit(-1)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end")))).filter("clear")
    before, after = _words(F.col("tail")), _words(F.coalesce("after", F.lit("")))
    l1, l2, r1 = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit("")), F.coalesce(F.try_element_at(after, F.lit(1)), F.lit(""))
    patterns = F.array(F.when(l1.rlike("[:=#]$"), F.concat(F.lit("lead "), l1)), F.when((l1 != "") & (l2 != ""), F.concat(F.lit("two "), l2, F.lit(" "), l1)), F.when(l2.rlike("[:=#]$"), F.concat(F.lit("skip "), l2)), F.when((l1 != "") & (r1 != ""), F.concat(F.lit("around "), l1, F.lit(" _ "), r1)))
    return found.select("row_id", F.when(other, "other").otherwise(F.col("kind")).alias("kind"), "start", "end", F.lower("key").alias("key"), F.array_compact(patterns).alias("patterns"))


def discover(found: DataFrame, *, min_precision: float = MIN_PRECISION, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """(key, kind) of identifiers that confident patterns name, from occurrences.

    The graph has an edge for each distinct pair of pattern and instance, so that copies don't count.
    A pattern takes part for a kind with ``min_support`` seeds or more of it, and is confident from
    ``min_precision`` on. Edges meet a row for each pattern or instance, broadcast where that is
    small and else salted, so that a frequent pattern's edges are dealt over many tasks.
    """
    edges = materialize(found.select("key", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "key").agg(F.min("kind").alias("kind")), "pii-edges")
    sums = F.array(*[F.struct(F.lit(k).alias("kind"), F.count_if(F.col("kind") == k).alias("support"), F.count("*").alias("n")) for k in KINDS])
    able = edges.groupBy("pattern").agg(sums.alias("kinds")).select("pattern", F.inline(F.filter("kinds", lambda x: x["support"] >= min_support)))
    # only patterns with enough seeds can ever become confident, and only instances with a kind's look count for it; the rest of the graph is idle
    able = materialize(able.groupBy("pattern").agg(F.collect_list(F.struct("kind", "n")).alias("able")), "pii-able")
    alive = join_small(edges.withColumnRenamed("kind", "own"), able, ["pattern"], "inner", spread=F.col("key")).select("pattern", "key", "own", F.inline("able"))
    fits = F.coalesce(*[F.when(F.col("kind") == k, (F.col("own") == k) | ((F.col("own") == "other") & F.col("key").rlike(p))) for k, p in LOOKS.items()])
    alive = materialize(alive.filter(fits), "pii-alive")
    seeds = alive.filter("own = kind").select("key", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = materialize(seeds, "pii-seeds")
    for _ in range(rounds):
        held = join_small(alive, scores, ["key", "kind"], "left", spread=F.col("pattern"))
        confident = held.groupBy("pattern", "kind").agg((F.sum(F.coalesce("score", F.lit(0.0))) / F.first("n")).alias("precision")).filter(F.col("precision") >= min_precision)
        confident = materialize(confident, "pii-confident")
        unknown = join_small(alive.filter("own = 'other'"), confident, ["pattern", "kind"], "inner", spread=F.col("key"))
        doubt = F.sum(F.log(1 - F.least(F.col("precision"), F.lit(0.99))))
        new = unknown.groupBy("key", "kind").agg((1 - F.exp(doubt)).alias("score"))
        # an edge's instance is a seed everywhere or nowhere, so that new ones aren't seeds
        scores = materialize(seeds.unionByName(new), "pii-scores")
    best = scores.join(edges.filter("kind <> 'other'").select("key").distinct(), "key", "left_anti").filter(F.col("score") >= min_score)
    return best.groupBy("key").agg(F.max_by("kind", F.struct("score", "kind")).alias("found"))


def _joined(only_base: bool) -> Column:
    kept = F.col("spans") if not only_base else F.filter("spans", lambda s: s["base"])
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(kept), lambda s: F.concat_ws(":", F.element_at(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def _found(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (text, and ``columns``) by row_id, and the spans (row_id, kind, start, end, base)."""
    at, digit = F.contains(F.col("text"), F.lit("@")), F.col("text").rlike("[0-9]")
    guards = {"email": at, "ip": digit, "card": digit, "phone": F.contains(F.col("text"), F.lit("+")) & digit, "other": at | digit, "groups": digit}
    hits = F.concat(*[_hits(k, g) for k, g in guards.items()])
    raw = materialize(docs.withColumn("text", F.coalesce("text", F.lit(""))).select(F.monotonically_increasing_id().alias("row_id"), *columns, hits.alias("hits")), "pii-hits")
    found = materialize(occurrences(raw.filter(F.size("hits") > 0)), "pii-found")
    named = found.filter("kind = 'other'").join(discover(found), "key").select("row_id", F.col("found").alias("kind"), "start", "end", F.lit(False).alias("base"))
    # a word inside digit groups that are found too is part of them
    wide = Window.partitionBy("row_id").orderBy("start", F.desc("end"))
    reach = F.max("end").over(wide.rowsBetween(Window.unboundedPreceding, -1))
    named = named.withColumn("reach", reach).filter("reach is null or end > reach").drop("reach")
    return raw.drop("hits"), found.filter("kind <> 'other'").select("row_id", "kind", "start", "end", F.lit(True).alias("base")).unionByName(named)


def _by_row(spans: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return spans.groupBy("row_id").agg(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "base")).alias("spans"))


def _equals(n: int):
    return lambda x: x == n


def find_pii(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (spans added by context), n_spans (all).

    Context is what stands within CONTEXT characters on each side: of a longer word next to a hit its
    nearest CONTEXT characters make the pattern. Words that aren't base spans are instances if they have
    six characters or more without the marks around them; shorter ones are never added.
    Null and empty texts have no spans (counts 0, the digest of an empty string, spans ''). Null
    and repeated doc_ids stay as they are, repeated rows are each their own; an instance counts once
    for a pattern however often it occurs. Other columns are ignored; an empty table gives no rows.
    """
    rows, spans = _found(wanted(docs, {"doc_id": "long", "text": "string"}), ["doc_id"])
    empty = F.expr("cast(array() as array<struct<rank:int,start:bigint,end:bigint,base:boolean>>)")
    joined = rows.join(_by_row(spans), "row_id", "left").withColumn("spans", F.coalesce("spans", empty))
    counts = [F.size(F.filter(F.filter("spans", lambda s: s["base"])["rank"], _equals(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS, 1)]
    extra = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_found")
    return joined.select("doc_id", *counts, F.sha2(_joined(True), 256).alias("base_sha256"), _joined(False).alias("spans"), extra, F.size("spans").cast("long").alias("n_spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets; n_chars, if there, follows. Overlapping spans become one, of the first kind.

    Null texts stay null. The rows stay where they are read; only texts with spans are rebuilt.
    """
    keyed = docs.withColumn("__mark", F.xxhash64("text"))
    rows, spans = _found(keyed.select("doc_id", "text", "__mark"), ["doc_id", "__mark"])
    order = Window.partitionBy("row_id").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    run = run.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = run.groupBy("row_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    lists = merged.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans"))
    # rows with equal doc_id and text have equal spans: one of them tells
    told = rows.join(lists, "row_id").groupBy("doc_id", "__mark").agg(F.first("__spans").alias("__spans"))
    told = materialize(told, "pii-spans")
    both = join_small(keyed, told, ["doc_id", "__mark"], "left", spread=F.col("__mark"))
    pieces = F.transform("__spans", lambda s, i: F.concat(F.substring(F.col("text"), F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0)).cast("int") + 1, (s["start"] - F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0))).cast("int")), F.lit("<"), s["kind"], F.lit(">")))
    tail = F.substring(F.col("text"), F.element_at("__spans", -1)["end"].cast("int") + 1, F.length("text"))
    text = F.when(F.size("__spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
