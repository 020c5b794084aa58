"""Sentences by locale or by a trained splitter; abbreviations after which none ends are learned from the texts themselves.

Breaks follow the default rules of Unicode's annex 29, as one regular expression. What a language
abbreviates is found by the likelihood ratio of Kiss and Strunk (2006): a word that nearly always has
a full stop behind it, is short, and is seldom without one. The candidates of a break and the
abbreviations meet by a join, so that a language's list may be of any size. Only the sizes of pieces
are shuffled, no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import keep

#: Signs that end sentences, besides full stops; signs that go on with one; locales whose usual breaks know abbreviations.
STOPS = ".․﹒．"
ENDS = "!?։؝-؟۔܀-܂߹।॥၊။።፧፨᙮᠃᠉᥄᥅‼‽⁇-⁉⸮。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝-꩟꫰꫱꯫﹖﹗！？｡"
GOES_ON = ",\\-:;՝،؍߸᠂᠈–—、︐︑︓︱︲﹐﹑﹕﹘﹣，－：､"
ABBREVIATING = ("en", "de", "es", "it", "pt")
TRAINED = "trained"
_PARA = r"\r\n\x85\u2028\u2029"
_CLOSE = r"[\p{Ps}\p{Pe}\p{Pi}\p{Pf}'\"]"
_SPACE = r"[\p{Zs}\t\x0B\x0C]"
_MARK = "\ue000"
#: All that can begin a break, as one range but for what stands below it: most characters need no other look.
_BEGINS = r"(?=[!?.;\r\n\x85\u037e\u0589-\uffff])"
#: White space and separators: what \p{Z} and \s are.
_BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Keys that pieces without a candidate are dealt over.
_SALTS = 64
#: The score from which on a word is an abbreviation, and the share of its occurrences that a true one has with a full stop.
LEAST_SCORE, SHARE = 0.3, 0.99


def break_pattern(locale: str = "en") -> str:
    """The regular expression whose matches end sentences."""
    ends = ENDS + (";\u037e" if locale.startswith("el") else "")
    goes_on = GOES_ON.replace(";", "").replace("\u037e", "") if locale.startswith("el") else GOES_ON
    behind = rf"{_CLOSE}*+{_SPACE}*+(?![{goes_on}{STOPS}{ends}])"
    initial = rf"(?!(?<=[\p{{IsUppercase}}\p{{IsLowercase}}][{STOPS}])\p{{IsUppercase}})"
    small = rf"(?!{_CLOSE}*+{_SPACE}*+[^\p{{IsAlphabetic}}{_PARA}{STOPS}{ends}]*+\p{{IsLowercase}})"
    para = rf"(?:\r\n|[{_PARA}])"
    return rf"(?:[{ends}]|[{STOPS}](?!\p{{Nd}}){initial}{small}){behind}{para}?+|{para}"


def word_stops(docs: DataFrame) -> DataFrame:
    """(lang, word, n_stop, n_plain): how often each word of letters stands with a full stop behind it and without one, from docs (lang, text); a word keeps the full stops inside it."""
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("token"))
    stop = F.col("token").endswith(".")
    word = F.when(stop, F.expr("substring(token, 1, length(token) - 1)")).otherwise(F.col("token"))
    rows = words.select("lang", word.alias("word"), stop.alias("stop")).filter(F.col("word").rlike(r"^\p{L}[\p{L}.]*$"))
    return rows.groupBy("lang", "word").agg(F.count_if("stop").alias("n_stop"), F.count_if(~F.col("stop")).alias("n_plain"))


def abbreviation_scores(stops: DataFrame) -> DataFrame:
    """``stops`` (lang, word, n_stop, n_plain) with score, for words that have a full stop somewhere. They are written, as they serve twice."""
    stops = keep(stops, "stops")
    totals = stops.groupBy("lang").agg((F.sum("n_stop") / F.sum(F.col("n_stop") + F.col("n_plain"))).alias("p"))
    rows = stops.filter("n_stop > 0").join(totals, "lang")
    ratio = 2 * (F.col("n_stop") * F.log(SHARE / F.col("p")) + F.when(F.col("n_plain") > 0, F.col("n_plain") * F.log((1 - SHARE) / (1 - F.col("p")))).otherwise(0.0))
    letters = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("word") - letters + 1
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -F.col("n_plain").cast("double"))
    return rows.select("lang", "word", "n_stop", "n_plain", score.alias("score"))


def abbreviations(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """(lang, word, score) of the words in lower case after which a full stop ends no sentence, learned from docs (lang, text). A null lang has none."""
    return abbreviation_scores(word_stops(docs)).filter(F.col("score") >= least_score).select("lang", "word", "score")


def _pieces(text: Column, locale: str) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, rf"[{_MARK}\x{{10000}}-\x{{10FFFF}}]", " "), _BEGINS + f"(?:{break_pattern(locale)})", "$0" + _MARK)
    return F.filter(F.split(marked, _MARK), lambda x: x != "")


def _last_word(piece: str, core: str) -> Column:
    """The word of letters, in lower case, that a full stop at the end of ``piece`` stands behind, or ''; ``core`` is the piece without blanks at its end, and only what follows its last space is looked at."""
    tail = F.lower(F.concat(F.substring_index(core, " ", -1), F.substring(F.col(piece), F.length(core) + 1, F.length(piece))))
    return F.when(F.col(core).endswith("."), F.regexp_extract(tail, r"(?s)(?:^|[\x20\x09-\x0D\p{Ps}\p{Pi}'\"])(\p{L}[\p{L}.]*)\.[\p{Zs}\t]*$", 1)).otherwise("")


def sentences(docs: DataFrame, splitter: str = "en", known: DataFrame | None = None) -> DataFrame:
    """(page, sentence, start, end) of docs (page, lang, text): sentences, numbered from 0, by places in the text.

    ``splitter`` is a locale or `trained`. Sentences of a locale cover the text, each with the white
    space behind it; those of `trained` have none at either end, and what is blank is no sentence.
    ``known`` (lang, word): abbreviations, which `trained` and the locales in ABBREVIATING heed.
    Characters beyond the basic plane count as spaces. Pages are told apart by ``page``; null and empty
    texts have no sentences.
    """
    locale = "en" if splitter == TRAINED else splitter
    rows = docs.select("page", "lang", F.posexplode(_pieces(F.col("text"), locale)).alias("i", "piece")).withColumn("core", F.rtrim("piece", F.lit(_BLANK)))
    back, size = F.length("core"), F.length("piece")
    front = size - F.length(F.ltrim("piece", F.lit(_BLANK)))
    rows = rows.select("page", "lang", "i", size.alias("size"), front.alias("front"), back.alias("back"), _last_word("piece", "core").alias("last"))
    by = Window.partitionBy("page").orderBy("i")
    if known is not None and (splitter == TRAINED or locale.split("_")[0].split("-")[0] in ABBREVIATING):
        # a written list is sent to all tasks if it is small; where it isn't, pieces without a candidate are dealt over many keys that no word is
        short = keep(known.select("lang", F.col("word").alias("last")).filter(F.col("last").rlike(r"^\p{L}")).distinct(), "abbreviations").withColumn("goes_on", F.lit(True))
        none = F.concat(F.lit(" "), F.pmod(F.xxhash64("page", "i"), F.lit(_SALTS)))
        rows = rows.withColumn("last", F.when(F.col("last") == "", none).otherwise(F.col("last")))
        rows = rows.join(short, ["lang", "last"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    else:
        rows = rows.withColumn("goes_on", F.lit(False))
    end = F.sum("size").over(by)
    begins = F.when(F.lag("goes_on", 1, False).over(by), 0).otherwise(1)
    placed = rows.select("page", "i", "front", "back", (end - F.col("size")).alias("start"), end.alias("end"), begins.alias("begins"))
    numbered = placed.withColumn("sentence", F.sum("begins").over(by) - 1)
    if splitter != TRAINED:
        return numbered.groupBy("page", "sentence").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end")).withColumn("sentence", F.col("sentence").cast("int"))
    seen = numbered.filter("back > 0").withColumn("from", F.col("start") + F.col("front")).withColumn("to", F.col("start") + F.col("back"))
    whole = seen.groupBy("page", "sentence").agg(F.min("from").cast("int").alias("start"), F.max("to").cast("int").alias("end"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy("sentence")) - 1
    return whole.withColumn("sentence", rank)
