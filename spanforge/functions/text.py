"""Column functions over texts, tokens and spans; all are built-in expressions."""

from __future__ import annotations

import functools
import itertools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, and ASCII code points that count as punctuation besides category P.
SPACES = r"(?U)\s+"
PUNCTUATION = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}]"
ARTICLES = ("a", "an", "the")
#: Articles by language; Chinese and Hindi have none.
LANGUAGE_ARTICLES = {
    "en": ("a", "an", "the"),
    "es": ("un", "una", "unos", "unas", "el", "la", "los", "las"),
    "vi": ("của", "là", "cái", "chiếc", "những"),
    "de": ("ein", "eine", "einen", "einem", "eines", "einer", "der", "die", "das", "den", "dem", "des"),
    "ar": ("ال",),
    "zh": (),
    "hi": (),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(text: Column | str) -> Column:
    """Runs of white space as one space, none at the end."""
    return F.rtrim(F.regexp_replace(col(text), SPACES, " "))


def is_punctuation(char: Column | str) -> Column:
    return col(char).rlike(f"^{PUNCTUATION}")


def is_subword(token: Column | str, family: str) -> Column:
    """Whether ``token`` goes on with a word, by tokenizer family: ## (wordpiece), no Ġ (byte pairs) or no ▁ (pieces) in front."""
    t = col(token)
    return {"wordpiece": t.startswith("##"), "bytes": ~t.startswith("Ġ"), "pieces": ~t.startswith("▁")}[family]


def needs_prefix_space(text: Column | str, start: Column | str) -> Column:
    """Whether the token at ``start`` stands at the text's start or after a space."""
    return (col(start) == 0) | (F.substring(col(text), col(start), F.lit(1)) == " ")


def prefix_places(text: Column | str) -> Column:
    """All places of a text, its end too, at which ``needs_prefix_space`` holds, in order. The text is cut into its characters once, so that work grows with it."""
    signs = F.regexp_extract_all(col(text), F.lit("(?s)."), F.lit(0))
    # as a lambda's variable the characters are made once, not once for each place
    return F.get(F.transform(F.array(signs), lambda x: F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i == 0) | (F.get(x, i - 1) == " "))), F.lit(0))


def words_and_marks(text: Column | str) -> Column:
    """Default tokens: runs of word characters, and single other characters."""
    return F.regexp_extract_all(col(text), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


@functools.cache
def accents(marks: str = "M") -> tuple[str, str]:
    """Characters of all planes that hold or are marks, and what is left of those that hold some, in the same order; the marks themselves come last.

    What is left is the canonical decomposition, of as many steps as it takes, without characters of
    the category ``marks``, put together again.
    """
    held, left, gone = [], [], []
    for c in map(chr, itertools.chain(range(1, 0xD800), range(0xE000, 0x110000))):
        plain = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith(marks)))
        if not plain:
            gone.append(c)
        elif plain != c and len(plain) == 1:
            held.append(c)
            left.append(plain)
    return "".join(held + gone), "".join(left)


def strip_accents(text: Column | str, marks: str = "M") -> Column:
    """Characters without their accents, and no accents of their own; ``marks``: the category that counts as accents, Mn for those that take no room."""
    return F.translate(col(text), *accents(marks))


def normalize_mention(text: Column | str, lower: bool = False) -> Column:
    out = F.trim(col(text))
    return F.lower(out) if lower else out


def escape_tokens(tokens: Column | str) -> Column:
    """Tokens as one key: ▁ within them becomes _, ▁ stands between them."""
    return F.array_join(F.transform(col(tokens), lambda t: F.replace(t, F.lit("▁"), F.lit("_"))), "▁")


def blank_astral(text: Column | str) -> Column:
    """Characters beyond the basic plane as single spaces; lengths stay."""
    return F.regexp_replace(col(text), r"[\x{10000}-\x{10FFFF}]", " ")


def letters_only(text: Column | str) -> Column:
    """Lower case, without what isn't a word character."""
    return F.regexp_replace(F.lower(col(text)), r"(?U)[\W]+", "")


def unquote(text: Column | str) -> Column:
    """Percent signs decoded; + stays."""
    return F.url_decode(F.replace(col(text), F.lit("+"), F.lit("%2B")))


def split_last(key: Column | str, sign: str = ":") -> Column:
    """A key of two parts, parted at the last ``sign``."""
    k = col(key)
    last = F.substring_index(k, sign, -1)
    return F.struct(F.substring(k, F.lit(1), F.length(k) - F.length(last) - len(sign)).alias("head"), last.alias("tail"))


def answer_tokens(text: Column | str, language: str = "en", unicode_marks: bool | None = None) -> Column:
    """Tokens of an answer in normal form: lower case, no punctuation, no articles. Chinese characters are tokens each.

    Articles go at word boundaries, so that they part what marks beyond ASCII had joined; the Arabic
    one goes wherever it stands. ``unicode_marks``: whether all marks are punctuation, or ASCII ones
    only, as is usual for English alone.
    """
    signs = PUNCTUATION if (language != "en" if unicode_marks is None else unicode_marks) else r"[!-/:-@\[-`{-~]"
    plain = F.regexp_replace(F.lower(col(text)), signs, "")
    if articles := "|".join(LANGUAGE_ARTICLES.get(language, ())):
        plain = F.regexp_replace(plain, articles if language == "ar" else rf"(?U)\b(?:{articles})\b", " ")
    if language == "zh":
        plain = F.regexp_replace(plain, r"([\x{4E00}-\x{9FA5}])", " $1 ")
    return F.array_remove(F.split(plain, SPACES), "")


def normalize_answer(text: Column | str, language: str = "en", unicode_marks: bool | None = None) -> Column:
    return F.array_join(answer_tokens(text, language, unicode_marks), " ")


def inclusive_positions(start: Column | str, end: Column | str, length: int) -> Column:
    """Places start .. end, both included, cut or padded with -1 to ``length``."""
    return position_ids(col(start), col(end) + 1, length)


def marker_span(tokens: Column | str, mark: str) -> Column:
    """(start, end) from the first to behind the last ``mark``."""
    return F.struct(first_index(tokens, mark).cast("int").alias("start"), (last_index(tokens, mark) + 1).cast("int").alias("end"))


def bankers(x: Column) -> Column:
    """Rounding with halves to even, as a whole number."""
    return F.bround(x).cast("int")


def share_of(n: Column, rate: float) -> Column:
    """``rate`` of n, rounded, at least 1."""
    return F.greatest(F.lit(1), bankers(n * rate))


def position_ids(start: Column | str, end: Column | str, length: int) -> Column:
    """Places start .. end - 1, cut or padded with -1 to ``length``."""
    s, e = col(start), col(end)
    places = F.when(e > s, F.sequence(s.cast("int"), (e - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.slice(F.concat(places, F.array_repeat(F.lit(-1), length)), 1, length)


def padded(values: Column | str, length: Column | int, pad: int = 0) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(col(values), F.array_repeat(F.lit(pad), n)), F.lit(1), n)


def attention_mask(values: Column | str, length: int) -> Column:
    return padded(F.transform(col(values), lambda v: F.lit(1)), length)


def first_index(tokens: Column | str, mark: str) -> Column:
    """Place from 0 of the first ``mark``; an error if there is none."""
    at = F.array_position(col(tokens), mark)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit(f"no {mark}")))


def last_index(tokens: Column | str, mark: str) -> Column:
    at = F.array_position(F.reverse(col(tokens)), mark)
    return F.when(at > 0, F.size(col(tokens)) - at).otherwise(F.raise_error(F.lit(f"no {mark}")))


def sentence_spans(text: Column | str) -> Column:
    """(start, end) of sentences that cover the text, each with the white space behind it: they end after . ! or ? and at line breaks."""
    parts = F.filter(F.regexp_extract_all(col(text), F.lit(r"[^.!?\n]*(?:[.!?]+|\n|$)[\s]*"), F.lit(0)), lambda p: p != "")
    step = lambda state, p: F.struct((state["at"] + F.length(p)).alias("at"), F.array_append(state["spans"], F.struct(state["at"].alias("start"), (state["at"] + F.length(p)).alias("end"))).alias("spans"))
    return F.aggregate(parts, F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))"), step)["spans"]


def softmax(scores: Column | str) -> Column:
    """Shares of e to the power of each score, computed from the largest down."""
    s = col(scores)
    powers = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def answer_text(text: Column | str, offsets: Column | str, lengths: Column | str, start: Column | str, end: Column | str, first: Column | int = 0) -> Column:
    """The piece of ``text`` from token ``start`` to token ``end`` (inclusive, places in a sequence where the text's tokens begin at ``first``).

    Tokens lie at ``offsets`` with ``lengths``; where an offset is null, the next token outward tells,
    and beyond the last one the text's start or end. Place 0, the mark of no answer, gives ''.
    """
    at, size = col(offsets), col(lengths)
    s, e = (col(start) - first).cast("int"), (col(end) - first).cast("int")
    known = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size(at) - 1).alias("i"), at.alias("at"), size.alias("n")), lambda t: t["at"].isNotNull())
    before, behind = F.filter(known, lambda t: t["i"] <= s), F.filter(known, lambda t: t["i"] >= e)
    begin = F.coalesce(F.try_element_at(before, F.lit(-1))["at"], F.lit(0))
    stop = F.coalesce(F.get(behind, F.lit(0))["at"] + F.get(behind, F.lit(0))["n"], F.length(col(text)))
    return F.when(col(start) == 0, F.lit("")).otherwise(F.substring(col(text), begin + 1, F.greatest(F.lit(0), stop - begin)))


def projected_answer(answer: Column | str, text: Column | str, lower: bool = False) -> Column:
    """The piece of ``text`` that ``answer``, words and marks parted by spaces, stands for; all of ``text`` where they can't be aligned.

    Characters are matched one to one after spaces are taken out. ``lower``: the answer is in lower
    case and has no accents.
    """
    plain = strip_accents(F.lower(col(text))) if lower else col(text)
    tokens = F.array_join(F.regexp_extract_all(plain, F.lit(r"(?U)[^\W_]+|_|[^\w\s]"), F.lit(0)), " ")
    start = F.position(col(answer), tokens)
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    places = F.filter(F.transform(F.split(col(text), ""), lambda c, i: F.when(~c.isin(" ", ""), i)), lambda i: i.isNotNull())
    begin = F.get(places, F.length(bare(F.substring(tokens, F.lit(1), start - 1))))
    stop = F.get(places, F.length(bare(F.substring(tokens, F.lit(1), start + F.length(col(answer)) - 1))) - 1)
    aligned = (start > 0) & (F.length(bare(tokens)) == F.length(bare(col(text)))) & col(answer).rlike("(?s)^[^ ](?:.*[^ ])?$")
    return F.when(aligned, F.substring(col(text), begin + 1, stop - begin + 1)).otherwise(col(text))
