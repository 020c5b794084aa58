"""Wiki dumps: pages of an XML dump, compressed or not, read in splits; paragraphs and links of their wikitext.

A record of the reader ends at a page's closing tag. Spark's text source cuts bz2 files at their
blocks, so that one large dump is read by many tasks, and a page belongs to the task in whose range
it begins. All else is regular expressions over one page: nested markup goes from the inside out, in
as many rounds as the page has levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.pages import resolve

#: Names of the media and category namespaces, and of templates that mark a page of meanings, in lower case.
MEDIA = ("file", "image", "category", "datei", "bild", "kategorie", "fichier", "catégorie", "archivo", "imagen", "categoría")
MEANINGS = ("disambiguation", "disambig", "dab", "hndis", "geodis", "begriffsklärung", "homonymie", "desambiguación", "曖昧さ回避")
#: What stands for the five signs that XML escapes, the last being the one the others are written with.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#039;", "'"), ("&amp;", "&"))

# signs of private use that stand for pairs of brackets while markup is taken apart; texts lose any of their own
_TEMPLATE, _TEMPLATE_END, _TABLE, _TABLE_END, _OPEN, _CLOSE, _LINK, _LINK_END = (chr(c) for c in range(0xE000, 0xE008))


def _unescaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def escaped(text: Column | str) -> Column:
    """``text`` as it stands in XML."""
    t = F.col(text) if isinstance(text, str) else text
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')), t)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, ns, title, redirect, text) of the pages of a dump file or folder; redirect is the title that a page leads to, or null.

    A page without text has an empty one; what isn't a page is passed over.
    """
    raw = spark.read.option("lineSep", "</page>").text(path).select(F.substring_index("value", "<page>", -1).alias("page"), F.instr("value", "<page>").alias("at")).filter("at > 0")

    def field(pattern: str) -> Column:
        return _unescaped(F.regexp_extract("page", pattern, 1))

    # the head of a page holds no text, so that no field is looked for in one
    head = F.substring_index("page", "<text", 1)
    moved = F.regexp_extract(head, r'<redirect title="([^"]*)"', 1)
    columns = [F.regexp_extract(head, r"<id>(\d+)</id>", 1).cast("long").alias("page_id"), F.coalesce(F.regexp_extract(head, r"<ns>(-?\d+)</ns>", 1).try_cast("int"), F.lit(0)).alias("ns"), _unescaped(F.regexp_extract(head, r"<title>(.*?)</title>", 1)).alias("title")]
    text = F.when(F.col("page").contains("</text>"), field(r"(?s)<text[^>]*>(.*)</text>")).otherwise("")
    return raw.select(*columns, F.when(moved != "", _unescaped(moved)).alias("redirect"), text.alias("text"))


def write_dump(pages: DataFrame, path: str, files: int = 1) -> None:
    """Write ``pages`` (page_id, ns, title, redirect, text) as ``files`` dump files in bz2."""
    moved = F.when(F.col("redirect").isNull(), "").otherwise(F.concat(F.lit('    <redirect title="'), escaped("redirect"), F.lit('" />\n')))
    parts = [F.lit("  <page>\n    <title>"), escaped("title"), F.lit("</title>\n    <ns>"), F.col("ns").cast("string"), F.lit("</ns>\n    <id>"), F.col("page_id").cast("string"), F.lit("</id>\n"), moved]
    body = [F.lit('    <revision>\n      <text xml:space="preserve">'), escaped(F.coalesce("text", F.lit(""))), F.lit("</text>\n    </revision>\n  </page>")]
    pages.repartition(files, "page_id").select(F.concat(*parts, *body).alias("value")).write.option("compression", "bzip2").text(path)


def is_disambiguation(text: Column | str = "text") -> Column:
    """Whether a wikitext has a template that marks pages of meanings."""
    return (F.col(text) if isinstance(text, str) else text).rlike(r"(?iu)\{\{\s*(?:" + "|".join(MEANINGS) + r")\s*[|}]")


def redirect_title(text: Column | str = "text") -> Column:
    """The title that a wikitext leads to, or null."""
    found = F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"(?iu)^\s*#\s*(?:redirect|weiterleitung|redirection|redirección|転送)\s*:?\s*\[\[([^\]|#]+)", 1)
    return F.when(found != "", F.trim(found))


def title_of(target: Column, capital: bool = True) -> Column:
    """The title that a link names: without what follows #, spaces for underscores, the first letter large."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(target, "#", 1), "[_ ]+", " "), r"^\s*:", ""))
    return F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 1 << 30)) if capital else title


def _inside_out(text: Column, opens: str, closes: str, round_: object) -> Column:
    """``round_`` over ``text`` as often as brackets are nested in it."""
    signs = F.regexp_extract_all(text, F.lit(f"[{opens}{closes}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(s: Column, sign: Column) -> Column:
        at = F.when(sign == opens, s["at"] + 1).otherwise(F.greatest(F.lit(0), s["at"] - 1))
        return F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most"))

    return F.aggregate(F.array_repeat(F.lit(0), F.aggregate(signs, start, step)["most"]), text, lambda t, _: round_(t))


def marked_text(text: Column | str = "text", media: tuple[str, ...] = MEDIA) -> Column:
    """A wikitext without templates, tables, references, media and other markup; links stay, between two signs of private use."""
    t = F.col(text) if isinstance(text, str) else text
    plain = [(f"[{_TEMPLATE}-{_LINK_END}]", ""), (r"(?s)<!--.*?-->", ""), (r"(?is)<(ref|math|gallery|nowiki|source|syntaxhighlight|timeline)\b[^>]*/>", ""), (r"(?is)<(ref|math|gallery|nowiki|source|syntaxhighlight|timeline)\b[^>]*>.*?</\1\s*>", "")]
    pairs = [(r"\{\{\{[^{}]*\}\}\}", ""), (r"\{\{", _TEMPLATE), (r"\}\}", _TEMPLATE_END)]
    t = reduce(lambda t, p: F.regexp_replace(t, *p), plain + pairs, t)
    t = _inside_out(t, _TEMPLATE, _TEMPLATE_END, lambda t: F.regexp_replace(t, f"{_TEMPLATE}[^{_TEMPLATE}{_TEMPLATE_END}]*{_TEMPLATE_END}", ""))
    t = reduce(lambda t, p: F.regexp_replace(t, *p), [(r"\{\|", _TABLE), (r"\|\}", _TABLE_END)], t)
    t = _inside_out(t, _TABLE, _TABLE_END, lambda t: F.regexp_replace(t, f"{_TABLE}[^{_TABLE}{_TABLE_END}]*{_TABLE_END}", ""))
    t = reduce(lambda t, p: F.regexp_replace(t, *p), [(r"\[\[", _OPEN), (r"\]\]", _CLOSE)], t)
    inner = f"[^{_OPEN}{_CLOSE}]*"
    unseen = rf"(?iu){_OPEN}\s*(?:{'|'.join(media)})\s*:{inner}{_CLOSE}"
    t = _inside_out(t, _OPEN, _CLOSE, lambda t: F.regexp_replace(F.regexp_replace(t, unseen, ""), f"{_OPEN}({inner}){_CLOSE}", f"{_LINK}$1{_LINK_END}"))
    rest = [(r"\[(?:https?:|ftp:)?//[^\s\]]+\s+([^\]]*)\]", "$1"), (r"\[(?:https?:|ftp:)?//[^\s\]]+\]", ""), ("'{2,}", ""), (r"<[^<>]*>", ""), (r"(?m)^=+[^\n]*=+[ \t]*$", ""), (r"(?m)^[*#:;]+[ \t]*", ""), (r"__[A-Z]+__", ""), (r"&nbsp;|\xA0", " "), (f"[{_TEMPLATE}-{_CLOSE}]", "")]
    return _unescaped(reduce(lambda t, p: F.regexp_replace(t, *p), rest, t))


def paragraphs(pages: DataFrame, *, capital: bool = True, media: tuple[str, ...] = MEDIA) -> DataFrame:
    """(page_id, title, paragraph, text, links) of ``pages`` (page_id, title, text): lines of text, numbered from 0, and their links (text, title, start, end) by places in the text.

    A link shows what follows its last bar. Lines without text are no paragraphs; a page that is empty,
    null or nothing but markup has none.
    """
    lines = F.split(marked_text("text", media), r"[ \t]*\n\s*")
    rows = pages.select("page_id", "title", F.posexplode(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")).alias("paragraph", "marked"))
    pieces = F.regexp_extract_all("marked", F.lit(f"{_LINK}[^{_LINK}{_LINK_END}]*{_LINK_END}|[^{_LINK}{_LINK_END}]+"), F.lit(0))

    def piece(x: Column) -> Column:
        inside = F.translate(x, _LINK + _LINK_END, "")
        target = F.when(x.startswith(_LINK), title_of(F.substring_index(inside, "|", 1), capital))
        return F.struct(F.when(x.startswith(_LINK), F.substring_index(inside, "|", -1)).otherwise(x).alias("shown"), target.alias("title"))

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x["shown"])
        link = F.struct(x["shown"].alias("text"), x["title"].alias("title"), s["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["title"], F.lit("")) != "", F.array_append(s["links"], link)).otherwise(s["links"]).alias("links"))

    start = F.expr("named_struct('at', 0, 'links', cast(array() as array<struct<text:string,title:string,start:int,end:int>>))")
    cut = rows.select("page_id", "title", "paragraph", F.transform(pieces, piece).alias("pieces"))
    return cut.select("page_id", "title", "paragraph", F.array_join("pieces.shown", "").alias("text"), F.aggregate("pieces", start, step)["links"].alias("links"))


def moved_titles(pages: DataFrame) -> DataFrame:
    """(src, dest) of the pages of ``pages`` (title, redirect, text) that lead to another one, each title once."""
    dest = F.coalesce("redirect", redirect_title("text"))
    return pages.select(F.col("title").alias("src"), dest.alias("dest")).filter("dest is not null and src <> dest").groupBy("src").agg(F.min("dest").alias("dest"))


def links(pages: DataFrame, *, capital: bool = True) -> DataFrame:
    """(page_id, paragraph, pos, text, title, start, end) of the links of ``pages`` that are articles, as ``paragraphs`` finds them, with redirects resolved; pos counts from 1 within the paragraph."""
    articles = pages.filter("ns = 0").filter(F.coalesce("redirect", redirect_title("text")).isNull())
    rows = paragraphs(articles, capital=capital).select("page_id", "paragraph", F.posexplode("links").alias("pos", "link"))
    return resolve(rows.select("page_id", "paragraph", (F.col("pos") + 1).cast("long").alias("pos"), "link.*"), "title", moved_titles(pages))
