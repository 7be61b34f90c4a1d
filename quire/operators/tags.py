"""Tagged text of works lists: paragraphs, styled spans and the entries in them.

Files may have the long tags (a paragraph ends at a carriage return) or the short ones
(each paragraph starts with its tag).  ``config.Layout`` tells which styles stand for what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Layout
from ..functions import text as T
from ..functions.unicode import normalised
from .ordering import carried

# fixed values: the forms of both dialects
_PARAGRAPH = r"^\s*<(?:ParaStyle|pstyle):([^>]*)>"
_SPAN = r"(?s)<(?:CharStyle|cstyle):([^>]+)>(.*?)<(?:CharStyle|cstyle):>"
_TOKEN = r"(?s)\\.|<[^>]*>|."
_RANGE = r"(?i)\bworks?\s+[0-9]+\s*[-–—]\s*[0-9]+\s*\.?"


def paragraphs(texts: DataFrame, text: str = "text", document: str = "document") -> DataFrame:
    """(document, ord, style, body): the paragraphs of whole texts that have a style."""
    c = F.col(text)
    parts = F.when(c.rlike("<(?:pstyle|cstyle):"), F.split(c, "(?=<pstyle:)")).otherwise(F.split(c, "\r"))
    return styles_of(texts.select(document, F.posexplode(parts).alias("ord", "paragraph")), document)


def styles_of(lines: DataFrame, document: str = "document") -> DataFrame:
    """(document, ord, style, body) of paragraphs (document, ord, paragraph); those without a style are left out."""
    found = lines.where(F.col("paragraph").rlike(_PARAGRAPH))
    return found.select(document, "ord", F.regexp_extract("paragraph", _PARAGRAPH, 1).alias("style"), F.regexp_replace("paragraph", _PARAGRAPH, "").alias("body"))


def decoded(body: Column) -> Column:
    """Content without escapes and inline tags, in one pass: \\X is X, <0xN> a character, any other tag nothing."""

    def plain(token: Column) -> Column:
        code = F.regexp_extract(token, "^<0x([0-9A-Fa-f]{1,8})>$", 1)
        character = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        tag = token.startswith("<") & (F.length(token) > 1)
        return F.when(token.startswith("\\") & (F.length(token) > 1), F.substring(token, 2, 1)).when(code != "", character).when(tag, "").otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0)), plain), "")


def _uncontrolled(c: Column, instead: str = "") -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f]", instead)


def heading(body: Column) -> Column:
    """A section's name: white space collapsed, a range of works left out (not yet in NFC)."""
    name = F.regexp_replace(_uncontrolled(decoded(body), " "), _RANGE, "")
    return T.strip(F.regexp_replace(name, r"(?U)\s+", " "))


def spans(body: Column) -> Column:
    """array<struct<style, value>> of the styled spans, in order, with decoded values."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(_SPAN), F.lit(1)).alias("style"), F.regexp_extract_all(body, F.lit(_SPAN), F.lit(2)).alias("value"))
    return F.transform(pairs, lambda x: F.struct(F.regexp_replace(x["style"], r"(?s)\\(.)", "$1").alias("style"), decoded(x["value"]).alias("value")))


def field_order(layout: Layout) -> list[str]:
    """Enabled fields as they are rendered, honorifics behind the artist."""
    return [f for c in layout.components if c.enabled for f in ((c.field, "honorifics") if c.field == "artist" else (c.field,))]


def recoverable(layout: Layout) -> list[str]:
    """Fields with a character style of their own or shared, which a parse can tell apart."""
    return [f for f in field_order(layout) if layout.styles.get(f)]


def assigned(found: Column, layout: Layout) -> dict[str, Column]:
    """Fields of an entry from its spans.

    The spans of a field with its own style are joined.  Where fields share a style, what
    has content between tabs goes to one field each, and all that is left to the last.
    """
    by_style: dict[str, list[str]] = {}
    for name in recoverable(layout):
        by_style.setdefault(layout.styles[name], []).append(name)
    out: dict[str, Column] = {}
    for style, names in by_style.items():
        values = F.transform(F.filter(found, lambda x: x["style"] == style), lambda x: x["value"])
        if len(names) == 1:
            out[names[0]] = F.when(F.size(values) > 0, _uncontrolled(F.array_join(values, "")))
            continue
        pieces = F.transform(F.flatten(F.transform(values, lambda v: F.split(v, "\t"))), _uncontrolled)
        pieces = F.filter(pieces, lambda p: T.strip(p) != "")
        for i, name in enumerate(names[:-1]):
            out[name] = F.get(pieces, F.lit(i))
        rest = F.slice(pieces, F.lit(len(names)), F.greatest(F.size(pieces) - (len(names) - 1), F.lit(0)))
        out[names[-1]] = F.when(F.size(pieces) >= len(names), F.array_join(rest, ""))
    return out


def parsed_entries(found: DataFrame, layout: Layout = Layout(), document: str = "document") -> DataFrame:
    """(document, ord, section, cat_no and the recoverable fields): entries of ``paragraphs``.

    The last heading before an entry is its section, "" before the first.  Entries without a
    number, and paragraphs of other styles, are left out; where no style tells the number,
    there are no entries.  Texts are in NFC.  A document may be one of many, or a file that fills
    the cluster: headings are carried over stretches of it.
    """
    styles = [layout.section_style, *layout.other_section_styles]
    own = found.where(F.col("style").isin(*styles, layout.entry_style))
    named = own.withColumn("section_name", F.when(F.col("style").isin(*styles), heading(F.col("body"))))
    placed = carried(named, [document], "section_name", "section")
    entries = placed.where((F.col("style") == layout.entry_style) & F.col("section_name").isNull()).withColumn("spans", spans(F.col("body")))
    entries = entries.withColumn("section", F.coalesce("section", F.lit("")))
    fields = {"work_number": F.lit(None).cast("string")} | assigned(F.col("spans"), layout)
    entries = entries.select(document, "ord", "section", *(c.alias(f) for f, c in fields.items()))
    texts = {c: normalised(F.col(c), "NFC") for c in ("section", *fields)}
    out = entries.withColumns(texts)
    number = T.strip(F.coalesce(F.col("work_number"), F.lit("")))
    return out.withColumn("cat_no", number).where("cat_no <> ''").drop("work_number")


FIELDS = ("cat_no", "title", "artist_name", "price_display", "medium")


def render_entries(rows: DataFrame) -> DataFrame:
    """(ord, line): one short-tag paragraph an entry, its fields as styled spans."""
    span = lambda f: F.when(T.blank_to_null(F.col(f)).isNotNull(), F.concat(F.lit(f"<cstyle:{f}>"), T.escaped_tags(F.col(f)), F.lit("<cstyle:>")))
    return rows.select("ord", F.concat(F.lit("<pstyle:entry>"), F.concat_ws("\t", *(span(f) for f in FIELDS))).alias("line"))


def parse_entries(lines: DataFrame) -> DataFrame:
    """(ord and the fields): what ``render_entries`` wrote; entries without a number are left out.

    Exploding keeps the filters here from repeating what makes the lines.
    """
    lines = lines.select("ord", F.explode(F.array("line")).alias("line"))
    body = F.regexp_extract("line", r"(?s)^<pstyle:entry>(.*)$", 1)
    value = lambda f: F.regexp_extract(body, rf"(?s)<cstyle:{f}>((?:\\.|[^\\<])*)<cstyle:>", 1)
    plain = lambda c: T.blank_to_null(F.regexp_replace(c, r"\\([\\<>])", "$1"))
    return lines.where(F.col("line").startswith("<pstyle:entry>")).select("ord", *(plain(value(f)).alias(f) for f in FIELDS)).where("cat_no is not null")
