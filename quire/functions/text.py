"""Normalisation of catalogue text as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import QUALIFICATION_TOKENS, RA_MEMBER_TOKENS, ROMAN, ROMAN_EXCLUDED, Money, Normalisation, Substitution

SPACE = r"(?U)\s+"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def artist_name(raw: Column, tokens: tuple[str, ...] = Normalisation.honorific_tokens) -> Column:
    """struct(name, honorifics): honorific words at the end are split off, but never from a single word."""
    text, parts = strip(raw), words(raw)
    plain = F.transform(F.reverse(parts), lambda w: ~F.upper(w).isin(*tokens))
    trailing = F.coalesce(F.nullif(F.array_position(plain, True), F.lit(0)) - 1, F.size(parts)).cast("int")
    cut = (F.size(parts) > 1) & (trailing > 0)
    name = F.when(cut, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - trailing), " ")).otherwise(text)
    honorifics = F.when(cut, F.array_join(F.slice(parts, F.size(parts) - trailing + 1, F.greatest(trailing, F.lit(1))), " "))
    usable = raw.isNotNull() & (raw != "")
    return F.struct(F.when(usable, name).alias("name"), F.when(usable, honorifics).alias("honorifics"))


def price(raw: Column) -> Column:
    """struct(numeric, text): digits and dots are the price in whole units; what can't be read stays text."""
    text = strip(F.coalesce(raw, F.lit("")))
    digits = F.regexp_replace(text, "[^0-9.]", "")
    value = F.when(~F.upper(text).isin("", "*", "NFS") & (digits != ""), digits.try_cast("decimal(38,9)"))
    whole = F.floor(value).cast("decimal(12,0)")
    shown = F.when(text.isin("", "*"), "*").when(F.upper(text) == "NFS", "NFS").when(whole.isNotNull(), whole.cast("string")).otherwise(text)
    return F.struct(whole.cast("decimal(12,2)").alias("numeric"), shown.alias("text"))


def edition(raw: Column, suppress_max: int = Normalisation.edition_suppress_max) -> Column:
    """struct(total, price) of "Edition of N [at P]"; null for totals up to ``suppress_max`` and for other texts."""
    total = F.regexp_extract(raw, r"^Edition of ([0-9]+)", 1).try_cast("int")
    token = F.regexp_extract(raw, r"^Edition of [0-9]+ at .*?([0-9,]+\.?[0-9]*)", 1)
    amount = F.floor(F.replace(token, F.lit(","), F.lit("")).try_cast("decimal(38,9)")).cast("decimal(12,2)")
    kept = total > suppress_max
    return F.struct(F.when(kept, total).alias("total"), F.when(kept, amount).alias("price"))


def substituted(c: Column, rules: tuple[Substitution, ...], field: str) -> Column:
    """Literal replacements for ``field``, in order."""
    for rule in rules:
        if field in rule.fields and rule.find:
            if rule.whole_word:
                c = F.regexp_replace(c, rf"\b{re.escape(rule.find)}\b", re.sub(r"([\\$])", r"\\\1", rule.replace))
            else:
                c = F.replace(c, F.lit(rule.find), F.lit(rule.replace))
    return c


def looks_roman(word: Column) -> Column:
    return (F.length(word) > 1) & F.upper(word).rlike(f"^{ROMAN}$") & ~F.lower(word).isin(*ROMAN_EXCLUDED)


def title_tokens(title: Column) -> Column:
    """The words of a title without punctuation around them; those that are nothing else are left out."""
    return F.filter(F.transform(words(title), lambda w: F.regexp_replace(w, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")), lambda w: w != "")


def catalogue_numbers(raw: Column) -> Column:
    """The whole numbers of a list separated by ; or , in order, repeats included."""
    return F.transform(F.filter(F.transform(F.split(raw, "[;,]"), strip), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def is_member(quals: Column) -> Column:
    """Whether a membership token stands in the text as whole words, in any case."""
    return F.coalesce(quals.rlike(rf"(?i)\b(?:{'|'.join(sorted(RA_MEMBER_TOKENS, key=len, reverse=True))})\b"), F.lit(False))


def is_company_name(first: Column, last: Column, quals: Column) -> Column:
    empty = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    return ~empty(last) & empty(first) & empty(quals)


def is_multi_name(first: Column, last: Column) -> Column:
    found = lambda c: F.coalesce(c.rlike(r"(?i)\band\b|\bwith\b|\s&\s"), F.lit(False))
    return found(first) | found(last)


def qualification_in(first: Column, last: Column) -> Column:
    """The first qualification token in the first name, else in the last name, in any case."""
    tokens = "|".join(sorted(QUALIFICATION_TOKENS, key=lambda t: (-len(t), t)))
    found = lambda c: blank_to_null(F.regexp_extract(c, rf"(?i)\b({tokens})\b", 1))
    return F.coalesce(found(first), found(last))


def whole_number(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast("int"))


def fingerprint(title: Column, artist: Column, medium: Column) -> Column:
    """Struct of the three texts, folded: lower case and single spaces, null as empty.

    The texts are taken as they are; ``operators.match.with_fingerprint`` brings them to NFKC
    first, so that texts that differ by composition or width have one fingerprint.
    """
    fold = lambda c: F.lower(F.array_join(words(F.coalesce(c, F.lit(""))), " "))
    return F.struct(fold(title).alias("title"), fold(artist).alias("artist"), fold(medium).alias("medium"))


def money(value: Column, style: Money = Money()) -> Column:
    """Grouped whole units with the symbol; null for null and zero."""
    shown = F.replace(F.format_number(value, 0), F.lit(","), F.lit(style.separator))
    return F.when(value.isNotNull() & (value != 0), F.concat(F.lit(style.symbol), shown))


def price_display(numeric: Column, text: Column, style: Money = Money()) -> Column:
    return F.coalesce(money(numeric, style), blank_to_null(text))


def edition_display(total: Column, value: Column, style: Money = Money()) -> Column:
    body = F.concat_ws(" ", F.lit(style.edition_prefix), total.cast("string"), F.when(money(value, style).isNotNull(), F.concat(F.lit("at "), money(value, style))))
    return F.when(F.coalesce(total, F.lit(0)) != 0, F.concat(F.lit("("), body, F.lit(")")) if style.brackets else body)


def escaped_tags(c: Column) -> Column:
    """Backslash, then the angle brackets, escaped for tagged text."""
    for find in ("\\", "<", ">"):
        c = F.replace(c, F.lit(find), F.lit("\\" + find))
    return c


def export_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(slug), F.lit("export"))
