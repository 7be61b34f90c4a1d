"""Works: normalised columns, warnings, resolved overrides, positions and gallery summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TITLE_CASE_EXCEPTIONS, Catalogue
from ..functions import text as T
from ..functions.unicode import title_case
from .ordering import numbered


def normalise_works(works: DataFrame, settings: Catalogue = Catalogue()) -> DataFrame:
    """Adds the derived columns; raw columns stay as they are."""
    rules = settings.normalisation
    artist, price, edition = T.artist_name(F.col("raw_artist"), rules.honorific_tokens), T.price(F.col("raw_price")), T.edition(F.col("raw_edition"), rules.edition_suppress_max)
    out = works.withColumns({"_a": artist, "_p": price, "_e": edition})
    return out.withColumns(
        {
            "title": T.substituted(T.strip(F.col("raw_title")), rules.substitutions, "title"),
            "medium": T.substituted(T.strip(F.col("raw_medium")), rules.substitutions, "medium"),
            "artist_name": T.substituted(F.col("_a.name"), rules.substitutions, "artist_name"),
            "artist_honorifics": F.col("_a.honorifics"),
            "price_numeric": F.col("_p.numeric"),
            "price_text": F.col("_p.text"),
            "edition_total": F.col("_e.total"),
            "edition_price": F.col("_e.price"),
        }
        | ({"artwork": T.whole_number(F.col("raw_artwork"))} if "raw_artwork" in works.columns else {})
    ).drop("_a", "_p", "_e")


def spread(works: DataFrame, key: str = "work_id") -> DataFrame:
    """Rows over tasks by key: a small file is few splits, however many rows it has, and what each row costs would be a few tasks'.

    A join by the key needs no other shuffle.
    """
    return works.repartition(key)


def with_title_case(normalised: DataFrame) -> DataFrame:
    """Adds ``title_cased``, from the title with its substitutions."""
    return normalised.withColumn("title_cased", title_case("title"))


def _warning_cases(settings: Catalogue) -> dict[str, Column]:
    """When a normalised work has each type of warning."""
    c, limit = F.col, settings.normalisation.edition_suppress_max
    raw_edition, edition = T.blank_to_null(T.strip(c("raw_edition"))), T.edition(c("raw_edition"), -1)
    stated = edition["total"]
    no_price = c("price_numeric").isNull() & F.coalesce(c("price_text"), F.lit("")).isin("", "*")
    only_price = edition["price"].isNotNull() & no_price
    suppressed = F.coalesce((stated > 0) & (stated <= limit), F.lit(False))
    excepted = lambda w: F.upper(w).isin(*(x.upper() for x in TITLE_CASE_EXCEPTIONS))
    in_title = lambda test: F.coalesce(F.exists(T.title_tokens(c("title")), test), F.lit(False))
    odd_space = lambda raw: raw != T.strip(raw)
    foreign = lambda x: F.coalesce(x.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return {
        "whitespace_trimmed": F.coalesce(odd_space(c("raw_title")), F.lit(False)) | F.coalesce(odd_space(c("raw_artist")), F.lit(False)) | F.coalesce(odd_space(c("raw_medium")), F.lit(False)),
        "missing_title": F.coalesce(c("title") == "", F.lit(True)),
        "missing_artist": F.coalesce(c("artist_name") == "", F.lit(True)),
        "missing_price": c("price_numeric").isNull() & (c("price_text") == "*"),
        "unrecognised_price": c("price_numeric").isNull() & ~c("price_text").isin("*", "NFS"),
        "edition_anomaly": raw_edition.isNotNull() & stated.isNull(),
        "zero_edition_suppressed": F.coalesce(stated == 0, F.lit(False)) & F.lit(limit >= 0),
        "edition_suppressed_no_price": suppressed & only_price,
        "edition_suppressed": suppressed & ~only_price,
        "non_ascii_characters": foreign(c("title")) | foreign(c("artist_name")) | foreign(c("artist_honorifics")) | foreign(c("medium")),
        "title_case_roman": in_title(lambda w: T.looks_roman(w) & ~excepted(w)),
        "title_case_exception": in_title(excepted),
    }


def _warning_texts() -> dict[str, Column]:
    """The sentence of each type of warning, with the texts it is about."""
    c = lambda x: F.concat(F.lit("'"), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit("'"))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def characters() -> Column:
        """The first five of each field's characters beyond ASCII, by code point."""
        odd = lambda f: F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(f), F.lit("")), F.lit(r"([^\x00-\x7F])")))), 1, 5)
        code = lambda x: F.concat(x, F.lit(" (U+"), F.lpad(F.regexp_replace(F.hex(F.encode(x, "UTF-32")), "^0+", ""), 4, "0"), F.lit(")"))
        return F.concat_ws("; ", *(F.when(F.size(odd(f)) > 0, F.concat(F.lit(f"{f}: "), F.array_join(F.transform(odd(f), code), ", "))) for f in ("title", "artist_name", "artist_honorifics", "medium")))

    trimmed = F.concat_ws(", ", *(F.when(F.col(f"raw_{f}") != T.strip(F.col(f"raw_{f}")), F.lit(f)) for f in ("title", "artist", "medium")))
    return {
        "whitespace_trimmed": said("White space trimmed from ", trimmed), "missing_title": F.lit("The work has no title"), "missing_artist": F.lit("The work has no artist"), "missing_price": F.lit("The work has no price"),
        "unrecognised_price": said("The price ", c("raw_price"), " can't be read"), "edition_anomaly": said("The edition ", c("raw_edition"), " can't be read"), "zero_edition_suppressed": said("The edition ", c("raw_edition"), " is of none and left out"),
        "edition_suppressed_no_price": said("The edition ", c("raw_edition"), " is left out, and with it the only price"), "edition_suppressed": said("The edition ", c("raw_edition"), " is left out"),
        "non_ascii_characters": said("Characters beyond ASCII in ", characters()), "title_case_roman": said("Roman numerals in ", c("title"), " keep their case"), "title_case_exception": said("Exceptions in ", c("title"), " keep their case"),
    }


def found_warnings(settings: Catalogue = Catalogue()) -> Column:
    """All warnings of a normalised work as an array of (type, message)."""
    texts = _warning_texts()
    found = (F.when(case, F.struct(F.lit(name).alias("type"), texts[name].alias("message"))) for name, case in _warning_cases(settings).items())
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def warnings(normalised: DataFrame, settings: Catalogue = Catalogue(), also: tuple[str, ...] = ()) -> DataFrame:
    """(work_id, type): one row for each warning of each normalised work, behind its columns ``also``."""
    found = F.filter(F.array(*(F.when(case, F.lit(name)) for name, case in _warning_cases(settings).items())), lambda x: x.isNotNull())
    return normalised.select(*also, "work_id", F.explode(found).alias("type"))


def warning_messages(normalised: DataFrame, settings: Catalogue = Catalogue()) -> DataFrame:
    """(work_id, type, message): the warnings, each with a sentence that has the texts it is about."""
    return normalised.select("work_id", F.inline(found_warnings(settings)))


def with_overrides(joined: DataFrame) -> DataFrame:
    """Normalised works beside their ``*_override`` columns, with the fields these override; a price text that isn't empty displaces the numeric price."""
    fields = ("title", "title_cased", "artist_name", "artist_honorifics", "price_text", "edition_total", "edition_price", "artwork", "medium")
    numeric = F.when(F.coalesce(F.col("price_text_override") != "", F.lit(False)), F.lit(None)).otherwise(F.coalesce("price_numeric_override", "price_numeric"))
    resolved = {f: F.coalesce(f"{f}_override", f) for f in fields if f"{f}_override" in joined.columns and f in joined.columns}
    return joined.withColumns(resolved | {"price_numeric": numeric.cast("decimal(12,2)")})


def effective_works(normalised: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each work with its overrides applied."""
    return with_overrides(normalised.join(overrides, "work_id", "left")).select(*normalised.columns)


def export_rows(works: DataFrame, settings: Catalogue = Catalogue()) -> DataFrame:
    """Included works with display texts, ready to be put in order."""
    shown = works.where("include_in_export").withColumns(
        {
            "price_display": T.price_display(F.col("price_numeric"), F.col("price_text"), settings.money),
            "edition_display": T.edition_display(F.col("edition_total"), F.col("edition_price"), settings.money),
        }
    )
    return shown.select("work_id", "ord", "cat_no", "gallery", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist_name", F.lit("")).alias("artist_name"), T.blank_to_null(F.col("artist_honorifics")).alias("artist_honorifics"), "price_display", "edition_display", T.blank_to_null(F.col("medium")).alias("medium"))


def section_positions(works: DataFrame) -> DataFrame:
    """(work_id, gallery, section_position, position): sections in the order they are first seen.

    Works are numbered in stretches of a section, sections themselves, one row each, in a
    small window.
    """
    named = works.select("work_id", "ord", F.coalesce(T.blank_to_null(F.col("gallery")), F.lit("Uncategorised")).alias("gallery"))
    order = named.groupBy("gallery").agg(F.min("ord").alias("first")).select("gallery", F.row_number().over(Window.orderBy("first")).alias("section_position"))
    return numbered(named, ["gallery"], "position").join(order, "gallery").select("work_id", "gallery", "section_position", F.col("position").cast("int").alias("position"))


def gallery_summary(works: DataFrame) -> DataFrame:
    """Works and range of numeric catalogue numbers of each gallery, in first-seen order."""
    number = T.whole_number(F.col("cat_no"))
    out = works.groupBy("gallery").agg(F.min("ord").alias("first"), F.count("*").alias("works"), F.min(number).alias("lowest"), F.max(number).alias("highest"))
    return out.select("gallery", "works", "lowest", "highest", F.row_number().over(Window.orderBy("first")).alias("position"))


def override_stats(works: DataFrame, overrides: DataFrame) -> DataFrame:
    """Works and overridden works of each gallery, 0 where there is none."""
    counted = works.select("work_id", "gallery").join(overrides.select("work_id", F.lit(1).alias("own")), "work_id", "left")
    return counted.groupBy("gallery").agg(F.count("*").alias("works"), F.count("own").alias("overridden"))


def without_override(works: DataFrame, overrides: DataFrame) -> DataFrame:
    return works.join(overrides, "work_id", "left_anti").select("work_id", "cat_no")


def search(works: DataFrame, text: str) -> DataFrame:
    """Works whose number, artist or title has the text, in any case."""
    return works.where(F.lower(F.concat_ws(" ", "cat_no", "raw_artist", "raw_title")).contains(text.strip().lower())).select("work_id", "cat_no")
