"""Comparison of a works list with an artist index by catalogue number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RA_WORDS
from ..functions import text as T


def name_words(c: Column) -> Column:
    """Distinct lower-case words, commas and full stops being spaces."""
    return F.array_distinct(T.words(F.translate(F.lower(F.coalesce(c, F.lit(""))), ",.", "  ")))


def compare_names(frame: DataFrame) -> DataFrame:
    """Adds level and differences to rows with name, honorifics, title, first, last, quals and is_company."""
    text = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    parts = T.words(text("name"))
    f = frame.withColumns({"_last": F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")), "_first": F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")})
    f = f.withColumns({"_ifirst": F.when(F.col("is_company"), F.lit("")).otherwise(text("first")), "_ilast": text("last"), "_title": text("title"), "_lq": F.array_sort(name_words(F.col("honorifics"))), "_iq": F.array_sort(name_words(F.col("quals")))})
    c = F.col
    low = F.lower
    join = lambda x: F.array_join(x, ", ")
    whole = lambda first, last, quals: low(F.concat_ws(" ", *(T.blank_to_null(x) for x in (first, last)), F.array_join(quals, " ")))
    last = (c("_last") != "") & (c("_ilast") != "") & (low("_last") == low("_ilast"))
    titled = c("_title") != ""
    title_word = F.regexp_replace(low("_title"), r"\.+$", "")
    within = F.size(F.array_except(name_words(c("_first")), F.array_union(name_words(c("_ifirst")), F.array(title_word)))) == 0
    first = ((c("_first") == "") & (c("_ifirst") == "")) | (low("_first") == low("_ifirst")) | (titled & (low("_first") == low(F.concat_ws(" ", "_title", "_ifirst")))) | (titled & (c("_first") != "") & within)
    ra = lambda q: F.filter(q, lambda w: w.isin(*RA_WORDS))
    other = lambda q: F.filter(q, lambda w: ~w.isin(*RA_WORDS))
    f = f.withColumns({"_lm": last, "_fm": first, "_exact": whole(c("_first"), c("_last"), c("_lq")) == whole(c("_ifirst"), c("_ilast"), c("_iq"))})
    more = lambda kind, a, b: F.when(F.size(F.array_except(a, b)) > 0, F.concat(F.lit(kind), join(F.array_except(a, b))))
    lra, ira, lo, io = ra(c("_lq")), ra(c("_iq")), other(c("_lq")), other(c("_iq"))
    all_differences = [
        F.when(~c("_lm"), F.lit("last_name_different")),
        F.when(~c("_fm"), F.when(titled & c("_lm"), "title_in_index_not_in_low").otherwise("first_name_different")),
        more("extra_ra_in_index:", ira, lra), more("extra_ra_in_low:", lra, ira), more("extra_quals_in_index:", io, lo), more("extra_quals_in_low:", lo, io),
    ]
    differences = F.filter(F.array(*all_differences), lambda x: x.isNotNull())
    ra_off, other_off = F.array_sort(lra) != F.array_sort(ira), F.array_sort(lo) != F.array_sort(io)
    mine = F.array_union(name_words(c("name")), c("_lq"))
    theirs = F.array_union(F.array_union(name_words(c("_ifirst")), name_words(c("_ilast"))), c("_iq"))
    level = (
        F.when(c("_exact"), "exact")
        .when(c("_lm") & c("_fm"), F.when(ra_off, "partial_ra").when(other_off, "partial_honorific").otherwise("exact"))
        .when(c("_lm"), F.when(titled, F.when(ra_off, "partial_ra").when(other_off, "partial_honorific").otherwise("partial_title")).otherwise("partial_name"))
        .when((F.size(mine) > 0) & (F.array_sort(mine) == F.array_sort(theirs)), "equivalent")
        .when(F.arrays_overlap(mine, theirs), "partial_name")
        .otherwise("none")
    )
    out = f.withColumns({"level": level, "differences": F.when(c("_exact"), F.array().cast("array<string>")).otherwise(differences)})
    return out.drop("_last", "_first", "_ifirst", "_ilast", "_title", "_lq", "_iq", "_lm", "_fm", "_exact")


def compare_entries(works: DataFrame, artists: DataFrame) -> DataFrame:
    """(cat_no, level, differences) for each number on either side; the last row of a number wins.

    ``works`` are normalised works, ``artists`` index rows with a list of numbers.
    """
    low = works.withColumn("number", T.whole_number(F.col("cat_no"))).where("number is not null")
    low = low.groupBy("number").agg(F.max_by(F.struct(F.col("artist_name").alias("name"), F.col("artist_honorifics").alias("honorifics")), "ord").alias("l"))
    company = T.is_company_name(F.col("first_name"), F.col("last_name"), F.col("quals"))
    index = artists.withColumn("number", F.explode(T.catalogue_numbers(F.col("cat_nos"))))
    index = index.groupBy("number").agg(F.max_by(F.struct("title", F.col("first_name").alias("first"), F.col("last_name").alias("last"), "quals", company.alias("is_company")), "row_number").alias("i"))
    both = low.join(index, "number", "full")
    compared = compare_names(both.select("number", F.col("l").isNull().alias("no_low"), F.col("i").isNull().alias("no_index"), "l.*", "i.*"))
    missing = F.col("no_low") | F.col("no_index")
    differences = F.when(F.col("no_index"), F.array(F.lit("missing_in_index"))).when(F.col("no_low"), F.array(F.lit("missing_in_low"))).otherwise(F.col("differences"))
    return compared.select(F.col("number").alias("cat_no"), F.when(missing, "none").otherwise(F.col("level")).alias("level"), F.array_join(differences, "; ").alias("differences"))


LEVELS = ("exact", "equivalent", "partial_title", "partial_honorific", "partial_ra", "partial_name", "none")


def compare_summary(entries: DataFrame) -> DataFrame:
    """One row of counters."""
    counters = [F.count("*").alias("total"), *(F.count_if(F.col("level") == x).alias(f"match_{x}") for x in LEVELS)]
    return entries.agg(*counters, F.count_if(F.col("differences") == "missing_in_index").alias("only_in_low"), F.count_if(F.col("differences") == "missing_in_low").alias("only_in_index"))
