"""Artist index: known-artist rules, merging, letter groups and composite names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import numbered


def known_rule(artists: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``rule`` (the known-artist row): exact qualifications first, then rules without any; users' rules beat seeded ones."""
    rank = Window.partitionBy("match_first", "match_last", "match_quals").orderBy("is_seeded", "rule_id")
    best = known.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k")
    row = F.struct("resolved_first", "resolved_last", "rule_id")
    exact = best.where("match_quals <> ''").select(F.col("match_first").alias("first_name"), F.col("match_last").alias("last_name"), F.col("match_quals").alias("quals"), row.alias("_exact"))
    wide = best.where("match_quals = ''").select(F.col("match_first").alias("first_name"), F.col("match_last").alias("last_name"), row.alias("_wide"))
    joined = artists.join(exact, ["first_name", "last_name", "quals"], "left").join(wide, ["first_name", "last_name"], "left")
    return joined.withColumn("rule", F.coalesce("_exact", "_wide")).select(*artists.columns, "rule")


def effective_artists(artists: DataFrame, known: DataFrame) -> DataFrame:
    """Names with rules applied: an empty value in a rule clears, null leaves the base."""
    layer = lambda rule, base: F.when(rule.isNotNull(), T.blank_to_null(rule)).otherwise(base)
    out = known_rule(artists, known)
    return out.select("artist_id", layer(F.col("rule.resolved_first"), F.col("first_name")).alias("first_name"), layer(F.col("rule.resolved_last"), F.col("last_name")).alias("last_name"), "title", "quals", F.col("rule.rule_id").alias("rule_id"))


def index_name(artist: DataFrame) -> Column:
    """Surname, [title] first quals; just the one name there is."""
    text = lambda c: T.blank_to_null(artist[c])
    rest = F.when(text("last_name").isNotNull() & text("first_name").isNotNull(), F.concat_ws(" ", text("title"), text("first_name")))
    surname = F.coalesce(text("last_name"), text("first_name"))
    return F.when(surname.isNull(), "").otherwise(F.concat_ws(" ", F.concat_ws(", ", surname, rest), text("quals")))


def sort_name(artist: DataFrame) -> Column:
    """The text of an artist's sort key: last and first name, or the one there is; empty where there is none."""
    text = lambda c: T.blank_to_null(artist[c])
    return F.when(text("last_name").isNull(), F.coalesce(text("first_name"), F.lit(""))).otherwise(F.concat(text("last_name"), F.lit(" "), F.coalesce(text("first_name"), F.lit(""))))


def name_key() -> Column:
    """By which rows of one artist are found: the folded parts of the name."""
    fold = lambda c: F.coalesce(F.lower(T.strip(F.col(c))), F.lit(""))
    return F.concat_ws("|", *(fold(c) for c in ("title", "first_name", "last_name", "quals")))


def merged_numbers(artists: DataFrame, size: int = 4096) -> DataFrame:
    """(key, chunk, numbers): the numbers of rows of one name, in row order, in chunks of ``size``.

    For names of any number of rows: numbers get their places without one task a name
    (``ordering.numbered``), and no array is longer than a chunk.  Rows with a courtesy are left out,
    as ``merged_artists`` keeps them apart; a row has less than 2**20 numbers.
    """
    plain = artists.where("courtesy is null or trim(courtesy) = ''").select(name_key().alias("key"), F.col("row_number").cast("long").alias("row"), F.posexplode(T.catalogue_numbers(F.col("cat_nos"))).alias("at", "number"))
    placed = numbered(plain.withColumn("ord", F.col("row") * F.lit(1 << 20) + F.col("at")), ["key"], "place")
    chunks = placed.groupBy("key", F.floor((F.col("place") - 1) / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "number"))).alias("n"))
    return chunks.select("key", "chunk", F.array_join(F.transform("n", lambda x: x["number"].cast("string")), ",").alias("numbers"))


def merged_artists(artists: DataFrame) -> DataFrame:
    """Rows of one name merged, numbers in row order; rows with a courtesy stay apart.

    An artist is one row with all its numbers; where a name may have more rows than a task
    should hold, ``merged_numbers`` has them in chunks.
    """
    key = name_key()
    numbers = artists.withColumns({"key": key, "numbers": T.catalogue_numbers(F.col("cat_nos"))})
    plain = numbers.where("courtesy is null or trim(courtesy) = ''").groupBy("key").agg(F.min("row_number").alias("row_number"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_number", "numbers"))), lambda x: x["numbers"])).alias("numbers"), F.count("*").alias("rows"))
    apart = numbers.where("not (courtesy is null or trim(courtesy) = '')").select("key", "row_number", "numbers", F.lit(1).cast("long").alias("rows"))
    return plain.unionByName(apart).select("key", "row_number", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"), "rows")


def letter(c: Column) -> Column:
    first = F.upper(F.substring(c, 1, 1))
    return F.when(F.coalesce(first, F.lit("")) == "", "?").when(first.rlike("^[0-9]$"), "#").otherwise(first)


def letter_groups(artists: DataFrame) -> DataFrame:
    """Entries of each letter."""
    return artists.select(letter(F.lower(F.coalesce("last_name", "first_name"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("entries"))


def linked_entries(artists: DataFrame) -> DataFrame:
    """Artists whose name stands more than once."""
    named = artists.select("artist_id", F.lower(F.concat_ws(" ", "last_name", "first_name")).alias("name"))
    return named.join(named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "name").select("artist_id", "name", "n")
