"""Tables that change over time: snapshots of states, rows by import, seeded rows and files by key.

All of them are append-only Parquet below a folder that the cluster shares.  What a write adds
becomes visible by its entry in a manifest, which is written after its rows.  A write names
its entry, and repeating it, after a lost task or a lost driver, replaces its own rows and
entry and nothing else.  Frames of the entry that were read before are to be read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a list of entries is broadcast.
SMALL = 100_000


def _small(rows: DataFrame) -> DataFrame:
    """With a broadcast hint if it has at most SMALL rows."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def _write(rows: DataFrame, path: str, *keys: str) -> None:
    """Replaces the partitions that the rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


class Log:
    """Rows of a schema in named entries, each with values of its own.

    ``schema`` and ``values`` are DDL of a row's and an entry's columns; ``parts`` are columns of
    entries that are partitions of the rows, too, so that filters on them prune files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, values: str, parts: tuple[str, ...] = ()):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), (*parts, "entry")
        self.manifest = StructType.fromDDL(f"{values}, entry string")
        kept = {f.name: f.dataType.simpleString() for f in self.manifest if f.name in self.parts}
        self.schema = StructType.fromDDL(", ".join([schema, *(f"{k} {t}" for k, t in kept.items())]))
        for name, own in (("data", self.schema), ("manifest", self.manifest)):
            spark.createDataFrame([], own).write.mode("ignore").parquet(f"{self.path}/{name}/{'/'.join(f'{k}=' + '__HIVE_DEFAULT_PARTITION__' for k in (self.parts if name == 'data' else ('entry',)))}")

    def append(self, rows: DataFrame, entry: str, after: Callable[[DataFrame], dict] | None = None, **values) -> None:
        """Adds an entry; one that is there is replaced.  ``after`` gives more values, of the rows as they were written."""
        own = {k: entry if k == "entry" else values[k] for k in self.parts}
        _write(rows.withColumns({k: F.lit(v) for k, v in own.items()}).select(*self.schema.names), f"{self.path}/data", *self.parts)
        if after is not None:
            written = self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
            values |= after(reduce(lambda df, k: df.where(F.col(k).eqNullSafe(F.lit(own[k]))), self.parts, written))
        row = self.spark.createDataFrame([tuple({**values, "entry": entry}[f.name] for f in self.manifest)], self.manifest)
        _write(row, f"{self.path}/manifest", "entry")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.manifest).parquet(f"{self.path}/manifest").where("entry is not null")

    def rows(self, entries: DataFrame | None = None) -> DataFrame:
        """The rows of entries, all of them by default; partitions of others aren't read."""
        wanted = _small((self.entries() if entries is None else entries).select(*self.parts).distinct())
        data = self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
        return data.join(wanted, list(self.parts), "left_semi").select(*self.schema.names)


class StateStore:
    """Snapshots of the states of imports, newest first by ``at``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.names = StructType.fromDDL(schema).names
        self.log = Log(spark, path, schema, "import_id string, template string, at timestamp_ntz", ("import_id",))

    def save(self, state: DataFrame, import_id: str, template: str | None, at) -> str:
        """Appends a snapshot; its name is that of import, template and time, so repeating it adds nothing."""
        entry = f"{import_id}.{template or ''}.{at:%Y%m%dT%H%M%S%f}"
        self.log.append(state.select(*self.names), entry, import_id=import_id, template=template, at=at)
        return entry

    def snapshots(self, import_id: str | None = None) -> DataFrame:
        """(import_id, template, at, entry)."""
        return self.log.entries() if import_id is None else self.log.entries().where(F.col("import_id") == import_id)

    def latest(self, import_id: str, template: str | None = None, any_template: bool = False) -> DataFrame:
        """The state of the newest snapshot of an import and template (null being one), or of the import; empty if there is none."""
        own = self.snapshots(import_id)
        own = own if any_template else own.where(F.col("template").eqNullSafe(F.lit(template)))
        return self.log.rows(own.orderBy(F.desc("at"), F.desc("entry")).limit(1)).where(F.col("import_id") == import_id).select(*self.names)

    def restore(self, current: DataFrame, import_id: str, at) -> DataFrame:
        """The state of the import's newest snapshot before ``at``; the current state is kept as a snapshot "pre_restore" first."""
        self.save(current, import_id, "pre_restore", at)
        own = self.snapshots(import_id).where((F.col("at") < F.lit(at)) & ~F.col("template").eqNullSafe(F.lit("pre_restore")))
        return self.log.rows(own.orderBy(F.desc("at"), F.desc("entry")).limit(1)).where(F.col("import_id") == import_id).select(*self.names)


class ImportTable:
    """Rows of imports, one partition each: importing again replaces an import's rows, and filters by import read no others."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), StructType.fromDDL(f"{schema}, import_id string")

    def replace(self, rows: DataFrame) -> None:
        """Replaces the rows of all imports that ``rows`` has."""
        _write(rows.select(*self.schema.names), self.path, "import_id")

    def rows(self, *import_ids: str) -> DataFrame:
        """Rows of some imports, of all without any."""
        found = self.spark.read.schema(self.schema).parquet(self.path)
        return found.where(F.col("import_id").isin(*import_ids)) if import_ids else found

    def rows_of(self, imports: DataFrame) -> DataFrame:
        """Rows of the imports in a table, whose partitions are found when the query runs."""
        return self.rows().join(_small(imports.select("import_id").distinct()), "import_id", "left_semi").select(*self.schema.names)


class FileStore:
    """Files by the last part of their path: save, load, delete, exists, keys and sizes.

    Each write is an entry with a growing number, and of a key's rows that of the newest entry
    counts; a deletion is a row without content.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path, "key string, size long, content binary", "seq long", ("seq",))

    @staticmethod
    def key(path: Column) -> Column:
        return F.element_at(F.split(path, r"[/\\]"), -1)

    def _add(self, rows: DataFrame, name: str) -> None:
        known = self.log.entries().agg(F.max(F.when(F.col("entry") == name, F.col("seq"))), F.coalesce(F.max("seq"), F.lit(0))).first()
        self.log.append(rows, name, seq=known[0] or known[1] + 1)

    def save(self, files: DataFrame, name: str) -> None:
        """Saves (path, content) in a write called ``name``; of paths with one key the last by path counts."""
        one = files.groupBy(self.key(F.col("path")).alias("key")).agg(F.max_by("content", "path").alias("content")).where("key <> ''")
        self._add(one.select("key", F.octet_length("content").cast("long").alias("size"), "content"), name)

    def delete(self, keys: DataFrame, name: str) -> None:
        """Deletes the files of (path)."""
        gone = keys.select(self.key(F.col("path")).alias("key")).distinct()
        self._add(gone.select("key", F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("content")), name)

    def listing(self) -> DataFrame:
        """(key, size, seq) of the files that are there."""
        newest = self.log.rows().groupBy("key").agg(F.max_by(F.struct("size", "seq"), "seq").alias("f"))
        return newest.where("f.size is not null").select("key", "f.size", "f.seq")

    def load(self, keys: DataFrame) -> DataFrame:
        """(key, content) of the files of (path) that are there."""
        wanted = self.listing().join(keys.select(self.key(F.col("path")).alias("key")).distinct(), "key", "left_semi")
        return self.log.rows().join(wanted.select("key", "seq"), ["key", "seq"]).select("key", "content")

    def exists(self, keys: DataFrame) -> DataFrame:
        """(key, there) of each key of (path)."""
        own = keys.select(self.key(F.col("path")).alias("key")).distinct()
        return own.join(self.listing().select("key", F.lit(True).alias("there")), "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there"))

    def stats(self) -> DataFrame:
        """One row: files and bytes."""
        return self.listing().agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def seeded_table(current: DataFrame, seeds: DataFrame, keys: list[str], content: list[str], flag: str = "is_seeded") -> DataFrame:
    """A table after its seeds were applied: (its columns, action), deleted rows left out.

    Rows without the flag are a user's and stay ("user").  Of seeded rows, those whose key is in
    ``seeds`` are kept if the hash of their content is the seed's, else replaced ("update"), and the others go;
    seeds without a row are inserted.  Of seeds with one key, the first by content counts; null keys are equal.
    """
    digest = lambda side: F.sha2(F.to_json(F.struct(*(F.col(f"{side}.{c}") for c in content)), {"ignoreNullFields": "false"}), 256)
    own = F.col(flag)
    users = current.where(~F.coalesce(own, F.lit(False))).withColumn("action", F.lit("user"))
    old = current.where(F.coalesce(own, F.lit(False))).select(F.struct(*keys).alias("key"), F.struct(*current.columns).alias("old"))
    new = seeds.groupBy(F.struct(*keys).alias("key")).agg(F.min(F.struct(*content)).alias("new"))
    both = old.join(new, "key", "left").where("new is not null").union(new.join(old, "key", "left_anti").select("key", F.lit(None).cast(old.schema["old"].dataType).alias("old"), "new"))
    action = F.when(F.col("old").isNull(), "insert").when(digest("old") == digest("new"), "keep").otherwise("update")
    pick = lambda c: F.col(f"key.{c}") if c in keys else F.col(f"new.{c}") if c in content else F.lit(True) if c == flag else F.col(f"old.{c}")
    return users.unionByName(both.select(*(pick(c).alias(c) for c in current.columns), action.alias("action")))
