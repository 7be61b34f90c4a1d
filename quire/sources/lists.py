"""Lists that are imported again and again: each import is one entry with its works, overrides, warnings, the state before it and its audit row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Catalogue
from ..operators.match import match_plan
from ..operators.reimport import in_scope
from ..operators.relisting import OVERRIDES, SCHEMA, override_struct, relisted_rows, relisting_counts
from ..operators.works import normalise_works, with_overrides
from .store import Log


class ListStore:
    """Works lists by import, in entries that become visible as a whole.

    An entry's rows are those of ``relisted_rows``, written in one job; its manifest row, written last, is the
    audit row (action, note, summary).  So a lost re-import leaves neither works nor a snapshot nor an audit row.
    An entry is named by import and time and starts from the newest one before that time, so repeating it
    replaces it by the same.  The state of an import that has none is empty.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Catalogue = Catalogue()):
        self.spark, self.settings = spark, settings
        self.log = Log(spark, path, SCHEMA, "import_id string, at timestamp_ntz, action string, note string, summary string", ("import_id",))

    def _entry(self, import_id: str, before=None) -> DataFrame:
        """The rows of the import's newest entry, before a time if there is one."""
        own = self.log.entries().where(F.col("import_id") == import_id)
        own = own if before is None else own.where(F.col("at") < F.lit(before))
        return self.log.rows(own.orderBy(F.desc("at"), F.desc("entry")).limit(1)).where(F.col("import_id") == import_id)

    def _add(self, rows: DataFrame, import_id: str, at, action: str, note: str | None, summary) -> str:
        entry = f"{import_id}.{at:%Y%m%dT%H%M%S%f}"
        named = rows.withColumn("work_id", F.when(F.col("kind") != "list", F.coalesce("work_id", F.concat(F.lit(f"{entry}/"), F.col("ord").cast("string")))))
        self.log.append(named, entry, after=lambda written: {"summary": summary(written)}, import_id=import_id, at=at, action=action, note=note)
        return entry

    def reimport(self, new: DataFrame, import_id: str, at, note: str | None = None, galleries: Sequence[str] | None = None, headers: Sequence[str] = ()) -> str:
        """Imports a list over the state before ``at``, of some galleries or whole; the first import of a list is one over nothing."""
        rows = relisted_rows(self.works(import_id, at), new, self.overrides(import_id, at), self.warnings(import_id, at), galleries, headers, self.settings)

        def summary(written: DataFrame) -> str:
            parts = [f"{k}={v}" for k, v in relisting_counts(written).first().asDict().items()]
            return ", ".join(parts if galleries is None else [*parts, f"scope={sorted(galleries)}"])

        return self._add(rows, import_id, at, "reimport", note, summary)

    def plan(self, new: DataFrame, import_id: str, galleries: Sequence[str] | None = None) -> DataFrame:
        """The match plan of a re-import that isn't made; ``old_ord`` is the ``ord`` of ``works``."""
        scope = None if galleries is None else list(galleries)
        return match_plan(in_scope(self.works(import_id), scope), in_scope(new, scope))

    def override(self, overrides: DataFrame, import_id: str, at, note: str | None = None) -> str:
        """Puts ``overrides``, one row a work, in place of all that the list had before ``at``."""
        edits = overrides.select(F.col("work_id").cast("string").alias("work_id"), override_struct(overrides).alias("override"))
        state = self._entry(import_id, at).drop("import_id", "entry")
        works = state.where("kind = 'work'").drop("override").join(edits, "work_id", "left").select(*(c for c in state.columns))
        return self._add(works.union(state.where("kind = 'list'")), import_id, at, "override", note, lambda written: f"overrides={written.where('kind = "work" and override is not null').count()}")

    def works(self, import_id: str, before=None) -> DataFrame:
        """Works of an import, in order of ``ord``, with their raw columns."""
        state = self._entry(import_id, before).where("kind = 'work'")
        return state.select("work_id", "ord", "gallery", "section_position", "position", "origin", "from_work", "include_in_export", "source.*")

    def overrides(self, import_id: str, before=None) -> DataFrame:
        return self._entry(import_id, before).where("kind = 'work' and override is not null").select("work_id", "override.*")

    def warnings(self, import_id: str, before=None) -> DataFrame:
        """(work_id, type, message); work_id is null for warnings of the list as a whole."""
        return self._entry(import_id, before).where("kind in ('work', 'list')").select("work_id", F.inline("warnings"))

    def effective(self, import_id: str) -> DataFrame:
        """Works with their derived columns and their overrides applied; read once, without a join."""
        state = self._entry(import_id).where("kind = 'work'").select("work_id", "ord", "gallery", "include_in_export", "source.*", "override.*")
        return with_overrides(normalise_works(state, self.settings)).drop(*(f"{f}_override" for f in OVERRIDES))

    def before(self, import_id: str) -> DataFrame:
        """The works before the newest entry of an import, with the outcome of each and its override."""
        return self._entry(import_id).where("kind = 'before'").select("work_id", "ord", "gallery", "section_position", "position", "outcome", "include_in_export", "source.*", "override")

    def audit(self, import_id: str) -> DataFrame:
        """(import_id, at, action, note, new_value) of each entry."""
        return self.log.entries().where(F.col("import_id") == import_id).select("import_id", "at", "action", "note", F.col("summary").alias("new_value"))
