"""The tables of the structured part as folders of parquet, with fixed columns.

A table is rewritten as a whole: into a folder beside it, which then takes its place. A table
of an older version gets its missing columns as nulls when it is read, so there is nothing to
migrate by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.relational import latest
from kgloom.operators.structured import replace_children, upsert
from kgloom.sources import files

#: Fixed columns of the five tables, in the order in which they are exported.
COLUMNS = {
    "entities": "entity_id canonical_name label_en label_zh description_en description_zh wikipedia_title_en wikipedia_summary_en entity_type external_ids source_name source_record_id retrieved_at confidence raw_payload_json",
    "aliases": "entity_id alias alias_lang normalized_alias",
    "claims": "claim_id subject_id predicate object_id object_text statement_id qualifiers_json source_name source_record_id retrieved_at confidence raw_payload_json",
    "event_candidates": "event_candidate_id event_type predicate subject_id object_id location_id start_time_norm end_time_norm time_text roles_json confidence status source_name claim_id",
    "fetch_jobs": "job_key job_type status attempts error updated_at",
}
KEYS = {"entities": ["entity_id"], "aliases": ["entity_id", "normalized_alias"], "claims": ["claim_id"], "event_candidates": ["event_candidate_id"], "fetch_jobs": ["job_key"]}
NUMBERS = {"confidence": "double", "attempts": "int"}


def schema(name: str) -> str:
    return ", ".join(f"{c} {NUMBERS.get(c, 'string')}" for c in COLUMNS[name].split())


class Repository:
    """Reads and writes the tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._files(name).exists(self._path(name))

    def init(self) -> list[str]:
        """Makes the tables that aren't there; the names of all."""
        for name in COLUMNS:
            if not self.exists(name):
                self.replace(name, self.spark.createDataFrame([], schema(name)))
        return list(COLUMNS)

    def table(self, name: str) -> DataFrame:
        """A table with all its columns; those that an older version lacks are null."""
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(NUMBERS.get(c, "string")).alias(c) for c in COLUMNS[name].split()])

    def listed(self, name: str, kind: str | None = None) -> DataFrame:
        """The rows in order of their key, of entities one type if asked for."""
        t = self.table(name)
        return (t.filter(F.col("entity_type") == kind) if kind else t).orderBy(*KEYS[name])

    def replace(self, name: str, rows: DataFrame) -> None:
        """Truncates and loads."""
        cols = COLUMNS[name].split()
        whole = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(NUMBERS.get(c, "string")).alias(c) for c in cols])
        whole.write.mode("overwrite").parquet(f"{self.folder}/_{name}")
        fs = self._files(name)
        fs.delete(self._path(name), True)
        fs.rename(self._path(f"_{name}"), self._path(name))

    def upsert(self, name: str, rows: DataFrame, keep_old: tuple[str, ...] = ()) -> None:
        """New rows over old ones of the same key, the last of repeated new ones; one key column."""
        key = KEYS[name][0]
        cols = COLUMNS[name].split()
        by = "retrieved_at" if "retrieved_at" in cols else "updated_at" if "updated_at" in cols else key
        new = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(NUMBERS.get(c, "string")).alias(c) for c in cols])
        self.replace(name, upsert(self.table(name), latest(new, [key], [by]), key, keep_old))

    def replace_aliases(self, rows: DataFrame) -> None:
        """The aliases of the entities that the rows name are replaced as a whole."""
        self.replace("aliases", replace_children(self.table("aliases"), rows.select(*COLUMNS["aliases"].split()), "entity_id", rows))

    def export_csv(self, folder: str) -> list[str]:
        """All five tables as CSV, in their order of columns."""
        for name, cols in COLUMNS.items():
            files.write_csv(self.table(name), f"{folder}/{name}", cols.split())
        return list(COLUMNS)
