"""Chunks of a corpus whose documents are added, edited and deleted.

The stored chunks carry the digest of the document they came from.  A refresh
compares the digests with those of the documents at hand and chunks only what
is new or changed; documents that are gone, or have no chunks any more, leave
a row without text that hides what was stored before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from narralake.operators.changes import GONE, content_manifest, differences
from narralake.operators.chunks import chunk_documents
from narralake.streaming.store import NewestRows


@dataclass(frozen=True)
class ChunkedCorpus:
    """The chunks of (doc_id, text) documents under ``root``."""

    root: str
    every: int = 8
    kept: int = 3

    @property
    def store(self) -> NewestRows:
        schema = StructType.fromDDL("doc_id bigint, digest string, chunk_idx bigint, text string, char_count bigint")
        return NewestRows(f"{self.root}/chunks", schema, ("doc_id",), every=self.every, kept=self.kept)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """doc_id and digest of the documents that the stored chunks stand for."""
        rows = self.store.read(spark).where(F.col("digest").isNotNull())
        return rows.groupBy("doc_id").agg(F.max("digest").alias("digest"))

    def changes(self, docs: DataFrame) -> DataFrame:
        """doc_id and change of the documents that a refresh would work on."""
        return differences(self.manifest(docs.sparkSession), content_manifest(docs, "doc_id", "text"), "doc_id")

    def refresh(self, docs: DataFrame) -> int:
        """Bring the stored chunks up to the given documents; the version they are then in.

        Without differences nothing is written.  A refresh that is cut short
        leaves the version before it, and the next one starts from there.
        """
        spark = docs.sparkSession
        done = self.store.versions(spark)
        last = done[-1][0] if done else -1
        digests = content_manifest(docs, "doc_id", "text")
        changed = differences(self.manifest(spark), digests, "doc_id").persist()
        try:
            if changed.isEmpty():
                return last
            self.store.write(self._rows(docs, digests, changed), last + 1)
        finally:
            changed.unpersist()
        return last + 1

    def _rows(self, docs: DataFrame, digests: DataFrame, changed: DataFrame) -> DataFrame:
        same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
        live = changed.where(F.col("change") != GONE)
        todo = docs.select("doc_id", "text").alias("d").join(live.alias("c"), same("d", "c"), "left_semi")
        chunks = chunk_documents(todo).select("doc_id", "chunk_idx", "text", "char_count")
        # One row a document says that it was looked at; it alone is left of one that is gone.
        marks = (
            changed.alias("c")
            .join(digests.alias("g"), same("c", "g"), "left")
            .select(
                F.col("c.doc_id").alias("doc_id"),
                F.when(F.col("change") != GONE, F.col("g.digest")).alias("digest"),
                F.lit(None).cast("bigint").alias("chunk_idx"),
                F.lit(None).cast("string").alias("text"),
                F.lit(None).cast("bigint").alias("char_count"),
            )
        )
        return chunks.withColumn("digest", F.lit(None).cast("string")).select(marks.columns).unionByName(marks)

    def read(self, spark: SparkSession) -> DataFrame:
        """doc_id, chunk_idx, text, char_count of the documents as of the last refresh."""
        return self.store.read(spark).where(F.col("chunk_idx").isNotNull()).drop("digest")
