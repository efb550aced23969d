"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch inserts documents, deletes them, or revises their counts. It becomes signed entries (one document
enters with +1 and its tokens, leaves with -1 and minus them) and a delta, the entries' sums by source,
language and version. Totals are the sum of all committed deltas; no entry is ever changed.

A batch is committed by one file in the folder ``commits``, named by its id and created only if absent. It names the
folders that hold the batch's tables, so a batch is there wholly or not at all, what failed attempts left
is never read, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terraload.llm.scratch import bounded_batches, delete
from terraload.llm.tokenizing import WordTokenizer

GROUP = ["source", "lang", "version"]
ENTRIES = "doc_id long, source string, lang string, version string, docs long, tokens long"
DELTAS = "source string, lang string, version string, docs long, tokens long"


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, source, lang, tokens``: the number of ids of each whole text, without special ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.open(tokenizer)
        for batch in batches:
            _, bounds = encoder.encode(batch.column("text"), 0)
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "source", "lang"]).columns, pa.array(np.diff(bounds) - 1)],
                                             names=["doc_id", "source", "lang", "tokens"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")


class TokenRollup:
    """Totals in ``folder``. Rows without ``doc_id`` can be inserted but never be named again; null sources and
    languages are groups of their own. Rows that share an id are deleted and revised together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _marker(self, batch_id: str) -> str:
        return f"{self.folder}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}.json"

    def committed(self, batch_id: str) -> bool:
        files, marker = self._path(self._marker(batch_id))
        return files.exists(marker)

    def _tables(self, kind: str, schema: str) -> DataFrame:
        files, commits = self._path(f"{self.folder}/commits")
        if not files.exists(commits):
            return self.spark.createDataFrame([], schema)
        names = [r["name"] for r in self.spark.read.schema("batch string, name string").json(f"{self.folder}/commits").collect()]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/{n}" for n in names])

    def _commit(self, batch_id: str, entries: DataFrame) -> bool:
        name = uuid.uuid4().hex
        entries.write.parquet(f"{self.folder}/entries/{name}")
        written = self.spark.read.schema(ENTRIES).parquet(f"{self.folder}/entries/{name}")
        sums = written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs != 0 OR tokens != 0").write.parquet(f"{self.folder}/deltas/{name}")
        line = json.dumps({"batch": batch_id, "name": name}).encode()
        files, marker = self._path(self._marker(batch_id))
        files.mkdirs(marker.getParent())
        if files.exists(marker):
            for kind in ("entries", "deltas"):
                delete(self.spark, f"{self.folder}/{kind}/{name}")
            return False
        passing = self._path(f"{self.folder}/passing-{name}")[1]
        out = files.create(passing, True)
        out.write(bytearray(line + b"\n"))
        out.close()
        return files.rename(passing, marker)

    def _once(self, batch_id: str, entries: Callable[[], DataFrame]) -> bool:
        return False if self.committed(batch_id) else self._commit(batch_id, entries())

    def current(self) -> DataFrame:
        """What each document counts for now, by version."""
        entries = self._tables("entries", ENTRIES)
        sums = entries.groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 OR tokens != 0").select("doc_id", *GROUP, "docs", "tokens")

    def _counted(self, docs: DataFrame, version: str, tokenizer: str) -> DataFrame:
        counts = token_counts(docs, tokenizer)
        return counts.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), "tokens")

    def _taken_back(self, ids: DataFrame, versions: list[str] | None = None) -> DataFrame:
        held = self.current() if versions is None else self.current().where(F.col("version").isin(versions))
        held = held.join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return held.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))

    def insert(self, batch_id: str, docs: DataFrame, version: str, tokenizer: str) -> bool:
        """Count ``docs`` (``doc_id, text, source, lang``) in. False if the batch was committed before."""
        return self._once(batch_id, lambda: self._counted(docs, version, tokenizer))

    def delete(self, batch_id: str, ids: DataFrame) -> bool:
        """Take documents out of all versions; unknown ids change nothing."""
        return self._once(batch_id, lambda: self._taken_back(ids))

    def revise(self, batch_id: str, docs: DataFrame, version: str, tokenizer: str) -> bool:
        """Put new counts, sources and languages in place of what the version has of these documents.

        Documents that it does not have are left out.
        """
        def entries() -> DataFrame:
            out = self._taken_back(docs, [version])
            new = self._counted(docs, version, tokenizer).join(out.select("doc_id").distinct(), "doc_id", "left_semi")
            return out.union(new.select("doc_id", *GROUP, "docs", "tokens"))
        return self._once(batch_id, entries)

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` of what is in now."""
        sums = self._tables("deltas", DELTAS).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 OR tokens != 0")
