"""Versioned axiom tables: staged writes, optimistic commits, duplicate checks.

A revision is a folder of Parquet. A commit writes to a folder of its own and then renames it to the revision's name, which
succeeds for one of several commits only; a write that breaks leaves nothing that counts. Readers see all of it or nothing.
All paths go through Spark's file systems.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OWLOntologyStateError
from .changes import applied, net_changes


class Revisions:
    """Axiom sets (axiom_key) of ontologies under a root folder, a table a revision."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def latest(self, ont: str) -> int:
        """The last committed revision; 0 before the first."""
        fs, path = self._files()
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{ont}/revision=*/_SUCCESS"))
        return max((int(re.search(r"revision=(\d+)", f.getPath().toString())[1]) for f in found or []), default=0)

    def read(self, ont: str, revision: int | None = None) -> DataFrame:
        revision = self.latest(ont) if revision is None else revision
        if revision == 0:
            return self.spark.createDataFrame([], "axiom_key string")
        return self.spark.read.schema("axiom_key string").parquet(f"{self.root}/{ont}/revision={revision}")

    def commit(self, ont: str, log: DataFrame, expected: int) -> int:
        """Applies a change log (axiom_key, op, ts, seq) to a revision. A revision that is no longer the last one is an
        error; changes without a net effect commit nothing."""
        if self.latest(ont) != expected:
            raise OWLOntologyStateError(f"{ont} has moved on from revision {expected}")
        before = self.read(ont, expected)
        after = applied(before, log)
        if net_changes(before, after).isEmpty():
            return expected
        aside = f"{self.root}/{ont}/_commit-{uuid.uuid4().hex}"
        after.write.mode("error").parquet(aside)
        fs, _ = self._files()
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        target = of(f"{self.root}/{ont}/revision={expected + 1}")
        moved = not fs.exists(target) and fs.rename(of(aside), target)
        # A rename onto a folder that came up in between puts this one inside it.
        inside = of(target, aside.rsplit("/", 1)[1])
        if not moved or fs.exists(inside):
            fs.delete(inside if moved else of(aside), True)
            raise OWLOntologyStateError(f"{ont} has moved on from revision {expected}")
        return expected + 1


def unique_ids(ontologies: DataFrame) -> DataFrame:
    """Ontology ids and document IRIs (ontology_iri, version_iri, doc) that several documents claim."""
    by_id = ontologies.where("ontology_iri IS NOT NULL").groupBy("ontology_iri", "version_iri").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    return by_id.where("n > 1")


def resolve_imports(ontologies: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """doc, import_iri, target (null where unresolved). An import means a version IRI, an ontology IRI or a document;
    mapping (import_iri, document_iri) goes before."""
    authored = ontologies.select("doc", F.explode("imports").alias("import_iri"))
    if mapping is not None:
        authored = authored.join(mapping, "import_iri", "left").withColumn("wanted", F.coalesce("document_iri", "import_iri")).drop("document_iri")
    else:
        authored = authored.withColumn("wanted", F.col("import_iri"))
    names = ontologies.select(F.col("doc").alias("target"), F.explode(F.array("version_iri", "ontology_iri", "doc")).alias("wanted")).where("wanted IS NOT NULL")
    names = names.groupBy("wanted").agg(F.min("target").alias("target"))
    return authored.join(names, "wanted", "left").select("doc", "import_iri", "target")
