"""Stages of a run that can be resumed: a finished stage leaves a manifest beside its table.

A manifest holds a fingerprint of what the stage was made from: its settings
and the fingerprints of the stages it read. A later run takes a table whose
fingerprint is the one it needs, and makes the first one that is missing or
other, and with it all that follow from it.
"""

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources.tables import write_table


def table_digest(df: DataFrame) -> str:
    """A digest of rows, columns and types that does not depend on order; one pass, one row a task."""
    parts = []
    for name in df.columns:
        column = F.col(f"`{name}`")
        parts += [column.isNull(), column]
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")) for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(json.dumps([df.dtypes, [str(v) for v in row]]).encode()).hexdigest()


class Stages:
    """The tables of a run under ``output``; ``made`` and ``kept`` name the stages that this run made or found."""

    def __init__(self, spark: SparkSession, output: str):
        self.spark, self.output = spark, output
        self.fingerprints: dict[str, str] = {}
        self.made: list[str] = []
        self.kept: list[str] = []

    def _manifest(self, name) -> dict:
        try:
            found = self.spark.read.text(f"{self.output}/_manifests/{name}").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return json.loads(found.value) if found else {}

    def _write(self, name, **manifest):
        row = [(json.dumps(manifest, sort_keys=True),)]
        self.spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{self.output}/_manifests/{name}")

    def source(self, name: str, digest: str):
        """Name an input by its digest."""
        self.fingerprints[name] = digest

    def run(self, name: str, make: Callable[[str], dict | None], after=(), **settings) -> dict:
        """Call ``make(path)`` unless the stage is finished; returns the facts that it returned then or now.

        ``after`` names the stages and inputs that it reads. The manifest of an
        earlier run is taken back before the stage begins to write.
        """
        about = json.dumps([name, [self.fingerprints[a] for a in after], settings], sort_keys=True, default=str)
        wanted = self.fingerprints[name] = hashlib.sha256(about.encode()).hexdigest()
        manifest = self._manifest(name)
        if manifest.get("fingerprint") == wanted:
            self.kept.append(name)
            return manifest["facts"]
        if manifest:
            self._write(name)
        facts = make(f"{self.output}/{name}") or {}
        self._write(name, fingerprint=wanted, facts=facts, settings=settings, after=list(after))
        self.made.append(name)
        return facts

    def table(self, name: str, make: Callable[[], DataFrame], after=(), partition_by=(), **settings) -> DataFrame:
        """The table of a stage, read back from where it was written."""
        self.run(name, lambda path: write_table(make(), path, partition_by=partition_by), after, **settings)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.output}/{name}")
