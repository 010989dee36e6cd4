"""Adopted rules and their exceptions as a table of versions.

A version is a folder ``v00000001``: each run that tries for it writes its tables
``rules`` and ``exceptions`` in a folder of its own, and last ``committed``, which
names the run.  A version counts once that is whole, and a second run that tries
for it fails.  A run that dies half way leaves the version before it in force, and
who reads an older version goes on undisturbed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import change

EXCEPTIONS = "rule string, exception string"


class NewViolations(ValueError):
    """Rules in force are broken by more than what is recorded."""


class UnknownRules(ValueError):
    """Rules to be removed that are not in force, or that the same run adopts."""


@dataclass(frozen=True)
class AdoptionState:
    """The versions below a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def versions(self) -> list[int]:
        """Numbers of the whole versions, in order."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v*/committed/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted({int(f.getPath().getParent().getParent().getName()[1:9]) for f in found or ()})

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(rules, exceptions) of a version, else of the last one; None where there is none."""
        known = self.versions()
        if not known:
            return None
        number = known[-1] if version is None else version
        if number not in known:
            raise ValueError(f"no version {number}")
        run = self.spark.read.schema("run string").parquet(f"{self.folder}/v{number:08d}/committed").agg(F.min("run")).first()[0]
        return tuple(self.spark.read.parquet(f"{self.folder}/v{number:08d}/{run}/{name}") for name in ("rules", "exceptions"))

    def update(self, scanned: DataFrame, current: DataFrame, removed: DataFrame | None = None, baseline: DataFrame | None = None, reset: bool = False) -> int:
        """Add scanned rules (rule, ...) to those in force and record exceptions; returns the new version.

        ``current`` (rule, exception) is what breaks the rules today.  Rules
        outside the scan are carried, ``removed`` ones (rule) go.  What is
        recorded for rules in force only shrinks: where one is broken by
        more, nothing is written and :class:`NewViolations` is raised, but for
        rules of ``baseline`` (rule), which are recorded anew.  ``reset`` forgets
        what was in force.
        """
        none = self.spark.createDataFrame([], "rule string")
        removed, baseline = none if removed is None else removed, none if baseline is None else baseline
        last = self.read()
        prior, recorded = last if last is not None and not reset else (scanned.limit(0), self.spark.createDataFrame([], EXCEPTIONS))
        for wrong, why in ((removed.join(prior, "rule", "left_anti"), "not adopted"), (removed.join(scanned, "rule", "left_semi"), "both adopted and removed")):
            first = wrong.select(F.min("rule")).first()[0]
            if first is not None:
                raise UnknownRules(f"{first}: {why}")
        rules = change.merged_state(prior.withColumnRenamed("rule", "id"), scanned.withColumnRenamed("rule", "id"), F.lit(False)).withColumnRenamed("id", "rule").join(removed, "rule", "left_anti")
        run = uuid.uuid4().hex
        number = (self.versions() or [0])[-1] + 1
        version = f"{self.folder}/v{number:08d}"
        at = f"{version}/{run}"
        change.ratcheted(prior, recorded, scanned, current, removed, baseline).write.parquet(f"{at}/compared")
        compared = self.spark.read.parquet(f"{at}/compared")
        grown = compared.filter("state = 'grown'").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rule", "exception")).alias("least")).first()
        if grown["n"]:
            raise NewViolations(f"{grown['n']} new violations, such as {grown['least']['exception']} of {grown['least']['rule']}")
        rules.write.parquet(f"{at}/rules")
        compared.filter("state IN ('kept', 'first')").select("rule", "exception").write.parquet(f"{at}/exceptions")
        self.spark.createDataFrame([(run,)], "run string").write.mode("error").parquet(f"{version}/committed")
        return number
