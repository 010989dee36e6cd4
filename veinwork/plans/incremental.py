"""Incremental extraction: what files hold is kept by (app, path, state), and only new states are parsed.

The store is a Parquet table bucketed and sorted by one key, the digest of app,
path and content, at a path that the cluster shares.  A scan meets it in a
sort-merge join that needs no exchange on the store's side; what it does not
hold is parsed and appended in one commit, so a run that dies leaves the store
as it was.  A state that comes back is found again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.sources import code

#: Version of what is extracted: a change of the extraction makes all states new.
VERSION = 1
_IMPORTS = "array<struct<ord:int,specifier:string,has_value:boolean,names:array<string>,line:int,reexport:boolean,dynamic:boolean,require:boolean>>"
_USAGE = "array<struct<subject:string,line:int>>"
_LOADS = "array<struct<loader:int,glob:string,negative:boolean,pattern:string>>"
_COLUMNS = f"key string, imports {_IMPORTS}, usage {_USAGE}, loads {_LOADS}"


def keyed(files: DataFrame) -> DataFrame:
    """``files`` (app, path, text) with ``key``: where a file is and what it holds."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return files.withColumn("key", F.sha2(F.concat(F.lit(f"{VERSION}:"), part(F.col("app")), part(F.col("path")), F.coalesce("text", F.lit(""))).cast("binary"), 256))


def parse(files: DataFrame) -> DataFrame:
    """key, imports, usage, loads: one row a file of (key, path, text), as ``sources.code`` extracts them."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["ord", "specifier", "has_value", "names", "line", "reexport", "dynamic", "require"]
        for batch in batches:
            out = []
            for key, path, text in batch[["key", "path", "text"]].itertuples(index=False):
                script = code.script_of(path, text or "")
                imports = [dict(zip(names, (i, *x))) for i, x in enumerate(code.imports_of(script))]
                usage = [{"subject": s, "line": n} for s, n in code.usage_of(script)]
                loads = [{"loader": n, "glob": g, "negative": not_, "pattern": p} for n, g, not_, p in code.loads_of(script)]
                out.append((key, imports, usage, loads))
            yield pd.DataFrame(out, columns=["key", "imports", "usage", "loads"])

    return files.select("key", "path", "text").mapInPandas(rows, _COLUMNS)


class ParsedFiles:
    """Parsed files at ``path``, in ``buckets`` buckets; one number of buckets a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/buckets-{buckets}"
        self.name = f"parsed_files_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (key STRING, imports {_IMPORTS}, usage {_USAGE}, loads {_LOADS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, files: DataFrame) -> DataFrame:
        """Files (key, path, text) in a state that the store does not hold, one of each."""
        return files.join(self.table().select("key").hint("merge"), "key", "left_anti").dropDuplicates(["key"])

    def parsed(self, files: DataFrame) -> DataFrame:
        """app, path, imports, usage, loads of files (app, path, text); new states are parsed and appended."""
        named = keyed(files)
        fresh = parse(self.unknown(named))
        fresh.repartition(self.buckets, "key").write.mode("append").bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        known = self.table().dropDuplicates(["key"])  # two scans at once may have appended one state
        return named.select("key", "app", "path").join(known.hint("merge"), "key").drop("key")

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def relations(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports, usage and loads as ``sources.code`` has them, from ``ParsedFiles.parsed``."""
    of = lambda c: parsed.select("app", "path", F.explode(c).alias("x")).select("app", "path", "x.*")
    return of("imports"), of("usage"), of("loads")
