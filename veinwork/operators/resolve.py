"""Import resolution: aliases, packages, nearest owners, candidate files.

Longest-prefix matches are equality joins: a specifier or path is exploded
into its prefixes and the longest that the other side holds is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths

#: Fixed value: extensions in the order in which an import tries them.
CANDIDATES = ("", ".ts", ".tsx", ".vue", ".svelte", "/index.ts", "/index.tsx")


def _scope(df: DataFrame) -> list[str]:
    """The app, where rows have one: files of an app resolve within it."""
    return ["app"] if "app" in df.columns else []


def alias_targets(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, spec[, app[, owner]], ord, target: specifiers under all targets of the longest matching alias (prefix, dir, ord), in declared order.

    Where aliases have an app and the ``owner`` of their configuration, so have imports, and both must be equal.
    """
    keys = ["id", "spec", *_scope(imports), *[c for c in ("owner",) if c in imports.columns]]
    met = imports.select(*keys, F.explode(paths.prefixes(F.col("spec"))).alias("prefix")).join(aliases, ["prefix", *[c for c in ("app", "owner") if c in aliases.columns]])
    longest = F.max(F.struct(F.length("prefix").alias("n"), F.col("prefix").alias("prefix")))
    best = met.groupBy(*keys).agg(longest.alias("best"), F.collect_set(F.struct("prefix", "ord", "dir")).alias("all"))
    each = best.select(*keys, F.col("best.prefix").alias("prefix"), F.explode(F.filter("all", lambda x: x["prefix"] == F.col("best.prefix"))).alias("a"))
    rest = F.substring(F.col("spec"), F.length("prefix") + 1, F.length("spec"))
    star = F.replace(F.col("a.dir"), F.lit("*"), F.regexp_replace(rest, "^/", ""))
    star = F.when(rest != "", star)
    return each.select(*keys, F.col("a.ord").alias("ord"), F.when(F.col("a.dir").contains("*"), star).otherwise(F.concat("a.dir", rest)).alias("target"))


def aliased(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, spec[, app], target: the first declared of ``alias_targets``."""
    found = alias_targets(imports, aliases)
    keys = [c for c in found.columns if c not in ("ord", "target")]
    return found.groupBy(*keys).agg(F.min_by("target", "ord").alias("target"))


def relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """id, spec[, app], target: relative specifiers against the folder of their file, folded; null targets climb out."""
    own = imports.filter(F.col("spec").startswith(".")).select("id", "spec").join(files.select("id", "path", *_scope(files)), "id")
    return own.select("id", "spec", *_scope(files), paths.folded(F.concat(paths.directory(F.col("path")), F.lit("/"), F.col("spec"))).alias("target"))


def resolved(targets: DataFrame, files: DataFrame) -> DataFrame:
    """id, spec, dst: the first existing candidate file of the first target (by ``ord``, where there is one) that has any; within the app where targets have one."""
    scope = _scope(targets)
    order = F.col("ord") if "ord" in targets.columns else F.lit(0)
    tried = targets.filter("target IS NOT NULL").select("id", "spec", *scope, order.alias("ord"), F.posexplode(F.array(*[F.concat("target", F.lit(c)) for c in CANDIDATES])).alias("pos", "path"))
    return tried.join(files.select(F.col("id").alias("dst"), "path", *scope), [*scope, "path"]).groupBy("id", "spec").agg(F.min_by("dst", F.struct("ord", "pos")).alias("dst"))


def owners(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """id, dir: the deepest of ``dirs`` (dir) above each file."""
    above = files.select("id", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    return above.join(dirs.select("dir").distinct(), "dir").groupBy("id").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def discovered_apps(files: DataFrame, dirs: DataFrame, least: int = 25) -> DataFrame:
    """dir, n: app folders with at least ``least`` own files, or any if there is none such."""
    counted = owners(files, dirs).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    large = counted.agg(F.coalesce(F.max(F.col("n") >= least), F.lit(False)).alias("some_large"))
    return counted.crossJoin(F.broadcast(large)).filter(~F.col("some_large") | (F.col("n") >= least)).select("dir", "n")


def matched_loaders(files: DataFrame, loaders: list[tuple[str, str]]) -> DataFrame:
    """loader, path: files that a loader's glob names; globs compile to one expression each."""
    marks = F.array(*[F.when(paths.matches_any(F.col("path"), [glob]), F.lit(name)) for name, glob in loaders])
    return files.select("path", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("loader")).select("loader", "path")


def common_directory(files: DataFrame) -> DataFrame:
    """dir: one row, the deepest folder above all paths; the least and the greatest folder share what all share."""
    dirs = files.select(F.concat(paths.directory(F.col("path")), F.lit("/")).alias("dir"))
    ends = dirs.agg(F.min("dir").alias("a"), F.max("dir").alias("b")).filter("a IS NOT NULL")
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    shared = F.slice(a, F.lit(1), F.when(first == 0, F.size(a)).otherwise((first - 1).cast("int")))
    return ends.select(F.regexp_replace(F.array_join(shared, "/"), "/$", "").alias("dir"))


def config_references(literals: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: files that a tool's configuration names in its strings (id, path, literal), relative to its folder or the root."""
    bare = F.regexp_replace(F.regexp_replace("literal", "^<rootDir>/", "./"), r"^(?!\.)", "./")
    target = paths.folded(F.concat(paths.directory(F.col("path")), F.lit("/"), bare))
    found = resolved(literals.select("id", F.col("literal").alias("spec"), target.alias("target")), files)
    return found.select(F.col("id").alias("src"), "dst").distinct()


def manifest_references(targets: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: source files that manifests (id, dir, target) name as what they export."""
    target = paths.folded(F.concat("dir", F.lit("/"), "target"))
    found = resolved(targets.select("id", F.col("target").alias("spec"), target.alias("target")), files)
    return found.select(F.col("id").alias("src"), "dst").distinct()
