"""Ignore and publish rules as rows: the last line that matches a path, or a folder above it, decides.

Rules (app, dir, line, text) are lines of the file that stands in ``dir``; they
are found in the tree and parsed by column expressions.  A line is a glob below
its folder and meets files and folders by ``globjoin``; the verdict on a path
is an aggregate, the last of its matching lines, and a file is out where it,
or any folder above it, is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths
from veinwork.operators import globjoin
from veinwork.sources import settings

#: Fixed value: what is ignored before any file says so.
DEFAULT_IGNORES = ("node_modules", "dist", "build", "coverage", ".next", ".git")
#: Fixed value: what a package always holds.
ALWAYS_PACKED = r"(?i)^(package\.json|readme(\..*)?|licen[cs]e(\..*)?)$"


def lines_of(files: DataFrame, name: str) -> DataFrame:
    """(app, dir, line, text) of all files of a name, wherever they stand."""
    own = files.filter(settings.name_of(F.col("path")) == name)
    return own.select("app", paths.directory(F.col("path")).alias("dir"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))


def parsed(lines: DataFrame, partial: bool = False) -> DataFrame:
    """(app, base, line, keeps, folders, glob): lines as globs below their folder; comments and empty lines go.

    A line without an inner slash matches at any depth.  With ``partial`` a
    line that keeps something keeps the folders on the way to it too.
    """
    text = F.when(F.col("text").endswith("\\ "), F.col("text")).otherwise(F.rtrim("text"))
    own = lines.select("app", F.col("dir").alias("base"), "line", text.alias("text")).filter("text <> '' AND NOT startswith(text, '#')")
    keeps = F.length(F.regexp_extract("text", "^(!*)", 1)) % 2 == 1
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^!+", ""), "/+", "/"), r"^\\(?=[#!])", ""), r"\\ $", " ")
    folders = body.endswith("/")
    bare = F.regexp_replace(body, "/+$", "")
    glob = F.when(bare.contains("/"), F.regexp_replace(F.regexp_replace(bare, r"^\./", ""), "^/", "")).otherwise(F.concat(F.lit("**/"), bare))
    rules = own.select("app", "base", "line", keeps.alias("keeps"), folders.alias("folders"), glob.alias("glob"), bare.contains("/").alias("way")).filter("glob NOT IN ('', '**/')")
    if partial:
        parts = F.split("glob", "/")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        way = rules.filter("keeps AND way AND contains(glob, '/')").select("app", "base", "line", "keeps", F.lit(True).alias("folders"), F.explode(heads).alias("glob"), "way")
        rules = rules.unionByName(way)
    return rules.drop("way")


def left_out(files: DataFrame, lines: DataFrame, partial: bool = False, nocase: bool = False) -> DataFrame:
    """(id, dir): files (app, id, path) that the lines of a folder above them leave out."""
    fold: Column = F.lower("path") if nocase else F.col("path")
    own = files.select("app", "id", fold.alias("path"))
    rules = parsed(lines, partial)
    if nocase:
        rules = rules.withColumns({"glob": F.lower("glob"), "base": F.lower("base")})
    above = own.select("app", F.explode(paths.ancestors(F.col("path"))).alias("path")).filter("path <> ''").distinct()
    nodes = above.withColumn("folder", F.lit(True)).unionByName(own.select("app", "path").distinct().withColumn("folder", F.lit(False)))
    met = globjoin.matches(rules, nodes.select("app", F.col("folder").alias("id"), "path")).filter("id OR NOT folders")
    last = met.groupBy("app", "base", "path", "id").agg(F.max_by("keeps", "line").alias("keeps")).filter("NOT keeps")
    self_and_above = F.concat(F.transform(paths.ancestors(F.col("path")), lambda p: F.struct(p.alias("path"), F.lit(True).alias("folder"))), F.array(F.struct(F.col("path").alias("path"), F.lit(False).alias("folder"))))
    walked = own.select("app", F.col("id").alias("file"), F.explode(self_and_above).alias("x")).select("app", "file", "x.path", F.col("x.folder").alias("id"))
    # rows for each folder above a file, which the planner takes for as many as the files
    return walked.hint("merge").join(last, ["app", "path", "id"]).select(F.col("file").alias("id"), F.col("base").alias("dir")).distinct()


def not_ignored(files: DataFrame, written: DataFrame) -> DataFrame:
    """Files (app, id, path, ...) that no ignore file found among ``written``, wherever it stands, leaves out; each only adds.

    The root's has the default names before its own lines.
    """
    defaults = files.select("app").distinct().select("app", F.lit("").alias("dir"), F.posexplode(F.array(*[F.lit(d) for d in DEFAULT_IGNORES])).alias("line", "text")).withColumn("line", F.col("line") - len(DEFAULT_IGNORES))
    return files.join(left_out(files, lines_of(written, ".gitignore").unionByName(defaults)).select("id").distinct(), "id", "left_anti")


def shipped_files(files: DataFrame, written: DataFrame, described: DataFrame) -> DataFrame:
    """id: files that a published package without ``exports`` ships as they are, so that its users can import them by path.

    ``described`` are manifests (``settings.manifests``).  What is packed says the ``files``
    list, else ``.npmignore``, else ``.gitignore`` of the package's folder; what a
    compiler builds from a file is not followed.  Members of a workspace are
    not packed with its root.
    """
    packs = lines_of(written, ".npmignore")
    marked = packs.select("app", "dir").distinct().withColumn("npmignore", F.lit(True))
    owned = described.join(marked, ["app", "dir"], "left").withColumn("npmignore", F.coalesce("npmignore", F.lit(False)))
    owned = owned.filter("name IS NOT NULL AND NOT private AND NOT closed AND (files IS NOT NULL OR publishes OR npmignore)").select("app", "dir", "files", "elsewhere", "npmignore")
    entry = F.regexp_replace(F.regexp_replace("file", r"^\./", "/"), r"/\*$", "/**")
    listed = owned.filter("files IS NOT NULL AND NOT elsewhere")
    each = listed.select("app", "dir", F.posexplode("files").alias("at", "file")).select(
        "app", "dir", F.explode(F.when(entry.rlike(r"[*?\[{]"), F.array(F.struct((2 * F.col("at") + 1).alias("line"), F.concat(F.lit("!"), entry).alias("text")))).otherwise(
            F.array(F.struct((2 * F.col("at") + 1).alias("line"), F.concat(F.lit("!"), entry).alias("text")), F.struct((2 * F.col("at") + 2).alias("line"), F.concat(F.lit("!"), entry, F.lit("/**")).alias("text"))))).alias("x"),
    ).select("app", "dir", "x.*")
    everything = listed.select("app", "dir", F.lit(0).alias("line"), F.lit("*").alias("text"))
    by_npm = packs.join(owned.filter("files IS NULL AND NOT elsewhere").select("app", "dir"), ["app", "dir"], "left_semi")
    by_git = lines_of(written, ".gitignore").join(owned.filter("files IS NULL AND NOT elsewhere AND NOT npmignore").select("app", "dir"), ["app", "dir"], "left_semi")
    lines = everything.unionByName(each).unionByName(by_npm.select("app", "dir", "line", "text")).unionByName(by_git.select("app", "dir", "line", "text"))
    above = files.select("app", "id", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    held = above.join(owned.select("app", "dir"), ["app", "dir"])
    members = settings.workspace_members(written, described).select("app", F.col("root").alias("dir"), F.col("dir").alias("member"))
    inner = above.withColumnRenamed("dir", "member").join(members, ["app", "member"]).select("app", "id", "dir").distinct()
    out = left_out(files, lines, partial=True, nocase=True).withColumnRenamed("dir", "folded")
    return held.join(inner, ["app", "id", "dir"], "left_anti").withColumn("folded", F.lower("dir")).join(out, ["id", "folded"], "left_anti").select("id").distinct()
