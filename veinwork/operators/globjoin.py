"""Globs against paths, both sides large: met by literal folders, then verified.

The folders before a glob's first wildcard are its key, with the name that it
ends in, else the extension; a path has a key for each folder above it and
each kind of ending.  So a pair meets under one key at most, and is then
verified by the glob's regular expression, which is a column: nothing is
compiled on the driver.

Keys of paths are many more rows than their files, which the planner does not
see, so the sides are shuffled whatever it takes them for.  Paths of a key are
dealt in ``SPREAD`` parts, to each of which its globs go, so that no key, like
all files of an extension, is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths

#: Parts in which the paths of a key are dealt.
SPREAD = 16


def pattern(glob: Column) -> Column:
    """A glob as a regular expression of whole paths, as ``paths.glob_regex`` makes it."""
    # a placeholder for each wildcard, so that the rest can be quoted
    marked = F.regexp_replace(glob, r"^\./", "")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\[!([^\]/*?]+)\]", "\u0007\u0008$1\u000e"), r"\[([^\]/*?]+)\]", "\u0007$1\u000e")
    marked = F.regexp_replace(marked, r"(?<![^/])\*\*/", "\u0001")
    marked = F.regexp_replace(marked, r"(?<![^/\u0001])\*\*$", "\u0002")
    marked = F.regexp_replace(marked, r"\*+", "\u0003")
    marked = F.replace(marked, F.lit("?"), F.lit("\u0004"))
    quoted = F.regexp_replace(marked, r"([.+^$()|\[\]\\])", r"\\$1")
    braces = F.regexp_replace(F.regexp_replace(quoted, r"\{([^{}]*)\}", "\u0005$1\u0006"), r"[{}]", r"\\$0")
    # commas are alternatives inside braces only
    out = F.array_join(F.transform(F.split(braces, "\u0006"), lambda part: F.concat(F.substring_index(part, "\u0005", 1), F.when(F.instr(part, "\u0005") > 0, F.concat(F.lit("(?:"), F.replace(F.substring_index(part, "\u0005", -1), F.lit(","), F.lit("|")), F.lit(")"))).otherwise(""))), "")
    for mark, regex in (("\u0001", "(?:[^/]+/)*"), ("\u0002", ".*"), ("\u0003", "[^/]*"), ("\u0004", "[^/]"), ("\u0007", "["), ("\u0008", "^"), ("\u000e", "]")):
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), out, F.lit("$"))


def _keys(glob: Column) -> tuple[Column, Column]:
    """The folder before a glob's first wildcard, and the name or the extension that it ends in, if they are literal."""
    bare = F.regexp_replace(glob, r"^\./", "")
    literal = F.regexp_extract(bare, r"^([^*?\[{]*)", 1)
    whole = F.length(literal) == F.length(bare)
    folder = F.when(whole, paths.directory(bare)).otherwise(F.regexp_replace(F.regexp_extract(literal, r"^(.*)/", 1), "/$", ""))
    last, ending = F.substring_index(bare, "/", -1), F.regexp_extract(bare, r"(\.[^./*?\[\]{}]+)$", 1)
    return folder, F.when(~last.rlike(r"[*?\[\]{}]") & (last != ""), last).when(ending != "", F.concat(F.lit("*"), ending)).otherwise("*")


def matches(globs: DataFrame, files: DataFrame) -> DataFrame:
    """(columns of globs, id, path): files (app, id, path) that a glob (app, glob, ...) names, within their app.

    Where globs have a ``base``, a folder, they are below it.
    """
    folder, tail = _keys(F.col("glob"))
    based = "base" in globs.columns
    if based:
        folder = F.when(F.col("base") == "", folder).when(folder == "", F.col("base")).otherwise(F.concat("base", F.lit("/"), folder))
    own = globs.withColumns({"folder": folder, "tail": tail, "pattern": pattern(F.col("glob"))}).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    ending = F.concat(F.lit("*"), F.regexp_extract("path", r"(\.[^./]+)$", 1))
    tails = F.array_distinct(F.array(F.substring_index("path", "/", -1), ending, F.lit("*")))
    part = F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int").alias("part")
    keyed = files.select("app", "id", "path", part, F.explode(tails).alias("tail")).withColumn("folder", F.explode(paths.ancestors(F.col("path"))))
    met = own.join(keyed.hint("merge"), ["app", "folder", "tail", "part"]).select(*globs.columns, "id", "path", "pattern")
    inside = "substring(path, if(base = '', 1, length(base) + 2))" if based else "path"
    return met.filter(F.expr(f"{inside} RLIKE pattern")).drop("pattern")


def loaded(globs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, dst): files that the files of globs (app, id, path, glob[, loader, negative, pattern]) load.

    Relative globs are below the folder of their file, '/' is the root; others
    name no path.  A loader's negative globs take away what the others name;
    a pattern is found in the path below the glob's folder, from ``./`` on.
    """
    given = {"loader": F.lit(0), "negative": F.lit(False), "pattern": F.lit(None).cast("string")}
    own = globs.withColumns({c: v for c, v in given.items() if c not in globs.columns})
    base = F.concat(paths.directory(F.col("path")), F.lit("/"), F.col("glob"))
    whole = F.when(F.col("glob").startswith("."), paths.folded(base)).when(F.col("glob").startswith("/"), F.regexp_replace("glob", "^/+", "")).when(F.col("glob").startswith("**"), F.col("glob"))
    asked = own.select("app", F.col("id").alias("src"), "loader", "negative", F.col("pattern").alias("found"), whole.alias("glob")).filter("glob IS NOT NULL").distinct()
    met = matches(asked, files.select("app", "id", "path"))
    met = met.filter("found IS NULL OR concat('./', substring(path, length(regexp_extract(glob, '^([^*]*)', 1)) + 1)) RLIKE found")
    hits = met.groupBy("src", "loader", "id").agg(F.bool_or("negative").alias("taken")).filter("NOT taken")
    return hits.select(F.col("src").alias("id"), F.col("id").alias("dst")).distinct()
