"""What an import names: candidates from all sources, ranked, and the first that exists, in one shuffle.

An import is tried as a relative path, through the aliases of the
configuration that owns its file, through the ``#`` keys of the nearest
manifest, and through the packages of the workspace.  Each source only adds
rows (source, ord, target); the files that exist are met once, for all
sources and platforms, and the least rank wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths
from veinwork.operators import references, resolve

#: What an import of a built file may mean in the sources.
BUILT = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".ts", ".tsx"), ".cjs": (".ts", ".tsx")}
NATIVE_FREE = "web"


def owned(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(id, dir): the deepest of dirs (app, dir) above each file, within its app."""
    above = files.select("id", "app", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    return above.join(dirs.select("app", "dir").distinct(), ["app", "dir"]).groupBy("id").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def matched_subpaths(wanted: DataFrame, subpaths: DataFrame) -> DataFrame:
    """(keys of wanted, ord, target): targets of the key of a map that a subpath matches.

    ``wanted`` has app, dir and subpath, ``subpaths`` (app, dir, key, at,
    targets).  Exact keys meet by equality; patterns by their literal head,
    which a subpath is cut to at each length that heads of its map have.  An
    exact key wins, then the longest head, then the longest key; a star stands
    for one character at least.
    """
    keys = wanted.columns
    exact = wanted.join(subpaths.filter("NOT contains(key, '*')").withColumnRenamed("key", "subpath"), ["app", "dir", "subpath"])
    exact = exact.select(*keys, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.col("at")).alias("rank"), "targets", F.lit("").alias("star"))
    star = F.instr("key", "*") - 1
    patterns = subpaths.filter("contains(key, '*')").select("app", "dir", "key", "at", "targets", F.substring(F.col("key"), F.lit(1), star).alias("head"), F.substring(F.col("key"), star + 2, F.length("key")).alias("tail"))
    lengths = patterns.groupBy("app", "dir").agg(F.collect_set(F.length("head")).alias("lengths"))
    cut = wanted.join(lengths, ["app", "dir"]).withColumn("n", F.explode("lengths")).withColumn("head", F.substring(F.col("subpath"), F.lit(1), F.col("n")))
    met = cut.join(patterns, ["app", "dir", "head"]).filter(F.col("subpath").endswith(F.col("tail")) & (F.length("subpath") >= F.length("key")))
    met = met.select(
        *keys, F.struct(F.lit(1).alias("a"), (-F.length("head")).alias("b"), (-F.length("key")).alias("c"), F.col("at")).alias("rank"), "targets",
        F.substring(F.col("subpath"), F.length("head") + 1, F.length("subpath") - F.length("key") + 1).alias("star"),
    )
    best = exact.unionByName(met).groupBy(*keys).agg(F.min_by(F.struct("targets", "star"), "rank").alias("x"))
    each = best.select(*keys, "x.star", F.posexplode("x.targets").alias("ord", "target"))
    return each.select(*keys, "ord", F.replace("target", F.lit("*"), F.col("star")).alias("target"))


def candidates(imports: DataFrame, files: DataFrame, aliases: DataFrame, scopes: DataFrame, hashes: DataFrame, packages: DataFrame, exports: DataFrame) -> DataFrame:
    """(app, id, spec, source, ord, target): paths that an import may name, by rank.

    imports: app, id, spec; files: app, id, path of what imports; aliases: app,
    owner, prefix, ord, dir; scopes: app, dir of manifests, with ``hashes``
    their ``#`` keys; packages: app, name, dir, entry, with ``exports`` their
    keys (both as ``matched_subpaths`` has them).  The folders of aliases are
    those of their owners, also where an owner has none: nothing above counts.
    """
    keys = ["app", "id", "spec"]
    near = resolve.relative(imports, files).select(*keys, F.lit(0).alias("source"), F.lit(0).alias("ord"), "target")
    bare = imports.filter("NOT startswith(spec, '.')").select(*keys)
    owner = owned(files, aliases.select("app", F.col("owner").alias("dir"))).withColumnRenamed("dir", "owner")
    mapped = resolve.alias_targets(bare.join(owner, "id"), aliases.filter("prefix IS NOT NULL"))
    mapped = mapped.select(*keys, F.lit(0).alias("source"), "ord", paths.folded(F.col("target")).alias("target"))
    hashed = bare.filter("startswith(spec, '#')").join(owned(files, scopes), "id").withColumn("subpath", F.col("spec"))
    hashed = matched_subpaths(hashed, hashes).select(*keys, F.lit(1).alias("source"), "ord", "target")
    known = packages.withColumnRenamed("name", "prefix")
    met = bare.filter("NOT startswith(spec, '#')").select(*keys, F.explode(paths.prefixes(F.col("spec"))).alias("prefix")).join(known, ["app", "prefix"])
    owned_by = met.groupBy(*keys).agg(F.max_by(F.struct("prefix", "dir", "entry"), F.length("prefix")).alias("p")).select(*keys, "p.*")
    rest = F.substring(F.col("spec"), F.length("prefix") + 1, F.length("spec"))
    index = F.concat("entry", F.array("dir"))
    entries = owned_by.filter(rest == "").select(*keys, F.lit(2).alias("source"), F.posexplode(index).alias("ord", "target"))
    below = owned_by.filter(rest != "").select(*keys, "dir", F.concat(F.lit("."), rest).alias("subpath"))
    exported = matched_subpaths(below, exports).select(*keys, F.lit(2).alias("source"), "ord", "target")
    written = below.select(*keys, F.lit(3).alias("source"), F.lit(0).alias("ord"), paths.folded(F.concat("dir", F.substring(F.col("subpath"), F.lit(2), F.length("subpath")))).alias("target"))
    out = near
    for more in (mapped, hashed, entries, exported, written):
        out = out.unionByName(more)
    return out.filter("target IS NOT NULL")


def _tries(target: Column) -> Column:
    """Source files that a path may mean: of a built file its source, then the path itself, with an extension, and as a folder."""
    built = F.lit(None)
    for end, sources in BUILT.items():
        stem = F.substring(target, F.lit(1), F.length(target) - len(end))
        built = F.when(target.endswith(end), F.array(*[F.concat(stem, F.lit(s)) for s in sources])).otherwise(built)
    plain = F.array(*[F.concat(target, F.lit(c)) for c in resolve.CANDIDATES])
    return F.concat(F.coalesce(built, F.array().cast("array<string>")), plain)


def _platform_tries(target: Column, name: Column) -> Column:
    """The same for a bundler's platform: its own file of each extension, then the native one, then the plain one."""
    ends = [(F.lit(""), F.lit(True))]
    for base in ("", "/index"):
        for ext in references.EXTENSIONS:
            ends += [(F.concat(F.lit(f"{base}."), name, F.lit(ext)), F.lit(True)), (F.lit(f"{base}.native{ext}"), name != NATIVE_FREE), (F.lit(f"{base}{ext}"), F.lit(True))]
    return F.array(*[F.when(use, F.concat(target, end)) for end, use in ends])


def first_hits(found: DataFrame, files: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """(app, id, spec, platform, dst): the first file that exists, by (source, ord, place among its tries); ``platform`` is '' without one.

    ``platforms`` (id, platforms) names those that a file's imports are built for too.
    """
    per = found.withColumn("platforms", F.array(F.lit("")))
    if platforms is not None:
        per = found.join(platforms, "id", "left").withColumn("platforms", F.concat(F.array(F.lit("")), F.coalesce("platforms", F.array().cast("array<string>"))))
    per = per.withColumn("platform", F.explode("platforms"))
    tries = F.when(F.col("platform") == "", _tries(F.col("target"))).otherwise(_platform_tries(F.col("target"), F.col("platform")))
    tried = per.select("app", "id", "spec", "platform", "source", "ord", F.posexplode(tries).alias("pos", "path")).filter("path IS NOT NULL")
    met = tried.join(files.select("app", F.col("id").alias("dst"), "path"), ["app", "path"])
    return met.groupBy("app", "id", "spec", "platform").agg(F.min_by("dst", F.struct("source", "ord", "pos")).alias("dst"))
