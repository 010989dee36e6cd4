"""Files that wrap a database client, and the imports that reach one.

A wrapper is known by its path and by what others import it as: the workspace
package that holds it, or an alias of the importing file's own configuration,
whichever folder is deeper.  Wrappers are a relation of any size; imports meet
them by equality of their beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths, roles
from veinwork.operators import references

#: The libraries whose factories are told by the name that is imported, and those factories.
FACTORY_LIBRARY = r"@supabase/(supabase-js|ssr|postgrest-js|auth-helpers-[a-z-]+)(/|$)"
FACTORIES = r"create(Server|Browser)?Client|create(RouteHandler|ServerComponent|ServerAction|ClientComponent|Middleware|PagesServer|PagesBrowser)Client"


def wrappers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """app, id, path of files (app, id, path, role, text) that open or re-export a database client; request handlers are none.

    imports: id, spec, names, reexport.  A factory counts where it is imported
    by its name, or all of its module is.
    """
    own = files.filter(~F.col("role").isin(*roles.REQUEST_ENTRY))
    opening = references.data_clients(own, imports).distinct().withColumn("opens", F.lit(True))
    library = F.lit(False)
    for pattern in references.DATA_LIBRARIES:
        library = library | F.col("spec").rlike(pattern)
    named = F.exists("names", lambda n: (n == "*") | n.rlike(f"^({FACTORIES})$"))
    told = imports.groupBy("id").agg(F.bool_or(F.col("reexport") & library).alias("passes"), F.bool_or(F.col("spec").rlike(FACTORY_LIBRARY) & F.coalesce(named, F.lit(False))).alias("factory"))
    met = own.join(opening, "path", "left").join(told, "id", "left")
    calls = F.col("text").rlike(rf"\b({FACTORIES})\s*(<[^()]*>)?\s*\(")
    return met.filter(F.coalesce("opens", F.lit(False)) | F.coalesce("passes", F.lit(False)) | (F.coalesce("factory", F.lit(False)) & calls)).select("app", "id", "path").distinct()


def stem(path: Column) -> Column:
    """A path as it is imported: without its extension, a folder for its index."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(ts|tsx)$", ""), "/index$", "")


def beginnings(text: Column) -> Column:
    """All of a text, and its parts before a slash, a point or a dash."""
    at = F.filter(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(text, k, F.lit(1)).isin("/", ".", "-"))
    return F.array_distinct(F.concat(F.transform(at, lambda k: F.substring(text, F.lit(1), k - 1)), F.array(text)))


def importable(wrapped: DataFrame, owners: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """(app, owner, mark): beginnings of specifiers by which files of an owner's folder import wrappers (app, id, path).

    owners: app, owner; aliases: app, owner, prefix, dir; packages: app, name,
    dir.  The deepest folder above a wrapper gives its name, of all packages
    but the root's and the owner's aliases; an alias wins where both are equal.
    """
    above = wrapped.select("app", "id", "path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array(stem(F.col("path"))))).alias("dir"))
    held = above.join(packages.filter("dir <> ''").select("app", "dir", "name"), ["app", "dir"]).groupBy("app", "id").agg(F.max_by("name", F.length("dir")).alias("name"), F.max(F.length("dir")).alias("size"))
    named = above.join(aliases.filter("prefix IS NOT NULL AND NOT contains(dir, '*')"), ["app", "dir"])
    rest = F.regexp_replace(F.substring(stem(F.col("path")), F.length("dir") + 1, F.length("path")), "^/", "")
    mark = F.when(rest == "", F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), rest))
    best = named.groupBy("app", "owner", "id").agg(F.max(F.struct(F.length("dir").alias("size"), mark.alias("mark"))).alias("a"))
    # owners without an alias for a wrapper know it by its package; owners are folders with a configuration
    by_package = held.join(owners.select("app", "owner").distinct(), "app").join(best, ["app", "owner", "id"], "left").filter("a IS NULL OR a.size < size")
    by_alias = best.join(held, ["app", "id"], "left").filter("size IS NULL OR a.size >= size")
    return by_package.select("app", "owner", F.col("name").alias("mark")).unionByName(by_alias.select("app", "owner", F.col("a.mark").alias("mark"))).distinct()


def reaching(imports: DataFrame, wrapped: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(id, spec): imports (app, id, spec, leaf[, owner]) that end at a wrapper, or are written as one is imported."""
    known = wrapped.select("app", F.regexp_replace("path", r"\.(ts|tsx)$", "").alias("begin"))
    ends = imports.filter("leaf IS NOT NULL").select("app", "id", "spec", F.explode(beginnings(F.col("leaf"))).alias("begin"))
    found = ends.join(known, ["app", "begin"], "left_semi").select("id", "spec")
    if marks is not None:
        written = imports.select("app", "owner", "id", "spec", F.explode(beginnings(F.col("spec"))).alias("mark"))
        found = found.unionByName(written.join(marks, ["app", "owner", "mark"], "left_semi").select("id", "spec"))
    return found.distinct()
