"""Files that a framework loads by where they stand, so that nothing needs to import them.

A project is a folder whose manifest or configuration names a framework; a
file below it is routed when its path from the folder matches the framework's
pattern.  Folders above files are exploded and meet projects by equality.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths

MODULE = r"\.(js|jsx|ts|tsx|md|mdx)"
#: A framework, the configuration file and the packages that tell it, and where its files stand.
FRAMEWORKS = (
    ("next", r"^next\.config\.(js|mjs|cjs|ts|mts)$", ("next",), r"^(src/)?pages/"),
    (
        "sveltekit", r"^svelte\.config\.(js|mjs|cjs|ts)$", ("@sveltejs/kit",),
        r"^src/(routes/(.*/)?\+(page|page\.server|layout|layout\.server|error|server)(@[^/]*)?\.(svelte|[jt]s)|(hooks(\.server|\.client)?|params|service-worker|instrumentation\.server)\.[jt]s|params/[^/]+\.[jt]s)$",
    ),
    ("expo", None, ("expo-router",), None),
    ("react-router", r"^react-router\.config\.(ts|js|mjs|cjs|mts|cts)$", ("@react-router/dev",), None),
    ("tanstack", None, ("@tanstack/router-plugin", "@tanstack/router-vite-plugin", "@tanstack/router-cli", "@tanstack/react-start", "@tanstack/solid-start"), None),
    ("routify", None, ("@roxi/routify",), r"^src/pages/"),
)


def escaped(text: Column) -> Column:
    """A text as a regular expression for itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _found(listing: DataFrame, manifests: DataFrame) -> DataFrame:
    """dir, framework: projects by configuration files (path) and declared packages (dir, package)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    config = F.array(*[F.when(name.rlike(c), F.lit(f)) for f, c, _, _ in FRAMEWORKS if c])
    by_file = listing.select(paths.directory(F.col("path")).alias("dir"), F.explode(F.filter(config, lambda x: x.isNotNull())).alias("framework"))
    package = F.array(*[F.when(F.col("package").isin(*p), F.lit(f)) for f, _, p, _ in FRAMEWORKS])
    by_package = manifests.select("dir", F.explode(F.filter(package, lambda x: x.isNotNull())).alias("framework"))
    return by_file.unionByName(by_package).distinct()


def module_files(routes: DataFrame, app: Column) -> DataFrame:
    """dir, path: what the routes module of a project (dir, text) names in ``route``, ``index`` and ``layout``, below its app folder."""
    bare = F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", "")
    route = F.regexp_extract_all(bare, F.lit(r"\broute\s*\(\s*(?:['\"][^'\"]*['\"]|[^,'\"()]*)\s*,\s*['\"]([^'\"]+)['\"]"), F.lit(1))
    other = F.regexp_extract_all(bare, F.lit(r"\b(?:index|layout)\s*\(\s*['\"]([^'\"]+)['\"]"), F.lit(1))
    each = routes.select("dir", app.alias("app"), F.explode(F.concat(route, other)).alias("file"))
    return each.select("dir", paths.folded(F.concat("app", F.lit("/"), "file")).alias("path"))


def projects(listing: DataFrame, manifests: DataFrame, app_directory: str = "app", routes_directory: str = "src/routes", ignored_prefix: str = "-") -> DataFrame:
    """dir, framework, pattern: what each project routes, as an expression for paths from its folder.

    ``listing`` has all paths of the tree, ``manifests`` (dir, package).  The
    settings are those of React Router's app folder and TanStack's routes.
    """
    found = _found(listing, manifests)
    inner = listing.filter(F.col("path").rlike("(^|/)src/app/")).select(F.regexp_extract("path", "^(.*?)(^|/)src/app/", 1).alias("dir")).distinct().withColumn("inner", F.lit(True))
    app = re.escape(app_directory.strip("/"))
    flat = rf"^{app}/((root|entry\.client|entry\.server|routes){MODULE}|routes/([^/.][^/]*|[^/.][^/]*/(route|index){MODULE}))$"
    skipped = f"(?!(.*/)?{re.escape(ignored_prefix)})" if ignored_prefix else ""
    chain = F.when(F.col("framework") == "expo", F.when(F.col("inner"), "^src/app/").otherwise("^app/")).when(F.col("framework") == "react-router", flat)
    chain = chain.when(F.col("framework") == "tanstack", f"^{re.escape(routes_directory.strip('/'))}/{skipped}")
    for name, _, _, pattern in FRAMEWORKS:
        if pattern:
            chain = chain.when(F.col("framework") == name, pattern)
    return found.join(inner, "dir", "left").select("dir", "framework", chain.alias("pattern"))


def routed(files: DataFrame, found: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """path, framework: files that a project above them routes, or that a routes module names (dir, path)."""
    above = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    inside = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    met = above.withColumn("inside", inside).join(found, "dir").filter(F.expr("inside rlike pattern")).select("path", "framework")
    if named is not None:
        own = named.select(F.when(F.col("dir") == "", F.col("path")).otherwise(F.concat("dir", F.lit("/"), "path")).alias("path"), F.lit("react-router").alias("framework"))
        met = met.unionByName(own.join(files.select("path").distinct(), "path", "left_semi"))
    return met.distinct()
