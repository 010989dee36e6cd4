"""References beyond imports: pages, loaders, packages, platforms, data clients."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths
from veinwork.operators import resolve

#: Libraries that talk to a database, and calls that open a client.
DATA_LIBRARIES = (
    r"@prisma/(client|adapter-)", r"drizzle-orm", r"(^|/)typeorm(/|$)", r"(^|/)mongoose(/|$)", r"(^|/)sequelize(/|$)", r"@mikro-orm/", r"(^|/)kysely(/|$)", r"(^|/)mongodb(/|$)", r"(^|/)pg(/|$)",
    r"(^|/)postgres(/|$)", r"(^|/)mysql2(/|$)", r"@planetscale/database", r"@neondatabase/serverless", r"better-sqlite3", r"@supabase/(supabase-js|ssr|postgrest-js|auth-helpers-[a-z-]+)(/|$)",
)
CLIENT_CALLS = r"(new PrismaClient|\bdrizzle|new DataSource|new Sequelize|new Kysely|MikroORM\.init|mongoose\.(connect|createConnection))\s*(<[^()]*>)?\s*\("
GENERIC_CALLS = r"(new Pool|new Client|\bpostgres|create(Pool|Connection)|new Database)\s*(<[^()]*>)?\s*\("
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".json")


def reference_graph(*sources: DataFrame) -> DataFrame:
    """Distinct (src, dst) of all kinds of references, without files that refer to themselves."""
    union = sources[0].select("src", "dst")
    for more in sources[1:]:
        union = union.unionByName(more.select("src", "dst"))
    return union.filter("src <> dst").distinct()


def module_scripts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, src) of the module scripts that pages load; comments do not count."""
    bare = F.regexp_replace(F.col(html_col), r"(?s)<!--.*?-->", "")
    tags = pages.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(bare, F.lit(r"(?i)<script\b([^>]*)>"), F.lit(1))).alias("tag"))
    src = F.regexp_extract("tag", r"(?i)\bsrc\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return tags.filter(F.col("tag").rlike(r"(?i)\btype\s*=\s*[\"']?module\b") & ~F.col("tag").contains("vite-ignore")).select("id", src.alias("src")).filter("src <> ''")


def inline_scripts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, scripts, inline_scripts): how many scripts a page has, and how many without a source."""
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html_col), r"(?s)<!--.*?-->", ""), F.lit(r"(?i)<script\b([^>]*)>"), F.lit(1))
    return pages.select(F.col(id_col).alias("id"), F.size(tags).cast("long").alias("scripts"), F.size(F.filter(tags, lambda t: ~F.lower(t).contains("src="))).cast("long").alias("inline_scripts"))


def platform_file(targets: DataFrame, files: DataFrame, platform: str, native: bool) -> DataFrame:
    """id, spec, dst: the file a bundler takes for a platform: exact, then per extension the platform's, the native, the plain one, then the same for an index."""
    ends = [""]
    for base in ("", "/index"):
        for ext in EXTENSIONS:
            ends += [f"{base}.{platform}{ext}", *([f"{base}.native{ext}"] if native else []), f"{base}{ext}"]
    tried = targets.select("id", "spec", F.posexplode(F.array(*[F.concat("target", F.lit(e)) for e in ends])).alias("pos", "path"))
    return tried.join(files.select(F.col("id").alias("dst"), "path"), "path").groupBy("id", "spec").agg(F.min_by("dst", "pos").alias("dst"))


def export_order(keys: list[str]) -> list[str]:
    """Keys of an export map in matching order: exact ones, then patterns, the most specific first."""
    usable = [k for k in keys if not k.endswith("/") and k.count("*") < 2]
    return [k for k in usable if "*" not in k] + sorted((k for k in usable if "*" in k), key=lambda k: (-k.index("*"), -len(k)))


def matching_export(subpath: Column, keys: list[str]) -> Column:
    """The first key that a subpath matches; a star stands for one character at least."""
    chain = F
    for key in export_order(keys):
        if "*" in key:
            head, tail = key.split("*")
            hit = subpath.startswith(head) & subpath.endswith(tail) & (F.length(subpath) >= len(key))
        else:
            hit = subpath == key
        chain = chain.when(hit, key)
    return chain.otherwise(F.lit(None).cast("string")) if export_order(keys) else F.lit(None).cast("string")


def scoped_imports(imports: DataFrame, files: DataFrame, scopes: DataFrame) -> DataFrame:
    """id, spec, dir: '#' imports with the folder of the nearest manifest (dir) above their file."""
    return imports.filter(F.col("spec").startswith("#")).join(resolve.owners(files, scopes), "id").select("id", "spec", "dir")


def computed_pattern(parts: list[str | None]) -> str:
    """A path put together from literals and unknown values (None) as a regular expression: an unknown stays inside one folder and may be empty."""
    return "^" + "".join("[^/]*" if p is None else re.escape(p) for p in parts) + "$"


def computed_targets(files: DataFrame, templates: list[tuple[str, list[str | None]]]) -> DataFrame:
    """loader, path: files that a computed path may name."""
    marks = F.array(*[F.when(F.col("path").rlike(computed_pattern(parts)), F.lit(name)) for name, parts in templates])
    return files.select("path", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("loader")).select("loader", "path")


def entry_candidates(targets: DataFrame, out_dir: str, root_dir: str) -> DataFrame:
    """package, stem: what a manifest's built targets (package, target) name in the sources."""
    moved = F.regexp_replace(F.regexp_replace("target", r"^\./", ""), f"^{re.escape(out_dir)}/", f"{root_dir}/")
    return targets.select("package", F.regexp_replace(moved, r"\.(d\.[cm]?ts|[cm]?[jt]sx?)$", "").alias("stem"))


def package_entries(files: DataFrame, stems: DataFrame) -> DataFrame:
    """package, path: source files whose path without extension is an entry's stem, or its index."""
    stem = F.regexp_replace("path", r"\.(vue|svelte|[cm]?[jt]sx?)$", "")
    keyed = files.select("path", F.explode(F.array_distinct(F.array(stem, F.regexp_replace(stem, "/index$", "")))).alias("stem"))
    return keyed.join(stems, "stem").select("package", "path").distinct()


def data_clients(code: DataFrame, imports: DataFrame) -> DataFrame:
    """path of files (id, path, text) that wrap a database client: a telling call, or a general one beside a known library."""
    library = F.lit(False)
    for pattern in DATA_LIBRARIES:
        library = library | F.col("spec").rlike(pattern)
    known = imports.filter(library).select("id").distinct().withColumn("known", F.lit(True))
    marked = code.join(known, "id", "left")
    return marked.filter(F.col("text").rlike(CLIENT_CALLS) | (F.coalesce("known", F.lit(False)) & F.col("text").rlike(GENERIC_CALLS))).select("path")


def published(files: DataFrame, listed: list[str], ignored: Column) -> DataFrame:
    """path, shipped: what a package publishes: what its list names, or all that its ignore rules keep; manifests always."""
    always = F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).rlike(r"^(package\.json|readme(\..*)?|licen[cs]e(\..*)?)$")
    named = paths.matches_any(F.col("path"), [g for glob in listed for g in (glob, f"{glob.rstrip('/')}/**")]) if listed else ~ignored
    return files.select("path", (always | named).alias("shipped"))
