"""Settings of a code base as relations: compiler configurations, manifests, workspaces.

Settings are rows (app, path, text); ``app`` names a code base, and paths are
below its root.  A worker parses one small file at a time; what a file says
about other files (what it extends, refers to, contains) is joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions import paths
from veinwork.operators.graph import kept
from veinwork.sources.code import _joined, loose_json, workspace_globs

#: The configuration that owns a folder, and the file that describes a package.
CONFIGURATION, MANIFEST, PNPM, PNPM_LOCK = "tsconfig.json", "package.json", "pnpm-workspace.yaml", "pnpm-lock.yaml"
CONFIG_SCHEMA = "app string, path string, dir string, base string, keys array<struct<key:string,target:string>>, extends array<string>, references array<string>, out string, root string"
MANIFEST_SCHEMA = (
    "app string, dir string, name string, declared array<string>, entry array<string>, exports array<struct<key:string,targets:array<string>>>, "
    "imports array<struct<key:string,targets:array<string>>>, workspaces array<string>, pnpm boolean, closed boolean, "
    "files array<string>, private boolean, publishes boolean, elsewhere boolean"
)
_DECLARED = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _parsed(files: DataFrame, one: Callable[[str, str], tuple], schema: str) -> DataFrame:
    """``one(path, text)`` of each file, as rows of ``schema`` after the app."""
    columns = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", schema)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(app, *one(path, text or "")) for app, path, text in batch[["app", "path", "text"]].itertuples(index=False)], columns=columns)

    return files.select("app", "path", "text").mapInPandas(rows, schema)


def _strings(value: object) -> list[str]:
    """Every string inside a JSON value, in order."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        value = list(value.values())
    return [s for v in value for s in _strings(v)] if isinstance(value, list) else []


def _configuration(path: str, text: str) -> tuple:
    config, folder = loose_json(text), path.rpartition("/")[0]
    options = config.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    keys, base = options.get("paths"), options.get("baseUrl")
    pairs = [{"key": k, "target": t} for k, targets in keys.items() if isinstance(targets, list) for t in targets if isinstance(t, str)] if isinstance(keys, dict) else None
    extended = config.get("extends", [])
    extended = [_joined(folder, e) for e in ([extended] if isinstance(extended, str) else extended) if isinstance(e, str) and e.startswith(".")]
    references = config.get("references")
    references = [_joined(folder, r.get("path", "")) for r in references if isinstance(r, dict)] if isinstance(references, list) else []
    placed = [_joined(folder, options[o]) if isinstance(options.get(o), str) else None for o in ("outDir", "rootDir")]
    return path, folder, _joined(folder, base) if isinstance(base, str) else None, pairs, extended, references, *placed


def configurations(settings: DataFrame) -> DataFrame:
    """Compiler configurations, as written: any JSON file but manifests can be extended."""
    return _parsed(settings.filter(F.col("path").endswith(".json") & (name_of(F.col("path")) != MANIFEST)), _configuration, CONFIG_SCHEMA)


def ancestry(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(app, path, above, order): what each node has above it over links (app, path, above, order), itself included.

    ``order`` is the place in a depth-first walk, as an array that sorts so.
    Ways double in each round: links of 1, 2, 4, ... steps, so a chain of n
    takes log2(n) rounds; of several ways to a node the first stays, so a
    circle ends.
    """
    own = nodes.select("app", "path", F.col("path").alias("above"), F.array().cast("array<int>").alias("order"))
    first = lambda df: df.groupBy("app", "path", "above").agg(F.min("order").alias("order"))
    known = kept(first(own.unionByName(links.select("app", "path", "above", F.array("order").alias("order")))))
    number = known.count()
    while True:
        further = known.select("app", F.col("path").alias("above"), F.col("above").alias("top"), F.col("order").alias("rest"))
        longer = known.join(further, ["app", "above"]).select("app", "path", F.col("top").alias("above"), F.concat("order", "rest").alias("order"))
        known, before = kept(first(longer)), number
        number = known.count()
        if number == before:
            return known


def inherited_options(configs: DataFrame) -> DataFrame:
    """(app, path, keys, base, base_url, out, root): path aliases with their base folder, and the folders that are
    compiled to and from, own or from the nearest configuration that one extends."""
    names = configs.select("app", F.col("path").alias("above"))
    written = configs.select("app", "path", F.posexplode("extends").alias("at", "target"))
    # a later entry of the list wins over an earlier one
    tried = written.select("app", "path", (-F.col("at")).alias("order"), F.posexplode(F.array("target", F.concat("target", F.lit(".json")))).alias("pos", "above"))
    links = tried.join(names, ["app", "above"]).groupBy("app", "path", "order").agg(F.min_by("above", "pos").alias("above"))
    chain = ancestry(links, configs).join(configs.select("app", F.col("path").alias("above"), "dir", "keys", "base", "out", "root"), ["app", "above"])
    nearest = lambda value, there: F.min_by(value, F.when(there, F.col("order")))
    found = chain.groupBy("app", "path").agg(
        nearest("keys", F.col("keys").isNotNull()).alias("keys"), nearest("dir", F.col("keys").isNotNull()).alias("keys_dir"), nearest("base", F.col("base").isNotNull()).alias("base_url"),
        *[nearest(c, F.col(c).isNotNull()).alias(c) for c in ("out", "root")],
    )
    return found.select("app", "path", "keys", F.coalesce("base_url", "keys_dir").alias("base"), "base_url", "out", "root")


def compiled_folders(settings: DataFrame) -> DataFrame:
    """(app, owner, out, root): folders that a configuration compiles to and from; where none is named as the source, its ``src`` and itself."""
    configs = kept(configurations(settings))
    own = configs.filter(name_of(F.col("path")).rlike(r"^tsconfig[^/]*\.json$")).select("app", "path", F.col("dir").alias("owner"))
    placed = own.join(inherited_options(configs), ["app", "path"]).filter("out IS NOT NULL")
    source = F.concat(F.when(F.col("owner") == "", "").otherwise(F.concat("owner", F.lit("/"))), F.lit("src"))
    return placed.select("app", "owner", "out", F.explode(F.when(F.col("root").isNotNull(), F.array("root")).otherwise(F.array(source, "owner"))).alias("root")).distinct()


def _below(folder: Column, target: Column) -> Column:
    return paths.folded(F.concat(folder, F.lit("/"), target))


def config_aliases(settings: DataFrame, files: DataFrame) -> DataFrame:
    """(app, owner, prefix, ord, dir): the import aliases of each folder with a configuration, in the order they are tried; a row without prefix for each.

    First the configuration's own, patterns before exact keys; then what those
    it refers to add, unless two of them map a prefix differently; then the
    folders of its ``baseUrl``; last the package's own name where no alias
    matches it.  A star that is not a target's last segment stays in it.
    """
    configs = kept(configurations(settings))
    options = kept(inherited_options(configs))
    owners = configs.filter(name_of(F.col("path")) == CONFIGURATION).select("app", F.col("dir").alias("owner"), "path", "references")
    tried = owners.select("app", "owner", F.posexplode("references").alias("k", "target")).select(
        "app", "owner", (F.col("k") + 1).alias("member"), F.posexplode(F.array("target", F.concat(F.when(F.col("target") == "", "").otherwise(F.concat("target", F.lit("/"))), F.lit(CONFIGURATION)))).alias("pos", "path")
    )
    peers = tried.join(configs.select("app", "path"), ["app", "path"]).groupBy("app", "owner", "member").agg(F.min_by("path", "pos").alias("path"))
    members = owners.select("app", "owner", F.lit(0).alias("member"), "path").unionByName(peers).join(options, ["app", "path"])
    keys = members.select("app", "owner", "member", "base", F.posexplode("keys").alias("k", "x")).select("app", "owner", "member", "k", "base", "x.*")
    keys = keys.filter(~(F.col("key").endswith("*") & ~F.col("key").endswith("/*")))
    prefix = F.regexp_replace(F.regexp_replace("key", r"/\*$", ""), r"/?\*$", "")
    folder = F.regexp_replace(_below(F.col("base"), F.regexp_replace("target", r"/\*$", "")), r"/?\*$", "")
    named = keys.select("app", "owner", "member", prefix.alias("prefix"), F.struct(~F.col("key").contains("*"), F.col("k")).alias("k"), folder.alias("dir"))
    lists = named.groupBy("app", "owner", "prefix", "member").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "dir"))), lambda x: x["dir"]).alias("dirs"))
    chosen = lists.groupBy("app", "owner", "prefix").agg(F.min_by("dirs", "member").alias("dirs"), F.min("member").alias("first"), F.count_distinct("dirs").alias("ways"))
    explicit = chosen.filter("first = 0 OR ways = 1").select("app", "owner", "prefix", "dirs")
    # folders right below a baseUrl are prefixes of their own
    based = members.filter("member = 0 AND base_url IS NOT NULL").select("app", "owner", F.col("base_url").alias("parent"))
    folders = files.select("app", F.explode(paths.ancestors(F.col("path"))).alias("dir")).filter("dir <> ''").distinct()
    plain = folders.select("app", paths.directory(F.col("dir")).alias("parent"), name_of(F.col("dir")).alias("prefix"), "dir").filter("prefix <> 'node_modules' AND NOT startswith(prefix, '.')")
    more = based.join(plain, ["app", "parent"]).select("app", "owner", "prefix", F.array("dir").alias("dirs")).join(explicit, ["app", "owner", "prefix"], "left_anti")
    both = kept(explicit.unionByName(more))
    own = manifests(settings).filter("name IS NOT NULL").select("app", F.col("dir").alias("owner"), "name").join(owners.select("app", "owner"), ["app", "owner"])
    named_self = own.select("app", "owner", "name", F.explode(paths.prefixes(F.col("name"))).alias("prefix")).join(both, ["app", "owner", "prefix"]).select("app", "owner").distinct()
    selves = own.join(named_self, ["app", "owner"], "left_anti").select("app", "owner", F.col("name").alias("prefix"), F.array("owner").alias("dirs"))
    none = owners.select("app", "owner", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("dir"))
    return both.unionByName(selves).select("app", "owner", "prefix", F.posexplode("dirs").alias("ord", "dir")).unionByName(none)


def _keys(field: object, folder: str, accepted: Callable[[str], bool]) -> list[dict]:
    if not isinstance(field, dict):
        return []
    out = []
    for key, value in field.items():
        if accepted(key) and not key.endswith("/") and key.count("*") < 2:
            targets = [t for t in _strings(value) if t.startswith("./")]
            out.append({"key": key, "targets": [_joined(folder, t) for t in sorted(targets, key=_declares)]})
    return out


def _declares(target: str) -> bool:
    return re.search(r"\.d\.[cm]?ts$", target) is not None


def _manifest(path: str, text: str) -> tuple:
    found, folder = loose_json(text), path.rpartition("/")[0]
    exports = found.get("exports")
    root = exports.get(".") if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else exports
    entry = _strings(root) + [s for f in ("types", "typings", "main", "module") for s in _strings(found.get(f))]
    declared = [p for f in _DECLARED for p in (found.get(f) if isinstance(found.get(f), dict) else {})]
    name, globs = found.get("name"), found.get("workspaces")
    return (
        folder, name if isinstance(name, str) and name else None, sorted(set(declared)), [_joined(folder, e) for e in sorted(entry, key=_declares)],
        _keys(exports, folder, lambda k: k.startswith("./")), _keys(found.get("imports"), folder, lambda k: k.startswith("#") and k != "#"),
        [g for g in workspace_globs(text) if isinstance(g, str)] if globs is not None else None,
        isinstance(found.get("packageManager"), str) and found["packageManager"].startswith("pnpm@"), exports is not None,
        [f for f in listed if isinstance(f, str)] if isinstance(listed := found.get("files"), list) else None, bool(found.get("private")),
        "publishConfig" in found, isinstance(found.get("publishConfig"), dict) and "directory" in found["publishConfig"],
    )


def manifests(settings: DataFrame) -> DataFrame:
    """One row a manifest: what it is called, declares, exports and imports, targets from the root, declaration files last."""
    return _parsed(settings.filter(name_of(F.col("path")) == MANIFEST), _manifest, MANIFEST_SCHEMA)


def sources_of(built: DataFrame, compiled: DataFrame) -> DataFrame:
    """(columns of built, moved): where the source of a built target (app, dir, target) may be.

    ``compiled`` (app, owner, out, root) are folders compiled to and from, of
    configurations at or above ``dir``; the deepest out folder that holds the
    target says where.  A declaration file stands for its source.
    """
    keys = built.columns
    places = F.concat(paths.ancestors(F.col("dir")), F.array("dir"))
    near = built.select(*keys, F.explode(F.array_distinct(places)).alias("owner")).join(compiled, ["app", "owner"])
    inside = near.filter((F.col("out") == "") | F.col("target").startswith(F.concat("out", F.lit("/"))))
    deepest = inside.groupBy(*keys).agg(F.max(F.struct(F.length("out").alias("n"), F.length("owner").alias("m"))).alias("best"))
    chosen = inside.join(deepest, keys).filter((F.length("out") == F.col("best.n")) & (F.length("owner") == F.col("best.m")))
    rest = F.when(F.col("out") == "", F.col("target")).otherwise(F.substring(F.col("target"), F.length("out") + 2, F.length("target")))
    moved = F.when(F.col("root") == "", rest).otherwise(F.concat("root", F.lit("/"), rest))
    return chosen.select(*keys, F.regexp_replace(moved, r"\.d\.([cm]?)ts$", ".$1js").alias("moved")).distinct()


def workspace_members(settings: DataFrame, described: DataFrame) -> DataFrame:
    """(app, root, dir): folders that the globs of a workspace root name, one level below for a star.

    In a pnpm repository its own file comes first, else the manifest; the other
    counts where the first lists nothing.
    """
    yaml = _parsed(settings.filter(name_of(F.col("path")) == PNPM), lambda path, text: (path.rpartition("/")[0], workspace_globs("{}", text)), "app string, dir string, globs array<string>")
    locked = settings.filter(name_of(F.col("path")) == PNPM_LOCK).select("app", paths.directory(F.col("path")).alias("dir"), F.lit(True).alias("locked"))
    none = F.array().cast("array<string>")
    both = described.filter("workspaces IS NOT NULL OR pnpm").select("app", "dir", "workspaces", "pnpm").join(yaml, ["app", "dir"], "full").join(locked, ["app", "dir"], "left")
    own, other = F.coalesce("workspaces", none), F.coalesce("globs", none)
    pnpm = F.coalesce("locked", F.lit(False)) | F.coalesce("pnpm", F.lit(False))
    first, second = F.when(pnpm, other).otherwise(own), F.when(pnpm, own).otherwise(other)
    globs = both.select("app", F.col("dir").alias("root"), F.explode(F.when(F.size(first) > 0, first).otherwise(second)).alias("glob")).filter("NOT startswith(glob, '!')")
    star = F.col("glob").rlike(r"/\*\*?$")
    named = globs.select("app", "root", star.alias("star"), _below(F.col("root"), F.regexp_replace("glob", r"/\*\*?$", "")).alias("at"))
    folders = described.select("app", "dir", F.explode(F.array(F.struct(F.lit(False).alias("star"), F.col("dir").alias("at")), F.struct(F.lit(True).alias("star"), paths.directory(F.col("dir")).alias("at")))).alias("x"))
    folders = folders.select("app", "dir", "x.*").filter("NOT star OR dir <> ''")
    return named.join(folders, ["app", "star", "at"]).select("app", "root", "dir").distinct()


def subpath_rows(described: DataFrame, field: str) -> DataFrame:
    """(app, dir, key, at, targets) of the ``exports`` or ``imports`` of manifests."""
    return described.select("app", "dir", F.posexplode(field).alias("at", "x")).select("app", "dir", "at", "x.key", "x.targets")


def workspace_packages(settings: DataFrame, described: DataFrame) -> DataFrame:
    """(app, name, dir, entry): packages of the workspaces; a name that several have is that of the least deep root and first folder."""
    rank = F.struct(F.size(F.split("root", "/")), F.col("root"), F.col("dir"))
    members = workspace_members(settings, described).join(described.filter("name IS NOT NULL"), ["app", "dir"])
    return members.withColumn("n", F.row_number().over(Window.partitionBy("app", "name").orderBy(rank))).filter("n = 1").select("app", "name", "dir", "entry", "closed")


def platforms(described: DataFrame) -> DataFrame:
    """(app, dir, platforms): what a bundler of native apps builds for, by nearest manifest; an empty list elsewhere."""
    # fixed values: packages that make a project native, and that bring a platform
    native = F.array_contains("declared", "react-native") | F.array_contains("declared", "expo")
    brought = (("react-native-web", "web"), ("react-native-windows", "windows"), ("react-native-macos", "macos"), ("react-native-tvos", "tvos"))
    root = described.filter("dir = ''").select("app", F.col("declared").alias("at_root"))
    here = described.join(root, "app", "left")
    all_of = F.array(F.lit("ios"), F.lit("android"), *[F.when(F.array_contains("declared", p) | F.coalesce(F.array_contains("at_root", p), F.lit(False)), F.lit(name)) for p, name in brought])
    return here.select("app", "dir", F.when(native, F.filter(all_of, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("platforms"))
