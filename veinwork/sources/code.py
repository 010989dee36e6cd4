"""Code bases as relations: source trees, imports, configuration, diffs.

A source tree is a DataFrame (app, path, text).  Reading is distributed; only
configuration, which is small, is parsed on the driver.  Extraction works on
tokens: comments, strings and templates are told apart, then import, export
and require forms are matched.  It has no scope analysis; a name that shadows
a global counts as the global.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import paths, prose, roles

IMPORT_SCHEMA = "app string, path string, ord int, specifier string, has_value boolean, names array<string>, line int, reexport boolean, dynamic boolean, require boolean"
USAGE_SCHEMA = "app string, path string, subject string, line int"

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_STRING = r"(?:'([^'\n]*)'|\"([^\"\n]*)\")"
_FROM = re.compile(r"\b(import|export)\s+(type\s+)?((?:[\w$*{}\s,]|\bas\b)*?)\s*\bfrom\s*" + _STRING)
_BARE = re.compile(r"\bimport\s*" + _STRING)
_CALL = re.compile(r"(?<![\w$.])(import|require)\s*\(\s*" + _STRING + r"\s*[,)]")


def read_tree(spark: SparkSession, root: str, app: str = "app") -> DataFrame:
    """(app, path, text) of the source files below ``root``; skipped folders and declarations are left out."""
    return read_files(spark, root, app).filter(paths.is_source(F.col("path")))


def read_files(spark: SparkSession, root: str, app: str = "app") -> DataFrame:
    """(app, path, text) of all files below ``root`` outside of skipped folders; an ignore file at the root counts as one of them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    named = raw.select(F.lit(app).alias("app"), path.alias("path"), F.col("content").cast("string").alias("text"))
    return named.filter(~paths.is_skipped(F.col("path")))


def ignore_patterns(text: str) -> list[tuple[str, bool]]:
    """(regular expression, keeps) of an ignore file's lines, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        body = line.removeprefix("!")
        folder = body.endswith("/")
        body = body.rstrip("/")
        glob = body.lstrip("/") if "/" in body else f"**/{body}"
        pattern = paths.glob_regex(glob)
        if pattern:
            out.append((pattern[:-1] + ("/.*$" if folder else "(/.*)?$"), keeps))
    return out


def is_ignored(path: Column, rules: Iterable[tuple[str, bool]]) -> Column:
    """Whether the last matching rule of one ignore file ignores the path."""
    state = F.lit(False)
    for pattern, keeps in rules:
        state = F.when(path.rlike(pattern), F.lit(not keeps)).otherwise(state)
    return state


def not_ignored(tree: DataFrame, files: dict[str, str]) -> DataFrame:
    """The tree without what ignore files (folder -> text) ignore; nested files only add."""
    gone = F.lit(False)
    for folder, text in files.items():
        prefix = f"{folder}/" if folder else ""
        inner = F.substring(F.col("path"), len(prefix) + 1, 1 << 20)
        gone = gone | (F.col("path").startswith(prefix) & is_ignored(inner, ignore_patterns(text)))
    return tree.filter(~gone)


def classified(tree: DataFrame, test_setup: Iterable[str] = ()) -> DataFrame:
    """One row a file with its role; named test setup files are tests, 'use server' upgrades unknown ones."""
    head = F.substring("text", 1, 512)
    role = roles.classify(F.col("path"), roles.leading_directive(head, "use server"))
    setup = F.col("path").isin(*test_setup) if list(test_setup) else F.lit(False)
    found = tree.select("app", "path", "text", role.alias("c"))
    return found.select(
        "app", "path", F.when(setup, "TEST").otherwise(F.col("c.role")).alias("role"), F.when(setup, 1.0).otherwise(F.col("c.role_confidence")).alias("role_confidence"),
        F.when(setup, "test-setup").otherwise(F.col("c.matched_rule")).alias("matched_rule"), "text",
    )


def script_of(path: str, text: str) -> str:
    """The code of a component file with its line numbers kept: script blocks, or front matter."""
    if path.endswith((".vue", ".svelte")):
        keep = [(m.start(1), m.end(1)) for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S | re.I)]
    elif path.endswith(".astro"):
        m = re.match(r"\s*---\r?\n(.*?)\r?\n---", text, re.S)
        keep = [(m.start(1), m.end(1))] if m else []
    else:
        return text
    out = [c if c == "\n" else " " for c in text]
    for a, b in keep:
        out[a:b] = text[a:b]
    return "".join(out)


def blanked(code: str, strings: bool) -> str:
    """Code with comments, and on demand strings, blanked out in place."""

    def blank(m: re.Match) -> str:
        s = m[0]
        if s[0] == "/" or strings or s[0] == "`":
            return re.sub(r"[^\n]", " ", s)
        return s

    return _TOKEN.sub(blank, code)


def imports_of(code: str) -> Iterator[tuple[str, bool, list[str] | None, int, bool, bool, bool]]:
    """(specifier, has_value, names, line, reexport, dynamic, require) in order of place; names None: unknown."""
    text, found = blanked(code, strings=False), []
    for m in _FROM.finditer(text):
        clause = m[3].strip()
        names: list[str] | None = []
        value = not m[2]
        braces = re.search(r"\{(.*?)\}", clause, re.S)
        parts = [p.strip() for p in braces[1].split(",") if p.strip()] if braces else []
        outside = re.sub(r"\{.*?\}", "", clause, flags=re.S).strip(" ,\n\t")
        typed = [p for p in parts if p.startswith("type ")]
        names = [re.split(r"\s+as\s+", p.removeprefix("type ").strip())[0] for p in parts if p not in typed or m[2]]
        for o in (x.strip() for x in outside.split(",") if x.strip()):
            names.append("*" if o.startswith("*") else "default")
        if parts and len(typed) == len(parts) and not outside:
            value = False
        found.append((m.start(), m[4] if m[4] is not None else m[5], value, names, m[1] == "export", False, False))
    for m in _BARE.finditer(text):
        found.append((m.start(), m[1] if m[1] is not None else m[2], True, [], False, False, False))
    for m in _CALL.finditer(text):
        found.append((m.start(), m[2] if m[2] is not None else m[3], True, None, False, m[1] == "import", m[1] == "require"))
    for at, spec, value, names, reexport, dynamic, require in sorted(found, key=lambda x: x[0]):
        yield spec, value, names, text.count("\n", 0, at) + 1, reexport, dynamic, require


def extract_imports(tree: DataFrame) -> DataFrame:
    """Imports of every file of (app, path, text); filter files before, the engine cannot push through this."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for app, path, text in batch[["app", "path", "text"]].itertuples(index=False):
                out += [(app, path, i, *x) for i, x in enumerate(imports_of(script_of(path, text or "")))]
            columns = [c.split()[0] for c in IMPORT_SCHEMA.split(", ")]
            frame = pd.DataFrame(out, columns=["app", "path", "ord", "specifier", "has_value", "names", "line", "reexport", "dynamic", "require"])
            yield frame[columns]

    return tree.select("app", "path", "text").mapInPandas(rows, IMPORT_SCHEMA)


def usage_of(code: str, subjects: tuple[str, ...] = ("console", "process.env")) -> list[tuple[str, int]]:
    """(subject, line) of what reads a global."""
    text = blanked(code, strings=True)
    pattern = re.compile(r"(?<![\w$.])(" + "|".join(re.escape(s) for s in subjects) + r")\b(?=\s*[.\[])")
    return sorted({(m[1], text.count("\n", 0, m.start()) + 1) for m in pattern.finditer(text)})


_GLOB_CALL = re.compile(r"\bimport\s*\.\s*meta\s*\.\s*glob(?:Eager)?\s*(?:<[^()]*>)?\(\s*(\[[^\]]*\]|" + _STRING + ")")
_CONTEXT_CALL = re.compile(r"\brequire\s*\.\s*context\s*\(\s*" + _STRING + r"\s*(?:,\s*(true|false)\s*(?:,\s*/((?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\[\\\n])+)/\w*)?)?")


def loads_of(code: str) -> list[tuple[int, str, bool, str | None]]:
    """(loader, glob, negative, pattern) of what a file loads by pattern, a number for each call.

    Globs of a list count together, without what its negative ones name; a
    folder that is loaded as a whole may have a regular expression for the
    paths below it, which start with ``./``.
    """
    text, found = blanked(code, strings=False), []
    for m in _GLOB_CALL.finditer(text):
        globs = [a if a is not None else b for a, b in ((x[1], x[2]) for x in re.finditer(_STRING, m[1]))]
        found.append((m.start(), [(g.removeprefix("!"), g.startswith("!"), None) for g in globs]))
    for m in _CONTEXT_CALL.finditer(text):
        folder = (m[1] if m[1] is not None else m[2]).rstrip("/")
        found.append((m.start(), [(f"{folder}/{'*' if m[3] == 'false' else '**'}", False, m[4] if m[4] and _portable(m[4]) else None)]))
    return [(n, *g) for n, (_, globs) in enumerate(sorted(found)) for g in globs]


def _portable(pattern: str) -> bool:
    """Whether an expression means the same to all engines at hand: without groups by name, look-behind or set operations."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return not re.search(r"\(\?<|\[[^\]]*(\[|&&)|\\[kpPu]", pattern)


def extract_loads(tree: DataFrame) -> DataFrame:
    """What the files of (app, path, text) load by pattern: app, path, loader, glob, negative, pattern."""
    columns = ["app", "path", "loader", "glob", "negative", "pattern"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(app, path, *x) for app, path, text in batch[["app", "path", "text"]].itertuples(index=False) for x in loads_of(script_of(path, text or ""))]
            yield pd.DataFrame(out, columns=columns)

    return tree.select("app", "path", "text").mapInPandas(rows, "app string, path string, loader int, glob string, negative boolean, pattern string")


def extract_usage(tree: DataFrame, subjects: tuple[str, ...] = ("console", "process.env")) -> DataFrame:
    """Lines that read a global, after comments and strings are blanked."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for app, path, text in batch[["app", "path", "text"]].itertuples(index=False):
                out += [(app, path, *x) for x in usage_of(script_of(path, text or ""), subjects)]
            yield pd.DataFrame(out, columns=["app", "path", "subject", "line"])

    return tree.select("app", "path", "text").mapInPandas(rows, USAGE_SCHEMA)


def string_literals(tree: DataFrame) -> DataFrame:
    """(app, path, literal): the plain strings of each file; comments and templates are left out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for app, path, text in batch[["app", "path", "text"]].itertuples(index=False):
                found = (m[0] for m in _TOKEN.finditer(script_of(path, text or "")) if m[0][0] in "'\"")
                out += sorted({(app, path, re.sub(r"\\(.)", r"\1", s[1:-1])) for s in found})
            yield pd.DataFrame(out, columns=["app", "path", "literal"])

    return tree.select("app", "path", "text").mapInPandas(rows, "app string, path string, literal string")


def renders_markup(path: Column, text: Column) -> Column:
    """Whether a file makes elements: a tag or fragment in a component file, or a call that creates or clones one."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")
    tags = path.endswith(".tsx") & bare.rlike(r"(?s)(^|[(\[{,;:?=&|>\s])<(>|[A-Za-z][\w.-]*(\s[^<>]*?)?/>|([A-Za-z][\w.-]*)(\s[^<>]*)?>.*?</\4\s*>)")
    return tags | bare.rlike(r"\b(createElement|cloneElement)\s*(<[^()]*>)?\s*\(")


def barrels(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """(app, path) of files that only re-export."""
    code = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", ""), r"export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['\"][^'\"]*['\"]\s*;?", "")
    only = tree.filter(F.trim(F.regexp_replace(code, r"\s+", " ")) == "").select("app", "path")
    return only.join(imports.filter("reexport").select("app", "path").distinct(), ["app", "path"], "left_semi")


def loose_json(text: str) -> dict:
    """JSON with comments and trailing commas; {} when it is not even that."""
    bare = _TOKEN.sub(lambda m: "" if m[0][0] == "/" else m[0], text)
    try:
        value = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def aliases_of(config_dir: str, text: str) -> list[tuple[str, str, int]]:
    """(prefix, dir, ord) of a compiler configuration's path aliases, targets relative to its folder."""
    options = loose_json(text).get("compilerOptions", {})
    base = options.get("baseUrl", ".")
    out = []
    for key, targets in (options.get("paths") or {}).items():
        for target in targets:
            folder = "/".join(p for p in f"{config_dir}/{base}/{target.removesuffix('/*').removesuffix('*')}".split("/") if p not in ("", "."))
            out.append((key.removesuffix("/*").removesuffix("*"), folder, len(out)))
    return out


def inherited(path: str, configs: dict[str, str]) -> dict:
    """Compiler options of a configuration (path -> text for all of them), with those of the ones it extends.

    The configuration's own options win over what it extends, later ones of a
    list over earlier; ``paths`` and ``baseUrl`` come with the folder of the
    configuration that writes them, as ``pathsDir`` and ``baseDir``.
    """

    def read(name: str, above: tuple[str, ...]) -> dict:
        if name in above or name not in configs:
            return {}
        config = loose_json(configs[name])
        folder, out = name.rpartition("/")[0], {}
        extended = config.get("extends", [])
        for one in [extended] if isinstance(extended, str) else extended:
            if not one.startswith("."):
                continue
            target = _joined(folder, one)
            out |= read(next((t for t in (target, f"{target}.json") if t in configs), target), (*above, name))
        own = config.get("compilerOptions", {})
        out |= own
        return out | ({"pathsDir": folder} if "paths" in own else {}) | ({"baseDir": folder} if "baseUrl" in own else {})

    return read(path, ())


def _joined(folder: str, relative: str) -> str:
    parts = [p for p in folder.split("/") if p]
    for part in relative.split("/"):
        if part == ".." and parts:
            parts.pop()
        elif part not in (".", "", ".."):
            parts.append(part)
    return "/".join(parts)


def inherited_aliases(path: str, configs: dict[str, str]) -> list[tuple[str, str, int]]:
    """(prefix, dir, ord) of the aliases of a configuration, its extended ones and, where it lists any, its references.

    A pattern's targets come before those of an exact key of the same prefix;
    a target keeps a star that is not its last segment.
    """
    out: list[tuple[str, str]] = []
    config = loose_json(configs.get(path, ""))
    folder = path.rpartition("/")[0]
    members = [path]
    for reference in config.get("references", []):
        target = _joined(folder, reference.get("path", ""))
        members += [t for t in (target, f"{target}/tsconfig.json") if t in configs]
    for member in members:
        options = inherited(member, configs)
        base = _joined(options["baseDir"], options["baseUrl"]) if "baseUrl" in options else options.get("pathsDir", folder)
        keys = options.get("paths") or {}
        for pattern in (True, False):
            for key, targets in keys.items():
                if ("*" in key) == pattern and isinstance(targets, list):
                    out += [(key.removesuffix("/*"), _joined(base, t.removesuffix("/*"))) for t in targets if isinstance(t, str)]
    unique = list(dict.fromkeys(out))
    return [(prefix, where, k) for k, (prefix, where) in enumerate(unique)]


_KIT_ALIAS = re.compile(r"['\"]?([\w$@~/*.-]+)['\"]?\s*:\s*['\"]([^'\"]+)['\"]")


def kit_aliases(folder: str, config: str | None) -> list[tuple[str, str, int]]:
    """(prefix, dir, ord) of a SvelteKit project: its library folder and the aliases of its configuration, as far as they are written as literals."""
    bare = blanked(config or "", strings=False)
    library = re.search(r"\blib\s*:\s*['\"]([^'\"]+)['\"]", bare)
    out = [("$lib", _joined(folder, library[1] if library else "src/lib"))]
    block = re.search(r"\balias\s*:\s*\{([^}]*)\}", bare)
    out += [(k.removesuffix("/*"), _joined(folder, v.removesuffix("/*"))) for k, v in _KIT_ALIAS.findall(block[1])] if block else []
    return [(prefix, where, k) for k, (prefix, where) in enumerate(out)]


#: Modules that SvelteKit provides.
KIT_MODULES = ("$app", "$env", "$service-worker")


def declared_packages(manifests: DataFrame) -> DataFrame:
    """(path, package) of the four dependency fields of manifests (path, text)."""
    fields = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    names = [F.coalesce(F.map_keys(F.from_json(F.get_json_object("text", f"$.{f}"), "map<string,string>")), F.array().cast("array<string>")) for f in fields]
    merged = names[0]
    for more in names[1:]:
        merged = F.array_union(merged, more)
    return manifests.select("path", F.explode(merged).alias("package"))


def workspace_globs(manifest: str, yaml: str | None = None) -> list[str]:
    """Workspace globs of a manifest, or of a pnpm workspace file, which counts first."""
    if yaml is not None:
        block = re.search(r"(?m)^packages:\s*\n((?:\s*-\s*.*\n?)+)", yaml)
        return re.findall(r"-\s*['\"]?([^'\"\n]+?)['\"]?\s*(?:\n|$)", block[1]) if block else []
    found = loose_json(manifest).get("workspaces", [])
    return found.get("packages", []) if isinstance(found, dict) else list(found)


def workspace_packages(manifests: DataFrame, globs: list[str]) -> DataFrame:
    """(name, dir, entry, subpaths) of manifests (path, text) whose folder a workspace glob names."""
    folder = paths.directory(F.col("path"))
    kept = manifests.filter(paths.matches_any(folder, globs))
    exports = F.from_json(F.get_json_object("text", "$.exports"), "map<string,string>")
    return kept.select(
        F.get_json_object("text", "$.name").alias("name"), folder.alias("dir"), F.coalesce(F.get_json_object("text", "$.module"), F.get_json_object("text", "$.main")).alias("entry"),
        F.coalesce(F.map_keys(exports), F.array().cast("array<string>")).alias("subpaths"),
    ).filter("name IS NOT NULL")


def installed_tools(manifests: DataFrame, tools: tuple[str, ...] = ("eslint", "dependency-cruiser")) -> DataFrame:
    """tool, installed over all manifests given (a folder's own and those above it)."""
    found = declared_packages(manifests).agg(F.collect_set("package").alias("p"))
    return found.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), F.array_contains("p", t).alias("installed")) for t in tools])).alias("x")).select("x.*")


def context_rules(markdown: DataFrame) -> DataFrame:
    """(doc, line, text, rule_like) of the prose of markdown (doc, text): no headings, code, HTML or front matter."""
    body = F.regexp_replace("text", r"(?s)^---\r?\n.*?\r?\n---(?=\r?\n|$)", "")
    # blanked in place: the newlines of a block stay, so lines keep their numbers
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    fence = F.aggregate(
        lines, F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept")),
        lambda s, line: F.struct(
            F.when(F.trim(line).rlike("^(```|~~~)"), ~s["inside"]).otherwise(s["inside"]).alias("inside"),
            F.concat(s["kept"], F.array(F.when(s["inside"] | F.trim(line).rlike("^(```|~~~|#{1,6} |<|    )"), F.lit("")).otherwise(F.regexp_replace(line, r"^\s*(?:[-*+]|\d+\.|>)\s+", "")))).alias("kept"),
        ),
    )
    front = F.size(F.split("text", "\n")) - F.size(lines)
    rows = markdown.select("doc", front.alias("front"), F.explode(prose.sentences(F.array_join(fence["kept"], "\n"))).alias("s"))
    text = prose.plain(F.col("s.text"))
    return rows.select("doc", (F.col("s.line") + F.col("front")).alias("line"), text.alias("text"), prose.reads_like_rule(text).alias("rule_like"))


def renames_of(name_status: str) -> list[tuple[str, str]]:
    """(from, to) of a diff's name-status output."""
    return [(p[1], p[2]) for p in (line.split("\t") for line in name_status.splitlines()) if p[0].startswith("R") and len(p) == 3]


def added_lines(spark: SparkSession, diff: str) -> DataFrame:
    """(file, line) of the lines a unified diff adds; ranges are expanded by the engine."""
    file, ranges = None, []
    for line in diff.splitlines():
        if line.startswith("+++ "):
            file = line[4:].removeprefix("b/") if line != "+++ /dev/null" else None
        elif file and (m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)):
            n = int(m[2]) if m[2] is not None else 1
            if n:
                ranges.append((file, int(m[1]), int(m[1]) + n - 1))
    hunks = spark.createDataFrame(ranges, "file string, lo int, hi int")
    return hunks.select("file", F.explode(F.sequence("lo", "hi")).alias("line"))
