"""Path, specifier and glob expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that decide which files and folders count.
SKIPPED_FOLDER = r"(^|/)(node_modules|dist|build|coverage|\.[^/]*)/"
SOURCE_FILE = r"\.(ts|tsx|vue|svelte)$"
DECLARATION = r"\.d\.ts$"
REFERRER = r"(?<!\.d)\.(js|jsx|mjs|cjs|mts|cts|astro)$"
SETTINGS = r"(^|/)(package\.json|pnpm-workspace\.yaml|pnpm-lock\.yaml|\.gitignore|\.npmignore|[^/]*tsconfig[^/]*\.json)$"
TOOL_CONFIG = r"\.config\.(ts|tsx|js|mjs|cjs|mts|cts)$"
STRUCTURAL = r"^(src|dist|build|public|test|tests|__tests__|node_modules|.*\..*|\(.*\)|\[.*\]|@.*)$"
ROUTER_ROOTS = ("app", "pages")
DEEP_RELATIVE = r"^(\.\./){3,}"
CLI_PATH = r"(^|/)(cli|scripts|bin|tools)(/|\.tsx?$)"
CONFIG_PATH = r"(^|/)(config|env|environment)(/|\.tsx?$)|\.config\.tsx?$"
STORY = r"\.stories\.(ts|tsx)$"
INFRA_PATH = r"(^|/)(health|seed|admin|webhook|webhooks|migration|migrations|cron)(/|\.|$)"
ENTRY_FILE = r"(^|/)(page|layout|loading|error|not-found|template|default|route|middleware|instrumentation|global-error|_app|_document|index)\.(ts|tsx)$"
APP_FILE = r"(^|/)app/(.*/)?(robots|sitemap|manifest|opengraph-image|twitter-image|icon|apple-icon|global-not-found|forbidden|unauthorized)\.(ts|tsx)$"
ROOT_FILE = r"^(src/)?(instrumentation-client|proxy)\.(ts|tsx)$"
INTERNAL = ("src", "internal", "internals")
CORE_MODULES = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https",
    "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty",
    "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def is_skipped(path: Column) -> Column:
    return path.rlike(SKIPPED_FOLDER)


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE_FILE) & ~path.rlike(DECLARATION)


def refers(path: Column) -> Column:
    """Files that are not sources of the code base, but can import them."""
    return path.rlike(REFERRER)


def as_typescript(path: Column) -> Column:
    """A path as its TypeScript counterpart would be named, to judge its role."""
    return F.regexp_replace(F.regexp_replace(path, r"\.([mc]?js|[mc]ts)$", ".ts"), r"\.jsx$", ".tsx")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def layer_of(path: Column) -> Column:
    """First segment that is a router root or not structural; null if there is none."""
    return F.get(F.filter(segments(path), lambda s: s.isin(*ROUTER_ROOTS) | ~s.rlike(STRUCTURAL)), F.lit(0))


def directory(path: Column) -> Column:
    parts = segments(path)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def ancestors(path: Column) -> Column:
    """Every directory above a path, the root '' first."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def prefixes(spec: Column) -> Column:
    """All beginnings of a specifier that end at a slash or its end."""
    parts = F.split(spec, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folded(path: Column) -> Column:
    """The path without '.' and '..'; null if it climbs out."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin(".", ""), done)
            .when((part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(segments(path), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def package_name(spec: Column, aliases: tuple[str, ...] = ()) -> Column:
    """The npm package a specifier names; null for relative, '#', scheme, core and aliased ones."""
    head = F.split(spec, "/")[0]
    aliased = F.lit(False)
    for prefix in aliases:
        aliased = aliased | (spec == prefix) | spec.startswith(f"{prefix}/")
    other = spec.startswith(".") | spec.startswith("#") | spec.rlike("(?i)^[a-z][a-z0-9+.-]*:") | head.isin(*CORE_MODULES) | aliased
    scoped = F.array_join(F.slice(F.split(spec, "/"), 1, 2), "/")
    return F.when(~other, F.when(spec.startswith("@"), scoped).otherwise(head))


def is_internal(spec: Column, name: Column) -> Column:
    return F.split(F.substring(spec, F.length(name) + 2, F.length(spec)), "/")[0].isin(*INTERNAL)


def without_query(spec: Column) -> Column:
    return F.when(F.instr(spec, "?") > 1, F.substring_index(spec, "?", 1)).otherwise(spec)


def glob_regex(glob: str) -> str | None:
    """A glob as a regular expression for whole paths; None when it does not compile.

    ``**`` crosses folders, ``*`` and ``?`` do not, dot files match, a leading ``./`` is dropped.
    """
    glob, out, i, depth = glob.removeprefix("./"), [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and i + 2 == len(glob):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out.append("[" + glob[i + 1 : end].replace("!", "^", 1) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    pattern = "^" + "".join(out) + "$"
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for glob in globs:
        pattern = glob_regex(glob)
        if pattern:
            hit = hit | path.rlike(pattern)
    return hit


def in_scope(path: Column, files: list[str], excluded: list[str]) -> Column:
    return matches_any(path, files) & ~matches_any(path, excluded)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def boundary_name(source: Column, target: Column) -> Column:
    return F.concat(F.lit("no-"), source, F.lit("-to-"), target)


def annotation_text(text: Column) -> Column:
    """Text as the message of a CI annotation."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotation_property(text: Column) -> Column:
    return F.replace(F.replace(annotation_text(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
