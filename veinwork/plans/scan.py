"""The scan: every rule family over one code base, from shared relations."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths, roles
from veinwork.operators import change, databases, detectors, findings, globjoin, graph, pathrules, references, resolve, rules, targets
from veinwork.plans import incremental
from veinwork.sources import code, settings

#: Containers whose members are slices of one app, and apps.
SLICES, APPS = ("features", "modules", "slices", "domains"), ("apps", "services")
#: The two rules on what a request handler must not import; the second's pattern is inferred from where components live.
DATABASE, INTERFACE = "AP-001", "AP-002"
DATABASE_PATTERN = "|".join(f"(?:{p})" for p in references.DATA_LIBRARIES)


@dataclass
class Codebase:
    """Relations of one snapshot.

    files: id, app, path, role, role_confidence, layer, text; imports: id, app,
    spec, ord, has_value; edges: src, dst of imports that bind a value; usage:
    id, subject, line; declared: package[, app]; workspace: name, exports,
    open[, app].  ``references`` (src, dst, kind) are of any kind, from files
    of ``referrers`` (id, role) too; ``leaves`` (id, spec, leaf) are the paths
    that an import ends at beyond files that only re-export; ``aliased`` (id,
    spec) are imports through an alias, beside those of ``aliases``;
    ``clients_reached`` (id, spec) those of files that wrap a database client.
    ``shipped`` says which files a package publishes; ``loaded`` has the paths
    that a framework loads by where they stand (``sources.routes``);
    ``database`` is the pattern of database libraries.
    """

    files: DataFrame
    imports: DataFrame
    edges: DataFrame
    usage: DataFrame
    declared: DataFrame
    workspace: DataFrame
    aliases: tuple[str, ...] = ()
    references: DataFrame | None = None
    referrers: DataFrame | None = None
    leaves: DataFrame | None = None
    aliased: DataFrame | None = None
    clients_reached: DataFrame | None = None
    shipped: Column | None = None
    loaded: DataFrame | None = None
    database: str | None = DATABASE_PATTERN

    def __post_init__(self) -> None:
        self.production = self.files.filter("role <> 'TEST'")
        ids = self.production.select("id")
        self.own = self.imports.join(ids, "id", "left_semi")
        self.values = self.own.filter("has_value")
        self.outward = self.values if self.aliased is None else self.values.join(self.aliased, ["id", "spec"], "left_anti")
        self.ends = self.values if self.leaves is None else self.values.join(self.leaves, ["id", "spec"], "left")
        if self.clients_reached is not None:
            self.ends = self.ends.join(self.clients_reached.withColumn("marked", F.array(F.lit(DATABASE))), ["id", "spec"], "left")
        self.inner = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        self.inner_by_app = self.inner.join(self.files.select(F.col("id").alias("src"), "app"), "src")
        scope = [c for c in ("app",) if c in self.declared.columns]
        self.known = self.declared.select(*scope, "package").unionByName(self.workspace.select(*scope, F.col("name").alias("package"))).distinct()
        self.barrels = self.production.filter(F.col("path").rlike(r"(^|/)index\.tsx?$")).select("id", paths.directory(F.col("path")).alias("dir"))
        self.entry = F.col("role").isin(*roles.FRAMEWORK_ENTRY)
        self.story = F.col("path").rlike(paths.STORY)

    def using(self, subject: str) -> DataFrame:
        return self.usage.filter(F.col("subject") == subject)

    def clients(self) -> DataFrame:
        marked = self.files.filter(roles.leading_directive(F.substring("text", 1, 512), "use client")).select("id").withColumn("client", F.lit(True))
        return self.production.join(marked, "id", "left")

    def patterns(self) -> dict[str, str | None]:
        """Forbidden imports of request handlers; folders of components are few (``ui_markers`` returns eight at most)."""
        folders = [r["segment"] for r in detectors.ui_markers(self.production).collect()]
        return {DATABASE: self.database, INTERFACE: "(^|/)(" + "|".join(re.escape(f) for f in folders) + ")(/|$)" if folders else None}

    def orphans(self) -> DataFrame:
        """Files that no reference of any kind, or only those of tests, leads to: path, kind."""
        known = [F.col("path").rlike(p) for p in (paths.ENTRY_FILE, paths.APP_FILE, paths.ROOT_FILE, paths.TOOL_CONFIG, paths.STORY)]
        entry = F.col("role").isin(*roles.REQUEST_ENTRY, "ROUTE_ENTRY")
        for more in known:
            entry = entry | more
        found = graph.orphans(self.files, self.edges if self.references is None else self.references, entry, self.shipped, self.referrers)
        return found if self.loaded is None else found.join(self.loaded.select("path").distinct(), "path", "left_anti")

    def close(self) -> None:
        """Give back what was kept in memory for this snapshot."""
        for df in (self.files, self.imports, self.edges, self.references, self.leaves):
            if df is not None:
                df.unpersist()


def codebase(
    tree: DataFrame, aliases: Iterable[tuple[str, str, int]] = (), packages: Iterable[str] = (), workspace: Iterable[tuple[str, list[str], bool]] = (),
    written: DataFrame | None = None, referrers: DataFrame | None = None, store: incremental.ParsedFiles | None = None, **more: object,
) -> Codebase:
    """Relations of a tree (app, path, text); extraction runs once, its results are kept.

    ``written`` (app, path, text) are the settings of the code bases
    (``sources.settings``): aliases, packages and workspaces then come from
    them, each within its app.  ``referrers`` (app, path, text) are files that
    only refer.  With a ``store`` only files that it does not hold are parsed.
    """
    spark, aliases = tree.sparkSession, list(aliases)
    ided = lambda df: df.withColumn("id", F.xxhash64("app", "path"))
    if written is not None:
        tree = pathrules.not_ignored(ided(tree), written).drop("id")
    files = ided(code.classified(tree)).withColumn("layer", paths.layer_of(F.col("path"))).persist()
    sources = everything = files.select("app", "id", "path", "text")
    others = None
    if referrers is not None:
        role = roles.classify(paths.as_typescript(F.col("path")), F.lit(False))["role"]
        others = ided(referrers.select("app", "path", "text")).withColumn("role", role)
        everything = everything.unionByName(others.select("app", "id", "path", "text"))
    raw, usage, loads = (code.extract_imports(everything), code.extract_usage(files), code.extract_loads(everything)) if store is None else incremental.relations(store.parsed(everything))
    imports = ided(raw).select("id", "app", F.col("specifier").alias("spec"), "ord", "has_value", "names", "line", "reexport", "dynamic", "require", paths.without_query(F.col("specifier")).alias("bare")).persist()
    asked = imports.select("app", "id", F.col("bare").alias("spec")).distinct()
    configs = ided(code.string_literals(everything.filter(F.col("path").rlike(paths.TOOL_CONFIG))))
    named = F.regexp_replace("literal", "^<rootDir>/", "./")
    literals = configs.select("app", "id", F.when(named.startswith("."), named).otherwise(F.concat(F.lit("./"), named)).alias("spec"))
    importers, platforms, aliased, described = everything.select("app", "id", "path"), None, None, None
    if written is None:
        declared = spark.createDataFrame([(p,) for p in packages], "package string")
        members = spark.createDataFrame(list(workspace), "name string, exports array<string>, open boolean")
        found = resolve.relative(asked, importers).withColumns({"source": F.lit(0), "ord": F.lit(0)})
        if aliases:
            mapped = resolve.alias_targets(asked, spark.createDataFrame(aliases, "prefix string, dir string, ord int"))
            found = found.unionByName(mapped.withColumn("source", F.lit(0)))
    else:
        described = graph.kept(settings.manifests(written))
        owned = graph.kept(settings.config_aliases(written, files))
        packaged = graph.kept(settings.workspace_packages(written, described))
        exports, hashes = settings.subpath_rows(described, "exports"), settings.subpath_rows(described, "imports")
        exports = exports.join(packaged.select("app", "dir"), ["app", "dir"], "left_semi")
        # a manifest refers to what each of its keys, and its own name, stands for
        manifest = packaged.select("app", "name", "dir", F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit(settings.MANIFEST)).alias("path"))
        keyed = exports.filter("size(targets) > 0").join(manifest, ["app", "dir"]).select("app", "path", F.concat("name", F.substring(F.col("key"), F.lit(2), F.length("key"))).alias("spec"))
        kept_by = ided(keyed.unionByName(manifest.select("app", "path", F.col("name").alias("spec"))))
        importers = importers.unionByName(ided(manifest.select("app", "path").distinct()).select("app", "id", "path"))
        asked = asked.unionByName(kept_by.select("app", "id", "spec"))
        if "shipped" not in more:
            packed = pathrules.shipped_files(files.select("app", "id", "path"), written, described).withColumn("shipped", F.lit(True))
            files = files.join(packed, "id", "left").withColumn("shipped", F.coalesce("shipped", F.lit(False))).persist()
            more["shipped"] = F.col("shipped")
        # entries of any package, as they are and moved to the sources that they are built from
        each = F.explode(F.array_distinct(F.concat("entry", F.flatten(F.transform("exports", lambda x: x["targets"])))))
        built = described.filter("name IS NOT NULL").select("app", "dir", each.alias("target")).filter("NOT contains(target, '*')")
        placed = settings.sources_of(built, settings.compiled_folders(written)).select("app", "dir", "target", F.col("moved").alias("at")).unionByName(built.withColumn("at", F.col("target")))
        entries = ided(placed.withColumn("path", F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit(settings.MANIFEST))))
        entries = entries.select("app", "id", F.concat(F.lit("entry:"), "at").alias("spec"), F.lit(0).alias("source"), F.lit(0).alias("ord"), F.col("at").alias("target"))
        found = targets.candidates(asked, importers, owned, described.select("app", "dir"), hashes, packaged, exports).unionByName(entries)
        by_folder = settings.platforms(described)
        platforms = targets.owned(everything, by_folder).join(everything.select("id", "app"), "id").join(by_folder, ["app", "dir"]).filter("size(platforms) > 0").select("id", "platforms")
        at = targets.owned(importers, owned.select("app", F.col("owner").alias("dir"))).withColumnRenamed("dir", "owner")
        aliased = resolve.alias_targets(imports.select("app", "id", "spec").distinct().filter("NOT startswith(spec, '.')").join(at, "id"), owned.filter("prefix IS NOT NULL")).select("id", "spec").distinct()
        declared = described.select("app", F.explode("declared").alias("package")).distinct()
        keys = exports.groupBy("app", "dir").agg(F.collect_list("key").alias("exports"))
        members = packaged.join(keys, ["app", "dir"], "left").select("app", "name", F.coalesce("exports", F.array().cast("array<string>")).alias("exports"), (~F.col("closed")).alias("open"))
    # imports of all kinds and the literals of tool configurations meet the files once
    literal = resolve.relative(literals, importers).withColumns({"source": F.lit(0), "ord": F.lit(0)}).withColumn("id", F.col("id"))
    columns = ["app", "id", "spec", "source", "ord", "target"]
    hits = graph.kept(targets.first_hits(found.select(*columns).unionByName(literal.select(*columns)).filter("target IS NOT NULL").distinct(), sources, platforms))
    meets = imports.withColumnRenamed("spec", "specifier").join(hits.withColumnRenamed("spec", "bare"), ["app", "id", "bare"])
    plain = meets.filter("platform = ''")
    edges = plain.filter("has_value").select(F.col("id").alias("src"), "dst").distinct().persist()
    kind = F.when(F.col("platform") != "", "platform").when(~F.col("has_value"), "type").when(F.col("reexport"), "reexport").when(F.col("dynamic"), "dynamic").when(F.col("require"), "require").otherwise("import")
    of = lambda df, named: df.select(F.col("id").alias("src"), "dst", F.lit(named).alias("kind"))
    parts = [meets.select(F.col("id").alias("src"), "dst", kind.alias("kind")), of(hits.join(literals.distinct(), ["app", "id", "spec"]), "config")]
    if written is not None:
        parts.append(of(hits.join(kept_by.distinct(), ["app", "id", "spec"]), "manifest"))
        parts.append(of(hits.join(entries.select("app", "id", "spec").distinct(), ["app", "id", "spec"]), "entry"))
    parts.append(of(globjoin.loaded(ided(loads), sources), "loader"))
    refers = parts[0]
    for part in parts[1:]:
        refers = refers.unionByName(part)
    refers = refers.filter("src <> dst").distinct().persist()
    passing = ided(code.barrels(raw, tree)).select("id")
    leafs = graph.leaf_files(plain.filter("reexport AND has_value").select(F.col("id").alias("src"), "dst"), passing)
    ends = plain.filter("has_value").select("id", F.col("specifier").alias("spec"), "dst").distinct()
    beyond = ends.join(leafs.withColumnRenamed("barrel", "dst"), "dst").select("id", "spec", F.col("leaf").alias("dst"))
    direct = ends.join(passing.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id", "spec", "dst")
    leaves = direct.unionByName(beyond).join(sources.select(F.col("id").alias("dst"), F.col("path").alias("leaf")), "dst").select("id", "spec", "leaf").distinct().persist()
    wrapped = graph.kept(databases.wrappers(files, imports))
    written_as = None
    tied = imports.filter("has_value").select("app", "id", "spec").distinct().join(leaves, ["id", "spec"], "left")
    if written is not None:
        tied = tied.join(at.select("id", "owner"), "id", "left")
        written_as = databases.importable(wrapped, owned, owned, packaged)
    usage = ided(usage).join(files.select("id"), "id", "left_semi").select("id", "subject", "line")
    return Codebase(
        files, imports, edges, usage, declared, members, tuple(a[0] for a in aliases), refers, None if others is None else others.select("id", "role"), leaves, aliased, graph.kept(databases.reaching(tied, wrapped, written_as)), **more,
    )


def families(c: Codebase, patterns: dict[str, str | None] | None = None) -> dict[str, DataFrame]:
    """What each family of rules with a gate measures.  Production files are what is not a test."""
    patterns = c.patterns() if patterns is None else patterns
    return {
        "forbidden-imports": detectors.forbidden_imports(c.production, c.ends, patterns),
        "layer": detectors.layer_boundaries(c.production, c.inner),
        "role-layering": detectors.role_layering(c.production, c.inner),
        "public-api": detectors.public_api(c.production, c.inner, c.barrels),
        "feature-slice": detectors.sibling_isolation(detectors.members_of(c.production, SLICES), c.inner),
        "app-isolation": detectors.sibling_isolation(detectors.members_of(c.production, APPS), c.inner),
        "cycles": findings.cycles_gate(c.production, graph.cyclic_nodes(c.inner_by_app)),
        "test-isolation": detectors.test_isolation(c.files, c.edges),
        "dependency-hygiene": detectors.package_hygiene(c.outward, c.aliases),
        "phantom-deps": detectors.phantom_dependencies(c.outward, c.known, c.aliases),
        "entry-purity": detectors.entry_purity(c.production, c.inner, c.entry),
        "import-style": detectors.import_style(c.own),
        "console-isolation": detectors.usage_isolation(c.files, c.using("console"), (F.col("role") != "TEST") & ~F.col("path").rlike(paths.CLI_PATH), False),
        "env-access": detectors.usage_isolation(c.files, c.using("process.env"), (F.col("role") != "TEST") & ~F.col("path").rlike(paths.CONFIG_PATH), True),
        "workspace-package-api": detectors.workspace_api(c.values, c.workspace),
        "stories-isolation": detectors.entry_purity(c.production, c.inner, c.story),
        "ui-data": detectors.reaches_role(c.production, c.inner, F.col("role") == "COMPONENT", F.col("role").isin("DB_MODULE", "DATA_ACCESS")),
        "server-client": detectors.server_client(c.clients(), c.inner, c.own, F.coalesce("client", F.lit(False))),
    }


def broken(c: Codebase, patterns: dict[str, str | None] | None = None) -> DataFrame:
    """All findings of a snapshot, of whatever gate: family, rule_id, file, subject, kind, line."""
    patterns = c.patterns() if patterns is None else patterns
    own, inner, files = c.production, c.inner, c.files
    importing = lambda entries: inner.join(own.filter(entries).select(F.col("id").alias("dst")), "dst", "left_semi").join(own.filter(entries).select(F.col("id").alias("src")), "src", "left_anti")
    reaching = lambda population, targets: inner.join(own.filter(population).select(F.col("id").alias("src")), "src", "left_semi").join(own.filter(targets).select(F.col("id").alias("dst")), "dst", "left_semi")
    tests = files.filter("role = 'TEST'").select(F.col("id").alias("dst"))
    server = c.own.filter("spec = 'server-only'").select("id").distinct()
    client = c.clients().filter(F.coalesce("client", F.lit(False))).select("id")
    quiet = lambda usage, skipped: usage.join(own.filter(~F.col("path").rlike(skipped)).select("id"), "id", "left_semi")
    parts = [
        findings.import_findings("forbidden-imports", detectors.forbidden_occurrences(own, c.ends, patterns), files, F.col("rule_id")),
        findings.boundary_findings("layer", detectors.layer_boundaries(own, inner), inner, own, "layer"),
        findings.boundary_findings("role-layering", detectors.role_layering(own, inner), inner, own, "role"),
        findings.public_api_findings(own, inner, c.barrels),
        findings.sibling_findings("feature-slice", detectors.members_of(own, SLICES), inner, own),
        findings.sibling_findings("app-isolation", detectors.members_of(own, APPS), inner, own),
        findings.cycle_findings(c.inner_by_app, own),
        findings.target_findings("test-isolation", c.edges.join(tests, "dst", "left_semi").join(own.select(F.col("id").alias("src")), "src", "left_semi"), files),
        findings.import_findings("dependency-hygiene", findings.packages_broken(c.outward, c.aliases), files),
        findings.import_findings("phantom-deps", findings.packages_undeclared(c.outward, c.known, c.aliases), files),
        findings.target_findings("entry-purity", importing(c.entry), files),
        findings.import_findings("import-style", c.own.filter(F.col("spec").startswith(".") & F.col("spec").rlike(paths.DEEP_RELATIVE)), files),
        findings.usage_findings("console-isolation", quiet(c.using("console"), paths.CLI_PATH), files),
        findings.usage_findings("env-access", quiet(c.using("process.env"), paths.CONFIG_PATH), files),
        findings.import_findings("workspace-package-api", findings.workspace_broken(c.values, c.workspace), files),
        findings.target_findings("stories-isolation", importing(c.story), files),
        findings.target_findings("ui-data", reaching(F.col("role") == "COMPONENT", F.col("role").isin("DB_MODULE", "DATA_ACCESS")), files),
        findings.target_findings("server-client", inner.join(server.withColumnRenamed("id", "dst"), "dst", "left_semi").join(client.withColumnRenamed("id", "src"), "src", "left_semi"), files),
        findings.import_findings("server-client", c.own.filter("spec = 'server-only'").join(client, "id", "left_semi"), files),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def rule_relation(c: Codebase) -> DataFrame:
    """Every rule of every family with its gate: family, id, population, violators, floor, observed, status."""
    return findings.gates(families(c))


def summary(c: Codebase, cap: int = 10) -> DataFrame:
    """Rules that are not rejected, with the first ``cap`` files that break each (the report's own limit)."""
    patterns = c.patterns()
    listed = broken(c, patterns).select(F.col("rule_id").alias("id"), F.col("file").alias("exception")).distinct()
    return rules.summary(findings.gates(families(c, patterns)), listed, cap)


def scan(tree: DataFrame, aliases: Iterable[tuple[str, str, int]] = (), packages: Iterable[str] = (), workspace: Iterable[tuple[str, list[str], bool]] = (), **more: object) -> dict[str, DataFrame]:
    """Results by family, and what has no gate: orphans, reachability, markers."""
    c = codebase(tree, aliases, packages, workspace, **more)
    return {
        **families(c),
        "orphans": c.orphans(),
        "reachability": graph.layer_reachability(c.inner_by_app, c.files.select("app", F.col("id").alias("node"), "layer").filter("layer IS NOT NULL")),
        "markers": detectors.ui_markers(c.production),
    }


def check(base: dict[str, DataFrame], head: dict[str, DataFrame], allowed: DataFrame, was_allowed: DataFrame, renames: DataFrame, added: DataFrame) -> dict[str, DataFrame]:
    """What a change does to adopted rules.

    Both sides have ``rules`` (id, definition) and ``findings`` (rule_id, file,
    subject, kind, line); allowed and was_allowed (rule, file) are the head's and
    the base's exemptions; renames (from, to) and added (file, line) come from the
    diff.  Rules of one definition on both sides are compared: what is
    introduced, without allowed files, and what is fixed, allowed or not.
    """
    partition = change.rule_partition(base["rules"], head["rules"])
    same = partition.filter("change = 'comparable'").select(F.col("id").alias("rule_id"))
    adopted = partition.filter("change IN ('new', 'changed')")
    was = change.renamed(base["findings"], renames).join(same, "rule_id", "left_semi")
    now = head["findings"].join(same, "rule_id", "left_semi")
    keys = ["rule_id", "file", "subject", "kind"]
    fresh = head["findings"].join(adopted.select(F.col("id").alias("rule_id")), "rule_id", "left_semi")
    counts = fresh.groupBy(F.col("rule_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    matched = now.unionByName(fresh)
    moved = was_allowed.join(renames.withColumnRenamed("from", "file"), "file", "left").select("rule", F.coalesce("to", "file").alias("file"))
    used = allowed.join(matched.select(F.col("rule_id").alias("rule"), "file"), ["rule", "file"], "left_semi")
    return {
        "introduced": change.introduced(was, change.without_allowed(now, allowed), added, keys),
        "fixed": change.fixed(was, now, keys),
        "adopted": adopted.join(counts, "id", "left").select("id", "change", F.coalesce("n", F.lit(0)).alias("n")),
        "removed": partition.filter("change = 'removed'").select("id"),
        "allowed_in_change": used.join(moved, ["rule", "file"], "left_anti").select("rule", "file"),
        "unused": change.unused_allowances(allowed, matched).select("rule", "file"),
    }


def exit_code(checked: dict[str, DataFrame], fail_on: str = "new") -> int:
    """1 if the change introduces anything and that is to fail, else 0."""
    return int(fail_on == "new" and not checked["introduced"].isEmpty())
