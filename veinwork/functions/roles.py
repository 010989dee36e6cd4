"""Roles of files: an ordered table of path patterns, the first match counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role, rule, pattern, confidence, in the order in which they are tried.
RULES = (
    ("TEST", "test-spec-suffix", r"\.(test|spec|e2e-spec|e2e)\.(ts|tsx)$", 1.0),
    ("TEST", "test-directory", r"(^|/)(__tests__|__mocks__|e2e|cypress|playwright|test|tests)/", 0.95),
    ("UNKNOWN", "generated-code", r"(^|/)generated/", 0.5),
    ("CONTROLLER", "controller-suffix", r"\.controller\.ts$", 1.0),
    ("SERVICE", "service-suffix", r"\.service\.ts$", 1.0),
    ("REPOSITORY", "repository-suffix", r"\.(repository|repo)\.ts$", 1.0),
    ("WORKER", "worker-job-queue-suffix", r"\.(worker|job|queue)\.ts$", 1.0),
    ("PROMPT_FILE", "prompt-skill-suffix", r"\.(prompt|skill)\.ts$", 1.0),
    ("COMPONENT", "angular-component", r"\.component\.ts$", 0.9),
    ("COMPONENT", "angular-directive", r"\.directive\.ts$", 0.85),
    ("COMPONENT", "vue-sfc", r"\.vue$", 0.9),
    ("COMPONENT", "svelte-sfc", r"\.svelte$", 0.9),
    ("ROUTE_HANDLER", "next-app-router-route", r"app/api/.*/route\.tsx?$", 0.95),
    ("API_HANDLER", "next-pages-api", r"pages/api/.*\.tsx?$", 0.95),
    ("TRPC_ROUTER", "trpc-router", r"server/api/routers/.*\.ts$", 0.95),
    ("SERVER_ACTION", "next-server-action", r"app/.*/actions?\.ts$", 0.9),
    ("API_HANDLER", "sveltekit-endpoint", r"(^|/)\+server\.ts$", 0.95),
    ("SERVER_ACTION", "sveltekit-page-server", r"(^|/)\+(page|layout)\.server\.ts$", 0.9),
    ("ROUTE_HANDLER", "sveltekit-hooks", r"(^|/)hooks\.server\.ts$", 0.85),
    ("ROUTE_ENTRY", "sveltekit-load", r"(^|/)\+(page|layout)\.ts$", 0.8),
    ("API_HANDLER", "nuxt-nitro-server", r"(^|/)server/(api|routes|middleware|plugins)/.*\.ts$", 0.85),
    ("ROUTE_ENTRY", "remix-route", r"(^|/)app/routes/.*\.tsx?$", 0.85),
    ("ROUTE_ENTRY", "remix-root", r"(^|/)app/(root|entry\.(server|client))\.tsx?$", 0.85),
    ("DB_MODULE", "db-package", r"packages/(db|database)/", 0.9),
    ("SHARED", "shared-package", r"packages/shared/", 0.9),
    ("DATA_ACCESS", "db-directory", r"(/db/|/database/|/prisma/)", 0.8),
    ("DATA_ACCESS", "db-client-file", r"(^|/)(prisma|drizzle|kysely)\.[cm]?[jt]sx?$", 0.8),
    ("ROUTE_ENTRY", "next-app-router-entry", r"(^|/)app/(.*/|)(page|layout|template|loading|error|not-found|default|global-error)\.tsx?$", 0.9),
    ("COMPONENT", "tsx-component", r"\.tsx$", 0.5),
)
#: Roles in which a request enters, and roles that take part in role layering.
REQUEST_ENTRY = ("CONTROLLER", "ROUTE_HANDLER", "SERVER_ACTION", "API_HANDLER", "TRPC_ROUTER")
LAYERED = ("CONTROLLER", "SERVICE", "REPOSITORY", "DATA_ACCESS", "DB_MODULE")
FRAMEWORK_ENTRY = ("ROUTE_ENTRY", "ROUTE_HANDLER", "API_HANDLER")
DIRECTIVE_RULE = "use-server-directive"


def classify(path: Column, use_server: Column | None = None) -> Column:
    """struct(role, role_confidence, matched_rule); UNKNOWN with confidence 0 without a match."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    value = lambda role, confidence, rule: F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("role_confidence"), F.lit(rule).cast("string").alias("matched_rule"))
    chain = F
    for role, rule, pattern, confidence in RULES:
        chain = chain.when(path.rlike(pattern), value(role, confidence, rule))
    base = chain.otherwise(value("UNKNOWN", 0.0, None))
    if use_server is None:
        return base
    upgraded = use_server & (base["role"] == "UNKNOWN") & ~path.rlike(r"\.tsx$")
    return F.when(upgraded, value("SERVER_ACTION", 0.9, DIRECTIVE_RULE)).otherwise(base)


def pattern_of(*names: str) -> str:
    """One pattern for the paths of roles, whatever comes before them in the table."""
    found = [pattern for role, _, pattern, _ in RULES if role in names]
    return found[0] if len(found) == 1 else "(" + "|".join(found) + ")"


def leading_directive(text: Column, directive: str) -> Column:
    """Whether code begins with a directive, after a byte order mark, a #! line, comments and other directives."""
    skip = r"^﻿?(?:#![^\n]*\n)?(?:\s|//[^\n]*(?:\n|$)|/\*(?:[^*]|\*(?!/))*+\*/|(?:'[^'\n]*'|\"[^\"\n]*\")\s*;?)*?"
    return F.coalesce(text, F.lit("")).rlike(skip + f"(?:'{directive}'|\"{directive}\")")


def case_sql(path: str, pick: int) -> str:
    """The table as an ordered CASE: pick 0 role, 1 rule, 3 confidence."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    empty = {0: "'UNKNOWN'", 1: "NULL", 3: "0.0"}[pick]
    return "CASE " + " ".join(f"WHEN regexp_matches({path}, '{r[2]}') THEN {show(r[pick])}" for r in RULES) + f" ELSE {empty} END"
