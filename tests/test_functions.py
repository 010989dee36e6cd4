import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinwork.functions import paths, prose, roles
from veinwork.functions.stats import gate


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("n", "v", "role", "applicable", "status"),
    [
        (100, 1, 0.95, True, "AUTO"), (9, 0, 0.95, True, "SUGGEST"), (1000, 15, 0.95, True, "SUGGEST"), (100, 15, 0.95, True, "SUGGEST"), (100, 1, 0.5, True, "SUGGEST"),
        (100, 1, 0.3, True, "REJECT"), (100, 0, 1.0, False, "REJECT"), (100, 50, 0.95, True, "REJECT"), (0, 0, 0.0, True, "REJECT"), (35, 0, 1.0, True, "AUTO"), (34, 0, 1.0, True, "SUGGEST"),
    ],
)
def test_gate(spark, n, v, role, applicable, status):
    row = one(spark, **gate(F.lit(n), F.lit(v), F.lit(role), F.lit(applicable)))
    assert row["status"] == status
    if n == 0:
        assert (row["floor"], row["observed"]) == (0, 0)


def test_wilson_values(spark):
    values = {(40, 40): 0.9124, (217, 216): 0.9744, (653, 650): 0.9866, (65, 65): 0.9442}
    rows = spark.createDataFrame([(n, n - h) for n, h in values], "n long, v long").select("n", "v", gate(F.col("n"), F.col("v"), F.lit(1.0))["floor"].alias("f")).collect()
    assert {(r["n"], r["n"] - r["v"]): r["f"] for r in rows} == values


@pytest.mark.parametrize(
    ("path", "role"),
    [
        ("src/a.controller.ts", "CONTROLLER"), ("src/a.test.ts", "TEST"), ("e2e/a.ts", "TEST"), ("src/generated/x.service.ts", "UNKNOWN"), ("app/api/x/route.ts", "ROUTE_HANDLER"),
        ("src/app/x/actions.ts", "SERVER_ACTION"), ("src/db/x.ts", "DATA_ACCESS"), ("app/page.tsx", "ROUTE_ENTRY"), ("src/x.tsx", "COMPONENT"), ("lib/x.ts", "UNKNOWN"), ("src\\a.service.ts", "SERVICE"),
    ],
)
def test_roles(spark, path, role):
    assert one(spark, r=roles.classify(F.lit(path)))["r"]["role"] == role


def test_directives(spark):
    assert one(spark, r=roles.leading_directive(F.lit("#!/x\n/* a */ // b\n'use strict'; \"use server\""), "use server"))["r"]
    assert not one(spark, r=roles.leading_directive(F.lit("const a = 'use server'"), "use server"))["r"]
    assert one(spark, r=roles.classify(F.lit("lib/x.ts"), F.lit(True)))["r"]["role"] == "SERVER_ACTION"
    assert one(spark, r=roles.classify(F.lit("lib/x.tsx"), F.lit(True)))["r"]["role"] == "COMPONENT"


def test_paths(spark):
    row = one(
        spark, layer=paths.layer_of(F.lit("src/(group)/features/x.ts")), router=paths.layer_of(F.lit("src/app/x.ts")), none=paths.layer_of(F.lit("src/x.ts")),
        scoped=paths.package_name(F.lit("@a/b/c")), core=paths.package_name(F.lit("fs/promises")), scheme=paths.package_name(F.lit("node:fs")), alias=paths.package_name(F.lit("@/x"), ("@",)),
        internal=paths.is_internal(F.lit("@a/b/src/x"), F.lit("@a/b")), fold=paths.folded(F.lit("a/b/../c/./d")), out=paths.folded(F.lit("a/../../b")), raw=paths.without_query(F.lit("x.svg?raw")), text=paths.annotation_text(F.lit("a%\n")),
    )
    assert tuple(row) == ("features", "app", None, "@a/b", None, None, None, True, "a/c/d", None, "x.svg", "a%25%0A")


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**/*.ts", "src/a/b.ts", True), ("src/**/*.ts", "src/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("./src/{a,b}.ts", "src/b.ts", True), ("**/.x/*", "a/.x/y", True), ("a?c", "abc", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, r=paths.matches_any(F.lit(path), [glob]))["r"] is hit


def test_prose(spark):
    row = one(spark, s=prose.sentences(F.lit("Use x. Never y!\n\nPlain words")), quote=prose.quote_line(F.lit("a\n**must** be\n“quoted”"), F.lit("be \"quoted\"")))
    assert [(s["line"], s["text"]) for s in row["s"]] == [(1, "Use x."), (1, "Never y!"), (3, "Plain words")]
    assert row["quote"] == 2
    likely = {"Always test.": True, "Use tabs.": True, "When building, please run it.": True, "This is a text.": False}
    for text, expected in likely.items():
        assert one(spark, r=prose.reads_like_rule(F.lit(text)))["r"] is expected


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 500), st.integers(0, 500))
def test_floor_grows_with_conformance(spark, n, v):
    v = min(v, n)
    rows = [gate(F.lit(n), F.lit(x), F.lit(1.0))["floor"] for x in (v, max(0, v - 1))]
    less, more = spark.range(1).select(*rows).first()
    assert 0 <= less <= more <= 1
