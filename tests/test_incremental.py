from pyspark.sql import functions as F

from veinwork.plans import incremental
from veinwork.plans import scan as plan


def tree_of(spark, files, app="app"):
    return spark.createDataFrame([(app, p, t) for p, t in files.items()], "app string, path string, text string")


def facts(c):
    of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    return of(c.imports), of(c.edges), of(c.usage), of(c.references), of(c.orphans())


FILES = {"src/a.ts": "import './b'\nconsole.log(1)\nimport.meta.glob('./l/*.ts')", "src/b.ts": "", "src/l/x.ts": "process.env.X", "src/c.vue": "<script>import './b'</script>", "src/none.ts": None}


def test_a_second_scan_parses_what_changed(spark, tmp_path):
    store = incremental.ParsedFiles(spark, f"file://{tmp_path}/store", 4)
    first = tree_of(spark, FILES)
    assert store.unknown(incremental.keyed(first)).count() == 5
    assert facts(plan.codebase(first, store=store)) == facts(plan.codebase(first))
    assert store.table().count() == 5 and store.unknown(incremental.keyed(first)).count() == 0
    changed = tree_of(spark, {**FILES, "src/b.ts": "import './a'", "src/new.ts": "", "src/moved.ts": FILES["src/a.ts"]} | {"src/l/x.ts": FILES["src/l/x.ts"]}).filter("path <> 'src/c.vue'")
    assert {r["path"] for r in store.unknown(incremental.keyed(changed)).collect()} == {"src/b.ts", "src/new.ts", "src/moved.ts"}
    assert facts(plan.codebase(changed, store=store)) == facts(plan.codebase(changed))
    assert store.table().count() == 8
    # the first state comes back: nothing is parsed; another session of the store finds it too
    store.close()
    again = incremental.ParsedFiles(spark, f"file://{tmp_path}/store", 4)
    assert facts(plan.codebase(first, store=again)) == facts(plan.codebase(first)) and again.table().count() == 8
    again.close()


def test_the_store_is_met_without_an_exchange(spark, tmp_path):
    store = incremental.ParsedFiles(spark, f"file://{tmp_path}/store", 4)
    store.parsed(tree_of(spark, FILES))
    found = store.unknown(incremental.keyed(tree_of(spark, FILES)))
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(lines) if "FileScan" in line)
    join = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    # between the join and the scan of the store nothing is exchanged
    own = [line for line in lines[join + 1 : at] if depth(line) < depth(lines[at])]
    branch = own[max(k for k, line in enumerate(own) if line.lstrip(" :|").startswith("+-") and depth(line) == min(depth(x) for x in own)) :]
    assert not any("Exchange" in line for line in branch)
    store.close()


def test_states_are_told_apart_by_place_and_text(spark):
    rows = [("a", "bc", "d"), ("ab", "c", "d"), ("a", "bc", "e"), ("a", "bc", None), ("a", "b", "cd")]
    keys = incremental.keyed(spark.createDataFrame(rows, "app string, path string, text string")).agg(F.count_distinct("key").alias("n")).first()
    assert keys["n"] == len(rows)
