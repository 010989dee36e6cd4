"""A Merkle manifest of documents: a tree of digests a source, and one over the sources.

The rank of a document in its source comes from digit histograms of the ids
(``ranks.radix_offsets``), without sorting a source.  The base-``FANOUT``
digits of the rank are its path in a trie: a node is keyed by a prefix of
them, and nodes are reduced from the longest prefix on, ``DIGITS`` digits a
step, so a worker holds ``FANOUT ** DIGITS`` nodes at a time whatever a source
holds.  Proofs go the same way down: a step hands each node the siblings on
its path, led by those of the prefix above it.

Defined results: leaves of a source ascend by id, a null id first, rows of one
id by their digest; a null source is a source of its own, before all others;
repeated rows are leaves of their own; null values count as the contract's
``-``; empty and very long texts are values like any other (a text is hashed
where it is read and never moved); a single document is its own subroot and
root, with an empty proof; an empty table gives no rows.  Only the five named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.llm.ranks import prefix, radix_offsets, ranked_strings
from veinwork.llm.workspace import from_files, partitions, shared_folder, small_batches, sparing, written

#: Children of a node; digits of a rank that one step reduces.
FANOUT, DIGITS = 3, 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAST = -(1 << 63)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], total: int, digits: int) -> list[list[str]]:
    """The nodes of a run and all prefixes above them: ``digits`` steps, or up to the one node where the run is all there is."""
    levels = [nodes]
    while len(levels) <= digits if total > FANOUT**digits else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[k : k + FANOUT])) for k in range(0, len(last), FANOUT)])
    return levels


def _paths(levels: list[list[str]], above: str) -> list[str]:
    """For each node the siblings on its way up, ``left,right;`` a level, then ``above``."""
    found = [above]
    for nodes in reversed(levels[:-1]):
        here = []
        for k in range(len(nodes)):
            first = k - k % FANOUT
            here.append(f"{''.join(nodes[first:k])},{''.join(nodes[k + 1 : first + FANOUT])};{found[k // FANOUT]}")
        found = here
    return found


def _folded(node: str, path: str) -> str:
    for level in path.split(";")[:-1]:
        left, right = level.split(",")
        node = _hash(f"{left}{node}{right}")
    return node


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (name, run) after another, of batches that are sorted by both."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["run"], row["name"]) != (held[0]["run"], held[0]["name"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_SOME = 4096


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == _SOME:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


_NODE = pa.schema([("name", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("node", pa.string())])
_PATH = pa.schema([("name", pa.string()), ("at", pa.int64()), ("subroot", pa.string()), ("path", pa.string())])
_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _up(digits: int) -> Batches:
    """(name, run, at, total, node) to the nodes of runs."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in _runs(batches):
                total = run[0]["total"]
                yield run[0]["name"], run[0]["run"], -(-total // FANOUT**digits), _levels([r["node"] for r in run], total, digits)[-1][0]

        yield from _emit(rows(), _NODE)

    return sparing(run_all)


def _down(rows_of: Callable[[list[dict], str, list[str]], Iterator[tuple]], schema: pa.Schema, digits: int) -> Batches:
    """Each run is led by a row with the subroot and the path of its own node, at place -1."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for lead, *run in _runs(batches):
                yield from rows_of(run, lead["subroot"], _paths(_levels([r["node"] for r in run], run[0]["total"], digits), lead["path"]))

        yield from _emit(rows(), schema)

    return sparing(run_all)


def _path_rows(run: list[dict], subroot: str, paths: list[str]) -> Iterator[tuple]:
    for row, path in zip(run, paths):
        yield row["name"], row["at"], subroot, path


def _proof_rows(run: list[dict], subroot: str, paths: list[str]) -> Iterator[tuple]:
    for row, path in zip(run, paths):
        yield row["doc_id"], row["node"], subroot, _hash(path.replace(",", "").replace(";", "")), _folded(row["changed"], path)


def _by_run(nodes: DataFrame) -> DataFrame:
    """Rows of a run together, in order."""
    return nodes.repartition(partitions(nodes.sparkSession), "name", "run").sortWithinPartitions("name", "run", "at")


def _with_run(nodes: DataFrame, digits: int) -> DataFrame:
    return nodes.withColumn("run", F.expr(f"at div {FANOUT**digits}"))


def climbed(leaves: DataFrame, folder: str, digits: int) -> list[DataFrame]:
    """Nodes (name, at, total, node) by step: the leaves, then the prefixes of ``digits`` digits less, until one node a name is left."""
    steps = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        open_ = _with_run(steps[-1].filter("total > 1").select("name", "at", "total", "node"), digits)
        found = _by_run(open_).select("name", "run", "at", "total", "node").mapInArrow(_up(digits), "name string, at long, total long, node string")
        steps.append(written(found, f"{folder}/{len(steps)}"))
        most = -(-most // FANOUT**digits)
    return steps


def tops(steps: list[DataFrame]) -> DataFrame:
    """name, node: the one node of each name."""
    out = steps[0].filter("total = 1").select("name", "node")
    for more in steps[1:]:
        out = out.unionByName(more.filter("total = 1").select("name", "node"))
    return out


def descended(steps: list[DataFrame], above: DataFrame, folder: str, digits: int) -> DataFrame:
    """Leads of the runs of leaves (name, at, subroot, path), from the paths ``above`` each name (name, subroot, path)."""
    ends = lambda nodes: nodes.filter("total = 1").select("name", "at").join(above, "name").select("name", "at", "subroot", "path")
    if len(steps) == 1:  # no name has a second leaf
        return ends(steps[0]).limit(0)
    paths = ends(steps[-1])
    for k in range(len(steps) - 2, 0, -1):
        below = written(
            _by_run(_led(steps[k].filter("total > 1"), paths, digits)).mapInArrow(_down(_path_rows, _PATH, digits), "name string, at long, subroot string, path string"), f"{folder}/paths{k}"
        )
        paths = below.unionByName(ends(steps[k]))
    return paths


def _led(nodes: DataFrame, paths: DataFrame, digits: int) -> DataFrame:
    """Nodes with the lead of each run before them."""
    lead = paths.select("name", F.col("at").alias("run"), F.lit(-1).cast("long").alias("at"), "subroot", "path")
    return _with_run(nodes, digits).unionByName(lead, allowMissingColumns=True)


def manifest(docs: DataFrame, changed: Callable[[Column, Column], Column], folder: str, digits: int = DIGITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a document.

    ``changed(doc_id, text)`` is the text as it is found later; what it gives
    is folded with the siblings of the original and compared with the root.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = from_files(docs.select(*FIELDS), f"{folder}/input")
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))  # null sorts first
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    offsets = radix_offsets(docs.select(name.alias("name"), key.alias("key")), "name", "key", f"{folder}/histogram")
    rest = [F.col(c) for c in FIELDS[:-1]]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), name.alias("name"), prefix(key).alias("prefix"),
        leaf(*rest, F.col("text")).alias("node"), leaf(*rest, changed(F.col("doc_id"), F.col("text"))).alias("changed"),
    )
    within = F.row_number().over(Window.partitionBy("name", "prefix").orderBy(F.col("doc_id").asc_nulls_first(), "node")) - 1
    placed = rows.withColumn("within", within).join(offsets.hint("shuffle_hash"), ["name", "prefix"])
    leaves = written(placed.select("name", (F.col("offset") + F.col("within")).alias("at"), "total", "node", "changed", "doc_id"), f"{folder}/leaves")

    steps = climbed(leaves, f"{folder}/up", digits)
    sources = written(tops(steps), f"{folder}/subroots")
    number = sources.count()
    ranked = ranked_strings(sources, "name", f"{folder}/ranges").select(F.lit("").alias("name"), F.col("rank").alias("at"), F.lit(number).cast("long").alias("total"), "node", F.col("name").alias("source"))
    ranked = written(ranked, f"{folder}/sources")
    over = climbed(ranked, f"{folder}/over", digits)
    top = tops(over).first()
    root = top["node"] if top else ""
    start = spark.createDataFrame([("", root, "")], "name string, subroot string, path string")
    # the way of each source in the tree over them; the subroot of a source is its own node there
    above = _finished(ranked, over, start, f"{folder}/over", _path_rows, _PATH, "name string, at long, subroot string, path string", digits)
    own = written(ranked.select("at", F.col("node").alias("subroot"), F.col("source").alias("name")).join(above.select("at", "path"), "at").select("name", "subroot", "path"), f"{folder}/above")
    proofs = _finished(leaves, steps, own, f"{folder}/up", _proof_rows, _PROOF, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string", digits)
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _finished(leaves: DataFrame, steps: list[DataFrame], above: DataFrame, folder: str, rows_of: Callable, schema: pa.Schema, ddl: str, digits: int) -> DataFrame:
    """``rows_of`` over all leaves; a leaf that is alone is a run of one, whose lead is what stands above its name."""
    lone = leaves.filter("total = 1").select("name", "at").join(above, "name")
    leads = descended(steps, above, folder, digits).unionByName(lone.select("name", "at", "subroot", "path"))
    return _by_run(_led(leaves, leads, digits)).mapInArrow(_down(rows_of, schema, digits), ddl)


def without_breaks(doc_id: Column, text: Column) -> Column:
    """The contract's tampering: where 2 divides the crc32 of the id, line feeds go."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), without_breaks, shared_folder(spark))


#: DuckDB has no crc32: it is worked out bit by bit, a byte being followed by eight steps (-1).
_EVEN = """(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 2 = 0)"""
ORACLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, CASE WHEN crc32_even AND text IS NOT NULL THEN replace(text, chr(10), '') ELSE text END AS later,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM (SELECT *, {even} AS crc32_even FROM documents)
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total
  FROM fields
), tree(source, lvl, pos, node, total) AS (
  SELECT source, 0, pos, leaf, total FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (total + 2) // 3 FROM tree WHERE total > 1 GROUP BY source, lvl, pos // 3, total
), subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1
), over_(lvl, pos, node, total) AS (
  SELECT 0, pos, subroot, total FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (total + 2) // 3 FROM over_ WHERE total > 1 GROUP BY lvl, pos // 3, total
), inner_runs AS (
  SELECT source, lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM tree WHERE total > 1 GROUP BY source, lvl, pos // 3
), over_runs AS (
  SELECT lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM over_ WHERE total > 1 GROUP BY lvl, pos // 3
), depths AS (SELECT source, max(lvl) AS depth FROM tree GROUP BY source),
steps AS (
  SELECT l.doc_id, r.lvl, r.nodes, ((l.pos // (3 ** r.lvl)::BIGINT) % 3)::BIGINT AS place
  FROM leaves l JOIN inner_runs r ON l.source IS NOT DISTINCT FROM r.source AND r.run = l.pos // (3 ** (r.lvl + 1))::BIGINT
  UNION ALL
  SELECT l.doc_id, d.depth + r.lvl, r.nodes, ((s.pos // (3 ** r.lvl)::BIGINT) % 3)::BIGINT
  FROM leaves l JOIN depths d ON l.source IS NOT DISTINCT FROM d.source JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  JOIN over_runs r ON r.run = s.pos // (3 ** (r.lvl + 1))::BIGINT
), parts AS (
  SELECT doc_id, lvl, array_to_string(nodes[:place], '') AS lft, array_to_string(nodes[place + 2:], '') AS rgt FROM steps
), folds(doc_id, lvl, node) AS (
  SELECT doc_id, 0, changed FROM leaves
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(p.lft || f.node || p.rgt) FROM folds f JOIN parts p ON p.doc_id = f.doc_id AND p.lvl = f.lvl
), proofs AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof FROM parts GROUP BY doc_id),
last_ AS (SELECT doc_id, arg_max(node, lvl) AS folded_root FROM folds GROUP BY doc_id),
top AS (SELECT node AS root FROM over_ WHERE total = 1)
SELECT l.doc_id, l.leaf, s.subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN last_ USING (doc_id) LEFT JOIN proofs USING (doc_id) CROSS JOIN top
""".replace("{even}", _EVEN)
