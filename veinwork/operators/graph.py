"""Import graphs: cycles, reachability, orphans, barrels.

A graph belongs to an app; apps are independent of each other.  The graph of
an app of up to ``LOCAL_EDGES`` edges is worked through in one task; larger
ones take rounds of joins, in which labels leap over labels and straight ways
get shortcuts.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strong_components(edges: list[tuple[int, int]]) -> dict[int, int]:
    """node -> smallest node of its strongly connected component (iterative, in one depth-first pass)."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    path: list[int] = []
    on_path: set[int] = set()
    found: dict[int, int] = {}
    for root in sorted(out):
        if root in order:
            continue
        work: list[tuple[int, Iterator[int]]] = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        path.append(root)
        on_path.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in order:
                    order[to] = low[to] = len(order)
                    path.append(to)
                    on_path.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in on_path:
                    low[node] = min(low[node], order[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(path.pop())
                    on_path.difference_update(members)
                    name = min(members)
                    found.update((m, name) for m in members)
    return found


def shortest_loop(start: int, members: set[int], out: dict[int, list[int]]) -> list[int]:
    """The shortest way from a node back to itself inside its component, neighbours in order."""
    before: dict[int, int] = {}
    front = [start]
    while front:
        following = []
        for node in front:
            for to in sorted(out.get(node, ())):
                if to == start:
                    way = [node]
                    while way[-1] != start:
                        way.append(before[way[-1]])
                    return [*way[::-1], start]
                if to in members and to not in before:
                    before[to] = node
                    following.append(to)
        front = following
    return []


#: Edges of an app up to which its graph is worked through in one task (two numbers an edge); larger ones take rounds of joins.
LOCAL_EDGES = 2_000_000


def kept(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the cluster's shared folder; where none is set, as they are."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def split_by_size(edges: DataFrame, local_edges: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edges of apps of at most ``LOCAL_EDGES``, and those of larger apps; None if there is none.  Apps are counted, then met by a join."""
    large = edges.groupBy("app").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (LOCAL_EDGES if local_edges is None else local_edges)).select("app")
    if large.isEmpty():
        return edges, None
    return edges.join(large, "app", "left_anti"), edges.join(large, "app", "left_semi")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written below ``spark.checkpoint.dir`` and read back, so that a round knows their true size.

    A checkpoint keeps the estimate of its plan, which rounds of joins square.
    Where that setting is absent, a local folder serves if all runs in this process.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veinwork-")
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _of_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges whose two ends are among nodes (app, node), with these columns of the nodes as ``src_*`` and ``dst_*``."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("app", F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), ["app", end])
    return edges


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that something enters and something leaves, once over: others are on no cycle."""
    sides = edges.select("app", F.col("src").alias("node"), F.lit(1).alias("side")).unionByName(edges.select("app", F.col("dst").alias("node"), F.lit(2).alias("side")))
    return stored(_of_ends(edges, sides.groupBy("app", "node").agg(F.bit_or("side").alias("sides")).filter("sides = 3")).select("app", "src", "dst"))


def _least(edges: DataFrame) -> DataFrame:
    """(app, node, ahead, behind): the least node that each node reaches, and the least that reaches it, itself included.

    A round takes labels of neighbours that changed, and the label of one's
    label, which is reached as well.
    """
    key = ["app", "ahead", "node"]
    hops = stored(
        edges.select("app", F.lit(False).alias("ahead"), F.col("src").alias("node"), F.col("dst").alias("to"))
        .unionByName(edges.select("app", F.lit(True).alias("ahead"), F.col("dst").alias("node"), F.col("src").alias("to")))
    )
    nodes = hops.select(*key).unionByName(hops.select("app", "ahead", F.col("to").alias("node"))).distinct()
    labels = nodes.withColumns({"label": F.col("node"), "fresh": F.lit(True)})
    while True:
        near = labels.filter("fresh").join(hops, key).select("app", "ahead", F.col("to").alias("node"), "label")
        heads = labels.select("app", "ahead", F.col("node").alias("label"), F.col("label").alias("further"))
        far = labels.join(heads, ["app", "ahead", "label"]).filter("further < label").select(*key, F.col("further").alias("label"))
        every = labels.select(*key, "label", F.col("label").alias("old")).unionByName(near.unionByName(far).withColumn("old", F.lit(None).cast("long")))
        best = every.groupBy(*key).agg(F.min("label").alias("label"), F.min("old").alias("old"))
        labels = stored(best.select(*key, "label", (F.col("label") < F.col("old")).alias("fresh")))
        if labels.filter("fresh").isEmpty():
            return labels.groupBy("app", "node").agg(F.min(F.when(F.col("ahead"), F.col("label"))).alias("ahead"), F.min(F.when(~F.col("ahead"), F.col("label"))).alias("behind"))


def _drawn(node: Column, turn: int) -> Column:
    """A node's place in an order by chance, another each turn; one to one, as this hash of a single long is."""
    return F.xxhash64(F.lit(turn), node.cast("long"))


def distributed_components(edges: DataFrame) -> DataFrame:
    """(app, node, component) of nodes on a cycle, self-imports included, by joins alone.

    Where the least node that one reaches is also the least that reaches it, both
    are of one component.  Nodes of one component agree in the two, so edges
    between others go, and what is left takes another turn in another order.
    """
    loops = edges.filter("src = dst").select("app", F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    left, found, turn = trimmed(edges.filter("src <> dst").select("app", "src", "dst").distinct()), loops.limit(0), 0
    while not left.isEmpty():
        turn += 1
        least = _least(left.select("app", _drawn(F.col("src"), turn).alias("src"), _drawn(F.col("dst"), turn).alias("dst")))
        names = left.select("app", F.col("src").alias("name")).unionByName(left.select("app", F.col("dst").alias("name"))).distinct()
        nodes = stored(names.withColumn("node", _drawn(F.col("name"), turn)).join(least, ["app", "node"]).select("app", F.col("name").alias("node"), "ahead", "behind", F.expr("ahead = behind").alias("done")))
        done = nodes.filter("done")
        groups = done.groupBy("app", "ahead").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.unionByName(stored(done.join(groups, ["app", "ahead"]).select("app", "node", "component")))
        agreeing = _of_ends(left, nodes.filter("NOT done"), "ahead", "behind").filter("src_ahead = dst_ahead AND src_behind = dst_behind")
        left = trimmed(agreeing.select("app", "src", "dst"))
    return found.unionByName(loops.join(found, ["app", "node"], "left_anti"))


def _local_components(edges: DataFrame) -> DataFrame:
    """(app, node, component) of nodes on a cycle, for apps that fit a task each."""

    def one(app: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(app["src"].tolist(), app["dst"].tolist()))
        found = strong_components(pairs)
        sizes = pd.Series(found).value_counts()
        loops = {a for a, b in pairs if a == b}
        rows = [(app["app"].iloc[0], n, c) for n, c in found.items() if sizes[c] > 1 or n in loops]
        return pd.DataFrame(rows, columns=["app", "node", "component"])

    return edges.groupBy("app").applyInPandas(one, "app string, node long, component long")


def cyclic_nodes(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(app, node, component) of nodes on a cycle, self-imports included; the component is its smallest node."""
    small, large = split_by_size(edges, local_edges)
    found = _local_components(small)
    return found if large is None else found.unionByName(distributed_components(large))


def cycle_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges inside one cyclic component, and self-imports."""
    own = nodes.select("app", F.col("node").alias("src"), F.col("component").alias("c1"))
    other = nodes.select("app", F.col("node").alias("dst"), F.col("component").alias("c2"))
    return edges.join(own, ["app", "src"]).join(other, ["app", "dst"]).filter("c1 = c2").select("app", "src", "dst")


def distributed_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(app, component, size, loop) of cyclic components of any size by joins alone: of the shortest loops from the smallest node the least in order.

    The steps from each node to the smallest one are found backwards from it,
    a round of joins a step in all components at once, until it is met again.
    Then the loop goes down the steps, by the least neighbour.
    """
    inside = stored(_of_ends(edges, nodes, "component").filter("src_component = dst_component").select("app", F.col("src_component").alias("component"), "src", "dst").distinct())
    whole = ["app", "component"]
    front = stored(nodes.select("app", "component", F.col("component").alias("node"), F.lit(0).alias("steps")).distinct())
    seen, closed, steps = front, front.select(*whole, F.lit(0).alias("length")).limit(0), 0
    while not front.isEmpty():
        steps += 1
        near = inside.join(front.select(*whole, F.col("node").alias("dst")), [*whole, "dst"]).select(*whole, F.col("src").alias("node"), F.lit(steps).alias("steps")).distinct()
        fresh = stored(near.filter("node = component").unionByName(near.filter("node <> component").join(seen, [*whole, "node"], "left_anti")))
        met = fresh.filter("node = component")
        closed = closed.unionByName(met.select(*whole, F.col("steps").alias("length")))
        front = stored(fresh.join(met, whole, "left_anti"))
        seen = seen.unionByName(front)
    ways = stored(closed.select(*whole, F.col("component").alias("at"), (F.col("length") - 1).alias("steps"), F.array("component").alias("loop")))
    ended = ways.limit(0)
    while not ways.isEmpty():
        on = ways.join(inside.select(*whole, F.col("src").alias("at"), F.col("dst").alias("node")), [*whole, "at"]).join(seen, [*whole, "node", "steps"])
        least = on.groupBy(*whole).agg(F.min("node").alias("at"), F.first("steps").alias("steps"), F.first("loop").alias("loop"))
        further = stored(least.select(*whole, "at", (F.col("steps") - 1).alias("steps"), F.concat("loop", F.array("at")).alias("loop")))
        ended = ended.unionByName(further.filter("steps < 0"))
        ways = further.filter("steps >= 0")
    return ended.join(nodes.groupBy(*whole).agg(F.count(F.lit(1)).alias("size")), whole).select(*whole, "size", "loop")


def cycle_loops(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(app, component, size, loop): one shortest loop for each cyclic component, from its smallest node.

    Each component of an app of up to ``LOCAL_EDGES`` edges is a task of its own;
    those of larger apps take rounds of joins.
    """
    small, large = split_by_size(edges, local_edges)
    found = _local_loops(small)
    return found if large is None else found.unionByName(distributed_loops(large, stored(distributed_components(large))))


def _local_loops(edges: DataFrame) -> DataFrame:
    """(app, component, size, loop) of cyclic components, each of which fits a task."""
    nodes = _local_components(edges)
    inside = cycle_edges(edges, nodes).join(nodes.select("app", F.col("node").alias("src"), "component"), ["app", "src"])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        for a, b in zip(part["src"].tolist(), part["dst"].tolist()):
            out.setdefault(a, []).append(b)
        members, c = set(out), int(part["component"].iloc[0])
        return pd.DataFrame([(part["app"].iloc[0], c, len(members), shortest_loop(c, members, out))], columns=["app", "component", "size", "loop"])

    return inside.groupBy("app", "component").applyInPandas(one, "app string, component long, size long, loop array<long>")


def with_shortcuts(edges: DataFrame) -> DataFrame:
    """Edges of a graph without cycles, and from nodes with one successor also the ways of 2, 4, 8, ... steps over such nodes."""
    single = edges.groupBy("app", "src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    ways, every = stored(single.select("app", "src", "dst")), edges
    while not ways.isEmpty():
        ways = stored(ways.join(ways.select("app", F.col("src").alias("dst"), F.col("dst").alias("far")), ["app", "dst"]).select("app", "src", F.col("far").alias("dst")))
        every = every.unionByName(ways)
    return every


def distributed_reachability(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(app, from_layer, to_layer) by joins alone.

    Components become one node each.  The layers that a node reaches are bits,
    64 to a row, which flow against the edges; a round passes on new bits only.
    """
    laid = stored(_of_ends(edges, layers).select("app", "src", "dst").distinct())
    cycles = stored(distributed_components(laid))
    in_order = Window.partitionBy("app").orderBy("layer")
    numbered = layers.select("app", "layer").distinct().withColumn("k", F.row_number().over(in_order) - 1)
    numbered = stored(numbered.select("app", "layer", F.floor(F.col("k") / 64).alias("word"), F.expr("shiftleft(1L, k % 64)").alias("bits")))
    # each node under the name of its component
    homes = stored(layers.join(cycles, ["app", "node"], "left").select("app", "node", F.coalesce("component", "node").alias("home"), "layer"))
    key = ["app", "node", "word"]
    own = stored(homes.join(numbered, ["app", "layer"]).groupBy("app", F.col("home").alias("node"), "word").agg(F.bit_or("bits").alias("bits")))
    apart = _of_ends(laid, homes.select("app", "node", "home").distinct(), "home").filter("src_home <> dst_home")
    hops = stored(with_shortcuts(stored(apart.select("app", F.col("src_home").alias("src"), F.col("dst_home").alias("dst")).distinct())))

    def before(reached: DataFrame) -> DataFrame:
        """Bits of the nodes, handed to those that lead to them."""
        return hops.join(reached.withColumnRenamed("node", "dst"), ["app", "dst"]).select("app", F.col("src").alias("node"), "word", "bits")

    back = own.join(cycles.select("app", F.col("component").alias("node")).distinct(), ["app", "node"], "left_semi").select(*key, "bits")
    known = stored(back.unionByName(before(own)).groupBy(*key).agg(F.bit_or("bits").alias("bits")).withColumn("fresh", F.col("bits")))
    while not known.filter("fresh <> 0").isEmpty():
        handed = before(known.filter("fresh <> 0").select(*key, F.col("fresh").alias("bits")))
        every = known.select(*key, "bits", F.lit(0).cast("long").alias("more")).unionByName(handed.select(*key, F.lit(0).cast("long").alias("bits"), F.col("bits").alias("more")))
        met = every.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.bit_or("more").alias("more"))
        known = stored(met.select(*key, F.expr("bits | more").alias("bits"), F.expr("more & ~bits").alias("fresh")))
    lived = homes.select("app", F.col("home").alias("node"), F.col("layer").alias("from_layer")).distinct()
    of_layer = known.join(lived, ["app", "node"]).groupBy("app", "from_layer", "word").agg(F.bit_or("bits").alias("reached"))
    return of_layer.join(numbered.withColumnRenamed("layer", "to_layer"), ["app", "word"]).filter("reached & bits <> 0").select("app", "from_layer", "to_layer")


def layer_reachability(edges: DataFrame, layers: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(app, from_layer, to_layer): layers that files of a layer reach over any number of imports.

    An app's graph is condensed to components, and sets of layers flow along
    the condensation in topological order; larger apps take rounds of joins.
    """
    laid = edges.join(layers.select("app", F.col("node").alias("src"), F.col("layer").alias("ls")), ["app", "src"]).join(
        layers.select("app", F.col("node").alias("dst"), F.col("layer").alias("ld")), ["app", "dst"]
    )

    def one(app: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(app["src"].tolist(), app["dst"].tolist()))
        of = dict(zip(app["src"].tolist(), app["ls"].tolist())) | dict(zip(app["dst"].tolist(), app["ld"].tolist()))
        comp = strong_components(pairs)
        own: dict[int, set] = {}
        sizes: dict[int, int] = {}
        for node, c in comp.items():
            own.setdefault(c, set()).add(of[node])
            sizes[c] = sizes.get(c, 0) + 1
        below: dict[int, set[int]] = {c: set() for c in own}
        cyclic = {c for c, n in sizes.items() if n > 1}
        for a, b in pairs:
            if comp[a] != comp[b]:
                below[comp[a]].add(comp[b])
            elif a == b:
                cyclic.add(comp[a])
        reach: dict[int, set] = {}
        for root in below:
            work = [root]
            while work:
                c = work[-1]
                left = [x for x in below[c] if x not in reach]
                if left:
                    work += left
                    continue
                work.pop()
                if c not in reach:
                    reach[c] = set(own[c]) if c in cyclic else set()
                    for x in below[c]:
                        reach[c] |= reach[x] | own[x]
        rows = {(l, to) for c in own for l in own[c] for to in reach[c]}
        return pd.DataFrame([(app["app"].iloc[0], *r) for r in sorted(rows)], columns=["app", "from_layer", "to_layer"])

    small, large = split_by_size(laid, local_edges)
    found = small.groupBy("app").applyInPandas(one, "app string, from_layer string, to_layer string")
    return found if large is None else found.unionByName(distributed_reachability(large, layers))


def orphans(files: DataFrame, edges: DataFrame, entry: Column, shipped: Column | None = None, others: DataFrame | None = None) -> DataFrame:
    """Production files that nothing, or only tests, refer to: path, kind.

    ``others`` (id, role) are files that only refer; what is in neither, like a
    manifest, is no test.
    """
    roles = files.select("id", "role") if others is None else files.select("id", "role").unionByName(others.select("id", "role"))
    referrers = edges.filter("src <> dst").join(roles.select(F.col("id").alias("src"), (F.col("role") == "TEST").alias("test")), "src", "left").withColumn("test", F.coalesce("test", F.lit(False)))
    seen = referrers.groupBy(F.col("dst").alias("id")).agg(F.bool_and("test").alias("only_tests"))
    own = files.filter((F.col("role") != "TEST") & ~entry).join(seen, "id", "left")
    alone = F.col("only_tests").isNull()
    kind = F.when(alone, "orphan").otherwise("test_only")
    if shipped is not None:
        kind = F.when(shipped, "shipped").otherwise(kind)
    return own.filter(alone | F.col("only_tests")).select("path", kind.alias("kind"))


def leaf_files(reexports: DataFrame, barrels: DataFrame) -> DataFrame:
    """(barrel, leaf): files that are not barrels, reached over re-exports; semi-naive, one join a round, until nothing is new.

    All sides grow with the files, so none goes through the driver, however
    small its columns are.
    """
    hop = stored(reexports.select(F.col("src").alias("via"), F.col("dst").alias("leaf")).distinct())
    known = ["barrel", "leaf"]
    seen = front = stored(barrels.select(F.col("id").alias("barrel"), F.col("id").alias("via")).join(hop.hint("merge"), "via").select(*known).distinct())
    while not front.isEmpty():
        near = front.withColumnRenamed("leaf", "via").join(hop.hint("merge"), "via").select(*known).distinct()
        front = stored(near.join(seen.hint("merge"), known, "left_anti"))
        seen = seen.unionByName(front)
    return seen.join(barrels.select(F.col("id").alias("leaf")).hint("merge"), "leaf", "left_anti").select(*known)
