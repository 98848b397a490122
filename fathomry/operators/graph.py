"""Graph operators: call inversion, breadth-first search, module edges, cycles, assembly, merge.

Searches join a frontier with the edges and drop what has been visited; each hop is written
to the shared folder, so plans stay short and survive lost executors.  Edge tables should be
bucketed or partitioned by source for repeated use; hubs are split by AQE.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, scratch, small

# Names of relations in imported graphs, by kind of edge.
RELATIONS = {
    "calls": "calls", "call": "calls", "invokes": "calls",
    "imports": "imports", "import": "imports", "requires": "imports", "uses": "imports",
    "depends_on": "depends_on", "dependency": "depends_on",
    "contains": "contains", "has": "contains", "defines": "contains",
    "implements": "implements", "extends": "implements", "inherits": "implements",
    "similar_to": "similar_to", "related_to": "similar_to", "co_changed": "similar_to", "inferred": "similar_to",
}
#: Edges up to which cycles are found on the driver (a module graph is small).
MAX_DRIVER_EDGES = 200_000
TRAVERSAL_LIMIT = 500
CALLER_LIMIT = 200


def invert_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(callee, called_by): who calls each known symbol.  ``calls``: caller, callee."""
    known = symbols.select(F.col("qualified_name").alias("callee")).distinct()
    return calls.select("caller", "callee").distinct().join(known, "callee", "left_semi").groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("called_by"))


def with_callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``symbols`` with ``called_by`` filled from the calls of all."""
    callers = invert_calls(calls, symbols).withColumnRenamed("callee", "qualified_name")
    return symbols.drop("called_by").join(callers, "qualified_name", "left").withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) to follow, for outgoing, incoming or both."""
    ahead, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
    return ahead if direction == "outgoing" else back if direction == "incoming" else ahead.unionByName(back)


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "outgoing", limit: int | None = None) -> DataFrame:
    """(node, depth) of all nodes within ``max_depth`` hops of ``starts`` (column node), starts at 0.

    With a limit, the first by depth, then name.
    """
    step = directed(edges, direction)
    seen = scratch(starts.select("node").distinct().withColumn("depth", F.lit(0)), "bfs-0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        n = frontier.count()
        if not n:
            break
        reached = step.join(small(frontier.select(F.col("node").alias("src")), n), "src").select(F.col("dst").alias("node")).distinct()
        frontier = scratch(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), f"bfs-{depth}")
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "node").limit(limit) if limit else seen


def call_search(calls: DataFrame, symbols: DataFrame, start: str, max_depth: int = 3, direction: str = "callers", limit: int = CALLER_LIMIT) -> DataFrame:
    """(qualified_name, depth, file, line): callers or callees; unknown symbols as (unknown, 0)."""
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth must be from 1 to 10")
    if direction not in ("callers", "callees"):
        raise ValueError(f"direction must be callers or callees, not {direction!r}")
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    starts = calls.sparkSession.createDataFrame([(start,)], "node string")
    found = bfs(edges, starts, max_depth, "incoming" if direction == "callers" else "outgoing").where("depth > 0")
    where = symbols.select(F.col("qualified_name").alias("node"), "file", "line")
    return (
        found.join(where, "node", "left")
        .select(F.col("node").alias("qualified_name"), "depth", F.coalesce("file", F.lit("unknown")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"))
        .orderBy("depth", "qualified_name")
        .limit(limit)
    )


def dependency_search(edges: DataFrame, start: str, max_depth: int) -> DataFrame:
    """(src, dst, type, depth): the edge by which each module is first reached; the least src wins."""
    if max_depth < 1:
        raise ValueError("max_depth must be 1 or more")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start,)], "node string")
    frontier, found = seen, None
    for depth in range(1, max_depth + 1):
        hop = (
            edges.join(frontier.select(F.col("node").alias("src")), "src")
            .join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
            .groupBy("dst")
            .agg(F.min(F.struct("src", "type")).alias("e"))
            .select("e.src", "dst", "e.type", F.lit(depth).alias("depth"))
        )
        hop = scratch(hop, f"dependencies-{depth}")
        found = hop if found is None else found.unionByName(hop)
        if hop.isEmpty():
            break
        frontier = hop.select(F.col("dst").alias("node"))
        seen = seen.unionByName(frontier)
    return found


def module_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, type) between modules from imports (file, dep, is_dynamic); direct beats dynamic.

    ``modules``: path, module.  Edges within a module don't count.
    """
    src = modules.select(F.col("path").alias("file"), F.col("module").alias("src"))
    dst = modules.select(F.col("path").alias("dep"), F.col("module").alias("dst"))
    return typed_edges(imports.join(src, "file").join(dst, "dep"))


def typed_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, type) of rows (src, dst, is_dynamic), pre-aggregated before the shuffle."""
    kind = F.when(F.bool_or(~F.col("is_dynamic")), "direct").otherwise("dynamic")
    return rows.where("src != dst").groupBy("src", "dst").agg(kind.alias("type"))


def _tarjan(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components of two nodes or more, without recursion."""
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(edges):
        out[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    found = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    held.append(to)
                    on.add(to)
                    work.append((to, iter(out.get(to, ()))))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(held.pop())
                        on.discard(own[-1])
                    if len(own) > 1:
                        found.append(sorted(own))
    return found


def _reached(edges: DataFrame, colour: DataFrame, name: str) -> DataFrame:
    """Pass the least colour along edges until nothing changes."""
    for k in range(1000):
        passed = edges.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
        new = scratch(colour.unionByName(passed).groupBy("node").agg(F.min("colour").alias("colour")), f"{name}-{k}")
        if new.join(colour, ["node", "colour"], "left_anti").isEmpty():
            return new
        colour = new
    raise RuntimeError("colours didn't settle")


def cycles(edges: DataFrame) -> DataFrame:
    """(component, members): strongly connected components of two nodes or more, named by the least.

    A small graph is solved on the driver; a larger one by colouring: every node takes the
    least name that reaches it, and what reaches back to its colour within it is a component.
    """
    spark = edges.sparkSession
    pairs = scratch(edges.select("src", "dst").where("src != dst").distinct(), "cycles-edges")
    n = pairs.count()
    schema = "component string, members array<string>"
    if n <= MAX_DRIVER_EDGES:
        return spark.createDataFrame([(m[0], m) for m in _tarjan([tuple(r) for r in pairs.collect()])], schema)
    found = spark.createDataFrame([], schema)
    for round_ in range(1000):
        pairs = scratch(pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "cycles-left")
        if pairs.isEmpty():
            break
        nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node"))
        ahead = _reached(pairs, nodes, f"cycles-{round_}-ahead")
        a, b = ahead.select(F.col("node").alias("src"), F.col("colour").alias("ca")), ahead.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        inside = scratch(pairs.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "ca"), "cycles-inside")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = ahead.where("node = colour")
        own = scratch(_reached(back, roots, f"cycles-{round_}-back"), "cycles-own")
        groups = own.groupBy("colour").agg(F.array_sort(F.collect_list("node")).alias("members"))
        found = found.unionByName(groups.where(F.size("members") > 1).select(F.element_at("members", 1).alias("component"), "members"))
        gone = own.select(F.col("node"))
        pairs = scratch(pairs.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "cycles-rest")
    return found


def assemble(symbols: DataFrame, files: DataFrame, module_deps: DataFrame, calls: DataFrame, imports: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, metadata) and edges (source, target, type) of the typed graph.

    symbols: qualified_name, name, file, type, module; files: path, purpose, module; module_deps: src, dst, type;
    calls: caller, callee; imports: file, dep; features: id, name, files, related_features.
    """
    tag = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    meta = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])
    modules = files.select("module").union(module_deps.select("src")).union(module_deps.select("dst")).union(symbols.select("module")).distinct()
    nodes = (
        files.select(tag("file", F.col("path")).alias("id"), F.lit("file").alias("type"), meta(path=F.col("path"), purpose=F.substring("purpose", 1, 200)).alias("metadata"))
        .unionByName(
            symbols.select(
                tag("symbol", F.col("qualified_name")).alias("id"),
                F.lit("symbol").alias("type"),
                meta(name=F.col("name"), qualifiedName=F.col("qualified_name"), file=F.col("file"), kind=F.col("type")).alias("metadata"),
            )
        )
        .unionByName(modules.select(tag("module", F.col("module")).alias("id"), F.lit("module").alias("type"), meta(name=F.col("module")).alias("metadata")))
        .unionByName(features.select(tag("feature", F.col("id")).alias("id"), F.lit("feature").alias("type"), meta(name=F.col("name")).alias("metadata")))
        .dropDuplicates(["id"])
    )
    edge = lambda df, s, t, kind: df.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("type"))
    member = features.select("id", F.explode("files").alias("f"))
    like = features.select("id", F.explode("related_features").alias("r"))
    edges = (
        edge(files, tag("module", F.col("module")), tag("file", F.col("path")), "contains")
        .unionByName(edge(symbols, tag("file", F.col("file")), tag("symbol", F.col("qualified_name")), "contains"))
        .unionByName(edge(calls, tag("symbol", F.col("caller")), tag("symbol", F.col("callee")), "calls"))
        .unionByName(edge(imports, tag("file", F.col("file")), tag("file", F.col("dep")), "imports"))
        .unionByName(edge(module_deps, tag("module", F.col("src")), tag("module", F.col("dst")), "depends_on"))
        .unionByName(edge(member, tag("feature", F.col("id")), tag("file", F.col("f")), "contains"))
        .unionByName(edge(like, tag("feature", F.col("id")), tag("feature", F.col("r")), "similar_to"))
    )
    return nodes, edges


def resolve_start(nodes: DataFrame, start: str) -> DataFrame:
    """(id, tier): all nodes of the best tier that fits: id, prefixed id, file suffix, symbol name, part of an id."""
    low = start.lower()
    tier = (
        F.when(F.col("id") == start, 1)
        .when(F.col("id").isin([f"{p}:{start}" for p in ("file", "symbol", "module", "feature", "package")]), 2)
        .when((F.col("type") == "file") & F.col("id").endswith("/" + start), 3)
        .when((F.col("type") == "symbol") & ((F.lower(F.col("metadata")["qualifiedName"]) == low) | (F.lower(F.col("metadata")["name"]) == low)), 4)
        .when(F.lower("id").contains(low), 5)
    )
    fits = nodes.select("id", tier.alias("tier")).where("tier is not null")
    best = fits.agg(F.min("tier").alias("best"))
    return fits.join(F.broadcast(best), F.col("tier") == F.col("best")).select("id", "tier")


def traverse(nodes: DataFrame, edges: DataFrame, start: str, edge_types: list[str] | None = None, max_depth: int = 2, direction: str = "both", limit: int = TRAVERSAL_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, depth) around a start, and the edges of every expanded node."""
    if not 1 <= max_depth <= 5:
        raise ValueError("max_depth must be from 1 to 5")
    own = edges if not edge_types else edges.where(F.col("type").isin(edge_types))
    plain = own.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    starts = resolve_start(nodes, start).select(F.col("id").alias("node"))
    known = nodes.select(F.col("id").alias("node"), "type")
    reached = bfs(plain, starts, max_depth, direction)
    near = scratch(reached.join(known, "node").orderBy("depth", "node").limit(limit).select(F.col("node").alias("id"), "type", "depth"), "traversal")
    inner = near.where(F.col("depth") < max_depth).select("id")
    ahead = own.join(inner, own.source == inner.id, "left_semi")
    back = own.join(inner, own.target == inner.id, "left_semi")
    used = ahead if direction == "outgoing" else back if direction == "incoming" else ahead.unionByName(back)
    return near, used.distinct()


def edge_kind(relation: Column) -> Column:
    """Kind of edge for a relation's name; similar_to if unknown."""
    table = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(relation)), F.lit("similar_to"))


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both graphs as one: what is new by id, or by (source, target, type), is added once.

    new_nodes: raw_id, id, type, metadata; new_edges: source, target, relation (raw ids or canonical ones).
    """
    added = new_nodes.select("id", "type", "metadata").dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti")
    ids = new_nodes.select("raw_id", F.col("id").alias("canonical")).dropDuplicates(["raw_id"])
    s, t = ids.select(F.col("raw_id").alias("source"), F.col("canonical").alias("cs")), ids.select(F.col("raw_id").alias("target"), F.col("canonical").alias("ct"))
    mapped = (
        new_edges.join(s, "source", "left")
        .join(t, "target", "left")
        .select(F.coalesce("cs", "source").alias("source"), F.coalesce("ct", "target").alias("target"), edge_kind(F.col("relation")).alias("type"))
        .distinct()
    )
    return nodes.unionByName(added), edges.unionByName(mapped.join(edges, ["source", "target", "type"], "left_anti"))


def imported_node(raw: DataFrame) -> DataFrame:
    """(raw_id, id, type, metadata) of nodes as other tools name them; those of unknown kind go.

    ``raw``: id, name, label, type, path; the first that is set names the node.
    """
    name = F.coalesce("id", "name", "label")
    kind = F.lower(F.coalesce("type", F.lit("")))
    kind = (
        F.when(kind.isin("file", "source_file"), "file")
        .when(kind.isin("symbol", "function", "class", "method", "interface"), "symbol")
        .when(kind.isin("module", "package", "directory"), "module")
        .when(kind.isin("feature", "concept", "community"), "feature")
    )
    shown = F.coalesce("path", "name", "label", "id")
    return raw.select(name.alias("raw_id"), F.concat(kind, F.lit(":"), shown).alias("id"), kind.alias("type"), F.create_map(F.lit("name"), F.coalesce("name", "label", "id")).alias("metadata")).where(
        "raw_id is not null and type is not null"
    )


def by_depth(near: DataFrame) -> DataFrame:
    """(depth, type, n, ids) of a traversal."""
    return near.groupBy("depth", "type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def resolve_calls(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, callee) of call sites (caller, file, name): same-file definitions of that name, else all.

    A site is marked near or far before it meets definitions, so only pairs that are returned are made.
    """
    known = symbols.select("name", F.col("file").alias("home"), F.col("qualified_name").alias("callee")).where("name is not null").distinct()
    homes = known.where("home is not null").select("name", F.col("home").alias("file"), F.col("home").alias("near")).distinct()
    marked = sites.select("caller", "file", "name").where("file is not null").distinct().join(homes, ["name", "file"], "left").select("caller", "name", "near")
    near = known.where("home is not null").select(F.col("name").alias("n"), F.col("home").alias("h"), "callee")
    far = known.join(homes.select("name"), "name", "left_semi").select(F.col("name").alias("n"), F.lit(None).cast("string").alias("h"), "callee")
    found = marked.join(near.unionByName(far), (F.col("name") == F.col("n")) & F.col("near").eqNullSafe(F.col("h")))
    return found.select("caller", "callee").distinct()


def _listed(defs: DataFrame) -> dict:
    """Callees of definitions (id, name, callees) as ranks among all, sorted, whose names stand one after another, each with a comma.

    Definitions of one name lie side by side: of the i-th, ``first[i]`` to ``last[i]``.
    """
    rows = sorted(defs.select("id", "name", "callees").collect(), key=lambda r: r.name)
    names = sorted({c.encode() for r in rows for c in r.callees})
    rank = {c: i for i, c in enumerate(names)}
    first = np.maximum.accumulate(np.array([0 if i and rows[i - 1].name == r.name else i for i, r in enumerate(rows)], dtype=np.int64))
    return {
        "text": np.frombuffer(b"".join(c + b"," for c in names), dtype=np.uint8),
        "ends": np.cumsum([0] + [len(c) + 1 for c in names]),
        "ids": [r.id for r in rows],
        "flat": np.array([rank[c.encode()] for r in rows for c in r.callees], dtype=np.int32),
        "starts": np.cumsum([0] + [len(r.callees) for r in rows]),
        "first": first,
        "last": np.searchsorted(first, first, side="right"),
    }


def _digest(text: np.ndarray, ends: np.ndarray, parts: list[np.ndarray]) -> tuple[int, str | None]:
    """Number and SHA-256 of the different names that parts (ranks) have, sorted and comma-joined; none: null."""
    ranks = np.sort(np.concatenate(parts))
    if not len(ranks):
        return 0, None
    new = ranks[1:] != ranks[:-1]
    if not new.all():
        ranks = ranks[np.concatenate(([True], new))]
    at = ends[ranks]
    size = ends[ranks + 1] - at
    to = np.cumsum(size)
    where = np.repeat(at - to + size, size)
    where += np.arange(to[-1])
    return len(ranks), hashlib.sha256(text[where][:-1]).hexdigest()


def callee_digests(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, n, digest): how many callees ``resolve_calls`` finds for a caller, and the SHA-256 of their sorted names, comma-joined.

    A caller keeps ids of what it resolves to (a name's definitions in one file, or below 0 those in all),
    not the pairs.  Callers are dealt by these ids; callees of equal ids are put together once, from names
    that each worker holds.  Where names or definitions are too many for that, the pairs are made.
    """
    spark = symbols.sparkSession
    size = symbols.agg(F.sum(F.octet_length("qualified_name") + 3)).first()[0] or 0
    defs = None
    if size <= MAX_BROADCAST_BYTES:
        listed = symbols.where("name is not null").groupBy("name", "file").agg(F.collect_set("qualified_name").alias("callees"))
        defs = scratch(listed.withColumn("id", F.monotonically_increasing_id()), "definitions")
        rows, size = defs.agg(F.count(F.lit(1)), F.sum(F.octet_length("name") + F.coalesce(F.octet_length("file"), F.lit(0)) + 3)).first()
    if defs is None or rows > MAX_BROADCAST_ROWS or (size or 0) > MAX_BROADCAST_BYTES:
        own = resolve_calls(sites, symbols).groupBy("caller").agg(F.sort_array(F.collect_list("callee")).alias("c"))
        return own.select("caller", F.size("c").cast("long").alias("n"), F.when(F.size("c") > 0, F.sha2(F.array_join("c", ","), 256)).alias("digest"))
    near = defs.where("file is not null").select("name", "file", F.col("id").alias("near"))
    far = near.groupBy("name").agg((-1 - F.min("near")).alias("far"))
    known = sites.select("caller", "file", "name").where("file is not null").join(F.broadcast(near), ["name", "file"], "left").join(F.broadcast(far), "name")
    ids = known.groupBy("caller").agg(F.sort_array(F.collect_set(F.coalesce("near", "far"))).alias("ids"))
    held = spark.sparkContext.broadcast(_listed(defs))

    def run(batches):
        d = held.value
        flat, starts, first, last = d["flat"], d["starts"].tolist(), d["first"].tolist(), d["last"].tolist()
        at = {x: i for i, x in enumerate(d["ids"])}
        before, found = None, (0, None)
        for b in batches:
            own, out, i = b.column("ids").flatten().to_numpy(), [], 0
            for size in b.column("ids").value_lengths().to_pylist():
                key, i = own[i : i + size].tolist(), i + size
                if key != before:
                    spans = [(at[k], at[k] + 1) if k >= 0 else (first[at[-1 - k]], last[at[-1 - k]]) for k in key]
                    before, found = key, _digest(d["text"], d["ends"], [flat[starts[x] : starts[y]] for x, y in spans])
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column("caller"), pa.array([n for n, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["caller", "n", "digest"])

    kind = sites.schema["caller"].dataType.simpleString()
    return ids.hint("rebalance", "ids").sortWithinPartitions("ids").mapInArrow(run, f"caller {kind}, n long, digest string")
