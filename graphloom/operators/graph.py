"""Graph operators: export, hubs, bounded walks, paths, ranks, cycles, impact and closure.

A walk with a cap on what it visits keeps its frontier on the driver, at most as many rows as the cap, and asks
the relations by a broadcast semi-join each level. A walk without a cap keeps its levels as staged tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.kinds import BACKWARD, FORWARD, display_kind
from graphloom.functions.text import xml_escaped
from graphloom.model import KnowledgeGraph
from graphloom.operators.aggregate import degrees, limited_ids
from graphloom.plans.staging import stage, unstage

#: Most that a capped walk may visit: bounds what is broadcast each level.
MOST_VISITED = 100_000


def export_nodes(g: KnowledgeGraph, limit: int = 500, connected: bool = False) -> DataFrame:
    """Entities of highest degree (0 for those without relations, unless ``connected``); ties by stable key."""
    e = g.entities.select("id", "stable_key", display_kind().alias("kind"), "name").join(degrees(g).select("id", "degree"), "id", "inner" if connected else "left")
    return e.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).orderBy(F.desc("degree"), "stable_key").limit(limit)


def export_edges(g: KnowledgeGraph, nodes: DataFrame, limit: int = 2000) -> DataFrame:
    """The first relations by id with both ends among ``nodes``, which export_nodes has limited."""
    ids = F.broadcast(nodes.select("id"))
    r = g.relations.select("id", display_kind().alias("kind"), "src", "dst", "status", "confidence")
    both = r.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.select("id", "kind", "src", "dst", "status", "confidence").orderBy("id").limit(limit)


def export_summary(g: KnowledgeGraph, max_nodes: int = 500, max_edges: int = 2000) -> DataFrame:
    """One row: nodes and edges returned and omitted."""
    nodes, kept = g.entities.agg(F.count("*").alias("all_nodes")), export_nodes(g, max_nodes)
    edges = g.relations.agg(F.count("*").alias("all_edges"))
    n = kept.agg(F.count("*").alias("nodes")).crossJoin(export_edges(g, kept, max_edges).agg(F.count("*").alias("edges")))
    return n.crossJoin(nodes).crossJoin(edges).select("nodes", "edges", (F.col("all_nodes") - F.col("nodes")).alias("omitted_nodes"), (F.col("all_edges") - F.col("edges")).alias("omitted_edges"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line) of a GraphML document of bounded nodes and edges."""
    q = lambda c: xml_escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'  <key id="{k}" for="{t}" attr.name="{k}" attr.type="string"/>' for k, t in (("stable_key", "node"), ("node_kind", "node"), ("name", "node"), ("edge_kind", "edge"))]
    head.append('  <graph id="G" edgedefault="directed">')
    lines = lambda xs, at: spark.createDataFrame([(at, f"{i:04d}", x) for i, x in enumerate(xs)], "ord int, key string, line string")
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), q(c), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("ord"), F.col("id").alias("key"), F.concat(F.lit('    <node id="'), q("id"), F.lit('">'), data("stable_key", "stable_key"), data("node_kind", "kind"), data("name", "name"), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("ord"), F.col("id").alias("key"), F.concat(F.lit('    <edge id="'), q("id"), F.lit('" source="'), q("src"), F.lit('" target="'), q("dst"), F.lit('">'), data("edge_kind", "kind"), F.lit("</edge>")).alias("line"))
    return lines(head, 0).union(n).union(e).union(lines(["  </graph>", "</graphml>"], 3)).orderBy("ord", "key")


def hubs(g: KnowledgeGraph, limit: int = 20, relations: int = 20, kind: str | None = None) -> DataFrame:
    """Entities by degree, in and out: with the first relation ids of each side."""
    e = g.entities.select("id", "stable_key", display_kind().alias("kind"), "name")
    if kind is not None:
        e = e.where(F.col("kind") == kind)
    top = degrees(g).join(e, "id").orderBy(F.desc("degree"), F.desc("n_in"), F.desc("n_out"), "stable_key").limit(limit)
    own = F.broadcast(top.select("id"))
    side = lambda c, out: limited_ids(g.relations.select(F.col(c).alias("node"), "id").join(own.withColumnRenamed("id", "node"), "node", "left_semi"), ["node"], relations, out).drop("n").withColumnRenamed("node", "id")
    none = F.array().cast("array<string>")
    out = top.join(side("dst", "incoming"), "id", "left").join(side("src", "outgoing"), "id", "left")
    return out.withColumn("incoming", F.coalesce("incoming", none)).withColumn("outgoing", F.coalesce("outgoing", none)).orderBy(F.desc("degree"), F.desc("n_in"), F.desc("n_out"), "stable_key")


def edges_both_ways(relations: DataFrame) -> DataFrame:
    """(a, b, rel, forward): each relation from both its ends; a self-loop once."""
    fwd = relations.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("id").alias("rel"), F.lit(True).alias("forward"))
    back = relations.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("id").alias("rel"), F.lit(False).alias("forward"))
    return fwd.union(back)


@dataclass(frozen=True)
class Visit:
    id: str
    stable_key: str
    depth: int
    seq: int
    parent: str | None
    rel: str | None
    forward: bool | None


def walk(g: KnowledgeGraph, starts: list[str], depth: int, most: int, stop: str | None = None) -> tuple[list[Visit], bool]:
    """Breadth-first over relations both ways: visits in order of discovery, and whether ``most`` cut it short.

    A node's neighbours come by (stable key, relation id). Ids that are no entity are not visited. The walk
    ends once ``stop`` is found.
    """
    if not 0 < most <= MOST_VISITED:
        raise ValueError(f"a walk may visit 1 to {MOST_VISITED}")
    spark = g.entities.sparkSession
    keys = g.entities.select("id", "stable_key")
    found = {r["id"]: r["stable_key"] for r in keys.where(F.col("id").isin(*starts)).collect()}
    visits = [Visit(i, found[i], 0, n, None, None, None) for n, i in enumerate(x for x in dict.fromkeys(starts) if x in found)][:most]
    seen, frontier, cut = {v.id for v in visits}, visits, False
    edges = edges_both_ways(g.relations)
    for level in range(1, depth + 1):
        if not frontier or cut or stop in seen:
            break
        own = F.broadcast(spark.createDataFrame([(v.id, v.seq) for v in frontier], "a string, parent_seq int"))
        known = F.broadcast(spark.createDataFrame([(i,) for i in seen], "b string"))
        best = F.min(F.struct("parent_seq", "rel", "a", "forward")).alias("via")
        # The key is the same for all ways into a node, so it orders nodes, not ways.
        new = edges.join(own, "a").join(known, "b", "left_anti").groupBy("b").agg(best).join(keys.withColumnRenamed("id", "b"), "b")
        left = most - len(visits)
        rows = new.select("b", "stable_key", "via.*").orderBy("parent_seq", "stable_key", "rel").limit(left + 1).collect()
        cut = len(rows) > left
        frontier = [Visit(r["b"], r["stable_key"], level, len(visits) + n, r["a"], r["rel"], r["forward"]) for n, r in enumerate(rows[:left])]
        if stop is not None and (at := next((n for n, v in enumerate(frontier) if v.id == stop), None)) is not None:
            frontier = frontier[: at + 1]
        visits = visits + frontier
        seen |= {v.id for v in frontier}
    return visits, cut


def id_of_key(g: KnowledgeGraph, stable_key: str) -> str:
    found = g.entities.where(F.col("stable_key") == stable_key).select(F.min("id").alias("id")).first()["id"]
    if found is None:
        raise LookupError(f"no entity of key {stable_key!r}")
    return found


def related(g: KnowledgeGraph, stable_key: str, depth: int = 1, max_entities: int | None = 50) -> DataFrame:
    """(id, stable_key, distance) around an entity, both ways, nearest first.

    ``max_entities`` at most, by a walk of the driver's; None: all of them, level by level in staged tables.
    """
    start = id_of_key(g, stable_key)
    if max_entities is None:
        hit = connected(g, g.entities.sparkSession.createDataFrame([(start,)], "id string"), depth)
        return hit.join(g.entities.select("id", "stable_key"), "id").select("id", "stable_key", F.col("depth").alias("distance"))
    visits, _ = walk(g, [start], depth, max_entities)
    rows = sorted(((v.id, v.stable_key, v.depth) for v in visits), key=lambda r: (r[2], r[1]))
    return g.entities.sparkSession.createDataFrame(rows, "id string, stable_key string, distance int")


def induced(g: KnowledgeGraph, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Relations with both ends among ``nodes`` (id), by id."""
    ids = nodes.select("id").distinct()
    r = g.relations.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return r if limit is None else r.orderBy("id").limit(limit)


def shortest_path(g: KnowledgeGraph, source_key: str, target_key: str, max_depth: int = 6, max_visited: int | None = 10_000) -> DataFrame:
    """(hop, relation, forward, src, dst) from source to target; no rows if there is no path within the limits or they are one.

    ``forward`` tells whether the hop goes along its relation. With ``max_visited`` None, levels are staged tables of any size.
    """
    a, b = id_of_key(g, source_key), id_of_key(g, target_key)
    if max_visited is None:
        hops = _staged_path(g, a, b, max_depth)
    else:
        visits, _ = walk(g, [a], max_depth, max_visited, stop=b)
        by, hops, at = {v.id: v for v in visits}, [], b
        while at in by and by[at].parent is not None:
            v = by[at]
            hops.append((v.depth, v.rel, v.forward, v.parent, v.id))
            at = v.parent
    return g.entities.sparkSession.createDataFrame(sorted(hops), "hop int, relation string, forward boolean, src string, dst string")


def _staged_path(g: KnowledgeGraph, a: str, b: str, depth: int) -> list[tuple]:
    """The hops of ``walk``'s path: of all shortest ways the first by the keys on it, then by relation ids.

    Levels are staged from both ends, the smaller next, until they meet. Keys of the way so far (which is the order of discovery) and
    the hop into each id are then kept only for ids on a shortest way, whose relations are read once; the way is followed back at the end.
    """
    spark = g.entities.sparkSession
    if a == b:
        return []
    edges = edges_both_ways(g.relations)
    sides = [[stage(spark.createDataFrame([(x,)], "id string"), "side")] for x in (a, b)]
    pairs, sizes, met = ([], []), [1, 1], None
    while len(sides[0]) + len(sides[1]) - 2 < depth and all(sizes):
        own = sizes[1] < sizes[0]
        near, level = _entities_next(g, edges.select("a", "b"), sides[own][-2:])
        pairs[own].append(near)
        sides[own].append(level)
        sizes[own] = level.count()
        met = sides[0][-1].join(sides[1][-1], "id", "left_semi")
        if not met.isEmpty():
            break
    else:
        return []
    met = stage(met, "on")
    hops = []  # (a, b) of each hop on a shortest way, from the start on
    for own in (0, 1):
        ids = met
        for near in reversed(pairs[own]):
            on = stage(near.join(_few(ids.select(F.col("id").alias("b"))), "b", "left_semi").select("a", "b").distinct(), "on")
            hops = [*hops, on.toDF("b", "a")] if own else [on, *hops]
            ids = on.select(F.col("a").alias("id")).distinct()
    used = None
    for n, on in enumerate(hops, 1):
        on = on.select("a", "b", F.lit(n).alias("hop"))
        used = on if used is None else used.unionByName(on)
    used = _few(stage(used, "on"))
    ways = stage(edges.join(used, ["a", "b"]).select("hop", "a", "b", "rel", "forward"), "on")
    ids = _few(stage(used.select(F.col("b").alias("id")).distinct(), "on"))
    keys = stage(g.entities.select("id", "stable_key").join(ids, "id", "left_semi"), "keys")
    new = g.entities.where(F.col("id") == a).select("id", F.array("stable_key").alias("way"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("rel"), F.lit(None).cast("boolean").alias("forward"))
    levels = [stage(new, "way")]
    for n in range(1, len(hops) + 1):
        best = F.min(F.struct("way", "rel", "a", "forward")).alias("v")
        step = ways.where(F.col("hop") == n).join(levels[-1].select(F.col("id").alias("a"), "way"), "a").groupBy(F.col("b").alias("id")).agg(best).join(keys, "id")
        levels.append(stage(step.select("id", F.array_append("v.way", F.col("stable_key")).alias("way"), F.col("v.a").alias("parent"), F.col("v.rel").alias("rel"), F.col("v.forward").alias("forward")), "way"))
    out, at = [], b
    for n in range(len(levels) - 1, 0, -1):
        row = levels[n].where(F.col("id") == at).select("parent", "rel", "forward").first()
        out.append((n, row["rel"], row["forward"], row["parent"], at))
        at = row["parent"]
    return out


def _few(df: DataFrame) -> DataFrame:
    """Staged rows, broadcast if they are no more than a capped walk's."""
    return F.broadcast(df) if df.limit(MOST_VISITED + 1).count() <= MOST_VISITED else df


def _entities_next(g: KnowledgeGraph, edges: DataFrame, last: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(a, b) and (id), staged: edges from the last of a walk's two ``last`` levels to ids in neither, and of these the entities. Few ids
    are looked up where relations and entities lie: no row of either moves."""
    near = edges.join(_few(last[-1]).withColumnRenamed("id", "a"), "a")
    for known in last:
        near = near.join(_few(known).withColumnRenamed("id", "b"), "b", "left_anti")
    near = stage(near.select("a", "b"), "near")
    ids = _few(near.select(F.col("b").alias("id")).distinct())
    return near, stage(g.entities.select("id").join(ids, "id", "left_semi").distinct(), "side")


def pagerank(g: KnowledgeGraph, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-8, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """(rank, id, stable_key, kind, score): directed, parallel relations count, dangling mass is spread evenly.

    What dangling and teleporting walkers add is the same for every node, so scores are in proportion to one for every node plus
    ``damping`` times what the nodes before it hand on, scaled to one in the end. A node's sum is whole once all its relations have
    handed on, so nodes on and behind no cycle are summed level by level, and each of their relations hands on once. For the rest the
    sum is a series: a round hands on the last term only and writes it. Either ends after ``iterations`` rounds, the series also once
    a term is at most ``tolerance`` of the sum (in L1). Arcs are dealt out by source and sorted once, and kept on the executors' disks;
    a lost one's are dealt again. ``kind`` only filters the output.
    """
    spark = g.entities.sparkSession
    nodes = stage(g.entities.select("id").where("id is not null").distinct(), "nodes")
    if nodes.isEmpty():
        return spark.createDataFrame([], "rank int, id string, stable_key string, kind string, score double" if limit is not None else "id string, stable_key string, kind string, score double")
    arcs, into = _arcs(g.relations.select("src", "dst").where("src is not null and dst is not null"), nodes)
    hand = lambda last: last.join(arcs, last["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") / F.col("outs")).alias("s"), F.count("*").alias("n"))
    whole = F.lit(1.0) + damping * F.col("s")
    last = nodes.join(into, "id", "left_anti").withColumn("x", F.lit(1.0))
    done, rest = last, into.select("id", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), "d").where(F.lit(False))
    for _ in range(iterations):
        got = hand(last).unionByName(rest.select("id", "s", "n")).groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        got = stage(got.join(into, "id"), "handed")
        last, rest = got.where("n = d").select("id", whole.alias("x")), got.where("n < d")
        if last.isEmpty():
            break
        done = done.union(last)
    done = stage(done, "done")
    total = done.agg(F.sum("x")).first()[0] or 0.0
    last = stage(into.select("id").join(done, "id", "left_anti").join(rest.select("id", "s"), "id", "left").select("id", F.coalesce(whole, F.lit(1.0)).alias("x")), "term")
    total += last.agg(F.sum("x")).first()[0] or 0.0
    terms = last
    for _ in range(iterations):
        if last.isEmpty():
            break
        last = stage(hand(last).select("id", (damping * F.col("s")).alias("x")), "term")
        moved = last.agg(F.sum("x")).first()[0] or 0.0
        total += moved
        terms = terms.union(last)
        if moved <= tolerance * total:
            break
    arcs.unpersist()
    scores = done.union(terms.groupBy("id").agg(F.sum("x").alias("x"))).select("id", (F.col("x") / total).alias("score"))
    e = g.entities.select("id", "stable_key", display_kind().alias("kind"))
    if kind is not None:
        e = e.where(F.col("kind") == kind)
    listed = scores.join(e, "id")
    if limit is None:
        return listed.select("id", "stable_key", "kind", "score")
    top = listed.orderBy(F.desc("score"), "stable_key").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "stable_key")).alias("rank"), "id", "stable_key", "kind", "score")


def _arcs(ends: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, outs), dealt out by source, and (id, d): relations' ends (src, dst) that are both nodes, with the number of arcs from
    each source, and of arcs into each node. Ends that are no node are looked for among the distinct ones; relations are dealt anew without them only if there are any."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        arcs = ends.repartition(parts, "src").withColumn("outs", F.count("*").over(Window.partitionBy("src"))).persist(StorageLevel.DISK_ONLY)
        into = stage(ends.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d")), "into")
        strange = stage(arcs.select(F.col("src").alias("id")).distinct().join(nodes, "id", "left_anti").union(into.select("id").join(nodes, "id", "left_anti")).distinct(), "strange")
        if strange.isEmpty():
            return arcs, into
        arcs.unpersist()
        ends = stage(ends.join(strange.withColumnRenamed("id", "src"), "src", "left_anti").join(strange.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "ends")


def cyclic_core(g: KnowledgeGraph, rounds: int = 64) -> DataFrame:
    """Relations that can lie on a cycle: ends without a way in or out are taken off until none is left, or for ``rounds``."""
    edges = stage(g.relations.select("id", "src", "dst"), "core")
    n = edges.count()
    for _ in range(rounds):
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = stage(kept.select("id", "src", "dst"), "core")
        unstage(edges)
        edges, before, n = kept, n, kept.count()
        if n in (0, before):
            break
    return edges


def cycles(g: KnowledgeGraph, max_starts: int | None = 1000, max_depth: int = 8, limit: int | None = 20) -> DataFrame:
    """(length, cycle_key, relations): simple directed cycles of at most ``max_depth`` relations through one of the first
    ``max_starts`` entities by key (None: any), the first ``limit`` by length and key (None: all).

    A cycle is told once, by the least rotation of its relation ids; a self-loop has length 1. Paths grow only in what is left when
    nodes that lie on no cycle are taken off, and a cycle is walked only from the least of the starts on it: a path does not enter
    a start that comes before its own.
    """
    core = cyclic_core(g)
    keyed = g.entities.select(F.col("id").alias("start"), "stable_key")
    starts = keyed.join(core.select(F.col("src").alias("start")).distinct(), "start", "left_semi")
    starts = (starts if max_starts is None else starts.orderBy("stable_key").limit(max_starts)).select("start")
    known = g.entities.select(F.col("id").alias("dst"))
    starts = stage(starts.distinct(), "starts")
    arcs = core.join(known, "dst", "left_semi").join(starts.select(F.col("start").alias("dst"), F.lit(True).alias("is_start")), "dst", "left")
    arcs = stage(arcs.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("id").alias("rel"), F.coalesce("is_start", F.lit(False)).alias("is_start")), "arcs")
    paths = starts.select("start", F.col("start").alias("at"), F.array().cast("array<string>").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    closed = None
    for _ in range(max_depth):
        step = paths.join(arcs, "at").where(~F.col("is_start") | (F.col("next") >= F.col("start"))).select("start", F.col("next").alias("at"), F.array_append("nodes", F.col("at")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"))
        step = stage(step.where((F.col("at") == F.col("start")) | ~F.array_contains("nodes", F.col("at"))), "paths")
        done = step.where("at = start").select("rels")
        closed = done if closed is None else closed.union(done)
        paths = step.where("at <> start")
        if paths.isEmpty():
            break
    turn = lambda r: F.array_join(F.concat(F.slice("rels", r + 1, F.size("rels") - r), F.slice("rels", F.lit(1), r)), "\x1f")
    key = F.array_min(F.transform(F.sequence(F.lit(0), F.size("rels") - 1), turn))
    out = closed.select(F.size("rels").alias("length"), key.alias("cycle_key")).distinct()
    return (out if limit is None else out.orderBy("length", "cycle_key").limit(limit)).select("length", "cycle_key", F.split("cycle_key", "\x1f").alias("relations"))


def oriented(relations: DataFrame) -> DataFrame:
    """(a, b, rel, forward): the ways along which a change travels. Other kinds carry none."""
    f = relations.where(F.col("kind").isin(*FORWARD)).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("id").alias("rel"), F.lit(True).alias("forward"))
    return f.union(relations.where(F.col("kind").isin(*BACKWARD)).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("id").alias("rel"), F.lit(False).alias("forward")))


def reached(edges: DataFrame, starts: DataFrame, depth: int | None = None, symmetric: bool = False) -> DataFrame:
    """(id, depth) of all that can be reached over ``edges`` (a, b) from ``starts`` (id): ``reach`` without its paths.

    For many levels edges are dealt out once and kept on the executors' disks, so that a level moves its own ids only. Of ``symmetric``
    edges a level's neighbours can be known from the last two levels alone.
    """
    ways = edges.select("a", "b")
    many = depth is None or depth > 2
    if many:
        ways = ways.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a").persist(StorageLevel.DISK_ONLY)
    levels = [stage(starts.select("id").distinct().withColumn("depth", F.lit(0)), "level")]
    while (depth is None or len(levels) <= depth) and not levels[-1].isEmpty():
        step = levels[-1].select(F.col("id").alias("a")).join(ways, "a").select(F.col("b").alias("id")).distinct()
        for known in levels[-2:] if symmetric else levels:
            step = step.join(known.select("id"), "id", "left_anti")
        levels.append(stage(step.withColumn("depth", F.lit(len(levels))), "level"))
    if many:
        ways.unpersist()
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


#: Bits of a packed id's number; its prefix has the rest.
NUMBER_BITS, MOST_PREFIXES = 55, 100


def packing(g: KnowledgeGraph) -> tuple[Callable[[DataFrame], DataFrame], Callable[[str], Column]] | None:
    """How a table's ids are packed into longs, null if they can't be, and how a column of these is unpacked: ids of 16 hex digits, as
    extraction gives them, or a number after one of the entities' prefixes and a colon. None if entities' ids have neither form."""
    ids = g.entities.select("id").where("id is not null")
    form = r"^ent_[0-9a-f]{16}$"
    if ids.where(~F.col("id").rlike(form)).isEmpty():
        pack = lambda c: F.when(F.col(c).rlike(form), F.conv(F.substring(c, 5, 16), 16, -10).cast("long")).alias(c)
        return lambda df: df.select(*map(pack, df.columns)), lambda c: F.concat(F.lit("ent_"), F.lpad(F.lower(F.hex(c)), 16, "0"))
    found = sorted(r[0] for r in ids.select(F.substring_index("id", ":", 1)).distinct().limit(MOST_PREFIXES + 1).collect())
    if len(found) > MOST_PREFIXES:
        return None

    def packed(df: DataFrame) -> DataFrame:
        # Step by step, so that what is used twice is computed once.
        names = df.columns
        chain = lambda c, f: reduce(lambda out, n: out.when(F.col(c).startswith(f"{found[n]}:"), f(n)), range(1, len(found)), F.when(F.col(c).startswith(f"{found[0]}:"), f(0)))
        df = df.select(*(chain(c, lambda n: F.lit(n << NUMBER_BITS)).alias(f"{c}_code") for c in names), *(chain(c, lambda n, c=c: F.substring(c, len(found[n]) + 2, 20)).alias(c) for c in names))
        df = df.select("*", *(F.col(c).try_cast("long").alias(f"{c}_n") for c in names))
        same = lambda c: F.col(f"{c}_n").between(0, (1 << NUMBER_BITS) - 1) & (F.col(f"{c}_n").cast("string") == F.col(c))
        return df.select(*(F.when(same(c), F.col(f"{c}_code").bitwiseOR(F.col(f"{c}_n"))).alias(c) for c in names))

    prefixes = F.array(*map(F.lit, found))
    return packed, lambda c: F.concat(F.get(prefixes, F.shiftrightunsigned(c, NUMBER_BITS).cast("int")), F.lit(":"), F.col(c).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).cast("string"))


def connected(g: KnowledgeGraph, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth) of all that is connected to ``starts`` (id) over relations of any direction. A null end leads nowhere.

    Many levels are walked over packed ids: relations are read once and dealt out from both ends, kept on the executors' disks, and a
    level moves longs only. If an end can't be packed, ids are walked as they are.
    """
    ends = g.ends.where("src is not null and dst is not null")
    plain = ends.select("src", "dst", F.lit(None).cast("string").alias("id"))
    starts = stage(starts.select("id").distinct(), "starts")
    how = packing(g) if depth is None or depth > 2 else None
    if how is None:
        return reached(edges_both_ways(plain), starts, depth, symmetric=True)
    pack, unpack = how
    both = pack(ends.select("src", "dst")).selectExpr("stack(2, src, dst, dst, src) as (a, b)")
    ways = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a").persist(StorageLevel.DISK_ONLY)
    if ways.agg(F.count_if(F.col("a").isNull())).first()[0]:
        ways.unpersist()
        return reached(edges_both_ways(plain), starts, depth, symmetric=True)
    levels = [stage(pack(starts).select(F.col("id").alias("a"), F.lit(0).alias("depth")).where("a is not null"), "level")]
    while (depth is None or len(levels) <= depth) and not levels[-1].isEmpty():
        step = ways.join(levels[-1].select("a").hint("shuffle_hash"), "a").select(F.col("b").alias("a")).distinct()
        for known in levels[-2:]:
            step = step.join(known.select("a"), "a", "left_anti")
        levels.append(stage(step.withColumn("depth", F.lit(len(levels))), "level"))
    ways.unpersist()
    out = starts.select("id", F.lit(0).alias("depth"))
    for x in levels[1:]:
        out = out.union(x.select(unpack("a").alias("id"), "depth"))
    return out


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth, path) of all that can be reached over ``edges`` (a, b, rel) from ``starts`` (id), by the path found first.

    Breadth-first order is the order of paths as arrays, so that no global number is needed. A level is a join, a partial minimum and an
    anti-join, staged; there is no cap.
    """
    new = stage(starts.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")), "level")
    levels, seen, level = [new], new.select("id"), 0
    while (depth is None or level < depth) and not new.isEmpty():
        level += 1
        step = new.select(F.col("id").alias("a"), "path").join(edges, "a").groupBy("b").agg(F.min(F.array_append("path", F.col("rel"))).alias("path"))
        new = stage(step.join(seen, step["b"] == seen["id"], "left_anti").select(F.col("b").alias("id"), F.lit(level).alias("depth"), "path"), "level")
        levels.append(new)
        seen = seen.union(new.select("id"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def impact(g: KnowledgeGraph, starts: DataFrame, depth: int = 10) -> DataFrame:
    """(id, stable_key, kind, depth, path): entities that a change of ``starts`` (id) reaches, with relation ids from the start.

    Ids that are no entity carry the change on, but are not reported.
    """
    hit = reach(oriented(g.relations), starts.select("id").distinct(), depth)
    e = g.entities.select("id", "stable_key", display_kind("debug").alias("kind"))
    return hit.join(e, "id").select("id", "stable_key", "kind", "depth", F.slice("path", F.lit(2), F.size("path")).alias("path"))


def impact_steps(g: KnowledgeGraph, hit: DataFrame) -> DataFrame:
    """(id, hop, relation, kind, forward, from_key, to_key) of every hop of ``impact``'s paths; unknown ends keep their id as key."""
    r = g.relations.select(F.col("id").alias("relation"), display_kind("debug").alias("kind"), "src", "dst", F.col("kind").isin(*FORWARD).alias("forward"))
    key = g.entities.select("id", "stable_key")
    steps = hit.select("id", F.posexplode("path").alias("hop", "relation")).join(r, "relation")
    a, b = F.when(F.col("forward"), F.col("src")).otherwise(F.col("dst")), F.when(F.col("forward"), F.col("dst")).otherwise(F.col("src"))
    steps = steps.select("id", (F.col("hop") + 1).alias("hop"), "relation", "kind", "forward", a.alias("a"), b.alias("b"))
    steps = steps.join(key.toDF("a", "a_key"), "a", "left").join(key.toDF("b", "b_key"), "b", "left")
    return steps.select("id", "hop", "relation", "kind", "forward", F.coalesce("a_key", "a").alias("from_key"), F.coalesce("b_key", "b").alias("to_key"))


def impact_diagnostics(g: KnowledgeGraph, hit: DataFrame) -> DataFrame:
    """Open diagnostics that name an entity of ``hit`` (id)."""
    d = g.diagnostics.where("status = 'open'").select("id", F.explode("entities").alias("entity"))
    return g.diagnostics.join(d.join(hit.select(F.col("id").alias("entity")), "entity", "left_semi").select("id").distinct(), "id", "left_semi")


def impact_files(g: KnowledgeGraph, hit: DataFrame) -> DataFrame:
    """Distinct files that entities of ``hit`` (id) lie in."""
    return g.entities.join(hit.select("id"), "id", "left_semi").where("source.path is not null").select(F.col("source.path").alias("path")).distinct()


def closure(g: KnowledgeGraph, ids: DataFrame) -> DataFrame:
    """(id): all that is connected to ``ids`` over relations of any direction."""
    return connected(g, ids).select("id")


def closure_graph(g: KnowledgeGraph, ids: DataFrame) -> KnowledgeGraph:
    """The tables' rows within a closure: entities, relations with both ends, facts with subject or object, diagnostics that name one."""
    inside = stage(closure(g, ids), "closure")
    f = g.facts.join(inside.withColumnRenamed("id", "x"), (F.col("subject") == F.col("x")), "left_semi")
    by_object = g.facts.join(inside.withColumnRenamed("id", "x"), F.col("object") == F.col("x"), "left_semi")
    f = f.unionByName(by_object.join(inside.withColumnRenamed("id", "x"), F.col("subject") == F.col("x"), "left_anti"))
    d = g.diagnostics.select("id", F.explode("entities").alias("x")).join(inside.withColumnRenamed("id", "x"), "x", "left_semi").select("id").distinct()
    return g.with_tables(entities=g.entities.join(inside, "id", "left_semi"), facts=f, relations=induced(g, inside), diagnostics=g.diagnostics.join(d, "id", "left_semi"))


def removed_neighbours(old: KnowledgeGraph, removed: DataFrame) -> DataFrame:
    """(id): one hop from removed entities in the old snapshot; of a relation between two removed ones, its target."""
    a = removed.select(F.col("id").alias("src")).distinct().withColumn("src_gone", F.lit(True))
    b = removed.select(F.col("id").alias("dst")).distinct().withColumn("dst_gone", F.lit(True))
    r = old.relations.select("src", "dst").join(a, "src", "left").join(b, "dst", "left")
    return r.where("src_gone or dst_gone").select(F.when(F.col("src_gone"), F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()


def keyed_edges(g: KnowledgeGraph) -> DataFrame:
    """(id, src_key, dst_key, kind) of relations between known entities, by stable key."""
    k = g.entities.select("id", "stable_key")
    return g.relations.select("id", "src", "dst", display_kind().alias("kind")).join(k.toDF("src", "src_key"), "src").join(k.toDF("dst", "dst_key"), "dst").select("id", "src_key", "dst_key", "kind")


def bounded(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes (key) by key, and of edges (src_key, dst_key, kind) between them the first by both keys and kind."""
    kept = nodes.select("key").distinct().orderBy("key").limit(max_nodes)
    ends = F.broadcast(kept)
    inside = edges.join(ends.withColumnRenamed("key", "src_key"), "src_key", "left_semi").join(ends.withColumnRenamed("key", "dst_key"), "dst_key", "left_semi")
    return kept, inside.select("src_key", "dst_key", "kind").distinct().orderBy("src_key", "dst_key", "kind").limit(max_edges)


def two_hop(g: KnowledgeGraph, root_key: str, first: str, second: str) -> DataFrame:
    """(src_key, dst_key, kind): relations of kind ``first`` from a root, and of kind ``second`` from what they lead to."""
    e = keyed_edges(g)
    one = e.where((F.col("src_key") == root_key) & (F.col("kind") == first))
    two = e.where(F.col("kind") == second).join(one.select(F.col("dst_key").alias("src_key")).distinct(), "src_key", "left_semi")
    return one.select("src_key", "dst_key", "kind").union(two.select("src_key", "dst_key", "kind"))


def family_graph(g: KnowledgeGraph, prefixes: tuple[str, ...], segment: str | None = None) -> DataFrame:
    """(src_key, dst_key, kind): relations whose ends both have one of the key prefixes and, if given, a first segment at either end."""
    e = keyed_edges(g)
    inside = lambda c: F.col(c).rlike("^(" + "|".join(prefixes) + ")://")
    e = e.where(inside("src_key") & inside("dst_key"))
    if segment is not None:
        own = lambda c: F.split(F.regexp_replace(c, r"^[a-z_]+://", ""), "/")[0] == segment
        e = e.where(own("src_key") | own("dst_key"))
    return e.select("src_key", "dst_key", "kind")


def violations(g: KnowledgeGraph, family: str, root_scheme: str, fields: tuple[str, ...] = ("module",)) -> DataFrame:
    """(src_key, dst_key, kind) of open diagnostics of a family: what they violate, and the files that are their evidence.

    The root's key is ``root_scheme`` and the payload's ``fields``. Edges to keys that no entity has are left out.
    """
    d = g.diagnostics.where((F.col("status") == "open") & F.coalesce("kind_other", "kind").startswith(family))
    have = g.entities.select(F.col("stable_key").alias("dst_key")).distinct()
    root = F.concat(F.lit(f"{root_scheme}://"), F.concat_ws("/", *(F.get_json_object("payload", f"$.{f}") for f in fields)))
    known = F.lit(True)
    for f in fields:
        known = known & F.get_json_object("payload", f"$.{f}").isNotNull()
    a = d.where(known).select(F.concat(F.lit("diagnostic://"), "id").alias("src_key"), root.alias("dst_key"), F.lit("violates").alias("kind"))
    paths = F.array_compact(F.array_distinct(F.concat(F.coalesce("evidence.source_file", F.array().cast("array<string>")), F.array(F.get_json_object("payload", "$.path")))))
    files = F.transform(paths, lambda p: F.concat(F.lit("file://"), p))
    b = d.select(F.concat(F.lit("diagnostic://"), "id").alias("src_key"), F.explode(files).alias("dst_key"), F.lit("evidenced_by").alias("kind"))
    return a.union(b).join(have, "dst_key", "left_semi").select("src_key", "dst_key", "kind")


def architecture_context(g: KnowledgeGraph, in_context: DataFrame, explicit: tuple[str, ...] = (), limit: int = 8, module_kind: str = "module") -> DataFrame:
    """(module, score): modules by what of them is in context (id): 4 for each such neighbour or itself, 1 for others, 100 more if named."""
    m = g.entities.where(display_kind() == module_kind).select("id", F.col("stable_key").alias("module"))
    near = m.select("id", "module", F.col("id").alias("other")).union(m.join(g.relations.select(F.col("src").alias("id"), F.col("dst").alias("other")), "id").select("id", "module", "other"))
    inside = in_context.select(F.col("id").alias("other")).distinct().withColumn("inside", F.lit(True))
    points = F.when(F.col("inside"), 4).otherwise(1)
    out = near.distinct().join(inside, "other", "left").groupBy("module").agg(F.sum(points).alias("score"))
    return out.withColumn("score", F.col("score") + F.when(F.col("module").isin(*explicit), 100).otherwise(0) if explicit else F.col("score")).orderBy(F.desc("score"), "module").limit(limit)


def path_column(path: str = "path") -> Column:
    return F.array_join(path, ">")
