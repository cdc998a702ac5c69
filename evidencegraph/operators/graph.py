"""The relationship graph: edges from mentions, upserts, degrees, components, paths, ego networks, communities.

Edges are undirected rows source, target, weight, with source < target after `upsert`. Iterations write each round to the
shared folder, so that lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hours_apart, micros, temporal_weight
from ..tables import new_folder, spread, tasks_of, written

DAY = 24.0


def cooccurrences(mentions: DataFrame, entity: str = "entity", unit: str = "uuid") -> DataFrame:
    """JOI-6, AGG-4: source, target, common units, weight = common units times mean confidence.

    Pairs are counted from an equi-join on the unit; an entity counts once in a unit. Units are messages, with few entities each.
    Each wide step is dealt to tasks by the size of the input, so that what one holds doesn't grow with it.
    """
    n = tasks_of(mentions)
    once = mentions.select(unit, entity, "confidence").repartition(n, unit).groupBy(unit, entity).agg(F.max("confidence").alias("c"))
    a = once.select(unit, F.col(entity).alias("source"))
    b = once.select(unit, F.col(entity).alias("target"))
    pairs = a.join(b, unit).filter("source < target").select("source", "target").repartition(n, "source", "target").groupBy("source", "target").agg(F.count("*").alias("common"))
    conf = mentions.groupBy(entity).agg(F.max("confidence").alias("c"))
    of = lambda c, name: conf.select(F.col(entity).alias(c), F.col("c").alias(name)).repartition(n, c)
    out = pairs.repartition(n, "source").join(of("source", "c1"), "source").repartition(n, "target").join(of("target", "c2"), "target")
    return out.select("source", "target", "common", (F.col("common") * (F.col("c1") + F.col("c2")) / 2).alias("weight"))


def shared_source_edges(entities: DataFrame) -> DataFrame:
    """JOI-9a: entities with common sources; the weight is how many."""
    n = tasks_of(entities)
    s = entities.select("entity_id", F.explode("sources").alias("s")).repartition(n, "s").distinct()
    pairs = s.withColumnRenamed("entity_id", "source").join(s.withColumnRenamed("entity_id", "target"), "s").filter("source < target")
    return pairs.select("source", "target").repartition(n, "source", "target").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight")).withColumn("relation", F.lit("co-occurrence"))


def temporal_edges(points: DataFrame, within: list[str] | None = None, hours: float = DAY) -> DataFrame:
    """JOI-9b: pairs of points (id, ts) that are over 0 and under `hours` apart, inside groups of `within`: a range join on buckets of that width.

    A pair meets once: the earlier point goes to its bucket and the next one, the later to its own.
    """
    keys = within or []
    width = int(hours * 3_600_000_000)
    at = F.floor(micros(F.col("ts")) / width)
    early = points.select(*keys, F.col("id").alias("a"), F.col("ts").alias("ta"), F.explode(F.array(at, at + 1)).alias("_b"))
    late = points.select(*keys, F.col("id").alias("b"), F.col("ts").alias("tb"), at.alias("_b"))
    gap = hours_apart(F.col("tb"), F.col("ta"))
    pairs = early.join(late, [*keys, "_b"]).filter((F.col("tb") > F.col("ta")) & (gap < hours))
    return pairs.select(*keys, F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), temporal_weight(gap).alias("weight"), F.col("ta").alias("ts"), F.lit("temporal").alias("relation"))


def multimodal_edges(rows: DataFrame, within: str, weight: float = 0.8) -> DataFrame:
    """JOI-9c: pairs of ids with different modalities inside a group."""
    a = rows.select(within, F.col("id").alias("source"), F.col("modality").alias("ma"))
    b = rows.select(within, F.col("id").alias("target"), F.col("modality").alias("mb"))
    pairs = a.join(b, within).filter("source < target and ma <> mb")
    return pairs.select(within, "source", "target", F.lit(weight).alias("weight"), F.lit("multi-modal").alias("relation"))


def relation_edges(relations: DataFrame, entities: DataFrame, existing: DataFrame) -> DataFrame:
    """JOI-7, JOI-8: named relations between known entities: an edge of 0.3, or 0.3 more on the edge there, 1 at most; each mention counts.

    `entities` has name, entity_id, seq: of equal names the last one counts.
    """
    ids = entities.groupBy(F.lower("name").alias("n")).agg(F.max_by("entity_id", "seq").alias("id"))
    out = relations.join(ids.select(F.col("n").alias("_s"), F.col("id").alias("s")), F.lower("source") == F.col("_s")).join(ids.select(F.col("n").alias("_t"), F.col("id").alias("t")), F.lower("target") == F.col("_t"))
    pairs = out.filter("s <> t").groupBy(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target")).agg(F.count("*").alias("n"), F.min_by("type", "seq").alias("relation"))
    joined = pairs.join(existing.select("source", "target", F.col("weight").alias("w")), ["source", "target"], "left")
    weight = F.when(F.col("w").isNotNull(), F.least(F.lit(1.0), F.col("w") + 0.3 * F.col("n"))).otherwise(F.least(F.lit(1.0), 0.3 * F.col("n")))
    return joined.select("source", "target", "relation", F.round(weight, 6).alias("weight"), F.col("w").isNotNull().alias("existed"))


def image_text_edges(persons: DataFrame, entities: DataFrame, existing: DataFrame) -> DataFrame:
    """JOI-8: images whose persons (image, name) a text names too: an edge of 0.5 between entity and image, or 0.5 more on the edge there, 1 at most."""
    ids = entities.groupBy(F.lower("name").alias("_n")).agg(F.max_by("entity_id", "seq").alias("id"))
    met = persons.join(ids, F.lower("name") == F.col("_n")).groupBy(F.col("id").alias("source"), F.concat(F.lit("image_"), "image").alias("target")).agg(F.count("*").alias("n"))
    joined = met.join(existing.select("source", "target", F.col("weight").alias("w")), ["source", "target"], "left")
    return joined.select("source", "target", F.lit("cross-modal").alias("relation"), F.round(F.least(F.lit(1.0), F.coalesce("w", F.lit(0.0)) + 0.5 * F.col("n")), 6).alias("weight"))


def upsert(events: DataFrame) -> DataFrame:
    """AGG-5: one edge for each pair: weights add up, frequency counts, the first relation (by seq) names it, the earliest time dates it."""
    own = events.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight", "relation", "seq", "ts")
    return own.repartition(tasks_of(own), "source", "target").groupBy("source", "target").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("frequency"), F.min_by("relation", "seq").alias("relation"), F.min("ts").alias("ts")
    )


def in_time(edges: DataFrame, start: Column, end: Column) -> DataFrame:
    """FIL-9: edges of that time, both ends included, and those without a time."""
    return edges.filter(F.col("ts").isNull() | F.col("ts").between(start, end))


def of_type(events: DataFrame, relation: str) -> DataFrame:
    """FIL-8: from the table of edge events, so that an edge is listed under all its relations, once each."""
    return events.filter(F.col("relation") == relation).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """GRA-1: node, neighbour, weight. A loop comes once."""
    back = edges.filter("source <> target").select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "weight")
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "weight").unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """GRA-2: degree and weighted degree of every node that has an edge."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA-3, GRA-8: one row; nodes without an edge count, with degree 0; no node gives zeros."""
    edges = written(edges.select("source", "target", "weight"), "edges")  # four sums are taken of them
    n = nodes.select("node").distinct()
    d = n.join(degrees(edges), "node", "left").agg(
        F.count("*").alias("node_count"),
        F.coalesce(F.avg(F.coalesce("degree", F.lit(0))), F.lit(0.0)).alias("avg_degree"),
        F.coalesce(F.max(F.coalesce("degree", F.lit(0))), F.lit(0)).alias("max_degree"),
        F.coalesce(F.min(F.coalesce("degree", F.lit(0))), F.lit(0)).alias("min_degree"),
    )
    e = edges.agg(F.count("*").alias("edge_count"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
    both = d.join(e)  # two rows of totals
    possible = F.col("node_count") * (F.col("node_count") - 1) / 2
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return both.select(
        "node_count", "edge_count", F.round("avg_degree", 6).alias("avg_degree"), "max_degree", "min_degree",
        F.round(ratio(F.col("total_weight"), F.col("edge_count")), 6).alias("avg_edge_weight"),
        F.round("total_weight", 6).alias("total_weight"),
        F.round(ratio(F.col("edge_count"), possible), 6).alias("density"),
    )


def full_statistics(nodes: DataFrame, edges: DataFrame, kind: str = "type") -> DataFrame:
    """GRA-3, GRA-8: `statistics` with the number of components (a node without an edge is one), the nodes of each type (a map as
    text), and the mean degree in which a loop counts twice. `nodes` has node and `kind`."""
    linked = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    roots = nodes.select("node").distinct().join(linked, "node", "left").agg(F.countDistinct(F.coalesce("component", "node")).alias("components"))
    types = nodes.groupBy(kind).agg(F.countDistinct("node").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(kind), F.col("n").cast("string")))), ",").alias("types"))
    twice = edges.agg(F.count("*").alias("_m"))
    out = statistics(nodes, edges).join(roots).join(types).join(twice)  # rows of totals
    return out.withColumn("avg_degree_loops", F.round(F.when(F.col("node_count") > 0, 2 * F.col("_m") / F.col("node_count")).otherwise(0.0), 6)).drop("_m")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """GRA-4: node, component (its least node) of every node in `links` (a, b): alternating large and small stars."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = written(e, "links"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            root = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root)
        before = now
    raise RuntimeError("the components did not settle")


def distances(edges: DataFrame, start, depth: int | None = None) -> DataFrame:
    """node, hops, path from `start`, as far as there are paths or up to `depth` hops: breadth first, of equally short paths the least one.

    Each round joins the edges to the last frontier and adds the new one to the table of paths.
    """
    spark = edges.sparkSession
    n = tasks_of(edges)
    ways = both_ways(edges.select("source", "target", F.lit(1.0).alias("weight"))).select("node", "neighbour").repartition(n, "node")
    ways = written(ways.distinct(), "ways")
    front = spark.range(1).select(F.lit(start).cast(edges.schema["source"].dataType).alias("node"))
    front = front.withColumn("path", F.array("node"))
    folder, schema = new_folder(spark, "paths"), front.withColumn("hops", F.lit(0)).select("node", "path", "hops").schema
    hops = 0
    while True:
        front.write.parquet(f"{folder}/hops={hops}")
        front = spark.read.schema(front.schema).parquet(f"{folder}/hops={hops}")
        if front.isEmpty() or hops == depth:
            return spark.read.schema(schema).option("basePath", folder).parquet(folder).select("node", "hops", "path")
        seen = spark.read.schema(schema).option("basePath", folder).parquet(folder).select("node")
        found = front.join(ways, "node").groupBy(F.col("neighbour").alias("node")).agg(F.min("path").alias("path"))
        front = found.join(seen, "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path"))
        hops += 1


def shortest_path(edges: DataFrame, start, end) -> DataFrame:
    """GRA-5: hops and path of one pair; no row where there is no path."""
    return distances(edges, start).filter(F.col("node") == F.lit(end)).select("hops", "path")


def ego_network(edges: DataFrame, center, depth: int = 1) -> DataFrame:
    """GRA-6: the edges among all nodes within `depth` hops."""
    inside = distances(edges, center, depth).select("node")
    return edges.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").join(inside.withColumnRenamed("node", "target"), "target", "left_semi")


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """JOI-14: entities of one mention without an edge."""
    return entities.filter("merged_count = 1").join(both_ways(edges).select(F.col("node").alias("entity_id")), "entity_id", "left_anti")


def temporal_context(edges: DataFrame, times: DataFrame, center, hours: float = DAY) -> DataFrame:
    """JOI-13, TOP-8: neighbours of `center` whose times (node, ts) are at most `hours` from its own, nearest first."""
    own = times.filter(F.col("node") == F.lit(center)).select(F.col("ts").alias("_t"), F.col("node").alias("_c"))
    near = both_ways(edges).filter(F.col("node") == F.lit(center)).select(F.col("node").alias("_c"), F.col("neighbour").alias("node"), "weight")
    rows = near.join(times, "node").join(own, "_c").withColumn("hours", hours_apart(F.col("ts"), F.col("_t")))
    return rows.filter(F.col("hours") <= hours).select("node", "hours", "weight").orderBy("hours", "node")


def modularity(labels: dict, edges: list[tuple]) -> float:
    total = sum(w for *_, w in edges)
    inside: dict = {}
    degree: dict = {}
    for a, b, w in edges:
        degree[labels[a]] = degree.get(labels[a], 0.0) + w
        degree[labels[b]] = degree.get(labels[b], 0.0) + w
        if labels[a] == labels[b]:
            inside[labels[a]] = inside.get(labels[a], 0.0) + w
    return sum(inside.get(c, 0.0) / total - (d / (2 * total)) ** 2 for c, d in degree.items()) if total else 0.0


def louvain(edges: list[tuple]) -> dict:
    """Communities of highest modularity by local moves and merging, nodes in ascending order; named by their least node."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    label = {n: n for n in nodes}
    work = list(edges)
    while True:
        near: dict = {}
        degree: dict = {}
        for a, b, w in work:
            degree[a] = degree.get(a, 0.0) + w
            degree[b] = degree.get(b, 0.0) + w
            if a != b:
                near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + w
                near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + w
        total = sum(degree.values())
        own = {n: n for n in degree}
        held = dict(degree)
        moved, any_move = True, False
        while moved and total:
            moved = False
            for n in sorted(degree):
                links: dict = {}
                for m, w in near.get(n, {}).items():
                    links[own[m]] = links.get(own[m], 0.0) + w
                c = own[n]
                held[c] -= degree[n]
                gain = lambda x: links.get(x, 0.0) - held[x] * degree[n] / total  # noqa: B023, E731
                best = max([c, *sorted(links)], key=lambda x: (round(gain(x), 12), x == c))  # noqa: B023  of equals the first one
                held[best] += degree[n]
                if best != c:
                    own[n] = best
                    moved = any_move = True
        if not any_move:
            break
        label = {n: own[c] for n, c in label.items()}
        merged: dict = {}
        for a, b, w in work:
            key = tuple(sorted((own[a], own[b])))
            merged[key] = merged.get(key, 0.0) + w
        work = [(a, b, w) for (a, b), w in merged.items()]
    least: dict = {}
    for n, c in label.items():
        least[c] = min(least.get(c, n), n)
    return {n: least[c] for n, c in label.items()}


def communities(edges: DataFrame) -> DataFrame:
    """GRA-7: node, community (its least node): Louvain inside each connected component, which no community leaves.

    A component is worked on in one task.
    """
    kind = edges.schema["source"].dataType.simpleString()
    roots = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    rows = edges.join(roots.select(F.col("node").alias("source"), "component"), "source").select("component", "source", "target", F.col("weight").cast("double").alias("weight"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Component after component, as they come in order: many are small, and each as a group of its own costs more than its work."""
        held: list[pd.DataFrame] = []

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            of: dict = {}
            for _, part in itertools.groupby(rows.itertuples(index=False, name=None), lambda r: r[0]):
                of |= louvain([r[1:] for r in part])
            return pd.DataFrame({"node": list(of), "community": list(of.values())})

        for pdf in frames:
            if not len(pdf):
                continue
            cut = int((pdf["component"] == pdf["component"].iloc[-1]).to_numpy().argmax())  # the last one may go on
            if held and (cut or pdf["component"].iloc[0] != held[-1]["component"].iloc[0]):
                held.append(pdf.iloc[:cut])
                yield found(pd.concat(held))
                held = []
            elif cut:
                yield found(pdf.iloc[:cut])
            held.append(pdf.iloc[cut:])
        if held:
            yield found(pd.concat(held))

    return spread(rows, "component").sortWithinPartitions("component", "source", "target").mapInPandas(work, f"node {kind}, community {kind}")


def relation_distribution(events: DataFrame) -> DataFrame:
    """GRA-3: edges of each relation."""
    return events.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def nodes(entities: DataFrame) -> DataFrame:
    """GRA-9."""
    return entities.select(F.col("entity_id").alias("node"), "name", "type", "confidence", F.size("sources").alias("n_sources"))


def timeline(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """TOP-1: dated entities of a confidence of `least` or more, by time and seq."""
    kept = entities.filter((F.coalesce("confidence", F.lit(1.0)) >= least) & F.col("ts").isNotNull())
    return kept.select("ts", "entity_id", "seq", F.lit("entity_activity").alias("event_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")).orderBy("ts", "seq")


def coverage(events: DataFrame) -> DataFrame:
    """TOP-1: first and last time, and number, of timeline events."""
    return events.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"))


def extended_timeline(events: DataFrame, external: DataFrame) -> DataFrame:
    """TOP-2."""
    return events.unionByName(external, allowMissingColumns=True).orderBy("ts", "seq")
