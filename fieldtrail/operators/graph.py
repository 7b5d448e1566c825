"""Graphs of nodes and edges, one per key: normalization, ranks, layers, caps, layout, main paths.

Nodes have (keys, id, kind, label, layer, ord, ...), edges (keys, src, dst, kind, confidence, ord, ...); ``ord`` is the order in
which a graph lists them. All windows are within one graph.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrail.functions.ranks import numbered
from fieldtrail.functions.text import slug
from fieldtrail.sources.scratch import written

KEY = ("repo", "keyword")
LAYER_ORDER = ("Controller", "Service", "Repository", "Table", "Other")


def edge_type(kind: Column) -> Column:
    return F.when(kind == "call", "calls").when(kind == "references", "reads_from").otherwise(F.when(F.coalesce(kind, F.lit("")) == "", "related").otherwise(kind))


def edge_weight(kind: Column, confidence: Column) -> Column:
    return F.when(confidence == "inferred", 0.55).when(kind == "references", 0.9).otherwise(1.0)


def _joined(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    ids = nodes.select(*keys, "id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi")
    return inside.join(ids.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi").filter("src <> dst")


def normalize_edges(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Edges between known, different nodes, one for each (src, dst, kind): the heaviest, of these the first, at the place of the first."""
    kept = _joined(nodes, edges, keys).withColumn("kind", F.coalesce("kind", F.lit("related")))
    kept = kept.withColumn("type", edge_type(F.col("kind"))).withColumn("direction", F.lit("forward")).withColumn("weight", edge_weight(F.col("kind"), F.col("confidence")))
    rest = [c for c in kept.columns if c not in {*keys, "src", "dst", "kind", "ord"}]
    best = kept.groupBy(*keys, "src", "dst", "kind").agg(F.max_by(F.struct(*rest), F.struct("weight", -F.col("ord"))).alias("r"), F.min("ord").alias("ord"))
    return best.select(*keys, "src", "dst", "kind", "ord", "r.*")


def edge_counts(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, dropped, deduped): edges left out for a missing end or a loop, and repeats merged."""
    every = edges.groupBy(*keys).agg(F.count("*").alias("n"))
    per = _joined(nodes, edges, keys).withColumn("kind", F.coalesce("kind", F.lit("related"))).groupBy(*keys, "src", "dst", "kind").agg(F.count("*").alias("m"))
    kept = per.groupBy(*keys).agg(F.sum("m").alias("kept"), F.count("*").alias("groups"))
    zero = F.lit(0).cast("bigint")
    return every.join(kept, list(keys), "left").select(*keys, (F.col("n") - F.coalesce("kept", zero)).alias("dropped"), (F.coalesce("kept", zero) - F.coalesce("groups", zero)).alias("deduped"))


def degrees(edges: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, id, degree): edges in and out."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(*keys, "id").agg(F.count("*").alias("degree"))


def _with_degree(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return nodes.join(degrees(edges, keys), [*keys, "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_complexity(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``nodes`` with degree and complexity: simple, moderate or complex by degree, usages and long SQL."""
    df = _with_degree(nodes, edges, keys)
    usages = F.when(_or_null(nodes, "usages", "array<string>").isNull(), 0).otherwise(F.size(_or_null(nodes, "usages", "array<string>")))
    score = F.col("degree") + usages + F.when(F.length(F.coalesce(_or_null(nodes, "sql_snippet"), F.lit(""))) > 160, 1).otherwise(0)
    return df.withColumn("complexity", F.when(score <= 1, "simple").when(score <= 4, "moderate").otherwise("complex"))


def enrich_nodes(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``nodes`` with degree, complexity, type, name, summary and tags."""
    df = with_complexity(nodes, edges, keys)
    filled = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    kind, layer, op, table = F.col("kind"), F.col("layer"), _or_null(nodes, "op"), _or_null(nodes, "table")
    label = filled(F.col("label"), F.col("id"))
    unit = filled(_or_null(nodes, "source_unit"), F.lit("traced call chain"))
    about_table = F.concat(F.lit("Database table "), label, F.lit(" is accessed via "), unit, F.lit(" ("), filled(op, F.lit("unknown")), F.lit(")."))
    about_unit = F.concat(label, F.lit(" participates in the traced keyword flow at the "), filled(layer, F.lit("Other")), F.lit(" layer."))
    tags = F.array(slug(filled(layer, F.lit("unknown"))), slug(filled(kind, F.lit("node"))), F.when(F.coalesce(table, F.lit("")) != "", "table"), F.when(F.coalesce(op, F.lit("")) != "", slug(op)))
    return (
        df.withColumn("type", F.when(kind == "table", "table").when(kind == "unit", "function").otherwise("concept"))
        .withColumn("name", label)
        .withColumn("summary", F.when(kind == "table", about_table).otherwise(about_unit))
        .withColumn("tags", F.array_sort(F.array_distinct(F.array_compact(tags))))
    )


def _layer_rank(layer_order: Sequence[str]) -> Column:
    known = [F.when(F.col("layer") == name, i) for i, name in enumerate(layer_order)]
    return F.coalesce(*known, F.lit(len(layer_order)))


def layer_members(nodes: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, layer, place, id): the nodes of each layer in their order, in long form, so that a layer of any size is many rows."""
    members = nodes.select(*keys, F.coalesce("layer", F.lit("Other")).alias("layer"), "ord", "id")
    return numbered(members, [*keys, "layer"], ["ord", "id"]).select(*keys, "layer", "place", "id")


def build_layers(nodes: DataFrame, layer_order: Sequence[str] = LAYER_ORDER, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, place, layer_id, layer, node_ids): layers that have nodes, in the given order, then as first seen.

    ``node_ids`` is one array for each layer: meant for capped graphs. The long form is layer_counts and layer_members.
    """
    layers = nodes.withColumn("layer", F.coalesce("layer", F.lit("Other"))).groupBy(*keys, "layer").agg(
        F.min("ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("node_ids")
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(_layer_rank(layer_order), "first", "layer"))
    return layers.select(*keys, place.alias("place"), F.concat(F.lit("layer:"), slug(F.col("layer"))).alias("layer_id"), "layer", "node_ids")


def layer_counts(nodes: DataFrame, layer_order: Sequence[str] = LAYER_ORDER, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, place, layer, n)."""
    counted = nodes.withColumn("layer", F.coalesce("layer", F.lit("Other"))).groupBy(*keys, "layer").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(_layer_rank(layer_order), "first", "layer"))
    return counted.select(*keys, place.alias("place"), "layer", "n")


def layer_edges(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, source_layer, target_layer, n, types): edges between different layers."""
    of = nodes.select(*keys, "id", F.concat(F.lit("layer:"), slug(F.coalesce("layer", F.lit("Other")))).alias("of"))
    both = edges.join(of.withColumnsRenamed({"id": "src", "of": "source_layer"}), [*keys, "src"]).join(of.withColumnsRenamed({"id": "dst", "of": "target_layer"}), [*keys, "dst"])
    kind = F.col("type") if "type" in edges.columns else edge_type(F.col("kind"))
    return both.filter("source_layer <> target_layer").groupBy(*keys, "source_layer", "target_layer").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(kind)).alias("types"))


def top_nodes(nodes: DataFrame, edges: DataFrame, k: int = 6, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, rank, id, degree): the k nodes with most edges, the first listed on a tie."""
    ranked = _with_degree(nodes, edges, keys).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("degree"), "ord", "id")))
    return ranked.filter(F.col("rank") <= k).select(*keys, "rank", "id", "degree")


def graph_counts(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, nodes, edges, tables, usages)."""
    usages = F.sum(F.when(F.col("kind") == "unit", F.greatest(F.size("usages"), F.lit(0))).otherwise(0)) if "usages" in nodes.columns else F.sum(F.lit(0))
    n = nodes.groupBy(*keys).agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "table").alias("tables"), usages.cast("bigint").alias("usages"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("edges"))
    return n.join(e, list(keys), "left").select(*keys, "nodes", F.coalesce("edges", F.lit(0).cast("bigint")).alias("edges"), "tables", "usages")


# ---- Paths ----


def shortest_paths_to_tables(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None, max_hops: int = 12, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, start, path): for each start (keys, id; all units if not given) the shortest path to the nearest table, ties by edge order.

    Distances to the nearest table spread backwards from the tables, a level at a time. A node's next step is its first edge
    to a node that is nearer; steps thus make trees whose roots are the tables. Nodes then jump along the trees: a round gives each
    node that knows its first n steps those of the node it has come to, so paths take log2(max_hops) rounds. They are rows (node, place, at)
    until arrays are put together once, for the starts alone. A table has no path. Needs a checkpoint folder.
    """
    tables = nodes.filter("kind = 'table'").select(*keys, "id").distinct()
    near = _distances(tables, edges, max_hops - 1, keys)
    steps = edges.select(*keys, "src", "dst", "ord").join(near.withColumnRenamed("id", "dst"), [*keys, "dst"])
    step = F.min_by(F.struct("dst", "dist"), F.struct("dist", "ord", "dst"))
    steps = steps.groupBy(*keys, F.col("src").alias("start")).agg(step.alias("s"))
    way = written(steps.select(*keys, "start", F.lit(1).alias("place"), F.col("s.dst").alias("at"), (F.col("s.dist") + 1).alias("hops")))
    known = 1
    while not (ends := way.filter((F.col("place") == known) & (F.col("hops") > known))).isEmpty():
        there = way.select(*keys, F.col("start").alias("at"), F.col("place").alias("more"), F.col("at").alias("then"))
        further = ends.join(there, [*keys, "at"]).select(*keys, "start", (F.col("more") + known).alias("place"), F.col("then").alias("at"), "hops")
        way = way.unionByName(written(further))
        known *= 2
    asked = (nodes if starts is None else starts).select(*keys, F.col("id").alias("start")).distinct().join(tables.withColumnRenamed("id", "start"), [*keys, "start"], "left_anti")
    paths = way.join(asked, [*keys, "start"]).groupBy(*keys, "start").agg(F.array_sort(F.collect_list(F.struct("place", "at"))).alias("s"))
    return paths.select(*keys, "start", F.concat(F.array("start"), F.col("s.at")).alias("path"))


def _distances(targets: DataFrame, edges: DataFrame, most: int, keys: Sequence[str]) -> DataFrame:
    """(keys, id, dist) of nodes from which a target can be reached in ``most`` steps, with the targets."""
    reached = frontier = written(targets.withColumn("dist", F.lit(0)))
    back = edges.select(*keys, F.col("dst").alias("id"), F.col("src").alias("next")).distinct()
    for dist in range(1, most + 1):
        met = frontier.join(back, [*keys, "id"]).select(*keys, F.col("next").alias("id")).distinct()
        frontier = written(met.join(reached, [*keys, "id"], "left_anti").withColumn("dist", F.lit(dist)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def main_paths(nodes: DataFrame, edges: DataFrame, k: int = 4, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, rank, nodes, labels, layers, table): up to k paths to tables. Starts are controllers, then units without callers, then units with usages, then
    all units; a path that is a part of a taken one is left out. Edges are written once, since each step of the search reads them. Needs a checkpoint folder."""
    edges = written(edges.select(*keys, "src", "dst", "ord"))
    incoming = edges.select(*keys, F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    unit = F.col("kind") == "unit"
    used = (F.size("usages") > 0) if "usages" in nodes.columns else F.lit(False)
    tier = F.when(F.col("layer") == "Controller", 0).when(unit & F.col("called").isNull(), 1).when(unit & used, 2).when(unit, 3)
    starts = nodes.join(incoming, [*keys, "id"], "left").withColumn("tier", tier).filter("tier IS NOT NULL").select(*keys, "id", "tier", "ord")
    paths = shortest_paths_to_tables(nodes, edges, starts, keys=keys)
    ranked = paths.join(starts.withColumnRenamed("id", "start"), [*keys, "start"]).select(*keys, "tier", "ord", "path")

    # a round takes the first path that is left in each graph, and leaves out the parts of it
    line = lambda c: F.concat(F.lit("\0"), F.array_join(c, "\0"), F.lit("\0"))
    left = written(ranked.withColumn("line", line(F.col("path"))))
    rounds = []
    for rank in range(1, k + 1):
        taken = left.groupBy(*keys).agg(F.min_by(F.struct("path", "line"), F.struct("tier", "ord", "path")).alias("t")).checkpoint()
        if taken.isEmpty():
            break
        rounds.append(taken.select(*keys, F.lit(rank).alias("rank"), F.col("t.path").alias("nodes")))
        left = written(left.join(taken.select(*keys, F.col("t.line").alias("whole")), list(keys)).filter(~F.contains("whole", "line")).drop("whole"))
    picked = union_all(rounds) if rounds else ranked.limit(0).select(*keys, F.lit(0).alias("rank"), F.col("path").alias("nodes"))
    table = _or_null(nodes, "table")
    facts = nodes.select(*keys, F.col("id").alias("node"), F.coalesce("label", "id").alias("label"), F.coalesce("layer", F.lit("")).alias("layer"), F.coalesce(table, F.col("label"), F.lit("")).alias("table"))
    each = picked.select(*keys, "rank", "nodes", F.posexplode("nodes").alias("at", "node")).join(facts, [*keys, "node"])
    rows = each.groupBy(*keys, "rank", "nodes").agg(F.array_sort(F.collect_list(F.struct("at", "label", "layer", "table"))).alias("s"))
    return rows.select(*keys, "rank", "nodes", F.col("s.label").alias("labels"), F.col("s.layer").alias("layers"), F.element_at("s.table", -1).alias("table"))


def main_path_members(paths: DataFrame, keys: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Nodes (keys, id) and edges (keys, src, dst) that lie on a main path."""
    pairs = F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("src"), F.slice("nodes", 2, F.size("nodes") - 1).alias("dst"))
    edges = paths.filter(F.size("nodes") > 1).select(*keys, F.explode(pairs).alias("e")).select(*keys, F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).distinct()
    return paths.select(*keys, F.explode("nodes").alias("id")).distinct(), edges


def tour(paths: DataFrame, layers: DataFrame, most: int = 15, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, step, title, node_ids): the first main path, then each layer."""
    first = paths.filter("rank = 1").select(*keys, F.lit(0).alias("at"), F.lit("Main path").alias("title"), F.col("nodes").alias("node_ids"))
    rest = layers.select(*keys, F.col("place").alias("at"), F.col("layer").alias("title"), "node_ids")
    step = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    return first.unionByName(rest).withColumn("step", step).filter(F.col("step") <= most).select(*keys, "step", "title", "node_ids")


def tour_stops(paths: DataFrame, nodes: DataFrame, most: int = 15, layer_order: Sequence[str] = LAYER_ORDER, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, step, title, place, id): the stops of :func:`tour` in long form, of a graph of any size."""
    first = paths.filter("rank = 1").select(*keys, F.posexplode("nodes").alias("place", "id"))
    led = first.select(*keys).distinct().withColumn("led", F.lit(1))
    places = layer_counts(nodes, layer_order, keys).join(led, list(keys), "left").select(*keys, "layer", (F.col("place") + F.coalesce("led", F.lit(0))).alias("step"))
    rest = layer_members(nodes, keys).join(places.filter(F.col("step") <= most), [*keys, "layer"])
    return first.select(*keys, F.lit(1).alias("step"), F.lit("Main path").alias("title"), (F.col("place") + 1).cast("bigint").alias("place"), "id").unionByName(
        rest.select(*keys, "step", F.col("layer").alias("title"), "place", "id")
    )


# ---- Cap and layout ----


def truncate_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 300, keys: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, pruned): graphs cut to ``max_nodes``. Tables and both ends of references come first, then what a breadth-first walk
    from units with usages meets (from the first node if there is none), then the rest in order. pruned: (keys, n) of graphs that were cut."""
    keys = list(keys)
    sizes = nodes.groupBy(*keys).agg(F.count("*").alias("size"), F.min("ord").alias("first"))
    big = nodes.join(sizes.filter(F.col("size") > max_nodes), keys).checkpoint()
    refs = edges.filter("kind = 'references'").select(*keys, F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("ref", F.lit(True))
    used = (F.col("kind") == "unit") & (F.size("usages") > 0)
    any_used = big.filter(used).select(*keys).distinct().withColumn("has_used", F.lit(True))
    seeds = big.join(any_used, keys, "left").filter(used | (F.col("has_used").isNull() & (F.col("ord") == F.col("first"))))
    steps = edges.select(*keys, F.col("src").alias("id"), F.col("dst").alias("next"), F.col("ord").alias("step")).join(big.select(*keys, F.col("id").alias("next")), [*keys, "next"], "left_semi")
    by = Window.partitionBy(*keys)
    # a level is written once, and what was walked is the levels: about max_nodes of each graph and its last level
    levels = [_placed(seeds.select(*keys, "id", F.struct(F.lit(0).cast("bigint").alias("place"), F.col("ord").cast("bigint").alias("step")).alias("b")), keys, 0)]
    while not levels[-1].isEmpty():
        walked = union_all(levels).select(*keys, "id")
        # enough was met once the walk alone fills every graph
        full = walked.groupBy(*keys).agg(F.count("*").alias("met")).filter(F.col("met") >= max_nodes)
        found = levels[-1].join(full, keys, "left_anti").join(steps, [*keys, "id"])
        found = found.groupBy(*keys, F.col("next").alias("id")).agg(F.min(F.struct("place", F.col("step").cast("bigint").alias("step"))).alias("b"))
        levels.append(_placed(found.join(walked, [*keys, "id"], "left_anti"), keys, len(levels)))
    walked = union_all(levels)
    ranked = big.join(refs, [*keys, "id"], "left").join(walked, [*keys, "id"], "left")
    tier = F.when((F.col("kind") == "table") | F.col("ref"), 0).when(F.col("level").isNotNull(), 1).otherwise(2)
    order = by.orderBy(tier, F.when(tier == 1, F.col("level")), F.when(tier == 1, F.col("place")), "ord")
    kept = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_nodes).select(*nodes.columns)
    small = nodes.join(sizes.filter(F.col("size") <= max_nodes), keys, "left_semi").select(*nodes.columns)
    out = small.unionByName(kept)
    ids = out.select(*keys, "id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi").select(*edges.columns)
    return out, inside, sizes.filter(F.col("size") > max_nodes).select(*keys, (F.col("size") - max_nodes).alias("n"))


def _placed(fresh: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
    """A level of a walk (keys, id, level, place): places grow in the order in which the level before met it, over ranges of any number."""
    spread = fresh.repartitionByRange(*keys, "b", "id").sortWithinPartitions(*keys, "b", "id")
    return spread.select(*keys, "id", F.lit(level).alias("level"), F.monotonically_increasing_id().alias("place")).checkpoint()


def class_of_node(nodes: DataFrame) -> Column:
    """The class or table under which a node is shown."""
    before = lambda c: F.regexp_extract(c, r"(?s)^(.*)\.", 1)
    label = F.coalesce("label", "id", F.lit(""))
    return (
        F.when(F.col("kind") == "table", F.coalesce(_or_null(nodes, "table"), F.col("label"), F.col("id")))
        .when(label.contains("."), before(label))
        .when(F.col("id").startswith("table:"), F.substr("id", F.lit(7)))
        .when(F.col("id").contains("."), before(F.col("id")))
        .otherwise(F.when(label != "", label).otherwise("unknown"))
    )


def grid_order(nodes: DataFrame, layer_order: Sequence[str] = LAYER_ORDER, keys: Sequence[str] = KEY) -> DataFrame:
    """``nodes`` with col (place of the layer, unknown ones with Other), group (class) and row; two rows stay free between classes."""
    other = next((layer_order.index(x) for x in ("Other", "Unknown") if x in layer_order), 0)
    col = F.coalesce(*[F.when(F.col("layer") == name, i) for i, name in enumerate(layer_order)], F.lit(other))
    df = nodes.withColumn("col", col).withColumn("group", class_of_node(nodes))
    # windows hold the classes of a layer, and the nodes of a class
    by = Window.partitionBy(*keys, "col").orderBy("group")
    before = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") + 2 * (F.row_number().over(by) - 1)
    groups = df.groupBy(*keys, "col", "group").agg(F.count("*").alias("n")).select(*keys, "col", "group", before.alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys, "col", "group").orderBy(F.coalesce("label", "id"), "ord"))
    placed = df.join(groups, [*keys, "col", "group"]).withColumn("row", (F.col("before") + place - 1).cast("int"))
    return placed.select(*df.columns, "row")


def class_groups(placed: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, col, group, layer, row_start, row_end) of nodes placed by :func:`grid_order`."""
    return placed.groupBy(*keys, "col", "group").agg(F.max_by(F.coalesce("layer", F.lit("Other")), "row").alias("layer"), F.min("row").alias("row_start"), F.max("row").alias("row_end"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
