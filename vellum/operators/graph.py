"""Citation graphs: breadth-first reach with depth, focus networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vellum.session import cut


def _once(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends, cut, so that no level makes them anew."""
    return cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, limit: int = 10_000) -> DataFrame:
    """(node, depth): least number of steps from any seed along src -> dst; cycles are fine, seeds have depth 0.

    Every level joins the frontier with the edges, which are read and made distinct once, and leaves out what was visited; each is cut by a checkpoint. Without
    max_depth the search goes on until nothing new is found, and a graph deeper than limit is an error, not a part of it.
    """
    edges = _once(edges)
    visited = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, (max_depth or limit) + 1):
        ahead = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        frontier = cut(ahead.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return visited
        visited = cut(visited.unionByName(frontier)) if depth % 10 == 0 else visited.unionByName(frontier)
    if max_depth is None:
        raise RuntimeError(f"the graph goes on beyond {limit} steps")
    return visited


def harvest(edges: DataFrame, seeds: DataFrame, max_nodes: int | None = None, limit: int = 10_000) -> DataFrame:
    """(node, depth, parent): a breadth-first network; a node found twice keeps its least depth, then its least parent.

    With max_nodes, levels are taken whole while they fit into it; of the level that does not, the least nodes fill what is left and the
    search ends. Without, all that can be reached is. Seeds have depth 0 and no parent. Dangling and null ends are no nodes.
    """
    edges = _once(edges)
    visited = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    frontier, held = visited, visited.count()
    for depth in range(1, limit + 1):
        ahead = frontier.join(edges, F.col("node") == F.col("src")).where("dst IS NOT NULL").groupBy("dst").agg(F.min("src").alias("parent"))
        new = ahead.join(visited.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "parent")
        frontier = cut(new if max_nodes is None else new.orderBy("node").limit(max(0, max_nodes - held)))
        if not (found := frontier.count()):
            return visited
        held, visited = held + found, visited.unionByName(frontier)
    raise RuntimeError(f"the graph goes on beyond {limit} steps")


def inherited_modes(edges: DataFrame, roots: DataFrame, limit: int = 10_000) -> DataFrame:
    """(node, mode): descendants of the roots along src -> dst, full or metadata_only.

    edges has mode too: a child is metadata_only if its parent or the edge is. A node reached both ways is full. A root's mode
    is given; cycles end where no mode changes.
    """
    best = cut(roots.select("node", (F.col("mode") == "full").alias("full")))
    frontier = best
    for _ in range(limit):
        ahead = frontier.join(edges, F.col("node") == F.col("src")).where("dst IS NOT NULL").groupBy("dst").agg(F.bool_or(F.col("full") & (F.col("mode") == "full")).alias("full"))
        seen = best.select(F.col("node").alias("dst"), F.col("full").alias("was"))
        frontier = cut(ahead.join(seen, "dst", "left").where("was IS NULL OR (full AND NOT was)").select(F.col("dst").alias("node"), "full"))
        if frontier.isEmpty():
            return best.select("node", F.when(F.col("full"), "full").otherwise("metadata_only").alias("mode"))
        best = cut(best.unionByName(frontier).groupBy("node").agg(F.bool_or("full").alias("full")))
    raise RuntimeError(f"the graph goes on beyond {limit} steps")


def focus_network(edges: DataFrame, seed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges among the nodes reached from the seed or one step from it, in either direction."""
    near = reach(edges, seed, max_depth).select("node")
    touching = edges.join(seed, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).union(edges.join(seed, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")))
    inside = cut(near.union(touching).distinct())
    a, b = inside.withColumnRenamed("node", "src"), inside.withColumnRenamed("node", "dst")
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


#: The widths of a layout, how high a degree lifts a node, how far an undated node strays from its neighbours, and the steps of a year axis.
X_SPAN, Y_GAIN, Z_SPAN, STRAY, STEPS = 160.0, 16.0, 90.0, 4.0, (1, 2, 5, 10)


def layers(bibliography: DataFrame, footnotes: DataFrame, hypercites: DataFrame, library: DataFrame) -> DataFrame:
    """(source, target, kind): the edges of three layers between works, each once, without loops.

    library (book, canonical_id): a book stands for its work, or for itself without one; books it lacks are no nodes. bibliography (book, canonical_id,
    foundation, verified) gives citation_verified or citation_auto to its work, else to that of its foundation; footnotes (book, is_citation, foundation)
    that are citations give citation_auto; hypercites (book, cited_in: array of addresses such as /book_1/2#id) give hypercite to the books of
    their addresses. Sub-books, whose names go on after a slash, stand for the book they are of.
    """
    nodes = library.select("book", F.coalesce(F.nullif("canonical_id", F.lit("")), F.col("book")).alias("node"))
    root = lambda c: F.split_part(c, F.lit("/"), F.lit(1))

    canonical = F.nullif("canonical_id", F.lit(""))
    listed = bibliography.select(root(F.col("book")).alias("_root"), canonical.alias("target"), F.when(canonical.isNull(), F.col("foundation")).alias("_to"), F.when(F.coalesce("verified", F.lit(False)), "citation_verified").otherwise("citation_auto").alias("kind"))
    noted = footnotes.where("is_citation").select(root(F.col("book")).alias("_root"), F.col("foundation").alias("_to"), F.lit("citation_auto").alias("kind"))
    path = F.regexp_replace(F.regexp_replace("_url", r"[?#].*$", ""), r"^(?:[a-z]+://[^/]*)?/*", "")
    linked = hypercites.select(root(F.col("book")).alias("_root"), F.explode("cited_in").alias("_url")).select("_root", root(path).alias("_to"), F.lit("hypercite").alias("kind"))
    # Only what names a book has its work looked up; what names none is no edge and goes before anything is shuffled.
    named = reduce(DataFrame.unionByName, [rows.where("_root IS NOT NULL AND _to IS NOT NULL") for rows in (listed.drop("target"), noted, linked)])
    met = named.join(nodes.select(F.col("book").alias("_to"), F.col("node").alias("target")), "_to").select("_root", "target", "kind")
    known = met.unionByName(listed.where("_root IS NOT NULL AND target IS NOT NULL").select("_root", "target", "kind"))
    edges = known.join(nodes.select(F.col("book").alias("_root"), F.col("node").alias("source")), "_root").select("source", "target", "kind")
    return edges.where("source <> target").distinct()


def id_hash(name: Column) -> Column:
    """A name as a number of -1 to 1: 31 times the number so far and each character's code, as 32 bits with a sign, by its last three digits."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.shiftright(F.shiftleft(h * 31 + c, 32), 32))
    return (folded % 1000) / 1000.0


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, x, y, z): nodes (node: string, year) of a graph (source, target) in space, the same each time.

    x goes by year over the span of years; a node without one has the mean of its dated neighbours, an edge a count, a little off, or by its name alone; y by the
    logarithm of its edges; z by its name. A self-loop counts twice, edges of unknown nodes count for those that are known.
    """
    span = nodes.agg(F.min("year").alias("_low"), F.max("year").alias("_high"))
    dated = nodes.where("year IS NOT NULL").join(F.broadcast(span)).select("node", F.when(F.col("_high") == F.col("_low"), 0.0).otherwise((F.col("year") - F.col("_low")) / (F.col("_high") - F.col("_low")) * X_SPAN - X_SPAN / 2).alias("_x"))
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("_other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("_other")))
    around = ends.join(dated.select(F.col("node").alias("_other"), F.col("_x").alias("_ox")), "_other", "left").groupBy("node").agg(F.count("*").alias("_degree"), F.avg("_ox").alias("_mean"))
    both = nodes.select("node").join(dated, "node", "left").join(around, "node", "left")
    name = id_hash(F.col("node"))
    x = F.coalesce(F.col("_x"), F.col("_mean") + name * STRAY, name * (X_SPAN / 4))
    return both.select("node", x.alias("x"), (F.log2(1 + F.coalesce("_degree", F.lit(0))) * Y_GAIN).alias("y"), (name * (Z_SPAN / 2)).alias("z"))


def year_axis(nodes: DataFrame, target: int = 8) -> DataFrame:
    """(year, x): about target ticks at multiples of 1, 2, 5 or 10 times a power of ten; none for fewer than two different years."""
    span = nodes.agg(F.min("year").alias("low"), F.max("year").alias("high")).where("high > low").withColumn("span", F.col("high") - F.col("low"))
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.col("span") / target)))
    step = F.coalesce(*[F.when(F.col("span") / (power * m) <= target, power * m) for m in STEPS], power * 10)
    ticks = span.withColumn("step", step).withColumn("first", F.ceil(F.col("low") / F.col("step")) * F.col("step"))
    count = F.floor((F.col("high") - F.col("first")) / F.col("step"))
    each = ticks.where("first <= high").select("low", "span", "first", "step", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("k"))
    year = F.col("first") + F.col("k") * F.col("step")
    return each.select(year.alias("year"), ((year - F.col("low")) / F.col("span") * X_SPAN - X_SPAN / 2).alias("x"))
