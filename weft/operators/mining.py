"""Miners of a concept graph: brokers, bridges, latent links, dissonance, long and short paths between modules, recombinations.

Inputs are ``simple`` (src, dst, relation, iter), ``member`` (id, module), ``cents``
(id, degree, pagerank, betweenness), ``names`` (id, label) and ``vectors`` (id, v,
of unit length; nodes may lack one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import labels
from weft.operators.components import connected_components
from weft.operators.embedding import pairs_above
from weft.operators.graph import both, constraint, hubs, links
from weft.operators.iterative import bfs, pair_distances, shortest_paths
from weft.shared import written

#: Fixed value: neighbours of a node that meet the others in one place.
MEET = 200


def dot(a: str, b: str) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_cosine(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``cosine``, null where an end has no vector."""
    one, two = (vectors.select(F.col("id").alias(c), F.col("v").alias(n)) for c, n in ((a, "__v1"), (b, "__v2")))
    return pairs.join(one, a, "left").join(two, b, "left").withColumn("cosine", dot("__v1", "__v2")).drop("__v1", "__v2")


def other_modules(simple: DataFrame, member: DataFrame) -> DataFrame:
    """(id, external): number of distinct modules next to a node other than its own; 0 rows left out."""
    m1, m2 = member.select(F.col("id").alias("a"), F.col("module").alias("m1")), member.select(F.col("id").alias("b"), F.col("module").alias("m2"))
    n = both(links(simple)).join(m1, "a", "left").join(m2, "b").where("m1 IS NULL OR m1 <> m2")
    return n.groupBy(F.col("a").alias("id")).agg(F.count_distinct("m2").alias("external"))


def relation_kinds(simple: DataFrame) -> DataFrame:
    """(id, kinds): distinct relations of a node's edges."""
    ends = simple.select(F.col("src").alias("id"), "relation").union(simple.select("dst", "relation"))
    return ends.groupBy("id").agg(F.count_distinct("relation").alias("kinds"))


def brokers(simple: DataFrame, member: DataFrame, cents: DataFrame, names: DataFrame) -> DataFrame:
    """(id, external, kinds, score): clean nodes next to other modules that are no hubs."""
    hub = hubs(cents.select("id", "degree")).select("id")
    own = cents.join(F.broadcast(hub), "id", "left_anti").join(names.where(labels.minable(F.col("label"))).select("id"), "id")
    n = own.join(other_modules(simple, member), "id").join(relation_kinds(simple), "id")
    score = 1.2 * F.col("external") + 0.25 * F.col("kinds") + 25.0 * F.col("betweenness") + 1200.0 * F.col("pagerank") + F.log1p("degree")
    return n.select("id", "external", "kinds", score.alias("score"))


def bridge_scores(simple: DataFrame, member: DataFrame, cents: DataFrame) -> DataFrame:
    """(id, span, score): 0.42 betweenness, 0.22 PageRank, 0.18 degree, each over its maximum, and the modules next to the node."""
    top = cents.agg(*[F.max(F.abs(c)).alias(f"top_{c}") for c in ("betweenness", "pagerank", "degree")])
    part = lambda c: F.when(F.col(f"top_{c}") > 0, F.col(c) / F.col(f"top_{c}")).otherwise(0.0)
    n = cents.join(other_modules(simple, member), "id", "left").withColumn("external", F.coalesce("external", F.lit(0))).where("external > 0 OR betweenness > 0")
    score = 0.42 * part("betweenness") + 0.22 * part("pagerank") + 0.18 * part("degree") + 0.12 * F.least(F.lit(1.0), F.col("external") / 4) + 0.06 * F.least(F.lit(1.0), (F.col("external") + 1) / 5)
    return n.crossJoin(F.broadcast(top)).select("id", (F.col("external") + 1).alias("span"), score.alias("score"))


def broker_ideas(simple: DataFrame, member: DataFrame, cents: DataFrame) -> DataFrame:
    """(id, communities, score): betweenness times one more than the communities next to a node, and 0.2 of what its constraint leaves."""
    u = links(simple)
    near = both(u).join(member.select(F.col("id").alias("b"), "module"), "b", "left").groupBy(F.col("a").alias("id")).agg(F.count_distinct(F.coalesce("module", F.lit(-1))).alias("communities"))
    n = cents.join(near, "id").join(constraint(u), "id", "left").where("communities >= 2 OR betweenness > 0")
    loose = F.when(F.col("constraint").isNotNull(), 1 - F.least(F.col("constraint"), F.lit(1.0))).otherwise(0.0)
    return n.select("id", "communities", (F.col("betweenness") * (1 + F.col("communities")) + 0.2 * loose).alias("score"))


def opened(ends: DataFrame, one: list[Column], two: list[Column]) -> DataFrame:
    """Pairs of the ends of a mid: ``ends`` has mid and d, its ends, ``one`` and ``two`` are the columns of either side, each with id columns u and v, u < v.

    Ends of a mid are dealt to places of some ``MEET`` and all of them go to each place, so no task opens all pairs of a hub.
    """
    places = F.ceil(F.col("d") / MEET).cast("int")
    left = ends.withColumn("place", F.pmod(F.hash(F.col("end")), places)).select("mid", "place", *one)
    right = ends.withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).select("mid", "place", *two)
    return left.join(right, ["mid", "place"]).where("u < v")


def latent_links(undirected: DataFrame, vectors: DataFrame, alpha: float = 0.5, hub: int | None = None) -> DataFrame:
    """(u, v, common, structural, semantic, score): Adamic-Adar over its maximum blended with the cosine.

    All pairs behind a common neighbour; with ``hub``, those of at most so many neighbours a node, whose common
    neighbours are all counted.
    """
    near = both(undirected)
    weight = near.groupBy(F.col("a").alias("mid")).agg(F.count("*").alias("d")).where("d > 1").select("mid", "d", (1 / F.log("d")).alias("w"))
    first = near.select(F.col("a").alias("mid"), F.col("b").alias("end"))
    if hub is not None:
        first = first.withColumn("rn", F.row_number().over(Window.partitionBy("mid").orderBy("end"))).where(F.col("rn") <= hub).drop("rn")
    # pairs travel once: those behind a node within the limit bring what it counts for
    within = lambda x, other: x if hub is None else F.when(F.col("d") <= hub, x).otherwise(other)
    u, v = F.col("end").alias("u"), F.col("end").alias("v")
    pairs = opened(first.join(weight, "mid"), [u, within(F.col("w"), 0.0).alias("w"), within(F.lit(1), 0).alias("c")], [v])
    met = pairs.groupBy("u", "v").agg(F.sum("c").alias("common"), F.sum("w").alias("aa"))
    found = met.join(undirected, ["u", "v"], "left_anti")
    large = None if hub is None else written(weight.where(F.col("d") > hub), "hubs")
    if large is not None and large.limit(1).count():
        # common neighbours above the limit are looked up
        large = large.join(near.withColumnRenamed("a", "mid"), "mid")
        met = found.select("u", "v").join(large.select(F.col("b").alias("u"), "mid", "w"), "u").join(large.select(F.col("b").alias("v"), "mid"), ["v", "mid"]).select("u", "v", F.lit(1).cast("long").alias("common"), F.col("w").alias("aa"))
        found = found.unionByName(met).groupBy("u", "v").agg(F.sum("common").alias("common"), F.sum("aa").alias("aa"))
    top = found.agg(F.max("aa").alias("top"))
    scored = with_cosine(found.crossJoin(F.broadcast(top)), vectors, "u", "v")
    structural, semantic = F.col("aa") / F.col("top"), F.coalesce("cosine", F.lit(0.0))
    return scored.select("u", "v", "common", structural.alias("structural"), semantic.alias("semantic"), (alpha * structural + (1 - alpha) * F.greatest(F.lit(0.0), semantic)).alias("score"))


def dissonance(simple: DataFrame, vectors: DataFrame, least: float = 0.55, min_hops: int = 3, far: int = 8, beyond: bool = True) -> DataFrame:
    """(a, b, similarity, hops, score): similar concepts that are far apart in the graph, hops null where no path joins them.

    All pairs at or above ``least`` are probed.  Hops beyond ``far`` score as ``far`` and are given as such; without
    ``beyond`` they count as no path.
    """
    nodes = simple.select(F.col("src").alias("id")).union(simple.select("dst")).distinct()
    pairs = written(pairs_above(vectors.join(nodes, "id"), least), "similar")
    u = links(simple)
    found = pairs.join(pair_distances(written(both(u), "near"), pairs, far), ["a", "b"], "left").withColumnRenamed("dist", "hops")
    if beyond:
        parts = connected_components(u.select(F.col("u").alias("a"), F.col("v").alias("b")))
        for c in "ab":
            found = found.join(parts.select(F.col("node").alias(c), F.col("component").alias(f"__{c}")), c, "left")
        found = found.withColumn("hops", F.coalesce("hops", F.when(F.col("__a") == F.col("__b"), F.lit(far))))
    found = found.where(F.col("hops").isNull() | (F.col("hops") >= min_hops))
    factor = 1 + F.when(F.col("hops").isNull(), 0.5).otherwise(F.least(F.col("hops"), F.lit(far)) / far)
    return found.select("a", "b", "similarity", "hops", (F.col("similarity") * factor).alias("score"))


def candidates(cents: DataFrame, member: DataFrame, names: DataFrame, limit: int = 180, per_module: int = 5) -> DataFrame:
    """(id): the first ``limit`` clean nodes without hubs, by PageRank, then betweenness, then degree, then the best of every module."""
    hub = hubs(cents.select("id", "degree")).select("id")
    clean = cents.join(F.broadcast(hub), "id", "left_anti").join(names.where(labels.minable(F.col("label"))).select("id"), "id").select("id")
    ordered = None
    for place, (by, n) in enumerate((("pagerank", limit), ("betweenness", limit), ("degree", max(40, limit // 2)))):
        top = cents.orderBy(F.desc(by), "id").limit(n)  # the limit holds before hubs and noise go
        ranked = top.select("id", F.lit(place).alias("part"), F.row_number().over(Window.orderBy(F.desc(by), "id")).alias("rank"))
        ordered = ranked if ordered is None else ordered.union(ranked)
    ordered = ordered.join(clean, "id")
    order = [F.desc("pagerank"), F.desc("betweenness"), F.desc("degree"), "id"]
    best = clean.join(cents, "id").join(member, "id").withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(*order))).where(F.col("rank") <= per_module)
    rest = best.select("id", F.lit(3).alias("part"), (F.col("module") * per_module + F.col("rank")).alias("rank"))
    once = ordered.union(rest).groupBy("id").agg(F.min(F.struct("part", "rank")).alias("p"))
    return once.orderBy("p", "id").limit(limit).select("id")


def module_paths(simple: DataFrame, cents: DataFrame, member: DataFrame, names: DataFrame, vectors: DataFrame, min_hops: int, max_hops: int, limit: int) -> DataFrame:
    """Shortest paths between candidates of different modules: (source, target, hops, path, distance, modules, relations, inner_betweenness, inner_hubs, ends_rank)."""
    ends = written(candidates(cents, member, names, limit).join(member, "id").join(cents.select("id", "pagerank"), "id"), "ends")
    one, two = (ends.select(F.col("id").alias(c), F.col("module").alias(f"{c}_module"), F.col("pagerank").alias(f"{c}_rank")) for c in ("source", "target"))
    # at most ``limit`` ends, a parameter
    pairs = one.join(F.broadcast(two), F.col("source") < F.col("target")).where("source_module <> target_module")
    u = links(simple)
    found = shortest_paths(both(u), pairs.select("source", "target"), max_hops).where(F.col("dist").between(min_hops, max_hops))
    found = written(found.select("source", "target", F.col("dist").alias("hops"), "path"), "found")
    steps = found.select("source", "target", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "x"), "path").select("source", "target", "x", F.get("path", F.col("i") + 1).alias("y"))
    back = simple.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.col("relation").alias("r2"))
    kinds = steps.join(simple.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("relation").alias("r1")), ["x", "y"], "left").join(back, ["x", "y"], "left").groupBy("source", "target").agg(F.count_distinct(F.coalesce("r1", "r2")).alias("relations"))
    inside = found.select("source", "target", F.posexplode("path").alias("i", "id"), "hops").join(member, "id", "left").join(cents.select("id", "betweenness"), "id", "left").join(F.broadcast(hubs(cents.select("id", "degree")).select("id", F.lit(1).alias("hub"))), "id", "left")
    inner = (F.col("i") > 0) & (F.col("i") < F.col("hops"))
    through = inside.groupBy("source", "target").agg(F.count_distinct("module").alias("modules"), F.coalesce(F.sum(F.when(inner, F.col("betweenness"))), F.lit(0.0)).alias("inner_betweenness"), F.count_if(inner & F.col("hub").isNotNull()).alias("inner_hubs"))
    rank = pairs.select("source", "target", (F.col("source_rank") + F.col("target_rank")).alias("ends_rank"))
    out = with_cosine(found, vectors, "source", "target").join(kinds, ["source", "target"]).join(through, ["source", "target"]).join(rank, ["source", "target"])
    return out.withColumn("distance", 1 - F.coalesce("cosine", F.lit(0.0))).drop("cosine")


def long_range_paths(simple: DataFrame, cents: DataFrame, member: DataFrame, names: DataFrame, vectors: DataFrame, min_hops: int = 4, max_hops: int = 8, least_distance: float = 0.18) -> DataFrame:
    """Paths of 4 to 8 hops between modules with a score of seven terms."""
    p = module_paths(simple, cents, member, names, vectors, min_hops, max_hops, 180).where(F.col("distance") >= least_distance)
    score = 2.5 * F.col("distance") + 0.35 * F.col("hops") + 0.45 * F.col("modules") + 0.2 * F.col("relations") + 1500.0 * F.col("ends_rank") + 20.0 * F.col("inner_betweenness") - 0.55 * F.col("inner_hubs")
    return p.select("source", "target", "hops", "path", "modules", "relations", score.alias("score"))


def short_bridges(simple: DataFrame, cents: DataFrame, member: DataFrame, names: DataFrame, vectors: DataFrame, max_hops: int = 3) -> DataFrame:
    """Paths of 1 to 3 hops between modules, scored."""
    p = module_paths(simple, cents, member, names, vectors, 1, max_hops, 220)
    score = 2.0 * F.col("distance") + 0.8 * F.col("modules") + 0.25 * F.col("relations") + 20.0 * F.col("inner_betweenness") + 1200.0 * F.col("ends_rank") - 0.2 * F.col("hops") - 0.6 * F.col("inner_hubs")
    return p.select("source", "target", "hops", "path", "modules", "relations", score.alias("score"))


def pair_moments(vectors: DataFrame) -> DataFrame:
    """(mean, sd) of the dot products of all pairs, from sums: a row of the Gram matrix per pair of dimensions, no pair of vectors."""
    v = vectors.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    gram = v.select(F.posexplode("v").alias("i", "a"), "v").select("i", "a", F.posexplode("v").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).agg(F.sum(F.col("g") * F.col("g")).alias("gg"))
    first = v.select(F.posexplode("v").alias("i", "a")).groupBy("i").agg(F.sum("a").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    own = v.select(dot("v", "v").alias("q")).agg(F.sum("q").alias("q2"), F.sum(F.col("q") * F.col("q")).alias("q4"), F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    one = own.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(gram)).select(((F.col("ss") - F.col("q2")) / 2 / pairs).alias("mean"), ((F.col("gg") - F.col("q4")) / 2 / pairs).alias("square"))
    return one.select("mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"))


def recombinations(edges: DataFrame, born: DataFrame, vectors: DataFrame, below: float = -1.0) -> DataFrame:
    """(u, v, z, iter): unlinked pairs behind a common neighbour whose cosine is atypically low, with the round in which they first met.

    A meeting needs both concepts (``born``: id, iter) and both edges; of equal
    pairs the earliest counts.  ``edges`` has src, dst, iter; the first of parallel edges counts.
    """
    first = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("iter").alias("iter"))
    near = first.select(F.col("u").alias("mid"), F.col("v").alias("end"), "iter").union(first.select("v", "u", "iter"))
    # an end without a vector gives no cosine; an end's edge counts from the end's own birth on
    able = born.join(vectors.where("v IS NOT NULL").select("id"), "id").select(F.col("id").alias("end"), F.col("iter").alias("born"))
    near = near.join(able, "end").select("mid", "end", F.greatest("iter", "born").alias("iter"))
    near = near.join(near.groupBy("mid").agg(F.count("*").alias("d")).where("d > 1"), "mid")
    side = lambda c: [F.col("end").alias(c), F.col("iter").alias(f"{c}_iter")]
    met = opened(near, side("u"), side("v")).groupBy("u", "v").agg(F.min(F.greatest("u_iter", "v_iter")).alias("iter"))
    found = met.join(first.select("u", "v"), ["u", "v"], "left_anti")
    scored = with_cosine(found, vectors, "u", "v").where("cosine IS NOT NULL").crossJoin(F.broadcast(pair_moments(vectors)))
    return scored.where("sd > 0").withColumn("z", (F.col("cosine") - F.col("mean")) / F.col("sd")).where(F.col("z") < below).select("u", "v", "z", "iter")


def steps_of(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, x, y): the steps of ``path``, in order."""
    return paths.select(*keys, "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "x")).select(*keys, "i", "x", F.get("path", F.col("i") + 1).alias("y"))


def with_relation(steps: DataFrame, simple: DataFrame) -> DataFrame:
    """Steps with ``relation``: that of the edge x -> y, else of y -> x."""
    there = simple.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("relation").alias("__r1"))
    back = simple.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.col("relation").alias("__r2"))
    return steps.join(there, ["x", "y"], "left").join(back, ["x", "y"], "left").withColumn("relation", F.coalesce("__r1", "__r2")).drop("__r1", "__r2")


def graph_leads(simple: DataFrame, names: DataFrame, vectors: DataFrame, query: list[float], defaults: DataFrame | None = None, seeds: int = 3, hops: int = 2, limit: int = 20) -> DataFrame:
    """(id, seed, hop, path, similarity, ood, relation_quality, score): concepts near the best matches of a query, best first.

    ``defaults`` (id, v) are vectors of answers given without the graph: ``ood`` is
    one less the highest cosine to them, or to the query where there are none.
    Each normalised label counts once; labels without content are left out.
    """
    from weft.operators.embedding import best_matches

    score = F.aggregate(F.zip_with("v", F.array(*map(F.lit, query)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    near = both(links(simple))
    degree = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    own = written(vectors.select("id", "v", score.alias("similarity")).join(names, "id").where(~labels.bad_graph_label(F.col("label"))).join(degree, "id"), "own")
    start = written(own.orderBy(F.desc("similarity"), "id").limit(seeds).select("id", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")).alias("rank")), "seeds")
    reached = bfs(near, start.select("id"), hops).where("dist > 0").join(F.broadcast(start.withColumnRenamed("id", "source")), "source").join(F.broadcast(start.select("id")), "id", "left_anti")
    best = reached.groupBy(F.col("id").alias("target")).agg(F.min(F.struct("dist", "rank", "source")).alias("b")).select("target", "b.source")
    paths = written(shortest_paths(near, best.join(own.select(F.col("id").alias("target")), "target"), hops), "paths")
    quality = with_relation(steps_of(paths, ["source", "target"]), simple).groupBy("target").agg(F.avg(labels.lead_relation_quality(F.col("relation"))).alias("relation_quality"))
    found = paths.withColumnRenamed("target", "id").join(quality.withColumnRenamed("target", "id"), "id").join(own, "id")
    if defaults is None:
        found = found.withColumn("ood", 1 - F.col("similarity"))
    else:
        given = defaults.select((-F.col("id") - 1).alias("id"), F.lit(0.0).alias("ord"), "v")
        nearest = best_matches(own.select("id", F.lit(0.0).alias("ord"), "v"), given, lambda a, b: (a == a) & (b == b))
        found = found.join(nearest.select("id", (1 - F.col("similarity")).alias("ood")), "id")
    top = degree.agg(F.max("degree").alias("top"))
    from weft.operators.retrieval import lead_score

    scored = found.crossJoin(F.broadcast(top)).withColumn("score", lead_score(F.col("similarity"), F.col("ood"), F.col("relation_quality"), F.col("dist"), F.col("degree"), F.col("top")))
    once = scored.withColumn("rn", F.row_number().over(Window.partitionBy(labels.normal(F.col("label"))).orderBy(F.desc("score"), "id"))).where("rn = 1")
    return once.orderBy(F.desc("score"), "id").limit(limit).select("id", F.col("source").alias("seed"), F.col("dist").alias("hop"), "path", "similarity", "ood", "relation_quality", "score")


def path_pairs(simple: DataFrame, names: DataFrame, topic: str, pool: int = 60, min_hops: int = 2, max_hops: int = 6, least_anchors: int = 0, bridge_anchors: int = 1, generic_bridges: int = 0) -> DataFrame:
    """(source, target, hops, path, label_pair, score): shortest paths between specific concepts that no rule rejects, with a composite score.

    Ends are the first ``pool`` concepts by anchors, specificity and low degree.
    """
    u = links(simple)
    near = both(u)
    degree = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    label = F.col("label")
    facts = written(names.join(degree, "id").select("id", "label", "degree", labels.key(label).alias("key"), labels.specificity(label).alias("spec"), labels.anchors(label).alias("anchors")), "facts")
    local = F.col("key").isin(*labels.GENERIC_KEYS, *labels.LOCAL_KEYS)
    fine = (F.col("spec") >= labels.SPECIFIC_LEAST) & ~local & labels.label_rejection(label, F.lit(topic), True, least_anchors).isNull()
    ends = written(facts.where(fine).orderBy(F.desc("anchors"), F.desc("spec"), "degree", "id").limit(pool), "ends")
    one, two = ends.select(F.col("id").alias("source")), ends.select(F.col("id").alias("target"))
    pairs = one.join(F.broadcast(two), F.col("source") < F.col("target"))  # ``pool`` ends, a parameter
    found = written(shortest_paths(near, pairs, max_hops).where(F.col("dist").between(min_hops, max_hops)), "found")
    keys = ["source", "target"]
    placed = found.select(*keys, (F.size("path") - 1).alias("last"), F.posexplode("path").alias("i", "id")).join(facts.withColumn("local", local), "id")
    inner = (F.col("i") > 0) & (F.col("i") < F.col("last"))
    by_place = F.array_sort(F.collect_list(F.struct("i", "label")))
    sums = placed.groupBy(*keys).agg(
        F.transform(by_place, lambda x: x["label"]).alias("labels"),
        F.sum("anchors").alias("domain"),
        F.coalesce(F.sum(F.when(inner, F.col("anchors"))), F.lit(0)).alias("inner_domain"),
        F.count_if(inner & F.col("local")).alias("inner_generic"),
        F.coalesce(F.sum(F.when(inner, F.log1p("degree"))), F.lit(0.0)).alias("inner_degree"),
        F.sum(F.when(~inner, F.col("spec"))).alias("ends_spec"),
    )
    quality = with_relation(steps_of(found, keys), simple).groupBy(*keys).agg(F.avg(labels.insight_relation_quality(F.col("relation"))).alias("quality"))
    a, b = labels.words(F.col("labels")[0]), labels.words(F.element_at("labels", -1))
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    apart = F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1 - shared / F.greatest(union, F.lit(1)))
    score = 1.2 * F.col("domain") + 0.8 * F.col("inner_domain") + 0.8 * F.col("quality") + 0.6 * apart + 0.2 * F.col("dist") + 0.25 * F.col("ends_spec") - 1.4 * F.col("inner_generic") - 0.15 * F.col("inner_degree") / F.greatest(F.col("dist") - 1, F.lit(1))
    pair = F.array_join(F.array_sort(F.array(labels.key(F.col("labels")[0]), labels.key(F.element_at("labels", -1)))), " | ")
    kept = found.join(sums, keys).join(quality, keys).where(labels.path_rejection(F.col("labels"), F.lit(topic), True, least_anchors, bridge_anchors, generic_bridges).isNull())
    return kept.select(*keys, F.col("dist").alias("hops"), "path", pair.alias("label_pair"), score.alias("score"))
