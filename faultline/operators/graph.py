"""Service graphs: co-occurrence, span dependencies, degrees, PageRank, root-cause ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scalars import bin_of, micros
from faultline.session import cut_lineage, sized_side


def cooccurrence_edges(incidents: DataFrame, window_us: int = 120_000_000, exclude_noise: bool = False) -> DataFrame:
    """Edge weights: pairs of alerts of two services in one incident at most `window_us` apart.

    Pairs are counted, never listed. For services a < b every alert of a opens a
    span of +-window and a running total over the opening and closing events
    tells each alert of b how many alerts of a can see it. A block of time is
    replicated once per partner service present in it, so the work is alerts x
    services, not alerts squared.
    """
    rows = incidents
    if exclude_noise:
        rows = rows.filter(~F.col("incident_id").endswith("_inc_outlier"))
    block_us = 4 * window_us
    group = ["run_id", "incident_id"]
    points = rows.groupBy(*group, "service", micros("ts").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    seen = points.withColumn("_block", F.explode(F.sequence(
        bin_of(F.col("_t") - window_us, block_us), bin_of(F.col("_t") + window_us, block_us))))
    home = bin_of(F.col("_t"), block_us)
    partners = (points.select(*group, F.col("service").alias("b"), home.alias("_block")).distinct())
    spans = (seen.join(partners, [*group, "_block"]).filter(F.col("service") < F.col("b"))
             .select(*group, "_block", F.col("service").alias("a"), "b",
                     F.inline(F.array(
                         F.struct((F.col("_t") - window_us).alias("_t"), F.col("_n").alias("_d"), F.lit(0).cast("long").alias("_q")),
                         F.struct((F.col("_t") + window_us + 1).alias("_t"), (-F.col("_n")).alias("_d"), F.lit(0).cast("long").alias("_q"))))))
    sources = seen.select(*group, F.col("service").alias("a"), "_block").distinct()
    queries = (points.withColumn("_block", home).join(sources, [*group, "_block"])
               .filter(F.col("a") < F.col("service"))
               .select(*group, "_block", "a", F.col("service").alias("b"), "_t", F.lit(0).cast("long").alias("_d"),
                       F.col("_n").alias("_q")))
    running = (Window.partitionBy(*group, "_block", "a", "b").orderBy("_t")
               .rangeBetween(Window.unboundedPreceding, 0))
    counted = (spans.unionByName(queries).withColumn("_open", F.sum("_d").over(running))
               .filter("_q > 0").groupBy("a", "b").agg(F.sum(F.col("_open") * F.col("_q")).alias("weight"))
               .filter("weight > 0"))
    return counted.select(F.inline(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").cast("double").alias("weight")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("weight").cast("double").alias("weight")))))


def span_edges(spans: DataFrame) -> DataFrame:
    """Distinct (parent service, child service). Children shrink to one row per parent and service first."""
    children = spans.filter(F.col("parent").isNotNull()).select("parent", F.col("service").alias("dst")).distinct()
    parents = spans.select(F.col("span_id").alias("parent"), F.col("service").alias("src")).distinct()
    return children.join(parents, "parent").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """in_degree and out_degree of each node of a distinct edge list."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("service"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("service"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("service").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Weights of repeated edges add up; a missing weight is 1."""
    return edges.groupBy("src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))


SMALL_GRAPH = 200_000  # links; up to here (16 bytes a link and a name) one partition holds them, so steps need no exchange
MASS = "\0dangling"  # the row that carries the rank of nodes without outgoing links


def pagerank(edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100,
             iterations: int | None = None, cut_every: int = 5) -> DataFrame:
    """Weighted PageRank. `iterations` fixes the number of steps instead of testing for convergence every `cut_every`.

    Every node has a link of weight zero to itself, so one join and one sum give the next
    ranks of all nodes. The rank of nodes without outgoing links is shared by all. It is a
    row of its own, one step behind: with p the ranks less that share and m the mass of the
    step before, rank = p + alpha * m / n. What links pass on of that share, and what stays
    with the dangling nodes, are links from the mass row. So a step is the same join with
    or without dangling nodes, and `cut_every` steps go into one plan before it is written.
    The merged links are written once: what they come from is read one time only.
    """
    edges = cut_lineage(merge_edges(edges))
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    moves = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share"), F.lit(False).alias("own"))
    ends = moves.select(F.inline(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0.0).alias("share")),
                                         F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.col("share").alias("share")))))
    nodes = cut_lineage(ends.groupBy("v").agg((F.max("o") == 0).alias("dangling"), F.sum("share").alias("gets")))
    n, n_dangling = nodes.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    if not n:
        return nodes.select(F.col("v").alias("service"), F.lit(0.0).alias("rank"))
    own = nodes.select("v")
    if n_dangling:
        mass, part = F.lit(MASS), alpha / n
        moves = moves.unionByName(nodes.filter("dangling").select(F.col("v").alias("src"), mass.alias("dst"), F.lit(1.0).alias("share"), F.lit(False).alias("own")))
        moves = moves.unionByName(nodes.filter("gets > 0").select(mass.alias("src"), F.col("v").alias("dst"), (F.col("gets") * part).alias("share"), F.lit(False).alias("own")))
        moves = moves.unionByName(edges.sparkSession.createDataFrame([(MASS, MASS, n_dangling * part, False)], moves.schema))
        own = own.unionByName(edges.sparkSession.createDataFrame([(MASS,)], own.schema))
    links = cut_lineage(moves.unionByName(own.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))))
    small = links.count() <= SMALL_GRAPH
    links = links.coalesce(1) if small else links
    is_mass = F.col("service") == MASS
    ranks = links.filter("own").select(F.col("src").alias("service")).withColumns({"value": F.when(is_mass, 0.0).otherwise(1.0 / n), "before": F.lit(0.0)})
    limit, done = iterations if iterations is not None else max_iter, 0
    while done < limit:
        steps = min(cut_every, limit - done)
        for _ in range(steps):
            now = ranks.select(F.col("service").alias("src"), "value").hint("shuffle_hash")
            ranks = links.join(now, "src").groupBy(F.col("dst").alias("service")).agg(
                F.sum(F.col("value") * F.col("share")).alias("_in"), F.max(F.when(F.col("own"), F.col("value"))).alias("before"))
            ranks = ranks.select("service", F.when(is_mass, F.col("_in")).otherwise(alpha * F.col("_in") + (1 - alpha) / n).alias("value"), "before")
        ranks = cut_lineage(ranks)
        ranks = ranks.coalesce(1) if small else ranks
        done += steps
        if iterations is None and _change(ranks, alpha / n) < n * tol:
            break
    shared = ranks.filter(is_mass).agg(F.coalesce(F.sum("value"), F.lit(0.0))).scalar() if n_dangling else F.lit(0.0)
    return ranks.filter(~is_mass).select("service", (F.col("value") + shared * (alpha / n)).alias("rank"))


def _change(ranks: DataFrame, part: float) -> float:
    """Sum of the changes of all ranks in the last step."""
    mass = ranks.filter(F.col("service") == MASS).select("value", "before").first()
    shift = (mass["value"] - mass["before"]) * part if mass else 0.0
    return ranks.filter(F.col("service") != MASS).agg(F.sum(F.abs(F.col("value") - F.col("before") + shift))).first()[0]


def max_normalize(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """v / (max + 1e-12), the maximum taken per key or over the whole table."""
    if not keys:
        return df.withColumn(out, F.col(value) / (df.agg(F.max(value)).scalar() + 1e-12))
    top = sized_side(df.groupBy(*keys).agg(F.max(value).alias("_max")))
    return df.join(top, keys).withColumn(out, F.col(value) / (F.col("_max") + 1e-12)).drop("_max")


def centrality(edges: DataFrame, **options) -> DataFrame:
    return max_normalize(pagerank(edges, **options), "rank", "centrality").select("service", "centrality")


def incident_services(incidents: DataFrame) -> DataFrame:
    """Per incident and service: mean score, first time seen, seconds after the incident began, earliness.

    All alerts are reduced to one row per incident and service before anything
    is compared inside an incident.
    """
    base = (incidents.groupBy("incident_id", "service")
            .agg(F.avg("score").alias("magnitude"), F.min("ts").alias("first_seen"),
                 F.count(F.lit(1)).alias("n_alerts"), F.min("run_id").alias("run_id")))
    return with_earliness(base)


def with_earliness(services: DataFrame) -> DataFrame:
    """elapsed_seconds and earliness of one row per incident and service with its first time."""
    whole = Window.partitionBy("incident_id")
    lag = (micros("first_seen") - F.min(micros("first_seen")).over(whole)) / 1e6
    services = services.withColumn("elapsed_seconds", lag)
    raw = 1.0 / (1.0 + F.col("elapsed_seconds"))
    return services.withColumn("earliness", raw / (F.max(raw).over(whole) + 1e-12))


def score_causes(incidents: DataFrame, graph_scores: DataFrame, w_magnitude: float = 1.0,
                 w_centrality: float = 0.6, w_earliness: float = 0.4) -> DataFrame:
    """All services of every incident with their score; a service outside the graph has centrality 0."""
    return add_scores(incident_services(incidents), graph_scores, w_magnitude, w_centrality, w_earliness)


def score_services(services: DataFrame, graph_scores: DataFrame, w_magnitude: float = 1.0,
                   w_centrality: float = 0.6, w_earliness: float = 0.4) -> DataFrame:
    """score_causes for rows that are one per incident and service already (magnitude, first_seen)."""
    return add_scores(with_earliness(services), graph_scores, w_magnitude, w_centrality, w_earliness)


def add_scores(services: DataFrame, graph_scores: DataFrame, w_magnitude: float, w_centrality: float, w_earliness: float) -> DataFrame:
    return (services.join(graph_scores, "service", "left")
            .withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
            .withColumn("score", w_magnitude * F.col("magnitude") + w_centrality * F.col("centrality")
                        + w_earliness * F.col("earliness")))


def rank_causes(incidents: DataFrame, graph_scores: DataFrame, top_k: int = 3, w_magnitude: float = 1.0,
                w_centrality: float = 0.6, w_earliness: float = 0.4) -> DataFrame:
    """Top services of every incident."""
    scored = score_causes(incidents, graph_scores, w_magnitude, w_centrality, w_earliness)
    best = Window.partitionBy("incident_id").orderBy(F.desc("score"), "service")
    return (scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
            .select("incident_id", "run_id", "rank", "service", "score", "magnitude", "centrality", "earliness"))


def one_incident(incidents: DataFrame, incident_id: object) -> DataFrame:
    """The alerts of one incident; ids are compared as texts, and an unknown one is an error."""
    found = incidents.filter(F.col("incident_id").cast("string") == str(incident_id))
    if found.isEmpty():
        raise ValueError(f"no incident {incident_id}")
    return found


def incident_summary(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.min("run_id").alias("run_id"))


def recent_incidents(incidents: DataFrame, keep: int = 20) -> DataFrame:
    """The last `keep` incidents by first alert."""
    first = incidents.groupBy("incident_id").agg(F.min("ts").alias("first_seen"))
    return first.orderBy(F.desc("first_seen"), F.desc("incident_id")).limit(keep)
