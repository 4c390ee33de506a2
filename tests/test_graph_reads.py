"""PageRank reads what its links come from once."""

from faultline.operators import graph


def test_links_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def noted(row):
        read.add(1)
        return row

    links = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "d", 2.0), ("a", "b", 1.0)]  # d calls nobody
    edges = spark.createDataFrame(spark.sparkContext.parallelize(links, 2).map(noted), "src STRING, dst STRING, weight DOUBLE")
    got = {r.service: r["rank"] for r in graph.pagerank(edges, iterations=12, cut_every=5).collect()}
    assert read.value == len(links)
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(12):
        into = dict.fromkeys("abcd", 0.0)
        for src, dst, weight in links:
            into[dst] += rank[src] * weight / sum(w for s, _, w in links if s == src)
        rank = {v: 0.85 * (into[v] + rank["d"] / 4) + 0.15 / 4 for v in "abcd"}
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in "abcd") and len(got) == 4
