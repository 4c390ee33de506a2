"""Graphs in several documents and labels in numbered batches."""

import shutil

import pytest

from faultline.operators import graph
from faultline.sources import readers, sinks

EDGES = "src STRING, dst STRING, weight DOUBLE"


def test_graph_of_many_documents(spark, tmp_path):
    edges = [(f"s{i % 90}", f"t{i}", None if i % 5 == 0 else i / 4) for i in range(700)] + [("s1", "t1", 2.0)]
    df = spark.createDataFrame(edges, EDGES).repartition(3)
    path = sinks.write_graph_json(df, 120, str(tmp_path), "multi", edges_per_document=40)
    lines = [line for f in (tmp_path / "service_graph_multi.json").glob("part-*") for line in f.read_text().splitlines()]
    assert len(lines) >= 18
    key = lambda d: sorted(map(tuple, d.select("src", "dst", "weight").collect()))
    assert key(readers.read_graph_json(spark, path)) == key(graph.merge_edges(df))
    docs = spark.read.json(path)
    assert docs.select("type", "window_seconds").distinct().collect() == [("cooccurrence_baseline", 120)]
    spans = sorted((min((e.src, e.dst) for e in r.edges), max((e.src, e.dst) for e in r.edges)) for r in docs.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_incomplete_graph_is_refused_and_empty_one_read(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", "t", 1.0) for i in range(50)], EDGES)
    path = sinks.write_graph_json(df, 120, str(tmp_path), "r", edges_per_document=10)
    part = sorted((tmp_path / "service_graph_r.json").glob("part-*.json"), key=lambda f: f.stat().st_size)[-1]
    part.write_text("")
    with pytest.raises(ValueError, match="were written"):
        readers.read_graph_json(spark, path)
    empty = sinks.write_graph_json(df.limit(0), 120, str(tmp_path), "none")
    assert readers.read_graph_json(spark, empty).count() == 0


def test_label_batches_keep_their_order_in_a_copy(spark, tmp_path, at):
    kinds = ["errors", "cpu", "memory", "latency"] * 3
    for i, k in enumerate(kinds):
        one = spark.createDataFrame([("r", "s", k, at(i), at(i + 1))], "run_id STRING, service STRING, fault_type STRING, start_ts TIMESTAMP, end_ts TIMESTAMP")
        assert sinks.append_labels(one, f"{tmp_path}/labels") == i
    for name in sorted((tmp_path / "labels").iterdir(), reverse=True):  # copied last to first: times say the opposite
        shutil.copytree(name, tmp_path / "copy" / name.name, copy_function=shutil.copyfile)
    (tmp_path / "copy" / "foreign.csv").write_text("run_id,service,fault_type,start_ts,end_ts\nr,s,other,2025-01-01T00:00:00+00:00,2025-01-01T00:01:00+00:00\n")
    got = readers.read_fault_labels(spark, f"{tmp_path}/copy").orderBy("label_seq")
    assert [r.fault_type for r in got.collect()] == ["other", *kinds]
