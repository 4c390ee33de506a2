"""What the plans must and must not contain."""

import re

import pytest

from faultline.catalog import load
from faultline.catalog.views import Tables
from faultline.operators import rolling
from faultline.session import checkpoint_root

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
FORESTS = {"fit_isolation_forest", "score_isolation_forest", "persist_model"}  # trees are grown and walked in Arrow batches
STREAMS = {k for k in QUERIES if k.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(ORACLES) - STREAMS - FORESTS))
def test_no_python_no_global_window_no_pair_loops(spark, key):
    text = plan(QUERIES[key](spark, FOLDER))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert not spec.lstrip().split(" ")[1:2] in (["ASC"], ["DESC"]), f"window without partition: {spec}"


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["time_range_filter"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>", text)
    text = plan(QUERIES["label_match"](spark, FOLDER))
    assert "EqualTo(event_type,click)" in text and "props" not in text.split("ReadSchema")[1]


def test_one_sort_serves_all_rolling_windows(spark):
    t = Tables(spark, FOLDER)
    text = plan(rolling.rolling_stats(rolling.pivot_metrics(t.metrics)))
    assert text.count("Exchange hashpartitioning") <= 3


def test_checkpoint_folder_comes_from_the_session(spark):
    class Named:
        """A session whose cluster names the shared folder, with none set in the context yet."""
        master, asked = "spark://cluster:7077", None
        conf = {"spark.checkpoint.dir": "hdfs://shared/checkpoints"}
        sparkContext = property(lambda self: self)
        getCheckpointDir = lambda self: self.asked

        def setCheckpointDir(self, path):
            self.asked = path

    named = Named()
    assert checkpoint_root(named) == named.asked == "hdfs://shared/checkpoints"
    named.conf, named.asked = {}, None
    with pytest.raises(RuntimeError):
        checkpoint_root(named)
    assert checkpoint_root(spark)
