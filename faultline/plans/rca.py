"""Feature rows to ranked root causes, for all runs and incidents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from faultline.functions.scalars import tfidf_columns
from faultline.operators import alerts as al
from faultline.operators import clustering, graph, intervals
from faultline.operators.intervals import MINUTE
from faultline.session import cut_lineage


@dataclass(frozen=True)
class RcaSettings:
    rules: al.AlertRules = al.AlertRules()
    eps: float = 0.8
    min_samples: int = 3
    time_weight: float = 0.05
    weight_after_scale: bool = False
    tolerance_us: int = MINUTE
    window_us: int = 2 * MINUTE
    exclude_noise: bool = False
    top_k: int = 3
    iterations: int | None = None


def incidents_of(features: DataFrame, s: RcaSettings = RcaSettings()) -> DataFrame:
    """Alerts with the text weights nearest to them, grouped into incidents."""
    raised = al.build_alerts(features, s.rules, ordered=False)
    text = tfidf_columns(features)
    if text:
        raised = intervals.attach_embeddings(raised, features, text, s.tolerance_us)
    return clustering.group_alerts(raised, text, s.eps, s.min_samples, s.time_weight, s.weight_after_scale)


def root_causes(features: DataFrame, s: RcaSettings = RcaSettings()) -> dict[str, DataFrame]:
    incidents = cut_lineage(incidents_of(cut_lineage(features), s))
    edges = cut_lineage(graph.cooccurrence_edges(incidents, s.window_us, s.exclude_noise))
    scores = graph.centrality(edges, iterations=s.iterations)
    return {"incidents": incidents, "edges": edges, "ranked": graph.rank_causes(incidents, scores, s.top_k),
            "summary": graph.incident_summary(incidents)}
