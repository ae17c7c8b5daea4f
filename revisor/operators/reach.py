"""What can be reached over stored edges, to any depth, and the chains of evidence that must be whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisor.functions.identity import identity
from revisor.operators.lineage import CORE
from revisor.sources.files import small, written

#: From a request's decision to the figure that shows its metric, and from an observation to the decision on it (fixed values).
EVIDENCE = ("audit_decision_contributes_to_metric", "metric_published_in_table", "table_supplies_figure_input")
ENTERS = "observation_enters_decision"


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_id").alias("from_id"), "relationship", F.col("from_id").alias("to_id"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, hops, via: every node that a path of ``edges`` leads to from each start, the start itself at 0 hops.

    ``starts``: a column ``start``.  A frontier moves one hop a round and leaves out
    what its start has seen, so cycles end and each pair is made once; rounds are as
    many as the longest of the shortest paths.  ``via`` is the relationship of the last
    hop (the first by name if several lead there at once).  Each round's table is
    written, so a join on it may be split where a node has very many edges.
    """
    hop = written(edges.select(F.col("from_id").alias("node"), "relationship", "to_id").distinct(), "hop")
    frontier = written(starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")), "frontier")
    seen, hops = frontier, 0
    while True:
        hops += 1
        found = frontier.select("start", "node").join(hop, "node").groupBy("start", F.col("to_id").alias("node")).agg(F.min("relationship").alias("via"))
        new = found.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = written(new.select("start", "node", F.lit(hops).alias("hops"), "via"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def decision_of(strategy: str = "strategy", request: str = "request_id"):
    return identity(F.lit("decision"), strategy, request)


def evidence_edges(audit: DataFrame, metrics: DataFrame) -> DataFrame:
    """Edges of the evidence: observation → decision → metric → table → figure.

    ``audit``: strategy, request_id, observation_id, each request once.  ``metrics``:
    strategy, requests; their rows are one table, which one figure shows.
    """
    m = metrics.select("strategy", identity(F.lit("metric"), "strategy", "requests").alias("metric_id"))
    edge = lambda a, name, b: F.struct(a.alias("from_id"), F.lit(name).alias("relationship"), b.alias("to_id"))
    table, figure = identity(F.lit("table"), F.lit("recall_metrics")), identity(F.lit("figure"), F.lit("recall_metrics"))
    rows = audit.join(small(written(m, "metrics")), "strategy", "left")
    by_request = rows.select(F.explode(F.array(edge(F.col("observation_id"), ENTERS, decision_of()), edge(decision_of(), EVIDENCE[0], F.col("metric_id")))).alias("e"))
    by_metric = m.select(F.explode(F.array(edge(F.col("metric_id"), EVIDENCE[1], table), edge(table, EVIDENCE[2], figure))).alias("e"))
    return by_request.unionByName(by_metric.distinct()).select("e.*").where("to_id IS NOT NULL")


def _ends(edges: DataFrame, starts: DataFrame, names: dict[str, str]) -> DataFrame:
    """start and, for each relationship in ``names``, the node it was last to lead to; broadcast if the starts are few."""
    reached = reachable(edges, starts)
    at = (F.max(F.when(F.col("via") == via, F.col("node"))).alias(name) for name, via in names.items())
    return small(written(reached.groupBy("start").agg(*at), "ends"))


def evidence_closure(audit: DataFrame, edges: DataFrame) -> DataFrame:
    """For each audited request what its decision reaches over the stored edges: the figure on one side, the source's manifest on the other.

    ``complete`` if both ends are reached; a missing hop leaves what lies behind it null.
    What lies behind a metric, an artifact, a record or an observation is found once for
    it, not for each decision that leads there: a decision crosses once with all it reaches.
    """
    hop = lambda name, a, b: edges.where(F.col("relationship") == name).select(F.col("from_id").alias(a), F.col("to_id").alias(b))
    top = lambda *names: [F.max(n).alias(n) for n in names]
    measured = hop(EVIDENCE[0], "decision_id", "metric_id")
    shown = _ends(edges.where(F.col("relationship").isin(*EVIDENCE[1:])), measured.select(F.col("metric_id").alias("start")), {"table_id": EVIDENCE[1], "figure_id": EVIDENCE[2]})
    forward = measured.join(shown.withColumnRenamed("start", "metric_id"), "metric_id")
    contained = hop(CORE[1], "artifact_id", "record_id")
    declared = _ends(reversed_edges(edges.where(F.col("relationship") == CORE[0])), contained.select(F.col("artifact_id").alias("start")), {"manifest_id": CORE[0]})
    records = contained.join(declared.withColumnRenamed("start", "artifact_id"), "artifact_id").groupBy("record_id").agg(*top("artifact_id", "manifest_id"))
    sources = hop(CORE[2], "record_id", "observation_id").join(records, "record_id", "left").groupBy("observation_id").agg(*top("record_id", "artifact_id", "manifest_id"))
    back = hop(ENTERS, "observation_id", "decision_id").join(sources, "observation_id", "left")
    ends = ("metric_id", "table_id", "figure_id", "observation_id", "record_id", "artifact_id", "manifest_id")
    reached = forward.unionByName(back, allowMissingColumns=True).groupBy("decision_id").agg(*top(*ends))
    decisions = audit.select("strategy", "request_id", decision_of().alias("decision_id"))
    return decisions.join(reached, "decision_id", "left").withColumn("complete", F.col("figure_id").isNotNull() & F.col("manifest_id").isNotNull())
