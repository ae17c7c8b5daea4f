"""The lineage graph: nodes, edges and paths from a source's manifest to the cell a value measures.

A fact has, beside its keys, manifest_sha256 and source_record_id; all other
identities are derived.  Depth is fixed, so paths are chains of equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisor.functions.identity import identity

#: Node types of the published graph and the columns of the fact that name a node (fixed values); a caller whose columns differ passes others.
NODES = {
    "source_manifest": ("manifest_sha256",),
    "source_artifact": ("source_id", "manifest_sha256"),
    "source_record": ("source_id", "manifest_sha256", "source_record_id"),
    "vintage": ("vintage_id",),
    "ingestion_batch": ("ingestion_batch_id",),
    "transformation_run": ("transformation_run_id",),
    "transformation_version": ("transformation_version",),
    "observation": ("observation_id",),
    "indicator_cell": ("cell_id",),
}
#: Relationship, the types it goes from and to, and what it rests on: a field of the fact, or one that a run derived (fixed values).
EDGES = {
    "manifest_declares_artifact": ("source_manifest", "source_artifact", "recorded"),
    "manifest_declares_vintage": ("source_manifest", "vintage", "recorded"),
    "artifact_contains_record": ("source_artifact", "source_record", "recorded"),
    "record_sources_observation": ("source_record", "observation", "recorded"),
    "vintage_contextualizes_observation": ("vintage", "observation", "recorded"),
    "ingestion_batch_feeds_run": ("ingestion_batch", "transformation_run", "derived"),
    "transformation_run_derives_observation": ("transformation_run", "observation", "derived"),
    "transformation_version_projects_observation": ("transformation_version", "observation", "recorded"),
    "observation_materializes_cell": ("observation", "indicator_cell", "recorded"),
}
#: The four hops from a manifest to a cell.
CORE = ("manifest_declares_artifact", "artifact_contains_record", "record_sources_observation", "observation_materializes_cell")
_NATURAL = ("observation", "indicator_cell", "vintage")  # nodes that are named by their own id

Names = dict[str, tuple[str, ...]]


def node_id(kind: str, names: Names = NODES):
    columns = names[kind]
    return F.col(columns[0]) if kind in _NATURAL else identity(F.lit(kind), *columns)


def lineage_nodes(fact: DataFrame, names: Names = NODES) -> DataFrame:
    """node_id, node_type, label: the nine nodes of every observation, each once."""
    each = F.array(*(F.struct(node_id(k, names).alias("node_id"), F.lit(k).alias("node_type"), F.concat_ws("|", *c).alias("label")) for k, c in names.items()))
    return fact.select(F.explode(each).alias("n")).select("n.*").distinct()


def lineage_edges(fact: DataFrame, names: Names = NODES, only: tuple[str, ...] = tuple(EDGES)) -> DataFrame:
    """edge_id, from_id, relationship, to_id, evidence: nine edges of every observation (or ``only`` some relationships), each once."""
    each = F.array(*(F.struct(node_id(a, names).alias("from_id"), F.lit(r).alias("relationship"), node_id(b, names).alias("to_id"), F.lit(basis).alias("evidence")) for r, (a, b, basis) in EDGES.items() if r in only))
    rows = fact.select(F.explode(each).alias("e")).select("e.*").distinct()
    return rows.select(identity("from_id", "relationship", "to_id").alias("edge_id"), "*")


def lineage_paths(fact: DataFrame) -> DataFrame:
    """One core path for each observation, and how many observations share its record."""
    ids = fact.select("observation_id", "cell_id", *(node_id(f"source_{k}").alias(f"{k}_id") for k in ("manifest", "artifact", "record")))
    reuse = ids.groupBy("record_id").agg(F.count("*").alias("record_reuse"))
    mode = F.when(F.col("record_reuse") == 1, "unique_locator").otherwise("shared_locator")
    return ids.join(reuse, "record_id").withColumn("resolution", mode).withColumn("lineage_path_id", identity("manifest_id", "artifact_id", "record_id", "observation_id", "cell_id"))


def lineage_metrics(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """metric, value: sizes of the graph, shared locators and complete paths."""
    one = lambda df, name, value: df.agg(value.alias("value")).select(F.lit(name).alias("metric"), F.col("value").cast("long"))
    complete = F.count_if(F.col("manifest_id").isNotNull() & F.col("record_id").isNotNull() & F.col("cell_id").isNotNull())
    return (
        one(nodes, "nodes", F.count("*"))
        .unionByName(one(edges, "edges", F.count("*")))
        .unionByName(one(paths, "paths", F.count("*")))
        .unionByName(one(paths, "cells", F.count_distinct("cell_id")))
        .unionByName(one(paths, "shared_locator_paths", F.count_if(F.col("record_reuse") > 1)))
        .unionByName(one(paths, "complete_paths", complete))
    )


def graph_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, violations: conflicting nodes, edges without an end, nodes without an edge."""
    clash = nodes.groupBy("node_id").agg(F.count_distinct(F.struct("node_type", "label")).alias("n")).where("n > 1")
    ids = nodes.select("node_id").distinct()
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    count = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return count(clash, "conflicting_node").unionByName(count(ends.join(ids, "node_id", "left_anti"), "dangling_edge")).unionByName(count(ids.join(ends, "node_id", "left_anti"), "orphan_node"))


def _edge(a, relationship: str, b):
    return F.struct(a.alias("from_id"), F.lit(relationship).alias("relationship"), b.alias("to_id"))


def strategy_lineage(requests: DataFrame, serving: DataFrame, strategy: str) -> DataFrame:
    """Edges run → decision → output → cell for each request that a strategy answered."""
    rows = requests.join(serving.select("cell_id", F.col("observation_id").alias("served_id")), "cell_id")
    run, decision = identity(F.lit("run"), F.lit(strategy)), identity(F.lit("decision"), F.lit(strategy), "request_id")
    output = identity(F.lit("output"), F.lit(strategy), "cell_id")
    each = F.array(
        _edge(run, "run_made_decision", decision),
        _edge(decision, "decision_selects_output", output),
        _edge(output, "output_shows_observation", F.col("served_id")),
        _edge(output, "output_describes_cell", F.col("cell_id")),
    )
    return rows.select(F.explode(each).alias("e")).select("e.*").distinct().withColumn("strategy", F.lit(strategy))


def snapshot_lineage(snapshots: DataFrame) -> DataFrame:
    """B1: an edge from each observation to every snapshot that holds it, and from the run to each snapshot."""
    state = identity(F.lit("snapshot"), "snapshot_order")
    held = snapshots.select(F.col("observation_id").alias("from_id"), F.lit("output_available_in_snapshot").alias("relationship"), state.alias("to_id"))
    made = snapshots.select("snapshot_order").distinct().select(identity(F.lit("run"), F.lit("B1")).alias("from_id"), F.lit("run_made_snapshot").alias("relationship"), state.alias("to_id"))
    return held.unionByName(made)


def arrival_lineage(fact: DataFrame) -> DataFrame:
    """B3: vintage → arrival, observation → arrival and arrival → cell."""
    arrival = identity(F.lit("arrival"), "arrival_order")
    each = F.array(
        _edge(F.col("vintage_id"), "vintage_in_arrival", arrival),
        _edge(F.col("observation_id"), "observation_in_arrival", arrival),
        _edge(arrival, "arrival_dirties_cell", F.col("cell_id")),
    )
    return fact.select(F.explode(each).alias("e")).select("e.*").distinct()


def impact_audit(fact: DataFrame, edges: DataFrame, catalog: DataFrame, current: DataFrame) -> DataFrame:
    """Dirty cells of each arrival by the graph, against the rows' own cells, the catalog's count and the served cells' last recomputation.

    ``catalog``: arrival_order, dirty_cells.  ``current``: cell_id, recomputed_at_arrival.
    ``agrees`` if nothing was missed: no row reaches another cell than its own, the
    catalog counts what the graph reaches, and no cell that the arrival dirtied last was
    last recomputed at another arrival, or is not served.
    """
    reach = edges.where("relationship = 'observation_materializes_cell'").select(F.col("from_id").alias("observation_id"), F.col("to_id").alias("reached"))
    rows = fact.select("arrival_order", "observation_id", "cell_id").join(reach, "observation_id", "left")
    last = fact.groupBy("cell_id").agg(F.max("arrival_order").alias("last_dirty")).join(current.select("cell_id", "recomputed_at_arrival"), "cell_id", "left")
    here = F.col("last_dirty") == F.col("arrival_order")
    by = rows.join(last, "cell_id").groupBy("arrival_order").agg(
        F.count_distinct("reached").alias("dirty_by_graph"),
        F.count_distinct("cell_id").alias("dirty_by_rows"),
        F.count_if(~F.col("reached").eqNullSafe(F.col("cell_id"))).alias("mismatches"),
        F.count_if(here).alias("last_dirty_here"),
        F.count_if(here & ~F.col("recomputed_at_arrival").eqNullSafe(F.col("arrival_order"))).alias("stale_cells"),
    )
    out = by.join(catalog.select("arrival_order", F.col("dirty_cells").alias("dirty_reported")), "arrival_order", "left")
    right = (F.col("mismatches") == 0) & (F.col("stale_cells") == 0) & F.col("dirty_reported").eqNullSafe(F.col("dirty_by_graph"))
    return out.withColumn("agrees", right)


def trace_upstream(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """From published cells back to the source manifests: four equi-joins on the edges."""
    out, at = cells.select("cell_id", F.col("cell_id").alias("cell")), "cell"
    for relationship in reversed(CORE):
        kind = EDGES[relationship][0]
        hop = edges.where(F.col("relationship") == relationship).select(F.col("to_id").alias(at), F.col("from_id").alias(kind))
        out, at = out.join(hop, at), kind
    return out.select("cell_id", "observation", *(F.col(f"source_{k}").alias(k) for k in ("record", "artifact", "manifest")))
