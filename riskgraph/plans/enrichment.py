"""Complete enrichment runs: match, audit, gate, aggregate, attach, coverage.

The matched rows are written before anything reads them, so the background table is scanned
once. The audit is written before its gate, and nothing is aggregated from a match that does
not pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskgraph.functions.labels import prefixed_features
from riskgraph.operators import enrich
from riskgraph.operators.linking import require_unique
from riskgraph.session import materialize, new_scratch_path
from riskgraph.sources.stores import enforce


@dataclass
class EnrichmentRun:
    """The enriched store (written), and one row each of match counts and coverage."""

    store: DataFrame
    audit: DataFrame
    coverage: DataFrame


def enrich_nodes(
    store: DataFrame,
    nodes: DataFrame,
    background: DataFrame,
    expected: int | None = None,
    audit_path: str | None = None,
) -> EnrichmentRun:
    """``store`` with the statistics of the background features of its labelled nodes."""
    require_unique(store, ["component_id"])
    features = prefixed_features(background, expected=expected)
    matched = materialize(enrich.match_node_features(background, nodes, features), "matched-nodes")
    path = audit_path or new_scratch_path(store.sparkSession, "node-audit")
    audit = enforce(enrich.node_match_audit(nodes, matched), enrich.NODE_GATE, path)
    aggregates = enrich.aggregate_node_features(matched, features)
    enriched = materialize(enrich.attach_node_aggregates(store, aggregates), "node-store")
    return EnrichmentRun(
        enriched, audit, enrich.enrichment_coverage(enriched, "matched_node_count", "node_feat_01_mean")
    )


def enrich_edges(
    store: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    background: DataFrame,
    expected: int | None = None,
    audit_path: str | None = None,
) -> EnrichmentRun:
    """``store`` with the statistics of the background features of its labelled edges."""
    require_unique(store, ["component_id"])
    features = prefixed_features(background, expected=expected)
    labelled = materialize(enrich.edge_source_component(edges, nodes), "edge-keys")
    matched = materialize(enrich.match_edge_features(background, labelled, features), "matched-edges")
    path = audit_path or new_scratch_path(store.sparkSession, "edge-audit")
    audit = enforce(enrich.edge_match_audit(labelled, matched), enrich.EDGE_GATE, path)
    aggregates = enrich.aggregate_edge_features(matched, features)
    enriched = materialize(enrich.attach_edge_aggregates(store, aggregates), "edge-store")
    return EnrichmentRun(
        enriched, audit, enrich.enrichment_coverage(enriched, "matched_edge_count", "edge_feat_01_mean")
    )
