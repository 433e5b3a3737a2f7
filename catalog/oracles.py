"""SQL for the registered queries, run by another engine over the same tables.

Each text starts from the named building blocks below that it mentions. The SQL follows
the rules of the operators (ties by id, rounding to six places), not their plans.
"""

from __future__ import annotations

import re

# Fixed values, written out here so that a wrong one in the code that is checked shows.
NUDGE, PLACES = 1.7e-08, 6
SEEDS = (11, 23, 42, 71, 101)
TOP_FEATURES = 15
NODE_FEATURES, EDGE_FEATURES = 43, 95
BUDGETS = (0.005, 0.01, 0.02, 0.05, 0.10)
CLIP = 1e-12
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)
BINS = (
    "(-0.001, 0.1]", "(0.1, 0.2]", "(0.2, 0.3]", "(0.3, 0.4]", "(0.4, 0.5]",
    "(0.5, 0.6]", "(0.6, 0.7]", "(0.7, 0.8]", "(0.8, 0.9]", "(0.9, 1.0]",
)
TIERS = (
    ("tier_1_top_0_5pct", 0.005, "Top 0.5%"),
    ("tier_2_top_1pct", 0.01, "0.5–1%"),
    ("tier_3_top_2pct", 0.02, "1–2%"),
    ("tier_4_top_5pct", 0.05, "2–5%"),
    ("tier_5_top_10pct", 0.10, "5–10%"),
)
STANDARD_TIER = ("standard", "Standard")
SCORE_TYPE = "ranking_score_not_probability"
REASON_PREFIX = "model-ranked component in "
REASON_REVIEW = (
    "review component evidence before escalation; model score is not proof of criminal activity"
)
EVIDENCE_METHOD = (
    "top globally important node features ranked by feature_importance x absolute standardized deviation"
)
EVIDENCE_NOTE = (
    "Statistical review cues only. Features are anonymized; evidence does not establish causality, c"
    "riminal activity, or a legal/regulatory determination."
)
STRUCTURAL_COLUMNS = (
    "node_count", "edge_count", "transaction_count", "unique_directed_pairs",
    "self_loop_count", "avg_in_degree", "max_in_degree", "sd_in_degree",
    "avg_out_degree", "max_out_degree", "sd_out_degree", "avg_total_degree",
    "max_total_degree", "sd_total_degree", "source_nodes", "sink_nodes",
    "isolate_nodes", "edges_per_node", "directed_density",
)
GRAPH_FEATURES = tuple(f"node_feat_{i:02d}" for i in range(1, NODE_FEATURES + 1))
EVIDENCE_FEATURES = (
    *STRUCTURAL_COLUMNS,
    "matched_node_count",
    *[f"{f}_{stat}" for f in GRAPH_FEATURES for stat in ("mean", "sd", "min", "max")],
)


def num(expression: str, name: str | None = None) -> str:
    """Rounded double with the same nudge as the queries; adding 0 clears a negative zero."""
    text = f"(round(({expression})::DOUBLE + {NUDGE!r}::DOUBLE, {PLACES}) + 0.0::DOUBLE)"
    return f"{text} AS {name}" if name else text


def nums(*names: str, table: str = "") -> str:
    dot = f"{table}." if table else ""
    return ", ".join(num(f'{dot}"{n}"', f'"{n}"') for n in names)


def whole(expression: str, name: str) -> str:
    return f"({expression})::BIGINT AS {name}"


BLOCKS: dict[str, str] = {}

BLOCKS["raw_cc"] = """
SELECT c_custkey AS ccId,
  CASE WHEN c_acctbal < 0 THEN ' Suspicious' WHEN c_custkey % 50 = 7 THEN 'unknown'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'non-suspicious' ELSE 'Licit' END AS ccLabel
FROM customer"""
BLOCKS["components"] = """
SELECT ccId AS component_id,
  CASE WHEN ccLabel = ' Suspicious' THEN 1 WHEN ccLabel = 'unknown' THEN NULL ELSE 0 END AS label
FROM raw_cc"""
BLOCKS["labelled"] = "SELECT component_id, label FROM components WHERE label IS NOT NULL"
BLOCKS["nodes"] = "SELECT o_orderkey AS node_id, o_custkey AS component_id FROM orders"
BLOCKS["paired"] = """
SELECT * FROM (
  SELECT l_orderkey AS source_node_id,
    lead(l_orderkey) OVER (PARTITION BY o_custkey, l_suppkey % 50
      ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    ) AS target_node_id,
    l_orderkey * 100000 + l_partkey AS transaction_id,
    l_quantity AS "feat#1", l_extendedprice AS "feat#2", l_discount AS "feat#3", l_tax AS "feat#4",
    l_linenumber::DOUBLE AS "feat#5"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
WHERE target_node_id IS NOT NULL"""
BLOCKS["paired"] = (
    "SELECT p.*, "
    + ", ".join(f'e.embedding[{i}]::DOUBLE AS "feat#{i + 5}"' for i in range(1, 65))
    + ", "
    + ", ".join(f'e.embedding[{i}]::DOUBLE * p."feat#1" AS "feat#{i + 69}"' for i in range(1, 27))
    + f" FROM ({BLOCKS['paired']}) p JOIN embeddings e ON e.vec_id = p.transaction_id % (SELECT count(*) FROM embeddings)"
)
BLOCKS["clean"] = "SELECT source_node_id, target_node_id, transaction_id FROM paired"
BLOCKS["edges"] = """
SELECT * FROM clean
UNION ALL SELECT o_orderkey, o_orderkey + 1, o_orderkey + 9000000000000 FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT o_orderkey, o_orderkey + 1000000000, o_orderkey + 8000000000000
FROM orders WHERE o_orderkey % 101 = 0"""
BLOCKS["bg_once"] = (
    "SELECT o_orderkey AS clId, "
    + ", ".join(f'embedding[{i}]::DOUBLE AS "feat#{i}"' for i in range(1, NODE_FEATURES))
    + f', 1.0::DOUBLE AS "feat#{NODE_FEATURES}" FROM orders JOIN embeddings '
    "ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings)"
)
BLOCKS["bg_nodes"] = (
    "SELECT * FROM bg_once UNION ALL SELECT * REPLACE (clId + 7000000000 AS clId) FROM bg_once"
)
BLOCKS["bg_edges"] = (
    "SELECT * FROM paired UNION ALL "
    "SELECT * REPLACE (source_node_id + 7000000000 AS source_node_id) FROM paired"
)
BLOCKS["mapped"] = """
SELECT e.*, s.component_id, t.component_id AS target_component_id
FROM edges e LEFT JOIN nodes s ON s.node_id = e.source_node_id
LEFT JOIN nodes t ON t.node_id = e.target_node_id"""
BLOCKS["valid"] = "SELECT * FROM mapped WHERE component_id = target_component_id"
BLOCKS["ends"] = """
SELECT component_id, source_node_id AS node_id, 0 AS ins, 1 AS outs FROM valid
UNION ALL SELECT component_id, target_node_id, 1, 0 FROM valid"""
BLOCKS["degrees"] = """
SELECT component_id, node_id, coalesce(sum(ins), 0)::BIGINT AS in_degree,
  coalesce(sum(outs), 0)::BIGINT AS out_degree, (coalesce(sum(ins + outs), 0))::BIGINT AS total_degree
FROM nodes LEFT JOIN ends USING (component_id, node_id) GROUP BY component_id, node_id"""
BLOCKS["degree_stats"] = (
    "SELECT component_id, count(*) AS node_count, "
    + ", ".join(
        f"avg({d}_degree) AS avg_{d}_degree, max({d}_degree) AS max_{d}_degree, "
        f"stddev_pop({d}_degree) AS sd_{d}_degree"
        for d in ("in", "out", "total")
    )
    + ", count(*) FILTER (in_degree = 0 AND out_degree > 0) AS source_nodes"
    ", count(*) FILTER (out_degree = 0 AND in_degree > 0) AS sink_nodes"
    ", count(*) FILTER (total_degree = 0) AS isolate_nodes FROM degrees GROUP BY component_id"
)
BLOCKS["edge_stats"] = """
SELECT component_id, count(*) AS edge_count, count(DISTINCT transaction_id) AS transaction_count,
  count(DISTINCT (source_node_id, target_node_id)) AS unique_directed_pairs,
  count(*) FILTER (source_node_id = target_node_id) AS self_loop_count
FROM valid GROUP BY component_id"""
_MEASURED = [c for c in STRUCTURAL_COLUMNS if c not in ("edges_per_node", "directed_density")]
BLOCKS["store"] = (
    "SELECT component_id, label, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _MEASURED)
    + ", coalesce(edge_count / node_count, 0)::DOUBLE AS edges_per_node"
    ", coalesce(CASE WHEN node_count > 1 THEN unique_directed_pairs / (node_count * (node_count - 1.0::DOUBLE)) END"
    ", 0)::DOUBLE AS directed_density"
    " FROM labelled LEFT JOIN degree_stats USING (component_id) LEFT JOIN edge_stats USING (component_id)"
)


def _statistics(count: int, prefix: str) -> str:
    made = []
    for i in range(1, count + 1):
        for stat, fn in (("mean", "avg"), ("sd", "stddev_pop"), ("min", "min"), ("max", "max")):
            made.append(f'{fn}("feat#{i}") AS {prefix}_{i:02d}_{stat}')
    return ", ".join(made)


def _stat_names(count: int, prefix: str) -> list[str]:
    return [
        f"{prefix}_{i:02d}_{s}" for i in range(1, count + 1) for s in ("mean", "sd", "min", "max")
    ]


NODE_STATS = _stat_names(NODE_FEATURES, "node_feat")
EDGE_STATS = _stat_names(EDGE_FEATURES, "edge_feat")
NODE_NAMES = [f"feat#{i}" for i in range(1, NODE_FEATURES + 1)]
EDGE_NAMES = [f"feat#{i}" for i in range(1, EDGE_FEATURES + 1)]

BLOCKS["matched_nodes"] = (
    "SELECT component_id, node_id, b.* EXCLUDE (clId) FROM bg_nodes b JOIN nodes ON clId = node_id"
)
BLOCKS["edge_keys"] = (
    "SELECT clean.*, component_id FROM clean LEFT JOIN nodes ON node_id = source_node_id"
)
BLOCKS["matched_edges"] = (
    "SELECT b.*, component_id FROM bg_edges b "
    "JOIN edge_keys USING (source_node_id, target_node_id, transaction_id)"
)
BLOCKS["node_aggs"] = (
    "SELECT component_id, count(*) AS matched_node_count, "
    + _statistics(NODE_FEATURES, "node_feat")
    + " FROM matched_nodes GROUP BY component_id"
)
BLOCKS["edge_aggs"] = (
    "SELECT component_id, count(*) AS matched_edge_count, "
    + _statistics(EDGE_FEATURES, "edge_feat")
    + " FROM matched_edges GROUP BY component_id"
)
BLOCKS["node_store"] = "SELECT * FROM store LEFT JOIN node_aggs USING (component_id)"
BLOCKS["shares"] = """
SELECT o_custkey AS component_id,
  floor(100.0::DOUBLE * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity)) / 100 AS share
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"""
BLOCKS["scores"] = """
SELECT component_id, label, coalesce(share, 0)::DOUBLE AS risk_score, 'return_share' AS model
FROM labelled LEFT JOIN shares USING (component_id)
UNION ALL
SELECT component_id, label, (10000 - c_acctbal) / 11000, 'balance'
FROM labelled JOIN customer ON c_custkey = component_id"""

# Canonical tables: clean edges with the component of their source.
BLOCKS["canon"] = """
SELECT component_id, source_node_id AS source, target_node_id AS target
FROM edge_keys JOIN (SELECT node_id AS target_node_id, component_id AS other FROM nodes) USING (target_node_id)
WHERE component_id = other"""
BLOCKS["canon_degrees"] = """
SELECT component_id, node_id, sum(ins) AS ins, sum(outs) AS outs FROM (
  SELECT component_id, source AS node_id, 0 AS ins, 1 AS outs FROM canon
  UNION ALL SELECT component_id, target, 1, 0 FROM canon)
GROUP BY component_id, node_id"""
BLOCKS["canon_counts"] = """
SELECT component_id, coalesce(node_count, 0)::BIGINT AS node_count, coalesce(edge_count, 0)::BIGINT AS edge_count
FROM (SELECT component_id, count(DISTINCT node_id) AS node_count FROM nodes GROUP BY 1)
FULL JOIN (SELECT component_id, count(*) AS edge_count FROM canon GROUP BY 1) USING (component_id)"""
BLOCKS["simple"] = """
SELECT component_id, node_count, edge_count, coalesce(mean_in, 0)::DOUBLE AS mean_in_degree,
  coalesce(mean_out, 0)::DOUBLE AS mean_out_degree, coalesce(top, 0)::BIGINT AS max_degree,
  edge_count / greatest(node_count * (node_count - 1), 1)::DOUBLE AS density
FROM canon_counts LEFT JOIN (
  SELECT component_id, avg(ins) FILTER (ins > 0) AS mean_in, avg(outs) FILTER (outs > 0) AS mean_out,
    max(ins + outs) AS top
  FROM canon_degrees GROUP BY 1) USING (component_id)"""

# Queue, importance and evidence.
_BAND = (
    "CASE "
    + " ".join(f"WHEN share <= {upper}::DOUBLE THEN '{name}'" for name, upper, _ in TIERS)
    + f" ELSE '{STANDARD_TIER[0]}' END"
)
BLOCKS["queue"] = f"""
SELECT component_id, risk_score, model, rank, share AS review_fraction_rank, {_BAND} AS priority_band,
  '{SCORE_TYPE}' AS score_type,
  '{REASON_PREFIX}' || replace({_BAND}, '_', ' ') AS reason_1, '{REASON_REVIEW}' AS reason_2
FROM (SELECT *, rank / (count(*) OVER ())::DOUBLE AS share FROM (
  SELECT component_id, risk_score, model, row_number() OVER (ORDER BY risk_score DESC, component_id) AS rank
  FROM scores WHERE model = 'return_share'))"""


def separation_sql(features, source: str = "store") -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) FILTER (label = 0) AS licit_mean, "
        f"avg({f}) FILTER (label = 1) AS suspicious_mean, stddev_pop({f}) AS sd FROM {source}"
        for f in features
    )


def separation_columns() -> str:
    smd = "coalesce((suspicious_mean - licit_mean) / nullif(sd, 0), 0)"
    return (
        f"feature, licit_mean, suspicious_mean, {smd} AS standardized_mean_difference, "
        f"abs({smd}) AS abs_standardized_mean_difference"
    )


BLOCKS["separation"] = f"SELECT {separation_columns()} FROM ({separation_sql(STRUCTURAL_COLUMNS)})"
BLOCKS["apart"] = f"SELECT {separation_columns()} FROM ({separation_sql(EVIDENCE_FEATURES, 'node_store')})"
BLOCKS["importance"] = f"""
SELECT feature, round(abs_standardized_mean_difference / (SELECT sum(abs_standardized_mean_difference) FROM apart),
  {PLACES}) AS random_forest_importance FROM apart"""
BLOCKS["weights"] = f"""
SELECT feature, random_forest_importance AS importance FROM importance
ORDER BY random_forest_importance DESC, feature LIMIT {TOP_FEATURES}"""
BLOCKS["long_store"] = (
    "SELECT component_id, feature, value FROM (SELECT component_id, "
    + ", ".join(f"round({f}::DOUBLE, 9) AS {f}" for f in EVIDENCE_FEATURES)
    + " FROM node_store) UNPIVOT INCLUDE NULLS (value FOR feature IN ("
    + ", ".join(EVIDENCE_FEATURES)
    + ")) WHERE feature IN (SELECT feature FROM weights)"
)
BLOCKS["stats"] = """
SELECT component_id, feature, value,
  CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY feature, value IS NULL ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE)
    / count(value) OVER (PARTITION BY feature) END AS percentile,
  coalesce((value - avg(value) OVER (PARTITION BY feature))
    / nullif(stddev_pop(value) OVER (PARTITION BY feature), 0), 0) AS zscore
FROM long_store"""
BLOCKS["scored_evidence"] = """
SELECT *, importance * abs(zscore) AS evidence_score FROM stats JOIN weights USING (feature)"""


def fixed(x: str, digits: int) -> str:
    base = 10**digits
    n = f"round_even(({x}) * {base}.0::DOUBLE, 0)::BIGINT"
    return f"(({n} // {base})::VARCHAR || '.' || lpad(({n} % {base})::VARCHAR, {digits}, '0'))"


def _sig_text(m: str, e: str) -> str:
    def split(places: int) -> str:
        base = 10**places
        return (
            f"regexp_replace(({m} // {base})::VARCHAR || '.' || lpad(({m} % {base})::VARCHAR, {places}, '0'), "
            "'\\.?0+$', '')"
        )

    return (
        f"CASE WHEN {e} = 3 THEN {m}::VARCHAR WHEN {e} = 2 THEN {split(1)} WHEN {e} = 1 THEN {split(2)} "
        f"WHEN {e} = 0 THEN {split(3)} "
        f"WHEN {e} BETWEEN -4 AND -1 THEN regexp_replace('0.' || repeat('0', (-{e} - 1)::INT) || {m}::VARCHAR, '\\.?0+$', '') "
        f"ELSE {split(3)} || 'e' || CASE WHEN {e} < 0 THEN '-' ELSE '+' END "
        f"|| CASE WHEN abs({e}) < 10 THEN '0' ELSE '' END || abs({e})::VARCHAR END"
    )


BLOCKS["digits"] = """
SELECT *, CASE WHEN raw >= 10000 THEN 1000 ELSE raw END AS m, e0 + (raw >= 10000)::INT AS e FROM (
  SELECT *, round_even(CASE WHEN e0 > 3 THEN abs(value) / pow(10.0::DOUBLE, (e0 - 3)::DOUBLE)
      ELSE abs(value) * pow(10.0::DOUBLE, (3 - e0)::DOUBLE) END, 0)::BIGINT AS raw FROM (
    SELECT *, CASE WHEN value = 0 THEN 0 ELSE floor(log10(nullif(abs(value), 0)))::INT END AS e0
    FROM scored_evidence))"""
BLOCKS["sentences"] = f"""
SELECT *, feature || ': value=' || CASE WHEN value = 0 THEN '0' ELSE CASE WHEN value < 0 THEN '-' ELSE '' END
  || {_sig_text('m', 'e')} END || '; ' || {fixed('percentile * 100', 1)} || 'th percentile ('
  || CASE WHEN percentile >= 0.5 THEN 'top ' || {fixed('(1 - percentile) * 100', 1)}
     ELSE 'bottom ' || {fixed('percentile * 100', 1)} END
  || '%); ' || {fixed('abs(zscore)', 2)} || CASE WHEN zscore >= 0 THEN ' SD above' ELSE ' SD below' END
  || ' overall mean; global RF importance=' || {fixed('importance * 100', 2)} || '%' AS evidence
FROM digits"""
BLOCKS["top_evidence"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component_id
  ORDER BY round(evidence_score, 9) DESC, importance DESC, feature) AS evidence_rank FROM sentences)
WHERE evidence_rank <= 3 AND component_id IN (SELECT component_id FROM queue)"""
BLOCKS["long_evidence"] = """
SELECT rank, component_id, priority_band, risk_score, model, score_type, evidence_rank, feature,
  value AS feature_value, percentile, zscore, abs(zscore) AS absolute_zscore,
  importance AS global_random_forest_importance, evidence_score
FROM queue JOIN top_evidence USING (component_id)"""
BLOCKS["wide_evidence"] = f"""
SELECT queue.*, e1 AS evidence_1, e2 AS evidence_2, e3 AS evidence_3,
  '{EVIDENCE_METHOD}' AS evidence_method, '{EVIDENCE_NOTE}' AS evidence_note
FROM queue JOIN (
  SELECT component_id, coalesce(max(evidence) FILTER (evidence_rank = 1), '') AS e1,
    coalesce(max(evidence) FILTER (evidence_rank = 2), '') AS e2,
    coalesce(max(evidence) FILTER (evidence_rank = 3), '') AS e3
  FROM top_evidence GROUP BY component_id) USING (component_id)"""


# Splits.
def split_block(source: str, seed: int, fraction: float) -> str:
    """component_id, label, is_test."""
    return f"""
SELECT h.component_id, h.label, h.place <= q.quota AS is_test FROM (
  SELECT component_id, label, row_number() OVER (PARTITION BY label
    ORDER BY md5(component_id::VARCHAR || ':{seed}'), component_id) AS place FROM {source}) h
JOIN (
  SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= held - sum(base) OVER ()
      THEN 1 ELSE 0 END AS quota
  FROM (SELECT label, held, held * n // total AS base, held * n % total AS rest
    FROM (SELECT label, n, total, ceil(total * {fraction}::DOUBLE)::BIGINT AS held
      FROM (SELECT label, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM {source} GROUP BY label)))
) q USING (label)"""


for _seed in SEEDS:
    BLOCKS[f"split_{_seed}"] = split_block("labelled", _seed, 0.2)
BLOCKS["development"] = "SELECT component_id, label FROM split_42 WHERE NOT is_test"
BLOCKS["split_inner"] = split_block("development", 43, 0.25)
# Isotonic regression by its min-max formula over the distinct calibration scores.
BLOCKS["levels"] = """
SELECT x, n, p, sum(n) OVER (ORDER BY x) AS cn, sum(p) OVER (ORDER BY x) AS cp FROM (
  SELECT risk_score AS x, count(*) AS n, sum(s.label) AS p
  FROM scores s JOIN split_inner i USING (component_id) WHERE model = 'return_share' AND i.is_test GROUP BY 1)"""
BLOCKS["monotone"] = """
SELECT x, max(low) AS y FROM (
  SELECT i.x, a.x AS from_x, min((b.cp - a.cp + a.p) / (b.cn - a.cn + a.n)::DOUBLE) AS low
  FROM levels i JOIN levels a ON a.x <= i.x JOIN levels b ON b.x >= i.x GROUP BY 1, 2) GROUP BY x"""
# Newton's method on the same scores: forty steps from the base rate.
BLOCKS["sigmoid"] = """
SELECT w, b FROM (
  WITH RECURSIVE step(i, w, b) AS (
    SELECT 0, 0.0::DOUBLE, ln(sum(p) / (sum(n) - sum(p))::DOUBLE) FROM levels
    UNION ALL
    SELECT i + 1, w - (ii * gs - si * gi) / (ss * ii - si * si), b - (ss * gi - si * gs) / (ss * ii - si * si)
    FROM (
      SELECT i, w, b, sum((n * q - p) * x) + w AS gs, sum(n * q - p) AS gi,
        sum(n * q * (1 - q) * x * x) + 1.0 AS ss, sum(n * q * (1 - q) * x) AS si, sum(n * q * (1 - q)) AS ii
      FROM (SELECT i, w, b, x, n, p, 1.0 / (1.0 + exp(-(w * x + b))) AS q FROM step, levels WHERE i < 40)
      GROUP BY i, w, b))
  SELECT w, b FROM step WHERE i = 40)"""
BLOCKS["asked"] = """
SELECT s.component_id, s.label, risk_score AS x FROM scores s JOIN split_42 i USING (component_id)
WHERE model = 'return_share' AND i.is_test"""
BLOCKS["around"] = """
SELECT x, coalesce((SELECT max(m.x) FROM monotone m WHERE m.x <= q.x), (SELECT min(x) FROM monotone)) AS x0,
  coalesce((SELECT min(m.x) FROM monotone m WHERE m.x >= q.x), (SELECT max(x) FROM monotone)) AS x1
FROM (SELECT DISTINCT x FROM asked) q"""
BLOCKS["curve"] = """
SELECT r.x, CASE WHEN x1 = x0 THEN a.y WHEN r.x <= x0 THEN a.y WHEN r.x >= x1 THEN b.y
  ELSE a.y + (b.y - a.y) * (r.x - x0) / (x1 - x0) END AS y
FROM around r JOIN monotone a ON a.x = x0 JOIN monotone b ON b.x = x1"""
BLOCKS["parts"] = " UNION ALL ".join(
    f"SELECT {s}::BIGINT AS seed, component_id, label, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part "
    f"FROM split_{s}"
    for s in SEEDS
)
BLOCKS["seed_scores"] = (
    "SELECT seed, component_id, s.label, risk_score, model FROM parts JOIN scores s USING (component_id) "
    "WHERE part = 'test'"
)
BLOCKS["shuffled"] = """
SELECT a.component_id, b.label FROM (
  SELECT component_id, row_number() OVER (ORDER BY md5(component_id::VARCHAR || ':42:row'), component_id) AS place
  FROM labelled) a
JOIN (SELECT label, row_number() OVER (ORDER BY md5(component_id::VARCHAR || ':42:label'), component_id) AS place
  FROM labelled) b USING (place)"""


# Metrics.
def quality_block(source: str, keys: str) -> str:
    """Average precision by running sums, ROC AUC by average ranks, base rate, Brier score."""
    return f"""
SELECT {keys}, coalesce(sum(p::DOUBLE * cp / cn) / nullif(sum(p), 0), 0) AS average_precision,
  (sum(p * (total - cn + (n + 1) / 2.0::DOUBLE)) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE)
    / nullif(sum(p) * sum(n - p), 0)::DOUBLE AS roc_auc,
  sum(p)::DOUBLE / sum(n) AS base_rate, sum(se) / sum(n) AS brier_score
FROM (
  SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER (PARTITION BY {keys}) AS total
  FROM (SELECT {keys}, risk_score, count(*) AS n, sum(label) AS p, sum(pow(risk_score - label, 2)) AS se
        FROM {source} GROUP BY {keys}, risk_score)
  WINDOW w AS (PARTITION BY {keys} ORDER BY risk_score DESC))
GROUP BY {keys}"""


def budget_block(source: str, keys: str) -> str:
    fractions = ", ".join(f"({f}::DOUBLE)" for f in BUDGETS)
    using = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT *, suspicious_captured / reviews::DOUBLE AS precision_at_budget,
  coalesce(suspicious_captured / nullif(positives, 0)::DOUBLE, 0) AS recall_at_budget,
  coalesce((suspicious_captured / reviews::DOUBLE) / nullif(positives / n::DOUBLE, 0), 0) AS lift_at_budget
FROM (
  SELECT {using}, f AS review_fraction, greatest(1, least(n, ceil(n * f)))::BIGINT AS reviews, n,
    sum(label)::BIGINT AS positives,
    coalesce(sum(label) FILTER (place <= greatest(1, least(n, ceil(n * f)))), 0)::BIGINT AS suspicious_captured
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n,
          row_number() OVER (PARTITION BY {keys} ORDER BY risk_score DESC, component_id) AS place
        FROM {source}) a, (VALUES {fractions}) b(f)
  GROUP BY {using}, f, n)"""


BLOCKS["quality"] = quality_block("scores", "model")
BLOCKS["budgets"] = budget_block("scores", "model")
BLOCKS["seed_quality"] = quality_block("seed_scores", "seed, model")
BLOCKS["seed_budgets"] = budget_block("seed_scores", "seed, model")
BLOCKS["blind"] = (
    "SELECT component_id, x.label, risk_score, model FROM scores JOIN shuffled x USING (component_id)"
)
BLOCKS["blind_quality"] = quality_block("blind", "model")
_INNER = EDGES[1:-1]
BLOCKS["bin_grid"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, {EDGES[i]!r}::DOUBLE, {EDGES[i + 1]!r}::DOUBLE, '{BINS[i]}')"
    for i in range(10)
) + ") g(bin_id, lower, upper, bin)"
BLOCKS["bins"] = f"""
SELECT model, bin_id, lower, upper, bin, count(risk_score) AS cases, avg(label) AS observed_rate,
  avg(risk_score) AS mean_score
FROM (SELECT DISTINCT model FROM scores) CROSS JOIN bin_grid
LEFT JOIN (SELECT model, label, risk_score, ({' + '.join(f'(risk_score > {e!r}::DOUBLE)::INT' for e in _INNER)})::BIGINT
    AS bin_id FROM scores WHERE risk_score BETWEEN 0 AND 1) USING (model, bin_id)
GROUP BY ALL"""
BLOCKS["ece"] = """
SELECT model, sum(cases * abs(observed_rate - mean_score)) / nullif(sum(cases), 0) AS ece FROM bins
WHERE cases > 0 GROUP BY model"""
BLOCKS["losses"] = f"""
SELECT model, avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss
FROM (SELECT *, greatest({CLIP}::DOUBLE, least(1 - {CLIP}::DOUBLE, risk_score)) AS p FROM scores) GROUP BY model"""
BLOCKS["methods"] = (
    "SELECT model AS method, average_precision, roc_auc, brier_score, log_loss, ece, base_rate "
    "FROM quality JOIN losses USING (model) JOIN ece USING (model)"
)


def summary_block(source: str, keys: str, values, where: str = "true") -> str:
    made = ", ".join(
        f"{fn}({v}) AS {v}_{n}"
        for v in values
        for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )
    return f"SELECT {keys}, {made} FROM {source} WHERE {where} GROUP BY {keys}"


def summary_names(values) -> list[str]:
    return [f"{v}_{n}" for v in values for n in ("mean", "std", "min", "max")]


QUALITY = ("average_precision", "roc_auc", "brier_score")
BUDGET_VALUES = ("precision_at_budget", "recall_at_budget", "lift_at_budget", "suspicious_captured")
BLOCKS["summary"] = summary_block("seed_quality", "model", QUALITY)
BLOCKS["summary_early"] = summary_block("seed_quality", "model", QUALITY, "seed < 50")
BLOCKS["budget_summary"] = summary_block("seed_budgets", "model, review_fraction", BUDGET_VALUES)
BLOCKS["budget_summary_early"] = summary_block(
    "seed_budgets", "model, review_fraction", BUDGET_VALUES, "seed < 50"
)

# Graph.
BLOCKS["graph_nodes"] = (
    "SELECT node_id, component_id, "
    + ", ".join(f'"feat#{i}" AS node_feat_{i:02d}' for i in range(1, NODE_FEATURES + 1))
    + " FROM matched_nodes"
)
BLOCKS["graph_edges"] = "SELECT component_id, source AS src, target AS dst FROM canon"


def hop_block(nodes: str, features, reverse: bool, prefix: str) -> str:
    sender, receiver = ("dst", "src") if reverse else ("src", "dst")
    means = ", ".join(f"coalesce(avg(s.{f}), 0) AS {prefix}{f}" for f in features)
    return (
        f"SELECT n.node_id, n.component_id, {means} FROM {nodes} n "
        f"LEFT JOIN graph_edges e ON e.{receiver} = n.node_id "
        f"LEFT JOIN {nodes} s ON s.node_id = e.{sender} GROUP BY n.node_id, n.component_id"
    )


_HOP_1 = list(GRAPH_FEATURES)
_HOP_2 = _HOP_1 + [f"in1_{f}" for f in _HOP_1] + [f"out1_{f}" for f in _HOP_1]
_HOP_3 = _HOP_2 + [f"in2_{f}" for f in _HOP_2] + [f"out2_{f}" for f in _HOP_2]
for _level, _base, _names in ((1, "graph_nodes", _HOP_1), (2, "hop_1", _HOP_2)):
    BLOCKS[f"forward_{_level}"] = hop_block(_base, _names, False, f"in{_level}_")
    BLOCKS[f"backward_{_level}"] = hop_block(_base, _names, True, f"out{_level}_")
    BLOCKS[f"hop_{_level}"] = (
        f"SELECT node_id, {_base}.component_id, "
        + ", ".join(_names + [f"in{_level}_{f}" for f in _names] + [f"out{_level}_{f}" for f in _names])
        + f" FROM {_base} JOIN (SELECT * EXCLUDE (component_id) FROM forward_{_level}) USING (node_id) "
        f"JOIN (SELECT * EXCLUDE (component_id) FROM backward_{_level}) USING (node_id)"
    )


def with_blocks(sql: str) -> str:
    """Put the building blocks that ``sql`` mentions, directly or not, in front of it."""
    needed: set[str] = set()
    words = set(re.findall(r"\w+", sql))
    todo = [b for b in BLOCKS if b in words]
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            inside = set(re.findall(r"\w+", BLOCKS[name]))
            todo += [b for b in BLOCKS if b in inside and b not in needed and b != name]
    if not needed:
        return sql
    # Blocks are listed after everything they use.
    ordered = [b for b in BLOCKS if b in needed]
    return "WITH " + ",\n".join(f"{b} AS ({BLOCKS[b]})" for b in ordered) + f"\n{sql}"


_RAW = {
    "connected_components": ("raw_cc", [("ccId", "bigint"), ("ccLabel", "string")]),
    "nodes": ("nodes", [("clId", "bigint"), ("ccId", "bigint")]),
    "edges": ("edges", [("clId1", "bigint"), ("clId2", "bigint"), ("txId", "bigint")]),
    "background_nodes": ("bg_nodes", [("clId", "bigint")] + [(f, "double") for f in NODE_NAMES]),
    "background_edges": (
        "bg_edges",
        [("clId1", "bigint"), ("clId2", "bigint"), ("txId", "bigint")] + [(f, "double") for f in EDGE_NAMES],
    ),
}
_STORE = f"component_id, label, {nums(*STRUCTURAL_COLUMNS)}"
_INT_COLUMNS = [
    c for c in STRUCTURAL_COLUMNS if not c.startswith(("avg_", "sd_")) and c not in ("edges_per_node", "directed_density")
]
_DEGREES = [c for c in STRUCTURAL_COLUMNS if c.endswith("_degree")]


def _store_columns(columns=STRUCTURAL_COLUMNS) -> str:
    return ", ".join(whole(c, c) if c in _INT_COLUMNS else num(c, c) for c in columns)


_NODE_AUDIT = """
SELECT *, distinct_labeled_nodes - distinct_matched_nodes AS missing_labeled_nodes,
  matched_background_rows - distinct_matched_nodes AS duplicate_background_matches
FROM (SELECT count(*) AS labeled_node_rows, count(DISTINCT node_id) AS distinct_labeled_nodes FROM nodes),
  (SELECT count(*) AS matched_background_rows, count(DISTINCT node_id) AS distinct_matched_nodes FROM matched_nodes)"""
_BUDGET = "review_fraction, reviews, suspicious_captured, " + nums(
    "precision_at_budget", "recall_at_budget", "lift_at_budget"
)
_TITLE_BUDGET = "CASE model WHEN 'return_share' THEN 'Return Share' ELSE 'Balance' END"
_NODE_STORE_FEATURES = list(STRUCTURAL_COLUMNS) + ["matched_node_count"] + NODE_STATS
_LEAKAGE = (
    "SELECT count(*) AS rows, count(*) FILTER (label = 1) AS positive_rows, "
    "count(*) FILTER (label = 0) AS negative_rows, "
    f"{len(_NODE_STORE_FEATURES)}::BIGINT AS feature_count, count(*) - count(DISTINCT component_id) AS duplicate_component_ids, "
    "coalesce(sum("
    + " + ".join(f"({c} IS NULL OR NOT isfinite({c}::DOUBLE))::INT" for c in _NODE_STORE_FEATURES)
    + "), 0)::BIGINT AS nonfinite_feature_values, '' AS potential_target_name_columns FROM node_store"
)
_STANDARD = ", ".join(
    num(f"({c} - (SELECT avg({c}) FROM train)) / coalesce(nullif((SELECT stddev_pop({c}) FROM train), 0), 1)", c)
    for c in STRUCTURAL_COLUMNS
)
BLOCKS["train"] = "SELECT store.* FROM store JOIN split_42 USING (component_id) WHERE NOT is_test"


def _coverage(source: str, names, quote: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS ordinal, '{n}' AS feature, count(\"{n}\") AS non_null_rows FROM {source}"
        for i, n in enumerate(names, 1)
    )


def oracle_sql() -> dict[str, str]:
    made: dict[str, str] = {}

    # Sources, sinks, schema.
    shapes = {
        "raw_cc": "ccId, NULL, NULL, ccLabel, NULL",
        "nodes": "node_id, component_id, NULL, NULL, NULL",
        "edges": "source_node_id, target_node_id, transaction_id, NULL, NULL",
        "bg_nodes": "clId, NULL, NULL, NULL, " + " + ".join(f'"{f}"' for f in NODE_NAMES),
        "bg_edges": "source_node_id, target_node_id, transaction_id, NULL, " + " + ".join(f'"{f}"' for f in EDGE_NAMES),
    }
    listed = " UNION ALL ".join(f"SELECT '{name}', {shapes[block]} FROM {block}" for name, (block, _) in _RAW.items())
    made["scan_raw_tables"] = (
        "SELECT name, id_1, id_2::BIGINT AS id_2, id_3::BIGINT AS id_3, label_text::VARCHAR AS label_text, "
        f"feature_sum::DOUBLE AS feature_sum FROM ({listed}) r(name, id_1, id_2, id_3, label_text, feature_sum)"
    )
    made["scan_feature_store"] = (
        f"SELECT component_id, label, node_count, {nums('directed_density')} FROM store"
    )
    made["write_store"] = f"SELECT component_id, label, {_store_columns()} FROM store"
    made["write_result_csv"] = f"SELECT component_id, label, {nums('risk_score')}, model FROM scores"
    made["write_profile_json"] = _NODE_AUDIT
    made["schema_manifest"] = " UNION ALL ".join(
        f"SELECT '{name}' AS name, (SELECT count(*) FROM {block}) AS rows, ordinal, column_name, column_type "
        f"FROM (VALUES {', '.join(f'({i}::BIGINT, {c!r}, {k!r})' for i, (c, k) in enumerate(columns, 1))}) "
        "v(ordinal, column_name, column_type)"
        for name, (block, columns) in _RAW.items()
    )
    made["discover_prefixed_features"] = _coverage("bg_nodes", NODE_NAMES)

    # Projections, filters, scalar functions.
    made["cast_ids"] = "SELECT source_node_id, target_node_id, transaction_id FROM edges"
    made["normalize_label"] = """SELECT ccId AS component_id, ccLabel AS raw_label,
  CASE WHEN lower(trim(ccLabel)) IN ('suspicious', 'illicit', 'true', '1') THEN 1
       WHEN lower(trim(ccLabel)) IN ('non-suspicious', 'nonsuspicious', 'licit', 'false', '0') THEN 0 END AS label
FROM raw_cc"""
    made["labelled_only"] = "SELECT component_id, label FROM labelled"
    made["valid_edges"] = "SELECT component_id, source_node_id, target_node_id, transaction_id FROM valid"
    made["rename_feature_columns"] = (
        "SELECT clId, "
        + ", ".join(f'"{f}" AS node_feat_{i:02d}' for i, f in enumerate(NODE_NAMES, 1))
        + " FROM bg_nodes"
    )
    made["zero_fill"] = """SELECT component_id, label, coalesce(edge_count, 0) AS edge_count,
  coalesce(transaction_count, 0) AS transaction_count, coalesce(self_loop_count, 0) AS self_loop_count
FROM components LEFT JOIN edge_stats USING (component_id)"""
    made["safe_ratios"] = f"SELECT component_id, {nums('edges_per_node', 'directed_density')} FROM store"
    made["derived_signals"] = (
        f"SELECT component_id, {num('node_count * 0.4::DOUBLE + max_degree * 0.7::DOUBLE', 'flow_dispersion')}, "
        f"{num('edge_count / greatest(node_count, 1)::DOUBLE', 'path_complexity')} FROM simple"
    )
    made["select_numeric_features"] = _coverage("store", STRUCTURAL_COLUMNS)
    made["nonfinite_count"] = (
        "SELECT sum("
        + " + ".join(f"({c} IS NULL OR NOT isfinite({c}::DOUBLE))::INT" for c in _NODE_STORE_FEATURES)
        + ")::BIGINT AS nonfinite_values FROM node_store"
    )
    at = len(STRUCTURAL_COLUMNS)
    made["target_name_columns"] = (
        f"SELECT {at + 1}::BIGINT AS ordinal, 'is_Suspicious' AS feature, count(label) AS non_null_rows FROM store "
        f"UNION ALL SELECT {at + 2}, 'sub_class', count(*) FILTER (label = 1) FROM store"
    )
    made["reason_codes"] = "SELECT component_id, reason_1, reason_2, score_type FROM queue"
    made["humanize_labels"] = """SELECT model, count(*) AS cases,
  CASE model WHEN 'balance' THEN 'Account balance' ELSE 'Return Share' END AS model_label
FROM scores GROUP BY model"""
    made["evidence_text"] = "SELECT component_id, feature, evidence FROM sentences"
    made["drop_null_importance"] = (
        f"SELECT feature, {nums('random_forest_importance')} FROM importance WHERE feature <> 'edge_count'"
    )
    made["drop_helper_columns"] = (
        f"SELECT component_id, rank, '{EVIDENCE_METHOD}' AS evidence_method, "
        f"'{EVIDENCE_NOTE}' AS evidence_note FROM queue"
    )

    # Joins and referential integrity.
    made["edge_component_map"] = (
        "SELECT source_node_id, target_node_id, transaction_id, component_id, target_component_id FROM mapped"
    )
    made["node_degree"] = "SELECT component_id, node_id, in_degree, out_degree, total_degree FROM degrees"
    made["assemble_component_store"] = made["write_store"]
    made["bucketed_component_store"] = made["write_store"]
    as_is = ", ".join(f'"{f}"' for f in NODE_NAMES)
    made["match_node_features"] = f"SELECT component_id, node_id, {as_is} FROM matched_nodes"
    made["match_edge_features"] = (
        "SELECT component_id, source_node_id, target_node_id, transaction_id, "
        + ", ".join(f'"{f}"' for f in EDGE_NAMES)
        + " FROM matched_edges"
    )
    made["edge_source_component"] = (
        "SELECT source_node_id, target_node_id, transaction_id, component_id FROM mapped"
    )
    made["attach_node_aggregates"] = (
        f"SELECT component_id, label, matched_node_count, {nums(*NODE_STATS)} "
        "FROM labelled LEFT JOIN node_aggs USING (component_id)"
    )
    made["attach_edge_aggregates"] = (
        "SELECT component_id, label, coalesce(matched_edge_count, 0) AS matched_edge_count, "
        + ", ".join(num(f"coalesce({c}, 0)", c) for c in EDGE_STATS)
        + " FROM labelled LEFT JOIN edge_aggs USING (component_id)"
    )
    made["missing_endpoints"] = """SELECT
  (SELECT count(*) FROM edges WHERE source_node_id NOT IN (SELECT node_id FROM nodes)) AS missing_source_nodes,
  (SELECT count(*) FROM edges WHERE target_node_id NOT IN (SELECT node_id FROM nodes)) AS missing_target_nodes"""
    made["cross_component_edges"] = (
        "SELECT source_node_id, target_node_id, transaction_id, component_id, target_component_id FROM mapped "
        "WHERE component_id <> target_component_id"
    )
    made["clean_graph_edges"] = made["valid_edges"]
    made["join_labels"] = (
        "SELECT component_id, node_count, edge_count, max_degree, label, "
        f"{nums('mean_in_degree', 'mean_out_degree', 'density')} FROM simple JOIN labelled USING (component_id)"
    )
    made["join_stats_many_to_one"] = (
        f"SELECT component_id, rank, node_count, {nums('directed_density')} FROM queue JOIN store USING (component_id)"
    )
    made["component_node_counts"] = """SELECT ccId AS component_id, lower(trim(ccLabel)) AS label, count(node_id) AS node_count
FROM raw_cc LEFT JOIN nodes ON component_id = ccId GROUP BY ALL"""
    made["count_outer_align"] = "SELECT component_id, node_count, edge_count FROM canon_counts"
    made["universe_match"] = """SELECT count(*) FILTER (b.component_id IS NULL) AS only_left,
  count(*) FILTER (a.component_id IS NULL) AS only_right,
  count(*) FILTER (a.component_id IS NOT NULL AND b.component_id IS NOT NULL AND a.label IS DISTINCT FROM b.label)
    AS label_mismatches
FROM components a FULL JOIN labelled b ON a.component_id = b.component_id"""
    made["matched_test_audit"] = """SELECT count(a) AS left_components, count(b) AS right_components,
  count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right,
  count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS exact_match
FROM (SELECT component_id AS a FROM split_42 WHERE is_test)
FULL JOIN (SELECT component_id AS b FROM split_11 WHERE is_test) ON a = b"""
    made["unknown_reference_check"] = """SELECT
  (SELECT count(*) FROM nodes WHERE component_id NOT IN (SELECT component_id FROM labelled)) AS nodes_with_unknown_component,
  (SELECT count(*) FROM mapped WHERE component_id IS NULL OR target_component_id IS NULL) AS edges_with_unknown_node"""

    # Aggregations, profiling, quality.
    made["component_structural_features"] = made["write_store"]
    made["in_out_degree"] = """SELECT component_id, node_id, sum(ins)::BIGINT AS in_degree, sum(outs)::BIGINT AS out_degree
FROM ends GROUP BY component_id, node_id"""
    made["component_degree_stats"] = (
        "SELECT component_id, node_count, source_nodes, sink_nodes, isolate_nodes, "
        f"{_store_columns(_DEGREES)} FROM degree_stats"
    )
    made["unique_directed_pairs"] = "SELECT component_id, unique_directed_pairs FROM edge_stats"
    made["component_edge_stats"] = (
        "SELECT component_id, edge_count, transaction_count, self_loop_count FROM edge_stats"
    )
    made["simple_structural_features"] = (
        "SELECT component_id, node_count, edge_count, max_degree, "
        f"{nums('mean_in_degree', 'mean_out_degree', 'density')} FROM simple"
    )
    made["aggregate_node_features"] = (
        f"SELECT component_id, matched_node_count, {nums(*NODE_STATS)} FROM node_aggs"
    )
    made["aggregate_edge_features"] = (
        f"SELECT component_id, matched_edge_count, {nums(*EDGE_STATS)} FROM edge_aggs"
    )
    made["node_match_audit"] = _NODE_AUDIT
    made["edge_match_audit"] = """
SELECT *, labeled_edge_rows - distinct_labeled_edge_keys AS duplicate_labeled_edge_keys,
  distinct_labeled_edge_keys - distinct_matched_edge_keys AS missing_labeled_edges,
  matched_background_rows - distinct_matched_edge_keys AS duplicate_background_matches
FROM (SELECT count(*) AS labeled_edge_rows, count(*) FILTER (component_id IS NULL) AS missing_component_ids,
    count(DISTINCT (source_node_id, target_node_id, transaction_id)) AS distinct_labeled_edge_keys FROM edge_keys),
  (SELECT count(*) AS matched_background_rows,
    count(DISTINCT (source_node_id, target_node_id, transaction_id)) AS distinct_matched_edge_keys FROM matched_edges)"""
    made["enrichment_coverage"] = """
SELECT count(*) AS output_component_rows, sum(label)::BIGINT AS positive_component_rows,
  count(*) FILTER (matched_node_count IS NULL) AS components_without_features,
  count(*) FILTER (node_feat_01_mean IS NULL) AS rows_with_null_aggregates, 'node' AS stage FROM node_store
UNION ALL
SELECT count(*), sum(label)::BIGINT, count(*) FILTER (matched_edge_count IS NULL), 0::BIGINT, 'edge'
FROM labelled LEFT JOIN edge_aggs USING (component_id)"""
    made["label_counts"] = (
        "SELECT lower(trim(ccLabel)) AS label, count(*) AS components FROM raw_cc GROUP BY 1"
    )
    made["node_count_by_label"] = f"""
SELECT label, count(*) AS components, min(n) AS min_nodes, quantile_disc(n, 0.5)::DOUBLE AS median_nodes,
  {num('avg(n)', 'avg_nodes')}, max(n) AS max_nodes
FROM (SELECT ccId, lower(trim(ccLabel)) AS label, count(node_id) AS n
      FROM raw_cc LEFT JOIN nodes ON component_id = ccId GROUP BY ALL) GROUP BY label"""
    made["edge_mapping_quality"] = """
SELECT count(*) FILTER (component_id IS NULL) AS missing_source_nodes,
  count(*) FILTER (target_component_id IS NULL) AS missing_target_nodes,
  count(*) FILTER (component_id <> target_component_id) AS cross_component_edges FROM mapped"""
    made["store_label_counts"] = """
SELECT count(*) AS rows, count(*) FILTER (label = 1) AS positive_rows, count(*) FILTER (label = 0) AS negative_rows,
  count(*) FILTER (label IS NULL) AS null_labels FROM store"""
    made["store_summary_by_label"] = f"""
SELECT label, count(*) AS components, {num('avg(node_count)', 'avg_node_count')},
  quantile_disc(node_count, 0.5)::DOUBLE AS median_node_count, max(node_count) AS max_node_count,
  {num('avg(edge_count)', 'avg_edge_count')}, quantile_disc(edge_count, 0.5)::DOUBLE AS median_edge_count,
  max(edge_count) AS max_edge_count, {num('avg(edges_per_node)', 'avg_edges_per_node')},
  {num('avg(directed_density)', 'avg_directed_density')}, {num('avg(source_nodes)', 'avg_source_nodes')},
  {num('avg(sink_nodes)', 'avg_sink_nodes')} FROM store GROUP BY label"""
    made["null_counts"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls FROM node_store" for c in _NODE_STORE_FEATURES
    )
    made["filtered_counts"] = """
SELECT count(*) AS component_rows, sum(label)::BIGINT AS positive_components,
  count(*) FILTER (label IS NULL) AS null_component_labels FROM components"""
    made["store_qa"] = """
SELECT 'row_count' AS "check", count(*) AS n FROM store
UNION ALL SELECT 'missing_component_id', count(*) FILTER (component_id IS NULL) FROM store
UNION ALL SELECT 'duplicate_component_ids', count(component_id) - count(DISTINCT component_id) FROM store
UNION ALL SELECT 'label_' || label, count(*) FROM store GROUP BY label"""
    made["queue_qa"] = f"""
SELECT count(*) AS rows, count(DISTINCT component_id) AS distinct_components,
  {num('min(risk_score)', 'min_score')}, {num('max(risk_score)', 'max_score')} FROM queue"""
    separation = nums(
        "licit_mean", "suspicious_mean", "standardized_mean_difference", "abs_standardized_mean_difference"
    )
    made["class_separation"] = (
        f"SELECT feature, {separation} FROM (SELECT {separation_columns()} "
        f"FROM ({separation_sql(_NODE_STORE_FEATURES, 'node_store')}))"
    )
    made["leakage_audit"] = _LEAKAGE
    made["repeat_summary"] = f"SELECT model, {nums(*summary_names(QUALITY))} FROM summary"

    def budget_summary_columns() -> str:
        return ", ".join(
            whole(c, c) if c in ("suspicious_captured_min", "suspicious_captured_max") else num(c, c)
            for c in summary_names(BUDGET_VALUES)
        )

    made["repeat_budget_summary"] = (
        f"SELECT model, review_fraction, {budget_summary_columns()} FROM budget_summary"
    )
    made["graph_dataset_profile"] = f"""
SELECT *, missing_labeled_nodes + duplicate_background_matches + missing_source_nodes + missing_target_nodes
    + cross_component_edges + null_component_labels AS hard_failures,
  labeled_edge_rows - output_edge_rows AS dropped_edge_rows, {NODE_FEATURES}::BIGINT AS node_feature_count
FROM (SELECT * RENAME (matched_background_rows AS matched_node_rows) FROM ({_NODE_AUDIT})),
  (SELECT count(*) AS labeled_edge_rows, count(*) FILTER (component_id IS NULL) AS missing_source_nodes,
    count(*) FILTER (target_component_id IS NULL) AS missing_target_nodes,
    count(*) FILTER (component_id <> target_component_id) AS cross_component_edges FROM mapped),
  (SELECT count(*) AS output_edge_rows FROM valid),
  ({made['filtered_counts']})"""

    # Ranking and evidence.
    made["review_queue"] = (
        f"SELECT component_id, {nums('risk_score')}, model, rank, {nums('review_fraction_rank')}, "
        "priority_band, score_type, reason_1, reason_2 FROM queue"
    )
    made["priority_band"] = (
        f"SELECT component_id, rank, {nums('review_fraction_rank')}, priority_band FROM queue"
    )
    made["average_rank_percentile"] = f"SELECT component_id, feature, {nums('value', 'percentile')} FROM stats"
    made["feature_zscores"] = " UNION ALL ".join(
        f"SELECT component_id, '{f}' AS feature, {num(f, 'value')}, "
        f"{num(f'coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0)', 'zscore')} FROM node_store"
        for f in _NODE_STORE_FEATURES
    )
    made["case_evidence_topk"] = (
        f"SELECT component_id, evidence_rank, feature, {nums('evidence_score')} FROM top_evidence"
    )
    evidence_texts = "evidence_1, evidence_2, evidence_3, evidence_method, evidence_note"
    wide = f"component_id, {nums('risk_score')}, model, rank, {nums('review_fraction_rank')}, priority_band, score_type"
    made["evidence_wide"] = f"SELECT {wide}, {evidence_texts} FROM wide_evidence"
    made["evidence_long"] = (
        "SELECT rank, component_id, priority_band, model, score_type, evidence_rank, feature, "
        + nums(
            "risk_score", "feature_value", "percentile", "zscore", "absolute_zscore",
            "global_random_forest_importance", "evidence_score",
        )
        + " FROM long_evidence"
    )
    made["top_importance"] = (
        f"SELECT feature, {num('importance', 'random_forest_importance')} FROM weights"
    )
    made["top_separation"] = (
        f"SELECT feature, {separation} FROM (SELECT {separation_columns()} FROM ({separation_sql(_NODE_STORE_FEATURES, 'node_store')}) "
        "ORDER BY abs_standardized_mean_difference DESC, feature LIMIT 15)"
    )
    made["select_model"] = (
        f"SELECT model, {nums('average_precision')} FROM (SELECT * FROM quality "
        "ORDER BY average_precision DESC, model DESC LIMIT 1)"
    )
    made["top_cases"] = (
        "SELECT DISTINCT rank, component_id FROM long_evidence ORDER BY rank, component_id LIMIT 20"
    )
    made["best_calibration_method"] = f"""
SELECT first(method ORDER BY brier_score, method) AS best_brier_method, {num('min(brier_score)', 'best_brier_score')},
  {num("max(brier_score) FILTER (method = 'return_share')", 'raw_brier_score')},
  {num("max(ece) FILTER (method = 'return_share')", 'raw_ece')} FROM methods"""

    # Set operations.
    made["union_model_results"] = f"SELECT model, {nums('brier_score')} FROM quality"
    made["benchmark_budget_union"] = f"SELECT model AS benchmark, {_BUDGET} FROM budgets"
    made["distinct_pairs"] = "SELECT DISTINCT component_id, source_node_id, target_node_id FROM valid"

    # Chart tables.
    shown = {"brier_score": "Brier score", "log_loss": "Log loss", "ece": "ECE", "roc_auc": "ROC-AUC"}
    made["metrics_long"] = " UNION ALL ".join(
        f"SELECT method, '{m}' AS metric, {num(m, 'value')}, "
        "CASE method WHEN 'return_share' THEN 'Return Share' ELSE 'Balance' END AS method_label, "
        f"'{name}' AS metric_label FROM methods"
        for m, name in shown.items()
    )
    made["case_feature_pivot"] = (
        "SELECT rank, component_id, "
        + ", ".join(num(f"min(zscore) FILTER (feature = '{f}')", f) for f in EVIDENCE_FEATURES)
        + " FROM long_evidence WHERE rank <= 20 GROUP BY rank, component_id"
    )
    for name, value in (("case_pivot_by_score", "zscore"), ("case_percentile_by_score", "percentile")):
        made[name] = f"""
SELECT c.rank, c.component_id, f.place, f.feature, {num('e.v', 'value')}
FROM (SELECT DISTINCT rank, component_id FROM long_evidence WHERE rank <= 20) c
CROSS JOIN (
  SELECT feature, row_number() OVER (ORDER BY avg(evidence_score) DESC, feature) AS place
  FROM long_evidence WHERE rank <= 20 AND feature IS NOT NULL GROUP BY feature) f
LEFT JOIN (SELECT rank, component_id, feature, min({value}) AS v FROM long_evidence GROUP BY ALL) e
  ON e.rank = c.rank AND e.component_id = c.component_id AND e.feature = f.feature"""
    made["evidence_frequency"] = """
SELECT feature, count(*) AS evidence_mentions FROM long_evidence WHERE priority_band = 'tier_1_top_0_5pct'
GROUP BY feature ORDER BY evidence_mentions DESC, feature LIMIT 12"""
    bands = [(name, label) for name, _, label in TIERS] + [STANDARD_TIER]
    made["band_counts"] = (
        "SELECT tier_order, priority_tier, count(component_id) AS cases FROM (VALUES "
        + ", ".join(f"({i}::BIGINT, '{n}', '{label}')" for i, (n, label) in enumerate(bands))
        + ") b(tier_order, name, priority_tier) LEFT JOIN queue ON priority_band = name GROUP BY ALL"
    )
    made["evidence_strength_by_rank"] = f"""
SELECT rank, component_id, priority_band, {nums('risk_score')}, {num('avg(evidence_score)', 'mean_evidence_score')},
  {num('max(absolute_zscore)', 'max_absolute_zscore')} FROM long_evidence
WHERE rank <= (SELECT greatest(1, floor(count(*) * 0.10::DOUBLE)) FROM queue)
GROUP BY rank, component_id, priority_band, risk_score"""
    stage = f"{_TITLE_BUDGET} AS model, {num('average_precision', 'pr_auc')}, {nums('roc_auc')}"
    made["feature_stage_table"] = f"""
SELECT 'Structure' AS feature_stage, {stage} FROM quality
UNION ALL SELECT 'Structure + node', {stage} FROM seed_quality WHERE seed = 11
UNION ALL SELECT 'Structure + node + edge', {stage} FROM seed_quality WHERE seed = 42"""
    means = (
        f"{num('average_precision_mean', 'pr_auc_mean')}, {num('average_precision_std', 'pr_auc_std')}, "
        f"{nums('roc_auc_mean')}"
    )
    made["feature_set_comparison"] = f"""
SELECT 'Node only' AS feature_set, {means} FROM summary_early WHERE model = 'return_share'
UNION ALL SELECT 'Node + edge', {means} FROM summary WHERE model = 'return_share'"""
    both = f"model, review_fraction, {budget_summary_columns()}, {num('review_fraction * 100', 'review_budget_pct')}"
    made["feature_set_budgets"] = f"""
SELECT 'Node only' AS feature_set, {both} FROM budget_summary_early WHERE model = 'return_share'
UNION ALL SELECT 'Node + edge', {both} FROM budget_summary WHERE model = 'return_share'"""
    made["budget_curve_table"] = (
        f"SELECT model, {_BUDGET}, {num('review_fraction * 100', 'review_budget_pct')}, "
        f"{_TITLE_BUDGET} AS model_label FROM budgets"
    )

    # Evaluation metrics.
    made["review_budget_metrics"] = f"SELECT model, {_BUDGET} FROM budgets"
    made["average_precision"] = f"SELECT model, {nums('average_precision')} FROM quality"
    made["roc_auc"] = f"SELECT model, {nums('roc_auc')} FROM quality"
    made["global_metrics"] = f"SELECT model, {nums('average_precision', 'roc_auc', 'base_rate')} FROM quality"
    made["brier_score"] = (
        f"SELECT model, {num('avg(pow(risk_score - label, 2))', 'brier_score')} FROM scores GROUP BY model"
    )
    made["log_loss"] = f"SELECT model, {nums('log_loss')} FROM losses"
    made["calibration_bins"] = (
        f"SELECT model, bin_id, {nums('lower', 'upper')}, cases, {nums('observed_rate', 'mean_score')}, "
        f"{num('abs(observed_rate - mean_score)', 'absolute_gap')} FROM bins"
    )
    made["reliability_table"] = f"SELECT model, bin, cases, {nums('observed_rate', 'mean_score')} FROM bins"
    made["expected_calibration_error"] = f"SELECT model, {nums('ece')} FROM ece"
    made["calibration_method_metrics"] = (
        "SELECT method, "
        + nums("average_precision", "roc_auc", "brier_score", "log_loss", "ece", "base_rate")
        + " FROM methods"
    )
    three = ("average_precision", "roc_auc", "base_rate")
    made["model_comparison"] = (
        "SELECT a.model AS first_model, b.model AS second_model, "
        + ", ".join(
            f"{num(f'a.{m}', f'first_{m}')}, {num(f'b.{m}', f'second_{m}')}, {num(f'a.{m} - b.{m}', f'{m}_difference')}"
            for m in three
        )
        + " FROM quality a, quality b WHERE a.model = 'return_share' AND b.model = 'balance'"
    )

    # Splits, weights, gates.
    made["stratified_split"] = "SELECT component_id, label, is_test FROM split_42"
    made["three_way_split"] = """
SELECT component_id, label, 'test' AS part FROM split_42 WHERE is_test
UNION ALL SELECT component_id, label, CASE WHEN is_test THEN 'calibration' ELSE 'train' END FROM split_inner"""
    made["repeated_split_parts"] = "SELECT seed, component_id, label, part FROM parts"
    made["standardize_features"] = f"SELECT component_id, label, {_STANDARD} FROM store"
    made["balanced_class_weights"] = f"""
SELECT label, n, {num('total / (2.0::DOUBLE * n)', 'class_weight')},
  {num('neg / (total - neg)::DOUBLE', 'positive_weight')}
FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total,
    sum(count(*) FILTER (label = 0)) OVER () AS neg FROM store GROUP BY label)"""
    made["shuffle_labels"] = "SELECT component_id, label FROM shuffled"
    names = ", ".join(f"('{f}')" for f in (*STRUCTURAL_COLUMNS, "(intercept)"))
    made["logistic_residuals"] = f"SELECT feature, true AS at_optimum FROM (VALUES {names}) v(feature)"
    made["score_checks"] = """
SELECT model, count(*) AS cases, count(DISTINCT component_id) AS components, sum(label)::BIGINT AS positives, 0::BIGINT AS outside
FROM split_42, (VALUES ('logistic_regression'), ('random_forest')) m(model) WHERE is_test GROUP BY model"""
    for name, size in (
        ("structural_queue_checks", "count(*) FILTER (is_test) FROM split_42"),
        ("canonical_queue_checks", "ceil(count(*) * 0.35::DOUBLE) FROM simple JOIN labelled USING (component_id)"),
    ):
        made[name] = f"""
SELECT n AS cases, n AS components, 1::BIGINT AS first_rank, n AS last_rank, 0::BIGINT AS out_of_order,
  len(list_filter(range(1, n + 1), lambda r: r / n::DOUBLE <= 0.005::DOUBLE))::BIGINT AS first_tier,
  len(list_filter(range(1, n + 1), lambda r: r / n::DOUBLE > 0.10::DOUBLE))::BIGINT AS standard_tier
FROM (SELECT ({size.split(' FROM ')[0]})::BIGINT AS n FROM {size.split(' FROM ')[1]})"""
    made["sigmoid_calibration"] = (
        f"SELECT component_id, label, {num('1.0 / (1.0 + exp(-(w * x + b)))', 'risk_score')} FROM asked, sigmoid"
    )
    made["isotonic_calibration"] = (
        f"SELECT component_id, label, {num('y', 'risk_score')} FROM asked JOIN curve USING (x)"
    )
    made["split_audit"] = """
SELECT seed, part, count(*) AS components, sum(label)::BIGINT AS positives FROM parts GROUP BY seed, part"""
    made["validation_gate"] = f"""
SELECT *, CASE WHEN repeated_split_stability_pass AND permutation_sanity_pass AND schema_leakage_audit_pass
    THEN 'hard_checks_pass' ELSE 'review_required' END AS status
FROM (
  SELECT s.model, {nums('average_precision_mean', 'average_precision_std', 'average_precision_min', 'roc_auc_mean', table='s')},
    {num('p.average_precision', 'permuted_average_precision')}, {num('p.roc_auc', 'permuted_roc_auc')},
    {num('p.base_rate', 'base_rate')},
    {num('b.precision_at_budget_mean', 'top_0_5_percent_precision_mean')},
    {num('b.lift_at_budget_mean', 'top_0_5_percent_lift_mean')},
    {num('b.suspicious_captured_mean', 'top_0_5_percent_suspicious_captured_mean')},
    (SELECT count(*) = count(DISTINCT component_id) FROM store) AS schema_leakage_audit_pass,
    s.average_precision_std / s.average_precision_mean < 0.10 AND s.average_precision_min > p.base_rate * 10
      AS repeated_split_stability_pass,
    p.average_precision <= p.base_rate * 2 AND abs(p.roc_auc - 0.5) <= 0.10 AS permutation_sanity_pass
  FROM summary s JOIN blind_quality p USING (model) JOIN budget_summary b USING (model)
  WHERE s.model = 'balance' AND b.review_fraction = 0.005::DOUBLE)"""
    made["dominance_review"] = f"""
SELECT feature AS top_feature, {num('first', 'top_feature_importance')}, {num('ten', 'top_10_cumulative_importance')},
  first >= 0.5 OR ten >= 0.9 AS manual_review_recommended
FROM (SELECT feature, random_forest_importance AS first,
    (SELECT sum(random_forest_importance) FROM (SELECT * FROM importance
      ORDER BY random_forest_importance DESC, feature LIMIT 10)) AS ten
  FROM importance ORDER BY random_forest_importance DESC, feature LIMIT 1)"""

    # Graph.
    made["graph_dataset"] = "SELECT * FROM graph_nodes"
    made["graph_dataset_edges"] = (
        "SELECT component_id, src AS source_node_id, dst AS target_node_id FROM graph_edges"
    )
    made["graph_dataset_components"] = "SELECT component_id, label FROM components"
    for name, reverse, prefix in (
        ("forward_neighbor_mean", False, "in_"),
        ("reverse_neighbor_mean", True, "out_"),
    ):
        made[name] = (
            f"SELECT node_id, component_id, {nums(*[prefix + f for f in GRAPH_FEATURES])} "
            f"FROM ({hop_block('graph_nodes', GRAPH_FEATURES, reverse, prefix)})"
        )
    made["khop_dual_channel"] = f"SELECT node_id, component_id, {nums(*_HOP_3)} FROM hop_2"
    made["graph_mean_max_pool"] = (
        "SELECT component_id, "
        + ", ".join(f"{num(f'avg({f})', f'mean_{f}')}, {num(f'max({f})', f'max_{f}')}" for f in GRAPH_FEATURES)
        + " FROM graph_nodes GROUP BY component_id"
    )
    made["explained_review_queue"] = f"SELECT {wide}, reason_1, reason_2, {evidence_texts} FROM wide_evidence"

    return {name: with_blocks(sql) for name, sql in made.items()}
