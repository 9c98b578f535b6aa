"""The feature table: node profiles with every graph feature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Config
from ledgerloom.functions.scalar import flow_ratio
from ledgerloom.operators import iterative, motifs
from ledgerloom.session import released

# The columns of the models in their order (it decides which ones a tree samples): behavioural ones, topological
# ones of the models, and those of the pruning; the scores that are ranked, and the heuristics among the graph features.
BEHAVIOURAL = ("vol_sent", "vol_recv", "tx_count", "time_variance", "flow_ratio", "distinct_currencies_sent", "distinct_currencies_recv", "wire_count_sent", "cash_count_sent", "bitcoin_count_sent", "cheque_count_sent", "credit_card_count_sent", "ach_count_sent", "reinvestment_count_sent", "wire_count_recv", "cash_count_recv", "bitcoin_count_recv", "cheque_count_recv", "credit_card_count_recv", "ach_count_recv", "reinvestment_count_recv")
TOPOLOGICAL = ("pr_vol_deep", "pr_vol_shallow", "pr_count", "leiden_macro_modularity", "leiden_micro_modularity", "betweenness", "k_core", "hits_hub", "hits_auth", "leiden_macro_size", "leiden_micro_size", "degree", "in_degree", "out_degree", "fan_out_count", "fan_in_count", "cycle_count", "egonet_node_count", "egonet_edge_count", "egonet_density", "egonet_total_weight", "local_clustering_coefficient", "triangle_count", "average_neighbor_degree", "successor_avg_volume", "successor_max_volume", "temporal_fan_out_count", "temporal_fan_in_count")
PRUNED_TOPOLOGICAL = ("pr_vol_deep", "pr_vol_shallow", "pr_count", "hits_hub", "hits_auth", "leiden_macro_size", "leiden_macro_modularity", "leiden_micro_size", "leiden_micro_modularity", "betweenness", "k_core", "degree", "in_degree", "out_degree", "fan_out_count", "fan_in_count", "scatter_gather_count", "gather_scatter_count", "cycle_count", "egonet_node_count", "egonet_edge_count", "egonet_density", "egonet_total_weight", "local_clustering_coefficient", "triangle_count", "average_neighbor_degree", "successor_avg_volume", "successor_max_volume")
RANKED = ("pr_vol_deep", "pr_vol_shallow", "pr_count", "hits_hub", "hits_auth", "betweenness", "k_core", "egonet_node_count", "egonet_edge_count", "egonet_density", "egonet_total_weight", "local_clustering_coefficient", "triangle_count", "average_neighbor_degree", "successor_avg_volume", "successor_max_volume", "vol_sent", "vol_recv", "in_degree", "out_degree", "tx_count", "time_variance", "wire_count_sent", "wire_count_recv", "cash_count_sent", "cash_count_recv", "bitcoin_count_sent", "bitcoin_count_recv", "cheque_count_sent", "cheque_count_recv", "credit_card_count_sent", "credit_card_count_recv", "ach_count_sent", "ach_count_recv", "reinvestment_count_sent", "reinvestment_count_recv", "distinct_currencies_sent", "distinct_currencies_recv")
HEURISTICS = ("pr_vol_deep", "pr_vol_shallow", "pr_count", "hits_hub", "hits_auth", "betweenness", "k_core", "degree", "in_degree", "out_degree", "egonet_node_count", "egonet_edge_count", "egonet_density", "egonet_total_weight", "local_clustering_coefficient", "triangle_count", "average_neighbor_degree", "successor_avg_volume", "successor_max_volume")
#: Values of entities that an extractor has no row for; all others are 0.
DEFAULTS = {"leiden_macro_id": -1, "leiden_micro_id": -1, "egonet_node_count": 1}
#: Constant columns that readers of the table expect.
CONSTANTS = {"weirdnodes_magnitude": 0.0, "weirdnodes_residual": 0.0, "is_riser": 0, "is_faller": 0}


def join_features(nodes: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Left joins on (window_id, entity_id), with defaults for missing values. All parts are hashed alike, so each is shuffled once."""
    out = nodes
    for part in parts:
        out = out.join(part, ["window_id", "entity_id"], "left")
    new = {f.name: f.dataType.simpleString() for part in parts for f in part.schema if f.name not in ("window_id", "entity_id")}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(DEFAULTS.get(c, 0)).cast(kind)) for c, kind in new.items()})


#: An extractor takes the edges of all windows and the parameters, and returns columns keyed by window_id and entity_id.
Extractor = Callable[[DataFrame, Config], DataFrame]


def _communities(kind: str, gamma: float) -> Extractor:
    names = ("leiden_id", "leiden_size", "leiden_modularity")
    return lambda edges, config: iterative.communities(edges, gamma, config).select("window_id", "entity_id", *(F.col(c).alias(c.replace("leiden", f"leiden_{kind}")) for c in names))


#: The extractors of the feature table by name; others can be added to a copy.
EXTRACTORS: dict[str, Extractor] = {
    "pagerank_deep": lambda edges, config: iterative.pagerank(edges, config.alpha_deep, "volume", "pr_vol_deep", config=config),
    "pagerank_shallow": lambda edges, config: iterative.pagerank(edges, config.alpha_shallow, "volume", "pr_vol_shallow", config=config),
    "pagerank_count": lambda edges, config: iterative.pagerank(edges, config.alpha_deep, "count", "pr_count", config=config),
    "hits": lambda edges, config: iterative.hits(edges, config=config),
    "leiden_macro": _communities("macro", 1.0),
    "leiden_micro": _communities("micro", 2.0),
    "betweenness": lambda edges, config: iterative.betweenness(edges, config),
    "k_core": lambda edges, config: iterative.k_core(edges, config),
    "fans": lambda edges, config: motifs.fans(edges, config),
    "scatter_gather": lambda edges, config: motifs.scatter_gather(edges, config),
    "cycles": lambda edges, config: motifs.cycles(edges, config.cycle_length, config),
    "egonet": lambda edges, config: motifs.egonets(edges),
    "clustering": lambda edges, config: motifs.clustering(edges),
    "triangles": lambda edges, config: motifs.triangle_counts(edges),
    "neighbours": lambda edges, config: motifs.neighbours(edges),
}


def extract(nodes: DataFrame, edges: DataFrame, config: Config = DEFAULT, extractors: dict[str, Extractor] = EXTRACTORS) -> DataFrame:
    """nodes with flow_ratio, the columns of all extractors and the constant columns.

    The edges are computed once, and so are the nodes and the columns of each extractor, one after the other: the
    shuffles of all of them would else lie on disk side by side until the last row is out.
    """
    nodes, edges = released(nodes), released(edges)
    out = join_features(nodes, [released(f(edges, config)) for f in extractors.values()]).withColumn("flow_ratio", flow_ratio(F.col("vol_sent"), F.col("vol_recv")))
    return out.withColumns({c: F.lit(v) for c, v in CONSTANTS.items()})
