"""Community search: from queries (query_id, node) to communities (query_id, node)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import biased, local, scored, structural

#: The methods by name; each takes (edges, queries, **parameters) and returns ``query_id, node``.
METHODS = {
    "kcore": structural.kcore,
    "ktruss": structural.ktruss,
    "kclique": structural.kclique,
    "kclique_densest": structural.kclique_densest,
    "kecc": structural.kecc,
    "ppr": local.ppr_nibble,
    "lm": local.local_modularity,
    "sgm": local.subgraph_modularity,
    "dmcs": local.density_modularity,
    "qdc": local.query_biased_density,
    "qdcii": biased.densest_biased,
    "qdci": biased.contracted_density,
    "qdc_peel": biased.block_peeled,
    "qdc_auto": biased.best_biased,
    "steiner": biased.joined,
    "csformer": scored.core_hops,
}


def search(method: str, edges: DataFrame, queries: DataFrame, **parameters) -> DataFrame:
    """Communities of all queries by one method; a query that the method can't serve is its own community."""
    found = METHODS[method](edges, queries, **parameters)
    return with_defaults(found, queries)


def with_defaults(found: DataFrame, queries: DataFrame) -> DataFrame:
    missing = queries.select("query_id", "node").join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.select("query_id", "node").unionByName(missing).distinct()
