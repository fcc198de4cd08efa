"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from vicinal.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
SOME = ["cover_pvalue", "knn_exact", "knn_bucketed", "fuzzy_union", "coarsen_galerkin", "prediction_set", "trust_continuity", "path_ties_drop", "policy_tilt", "components_min_label", "landmark_backbone", "cross_entropy", "affinity_usage", "support_per_landmark", "novelty", "edge_lengths", "owned_net", "cover_counts", "bunches_by_mass", "landmark_bunches", "whole_graph", "geodesic_fidelity", "alias_law", "procrustes_anchor", "path_loss", "composite_scales", "class_order_hinge", "class_axis_report", "class_axis_positions", "null_marginals", "map_persistence", "class_region_set", "active_cell_rows", "density_budget", "knn_refreshed"]


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(ORACLES[name]).df())
