"""Queries against their SQL on rows that share a hit_id, as a few do among many millions, and on figures that end in a half."""

from pathlib import Path

import duckdb
import pytest

from hitweave import registry
from hitweave.plans import proxy
from tests.test_oracles import SF, TABLES, plain

#: Steps of the part whose step of the supplier leaves the 20 bits of hit_id as they were: near in time, scattered, markers.
STEPS = (1, 7, 31, 10, 50, 13, 20, 90)


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The smallest tables with a second row for the hit_id of each 40th row; no two of them also share their time."""
    folder = tmp_path_factory.mktemp("sf")
    con = duckdb.connect()
    undo = pow(40503, -1, 2**20)
    steps = ", ".join(f"({i}, {p}, {-p * 2654435761 * undo % 2**20})" for i, p in enumerate(STEPS))
    con.execute(f"""COPY (WITH q AS (SELECT *, file_row_number AS i FROM read_parquet('{SF}/lineitem.parquet', file_row_number=true)) SELECT * EXCLUDE (i, file_row_number) FROM q UNION ALL
SELECT q.* EXCLUDE (i, file_row_number) REPLACE (l_partkey+p AS l_partkey, l_suppkey+s AS l_suppkey) FROM q JOIN (VALUES {steps}) v(k, p, s) ON i//40%{len(STEPS)}=k WHERE i%40=0) TO '{folder}/lineitem.parquet' (FORMAT parquet)""")
    for t in TABLES:
        if t != "lineitem":
            Path(folder, f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    return str(folder)


def differences(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*cols).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    return [(a, b) for a, b in zip(got, want) if a != b], len(got) - len(want)


def test_ids_are_shared(shared):
    n, ids = duckdb.sql(f"WITH {proxy.HITS.replace('FROM lineitem', f"FROM '{shared}/lineitem.parquet'")} SELECT count(*), count(DISTINCT hit_id) FROM h").fetchall()[0]
    assert n - ids > 50


FINDINGS = ["dbscan_labels", "stream_link_labels", "flagship_particles", "core_points", "dbscan_min3_labels", "adjusted_rand", "audit_totals", "candidate_features", "chunk_rows", "cluster_sizes", "dense_grids", "dilated_support", "edge_window_hits", "edge_components", "edge_labels", "edge_vectors", "edge_attributes"]


@pytest.mark.parametrize("name", FINDINGS)
def test_as_sql(spark, shared, name):
    assert differences(spark, shared, name) == ([], 0)


def test_slabs_of_shared_ids(spark, shared):
    from hitweave.operators.cluster import dbscan

    h = proxy.hits(spark, shared)
    for least in (2, 3):
        whole, cut = (dbscan(spark, h, min_samples=least, slab_ticks=t).collect() for t in (2**20, 16))
        assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def test_edge_figures_round_in_binary(spark):
    from hitweave.operators.edge_windows import edge_vectors

    hits = spark.createDataFrame([(0, 1, 100, 100, 0, 5), (0, 2, 31, 24, 6, 5)], "source long, hit_id long, x long, y long, fine long, tot long")
    edges = spark.createDataFrame([(0, 1, 2, 4)], "source long, src long, dst long, edge_type int")
    row = edge_vectors(edges, hits).first()
    assert row.dist_xyt == duckdb.sql("SELECT round(sqrt(dx*dx+dy*dy+dt*dt), 6) FROM (SELECT -69/128.0::DOUBLE AS dx, -76/128.0::DOUBLE AS dy, 6/10.0::DOUBLE AS dt)").fetchall()[0][0] == 1.001562


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Two particles of one cell each, whose energies end in a half of a thousandth and are stored a little below it."""
    folder = tmp_path_factory.mktemp("halves")
    tots = {1: [1, 20, 25, 26, 30, 31, 33, 42, 43], 500: [4, 12, 13, 22, 23, 33, 37, 39, 43]}
    values = ", ".join(f"({o}::BIGINT, 7::BIGINT, 3::BIGINT, 1::INTEGER, {t}::DOUBLE)" for o, ts in tots.items() for t in ts)
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) v(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


def test_dense_rows_round_in_binary(spark, halves):
    assert sorted(r.dense for r in registry.QUERIES["dense_grids"](spark, halves).collect()) == ["164:4.005", "164:4.077"]
    assert differences(spark, halves, "dense_grids") == ([], 0)


def test_dense_rows_of_gaps_and_ends(spark):
    from hitweave.operators.paths import dense

    grid = spark.createDataFrame([(1, 0, 2.0), (1, 3, 4.0), (1, 3, 1.0), (2, 1, 5.0), (3, 4, 9.0), (3, -1, 9.0)], "label long, voxel int, value double")
    assert {r.label: r["values"] for r in dense(grid, 4).collect()} == {1: [2.0, 0.0, 0.0, 5.0], 2: [0.0, 5.0, 0.0, 0.0], 3: [0.0] * 4}
