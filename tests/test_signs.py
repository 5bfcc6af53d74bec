"""Queries on vectors and their SQL agree to the bit, the sign of zero included."""

import struct

import duckdb
import pytest

from skeinworks.plans import catalog, catalog_more  # noqa: F401

NAMES = ["f11_tensor_layout", "f4_flip_component", "f5_weighted_mean", "f7_rotate_euler", "f8_rotate_tensor", "f9_vec_to_tensor", "g18_mask_and_normalize"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Numbers that round to zero from below and above, and ids beyond those of a small table."""
    folder = tmp_path_factory.mktemp("vectors")
    tiny = [1e-7, -1e-7, 1e-4, -1e-4, 0.5, -0.5, 0.0]
    rows = [(100 * i + i % 9, [float(tiny[(i + i // 7 * k + k) % 7]) for k in range(32)], i % 3) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return str(folder), con


def bits(rows):
    return sorted((r[0], *(b"".join(struct.pack("<d", x) for x in v) for v in r[1:])) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_bits(spark, tables, name):
    folder, con = tables
    want = con.sql(catalog.ORACLE[name])
    assert bits(catalog.QUERIES[name](spark, folder).select(*want.columns).collect()) == bits(want.fetchall())
