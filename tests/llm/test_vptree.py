"""Vantage-point trees against exhaustive search."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm import vptree
from visitstat.llm.queries import op11
from visitstat.llm.vptree import Search, Tree, inner_products, recall, search

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))] + [
    T.StructField(c, T.StringType()) for c in ("ids", "shard", "rank", "score", "row", "dim", "home")])


def made(seed, n, dim=6):
    """Clusters, noise, lengths of many orders, and ties."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    x = np.where(rng.random((n, 1)) < 0.5, centre[rng.integers(0, 5, n)] + 0.05 * rng.normal(size=(n, dim)), rng.normal(size=(n, dim)))
    x[::7] *= 10.0 ** rng.integers(-3, 4, (len(x[::7]), 1))
    x[::11] = np.eye(dim)[rng.integers(0, dim, len(x[::11]))]      # many equal products
    return x.astype(np.float32).astype(float)


def brute(rows, k):
    """[(query_id, rank, vec_id, score)] of rows (id, list)."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i is None or i % 20:
            continue
        found = [(-float(np.cumsum(q * v)[-1]), j is None, j or 0, m, j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q)]
        out += [(i, r + 1, f[4], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out)


ODD = [(20, None), (40, []), (60, [0.0] * 6), (80, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100, [float("nan")] + [1.0] * 5), (120, [float("inf")] + [1.0] * 5),
       (None, [1.0] * 6), (None, [2.0] * 6), (140, [1.0, 2.0]), (141, [3.0, -1.0]), (160, [5.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 7) for i, v in rows], VECTORS)


@pytest.mark.parametrize("seed,parts,shard_bytes,pilot", [(0, 1, 1 << 20, 16), (1, 4, 2_000, 2), (2, 8, 1, 3)])
def test_factor_one_is_exhaustive_search(spark, monkeypatch, seed, parts, shard_bytes, pilot):
    monkeypatch.setattr(vptree, "PILOT", pilot)
    x = made(seed, 400)
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(x)] + ODD
    rows += [(3000 + i, x[4].tolist()) for i in range(90)]                    # copies, some of them queries
    rows += [rows[60], rows[60]]                                              # a query's row three times
    for group in (10**6, 7):
        got = search(frame(spark, rows).repartition(parts), F.col("vec_id") % 20 == 0, leaf=8, shard_bytes=shard_bytes, group=group)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_few_rows_and_none(spark):
    rows = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [0.0, 1.0])]
    assert sorted(tuple(r) for r in search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()) == brute(rows, 20)
    assert search(frame(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert search(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert search(frame(spark, ODD[:3]), F.col("vec_id") % 20 == 0).collect() == []


def exact_of(x, queries, k):
    tree = Tree(x, 16)
    s = Search(tree, queries, np.full(len(queries), -np.inf), k, 1.0)
    s.run()
    return s


def test_pruning_and_the_factor():
    """Factor one is exact and prunes clustered data; larger factors compare fewer pairs and lose recall."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    queries, k = x[::40], 10
    want = np.sort(queries @ x.T, axis=1)[:, ::-1][:, :k]
    one = exact_of(x, queries, k)
    assert np.allclose(one.score, want) and one.compared < 0.7 * queries.shape[0] * len(x)
    work, found = [one.compared], [1.0]
    for factor in (1.5, 3.0, 16.0):
        s = Search(Tree(x, 16), queries, np.full(len(queries), -np.inf), k, factor)
        s.run()
        work.append(s.compared)
        found.append(np.mean([len(np.intersect1d(a, b)) / k for a, b in zip(s.row, one.row)]))
    assert work == sorted(work, reverse=True) and work[-1] < 0.2 * work[0]
    assert found[1] >= 0.9 and found == sorted(found, reverse=True)


def test_a_level_leaves_out_only_what_is_below_it():
    x = made(5, 300)
    one = exact_of(x, x[:30], 5)
    s = Search(Tree(x, 16), x[:30], one.score[:, 3], 5, 1.0)
    s.run()
    assert (s.row[:, :4] == one.row[:, :4]).all()


def test_products_are_sums_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 100, 64)).astype(np.float32).astype(float)
    want = []
    for p, q in zip(a, b):
        t = 0.0
        for u, v in zip(p.tolist(), q.tolist()):
            t += u * v
        want.append(t)
    assert inner_products(a, b).tolist() == want


def test_recall(spark):
    exact = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (4, 6)], "query_id int, vec_id int")
    assert recall(exact.limit(3), exact).first()["recall"] == 0.75


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(op11.ORACLE_SQL).fetchall()
    assert len(want) == 500 and sorted(tuple(r) for r in op11.query(spark, "/root/testdata/sf0.01").collect()) == sorted(want)
