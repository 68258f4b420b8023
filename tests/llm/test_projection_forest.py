import numpy as np

from surecal.llm.common import table
from surecal.llm.projection_forest import Settings, near_vectors

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold=0.95):
    """vec_id, embedding -> (links, component) by all pairs, over distinct rows."""
    rows = sorted({(i, None if e is None else tuple(e)) for i, e in rows}, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    ok = [e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e in rows]
    at = [k for k, good in enumerate(ok) if good]
    size = np.array([len(rows[k][1]) for k in at])
    x = np.zeros((len(at), max(size, default=0)))
    for place, k in enumerate(at):
        x[place, : size[place]] = np.array(rows[k][1], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # Vectors of different lengths never link.
    linked = (x @ x.T >= threshold) & (size[:, None] == size[None, :])
    np.fill_diagonal(linked, False)
    root = list(range(len(rows)))
    for a in range(len(at)):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(linked[todo.pop()]):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[at[b]][0] for b in seen if rows[at[b]][0] is not None]
        root[at[a]] = min(ids) if ids else None
    links = dict(zip(at, linked.sum(axis=1)))
    return sorted(
        (((r[0] is None, r[0] or 0), int(links.get(k, 0)), root[k] if ok[k] else r[0]) for k, r in enumerate(rows)),
        key=str)


def check(spark, rows, settings):
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id bigint, embedding array<float>, node string")
    out = near_vectors(df, settings=settings).collect()
    got = sorted((((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in out), key=str)
    assert got == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_against_all_pairs_and_edge_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(np.float32(v)) for v in base[i % 60] + rng.normal(size=8) * 0.05 * (i % 7)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(5, rows[5][1])]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [NAN] + [1.0] * 7), (2003, [INF] + [1.0] * 7),
             (2004, [1.0] * 5), (2005, []), (2006, [None] + [1.0] * 7), (None, rows[9][1]), (7, rows[8][1])]
    check(spark, rows, Settings(leaf=64, trees=8, levels=3))


def test_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = []
    for dim, n in ((4, 300), (8, 300), (3, 5)):
        base = rng.normal(size=(30, dim))
        rows += [(len(rows) + i, [float(np.float32(v)) for v in base[i % 30] + rng.normal(size=dim) * 0.02 * (i % 5)]) for i in range(n)]
    rows += [(9000 + i, [1.0] * 4) for i in range(5)] + [(9100 + i, [1.0] * 8) for i in range(5)]
    check(spark, rows, Settings(leaf=64, trees=12, levels=3))


def test_empty_and_single(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    one = near_vectors(spark.createDataFrame([(4, [1.0, 2.0])], schema)).first()
    assert (one.vec_id, one.n_links, one.component_id, one.kept) == (4, 0, 4, True)


def test_recall_on_the_table(spark, sf):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    out = near_vectors(table(spark, "/root/testdata/sf0.1", "embeddings"), settings=Settings(leaf=100)).collect()
    assert sum(r.n_links for r in out) >= 0.99 * linked.sum()
    want = dict(zip([r.vec_id for r in rows], linked.sum(axis=1)))
    assert all(r.n_links <= want[r.vec_id] for r in out)


def test_recall_in_a_large_group_of_near_vectors(spark):
    """A third of the rows are different vectors of which nearly all pairs are links."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=64)
    near = near / np.linalg.norm(near) + rng.normal(size=(5_000, 64)) * 0.19 / 8
    x = np.vstack([near, rng.normal(size=(10_000, 64))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert want[:5_000].mean() > 4_500
    out = near_vectors(df).collect()
    got = np.array([r.n_links for r in sorted(out, key=lambda r: r.vec_id)])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    assert {r.component_id for r in out if r.vec_id < 5_000} == {0}
