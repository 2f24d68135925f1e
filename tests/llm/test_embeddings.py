import numpy as np
import pytest

from epochlens.llm import embeddings


def brute(rows, cosine):
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def usable(e):
        return e is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(e)

    for i, (_, e, label) in enumerate(rows):
        for j in range(i):
            f, other = rows[j][1], rows[j][2]
            if label is None or label != other or not usable(e) or not usable(f) or len(e) != len(f):
                continue
            x, y = np.array(e, float), np.array(f, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[root(i)] = min(smallest.get(root(i), r[0]), r[0])
    return sorted(str((r[0], links[i], smallest.get(root(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_all_pairs(spark, kind):
    r = np.random.default_rng(2)
    dim, rows = 24, []
    for i in range(260):
        centre = r.standard_normal(dim)
        for k in range(r.integers(1, 4)):
            noise = r.standard_normal(dim)
            x = centre / np.linalg.norm(centre) + noise / np.linalg.norm(noise) * r.uniform(0, 0.25)
            rows.append((len(rows), np.float32(x * r.uniform(0.1, 10)).astype(float).tolist(), int(i % 3)))
    crowd = r.standard_normal(dim)
    rows += [(5000 + i, np.float32(crowd + 0.05 * r.standard_normal(dim)).astype(float).tolist(), 1) for i in range(80)]
    rows += [(6000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(7000, None, 1), (7001, [0.0] * dim, 1), (7002, [None] + [1.0] * (dim - 1), 1), (7003, [float("nan")] * dim, 1), (7004, [float("inf")] * dim, 1),
             (7005, rows[0][1], None), (7006, [], 0), (7007, rows[0][1][:5], 0), (None, rows[0][1], 0), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*x, 0) for x in rows], f"vec_id bigint, embedding array<{kind}>, label int, copies int")
    want = brute(rows, 0.98)
    # A small block cuts the crowd's cells.
    for block in (1024, 16):
        got = embeddings.near_duplicates(df, block=block).collect()
        assert sorted(str((x.vec_id, x.n_links, x.component_id)) for x in got) == want
        assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in got)


def test_needed_count_keeps_the_recall():
    from math import comb, erf, sqrt

    n, p = embeddings.COUNTED, erf(embeddings.COUNT_WINDOW / sqrt(2))
    tail = lambda k: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    need = embeddings.needed_count()
    assert tail(need) >= embeddings.RECALL > tail(need + 1)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
