import hashlib

import numpy as np
import pytest

from epochlens.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, x string, dots int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", 1) for i, v in rows], SCHEMA)


def plain(rows, k=16, rounds=3):
    """Whole k-means with all distances computed anew, in Python's own whole numbers."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    means = [x for _, x in sorted(kept, key=key)[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((square(x, m), c) for c, m in enumerate(means)) for _, x in kept]
        if turn < rounds:
            for c in range(len(means)):
                own = [x for (_, x), (_, n) in zip(kept, near, strict=True) if n == c]
                if own:
                    means[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    inertia = sum(d for d, _ in near)
    return sorted(
        (str(i), c, d, sum(e for e, n in near if n == c), inertia, hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, near, strict=True)
    )


def found(spark, rows, **more):
    return sorted((str(r[0]), *r[1:]) for r in centroids.clusters(table(spark, rows), **more).collect())


@pytest.fixture(scope="module")
def mixed():
    r = np.random.default_rng(3)
    middles = r.standard_normal((20, 64)) * 0.4
    rows = [(i, (middles[i % 20] + r.standard_normal(64) * 0.1).astype(np.float32).tolist()) for i in range(300)]
    rows += [(500 + i, rows[7][1]) for i in range(200)]  # one vector many times
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, rows[0][1][:63]), (903, [*rows[0][1][:63], None]), (904, [*rows[0][1][:63], float("nan")]), (905, [*rows[0][1][:63], float("-inf")]), (906, [0.0] * 64)]
    return rows


def test_equals_clustering_from_scratch(spark, mixed):
    assert found(spark, mixed) == plain(mixed)


def test_few_vectors_and_ties(spark):
    one = [(i, [0.5] * 64) for i in range(5)]
    assert found(spark, one) == plain(one)  # all centroids equal: the first takes all
    two = [(1, [0.25] * 64), (2, [-0.25] * 64)]
    assert found(spark, two, rounds=1) == plain(two, rounds=1)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_components_too_large_are_left_out(spark):
    assert found(spark, [(1, [1e30] * 64), (2, [1.0] * 64)]) == plain([(2, [1.0] * 64)])


def test_dot_products_are_kept_up_to_date(spark, mixed):
    kept = centroids.whole(table(spark, mixed))
    old = centroids.first_centroids(kept)
    assigned = centroids.measured(kept, old)
    new = old.copy()
    new[0, 5] += 3
    new[4] = centroids.updated(assigned, old)[4]
    for r in centroids.moved(assigned, old, new).collect():
        assert r["dots"] == (new @ np.array(r["x"])).tolist()
