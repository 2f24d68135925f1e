import random
import re

import numpy as np
import xxhash

from epochlens.llm import simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(keys, linked):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(keys))]


def test_documents_against_brute_force(docs_of, prose):
    base = prose(1, 400)
    rows = [(1, base), (2, base + " end"), (3, base), (4, None), (5, ""), (6, " \t\n"), (7, "One"), (8, "one"), (9, "a B c"), (10, prose(2, 30)),
            (11, prose(3, 9000)), (None, base), (12, "é ß x  y z"), (3, base), (None, None)]
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs_of(rows)).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = components(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    want = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None]
        want.append((doc_id, int(np.uint64(fps[k]).view(np.int64)), min(ids, default=None)))
    assert got == sorted(want, key=str)


def test_links_connect_as_all_pairs_do(spark):
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, dtype=np.uint64)
    near = [centre ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False))) for _ in range(300)]
    half = [(centre & ~np.uint64(0xFFFFFFFF)) | np.uint64(r.integers(0, 1 << 20)) for _ in range(300)]
    values = np.unique(np.array([*near, *half, *r.integers(0, 1 << 63, 100, dtype=np.uint64), np.uint64(0), np.uint64((1 << 64) - 1)], np.uint64))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    want = components(values, lambda i, j: bits[i, j] <= 3)
    # The smaller limit sends the large sets through quarters.
    for split_above in (1024, 16):
        edges = [(np.int64(a).view(np.uint64), np.int64(b).view(np.uint64)) for a, b in simhash.links(df, split_above=split_above).collect()]
        assert all((int(a) ^ int(b)).bit_count() >= 1 for a, b in edges)
        place = {int(v): i for i, v in enumerate(values)}
        pairs = {frozenset((place[int(a)], place[int(b)])) for a, b in edges}
        assert components(values, lambda i, j: frozenset((i, j)) in pairs) == want


def test_one_of_each_group_stays(docs_of, prose):
    a, b = prose(5, 200), prose(6, 3000)
    docs = docs_of([(3, a), (2, a), (2, a), (9, b), (4, b + " more"), (None, prose(7, 50)), (None, prose(7, 50))])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 4, None]
    assert simhash.keep_first(docs.limit(0)).count() == 0


def shingle_set(text):
    words = (text or "").translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similar_texts_are_joined_and_no_others(docs_of, prose):
    r = random.Random(8)
    rows = []
    for g in range(60):
        words = prose(g, r.randint(60, 400)).split()
        rows.append((10 * g, " ".join(words)))
        for k, edits in enumerate((len(words) // 60, len(words) // 20)):
            copy = list(words)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = "edited"
            rows.append((10 * g + 1 + k, " ".join(copy)))
    many = prose(900, 200)
    # A large group, whose bands go through their smallest member, with members that are only half alike.
    rows += [(1000 + i, many + f" tail{i}") for i in range(60)]
    rows += [(1100 + i, " ".join(many.split()[:120]) + " " + prose(950 + i, 80)) for i in range(40)]
    sets = [shingle_set(t) for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    roots = components(rows, alike)
    kept = simhash.keep_first_similar(docs_of([*rows, (5000, None), (5001, "")]))
    assert sorted(x.doc_id for x in kept.collect()) == [rows[i][0] for i in sorted(set(roots))] + [5000]
    assert simhash.keep_first_similar(docs_of([]).limit(0)).count() == 0


def test_candidates_of_a_large_band_grow_with_its_texts(spark):
    """Texts that share one band and little else, and texts that share all bands: a few candidates each, not all pairs."""
    r = random.Random(2)

    def members(n, like):
        rows = []
        for i in range(n):
            low = bytes(125) if like else bytes(r.randrange(256) for _ in range(125))
            rows.append((7, 0, [r.getrandbits(40) for _ in range(4)], i, 400, bytearray(low)))
        return spark.createDataFrame(rows, "band bigint, turn int, next array<bigint>, node bigint, size bigint, low binary")

    assert simhash._neighbours(members(2_000, False), 0.8, 2).count() == 0
    found = simhash._neighbours(members(2_000, True), 0.8, 2)
    assert 1_999 <= found.count() <= 3 * 2_000
    assert found.select("a").union(found.select("b")).distinct().count() == 2_000
