import collections
import re

import pytest

from epochlens.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    goal = {s: total * weight[s] / sum(weight.values()) for s in names}
    while over := [s for s in names if goal[s] > most * sizes[s] + 1e-9]:
        excess = sum(goal[s] - most * sizes[s] for s in over)
        for s in over:
            goal[s] = most * sizes[s]
        free = [s for s in names if goal[s] < most * sizes[s] - 1e-9]
        for s in free:
            goal[s] += excess * weight[s] / sum(weight[x] for x in free)
    return goal


@pytest.fixture(scope="module")
def rows(prose):
    out, k = [], 0
    for source, n in (("a", 400), ("b", 60), ("B", 30), ("c", 25), (None, 20), ("é", 1), ("z", 90)):
        for i in range(n):
            out.append((k, prose(k, 1 + (k * 7919) % 60), source))
            k += 1
    return out + [(9001, None, "a"), (9002, "", None), (9003, "  \t", "empty"), (None, "some words here", "b"), (5, out[5][1], "a"), (5, out[5][1], "a")]


def test_targets_and_taken_words(docs_of, rows):
    got = mixing.mixture(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    source = {(r[0], r[1]): r[2] for r in rows}
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    by_id = {r[0]: r for r in rows}
    for r in rows:
        sizes[r[2]] += count(r[1])
    for r in got:
        s = by_id[r.doc_id][2]
        assert r.size == count(by_id[r.doc_id][1]) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        target[s] = r.target
    want = targets(sizes)
    for s, t in want.items():
        assert target[s] == pytest.approx(t, rel=1e-9)
        largest = max(count(r[1]) for r in rows if r[2] == s)
        assert abs(taken[s] - t) <= max(0.02 * t, largest), s
    assert source


def test_reruns_agree_whatever_the_partitions(docs_of, rows):
    docs = docs_of(rows)
    once = sorted(map(str, mixing.mixture(docs).collect()))
    assert once == sorted(map(str, mixing.mixture(docs.repartition(5, "text")).collect()))


def test_copies_of_rows(docs_of, rows):
    docs = docs_of(rows)
    want = collections.Counter()
    for r in mixing.mixture(docs).collect():
        want[r.doc_id] += r.copies
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +want
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_inclusion_follows_the_rank(docs_of, prose):
    """Of one source, the documents taken once more are those of the smallest ranks, but for the one that fills up."""
    docs = docs_of([(i, prose(i, 10), "s") for i in range(200)] + [(1000 + i, prose(i, 10), "t") for i in range(500)])
    sized = mixing._sized(docs, 11).where("source = 's'").collect()
    draw = {r.doc_id: r.u for r in sized}
    copies = {r.doc_id: r.copies for r in mixing.mixture(docs).collect() if r.doc_id < 1000}
    order = sorted(draw, key=draw.get)
    more = [copies[d] for d in order]
    assert more == sorted(more, reverse=True)
