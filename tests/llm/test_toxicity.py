import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.llm import toxicity


def test_nearest_is_exact():
    r = np.random.default_rng(0)
    rows = [np.sort(r.choice(60, r.integers(1, 9), replace=False)) for _ in range(700)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    idf = r.random(60) + 0.5
    weights = np.concatenate([toxicity.unit_weights(idf, x, r.integers(1, 4, len(x)).astype(float)) for x in rows])
    ones = np.ones(len(rows), int)
    index = toxicity.Index({}, idf, at, np.concatenate(rows), weights, ones, ones, np.arange(700), 0.1, 0.1)
    dense = np.zeros((700, 60))
    for i, x in enumerate(rows):
        dense[i, x] = index.weights[at[i] : at[i + 1]]
    for q in range(0, 700, 7):
        found, best = index.nearest(rows[q], index.weights[at[q] : at[q + 1]], 10)
        cosine = dense @ dense[q]
        order = np.lexsort((np.arange(700), -np.round(cosine, 12)))
        order = order[cosine[order] > 0][:10]
        assert found.tolist() == order.tolist() and np.allclose(best, cosine[order])


@pytest.fixture(scope="module")
def tables(spark, docs_of, prose):
    r = random.Random(1)
    bad = ["zzrude", "zzvile", "zzfoul", "zznasty"]
    rows, labels = [], []
    for i in range(900):
        words = prose(i, r.randint(5, 60)).split()
        toxic = i % 9 == 0
        if toxic:
            for w in r.sample(bad, 2):
                words.insert(r.randrange(len(words)), w + r.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(words)))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "a zzrude zzvile text"), (2002, "ZZRUDE, and ZZFOULNESS"), (5, rows[5][1])]
    labels += [(None, 1), (3000, 1), (7, None)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_documents(tables):
    docs, labels = tables
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    out = [(r.doc_id, r.toxic) for r in labels.where("toxic IS NOT NULL AND doc_id < 1000").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum(found[i].predicted == t for i, t in out)
    assert right / len(out) > 0.97
    assert found[None].predicted == 1 and found[2002].predicted == 1
    assert found[2000].predicted == 0 and found[2000].score == found[2001].score
    assert found[2002].evidence and all(zlib.crc32(e.doc_id.encode()) % 5 for e in found[2002].evidence)


def test_held_out_labels_and_ids_don_t_matter(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda d, l: sorted((str(r.doc_id), r.score) for r in toxicity.toxicity(d, l).collect())  # noqa: E731, E741
    assert score(docs, labels) == score(docs, flipped)


def test_nothing_to_learn(tables):
    docs, labels = tables
    scores = {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert len(scores) == 1 and not math.isnan(scores.pop())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_stage_drops_toxic_documents(tables):
    docs, labels = tables
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in docs.collect() if r.doc_id not in gone), key=str)


def test_evidence_equals_brute_force_over_all_words(tables):
    docs, labels = tables
    kind = {}
    for r in labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            kind[r.doc_id] = max(kind.get(r.doc_id, 0), r.toxic)
    every = [(r.doc_id, toxicity.words_of((r.text or "").encode())) for r in docs.collect()]
    examples = {}
    for i, words in every:
        if i in kind and words:
            key = frozenset(words.items())
            examples[key] = max(examples.get(key, 0), kind[i])
    n, p = len(examples), sum(examples.values())
    terms = sorted({w for key in examples for w, _ in key})
    df = {t: sum(t in dict(key) for key in examples) for t in terms}
    pos = {t: sum(y for key, y in examples.items() if t in dict(key)) for t in terms}
    part = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
    weight = {}
    for t in terms:
        a, b = pos[t], df[t]
        ratio = 2 * (part(a, b * p / n) + part(b - a, b * (1 - p / n)) + part(p - a, (n - b) * p / n) + part(n - p - b + a, (n - b) * (1 - p / n)))
        idf = math.log((len(every) + 1) / (sum(t in w for _, w in every) + 1)) + 1
        weight[t] = idf * (max(ratio, 0) + toxicity.NEUTRAL)

    def unit(words):
        w = {t: (1 + math.log(c)) * weight[t] for t, c in words if t in weight}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = [unit(key) for key in examples]
    want = []
    for i, words in every:
        v = unit(words.items())
        cosines = sorted((sum(x * e.get(t, 0.0) for t, x in v.items()) for e in vectors), reverse=True)[:10]
        want.append((str(i), [round(c, 4) for c in cosines if c > 0]))
    got = [(str(r.doc_id), [e.cosine for e in r.evidence]) for r in toxicity.toxicity(docs, labels).collect()]
    assert len(got) == len(want)
    for (i, found), (j, cosines) in zip(sorted(got), sorted(want)):
        assert i == j and len(found) == len(cosines) and np.allclose(found, cosines, atol=2e-4)


def test_words_of_a_single_example_count(docs_of, spark, prose):
    rows = [(i, prose(i, 30)) for i in range(400)]
    rare = "qwzfoul qwzvile qwznasty qwzrude"
    rows += [(5000, f"{prose(1, 5)} {rare}"), (6000, f"{prose(2, 5)} {rare}")]
    assert zlib.crc32(b"5000") % 5
    labels = spark.createDataFrame([(i, 0) for i in range(400)] + [(5000, 1)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs_of(rows), labels).collect()}
    assert found[6000].evidence[0].doc_id == "5000" and found[6000].evidence[0].cosine > 0.7
    assert all(found[i].evidence for i in range(400))


def test_large_index_is_searched_exactly():
    r = np.random.default_rng(3)
    shares = 1 / np.arange(1, 2001) ** 0.9
    rows = [np.unique(r.choice(2000, 60, p=shares / shares.sum())) for _ in range(3000)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    weight = r.random(2000) ** 6 * 50 + 0.01
    weights = np.concatenate([toxicity.unit_weights(weight, x, np.ones(len(x))) for x in rows])
    ones = np.ones(3000, int)
    index = toxicity.Index({}, weight, at, np.concatenate(rows), weights, ones, ones, np.arange(3000), 0.1, 0.1)
    dense = np.zeros((3000, 2000))
    for i, x in enumerate(rows):
        dense[i, x] = weights[at[i] : at[i + 1]]
    for q in range(0, 3000, 50):
        _, best = index.nearest(rows[q], weights[at[q] : at[q + 1]], 10)
        assert np.allclose(best, np.sort(dense @ dense[q])[::-1][:10])


def test_the_driver_builds_no_postings(spark):
    """The driver searched the examples itself, so their postings and all their words stood in its memory."""
    rows = [(f"d{i}", f"w{i % 50} w{i % 7} common " + ("bad" if i % 3 == 0 else "good")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(400)], "doc_id string, toxic int")
    index, _ = toxicity.fit(docs, labels)
    assert "posting_rows" not in index.__dict__ and not index.terms
    assert index.steps is not None


def test_frequent_terms_are_multiplied_out(monkeypatch):
    """Every posting of a frequent term was read for every text, which was most of the work."""
    r = np.random.default_rng(5)
    shares = 1 / np.arange(1, 3001)
    rows = [np.unique(r.choice(3000, 80, p=shares / shares.sum())) for _ in range(1500)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    weight = r.random(3000) + 0.5
    weights = np.concatenate([toxicity.unit_weights(weight, x, np.ones(len(x))) for x in rows])
    ones = np.ones(1500, int)
    index = toxicity.Index({}, weight, at, np.concatenate(rows), weights, ones, ones, np.arange(1500), 0.1, 0.1)
    read, runs = [], index._runs
    monkeypatch.setattr(toxicity.Index, "_runs", lambda self, ptr, wanted, *values: [read.append(int((ptr[wanted + 1] - ptr[wanted]).sum())), *runs(ptr, wanted, *values)][1:])
    asked = [(rows[q], weights[at[q] : at[q + 1]]) for q in range(0, 1500, 10)]
    dense = np.zeros((1500, 3000))
    for i, x in enumerate(rows):
        dense[i, x] = weights[at[i] : at[i + 1]]
    for q, (_, best) in zip(range(0, 1500, 10), index.nearest_of(asked, 10)):
        assert np.allclose(best, np.sort(dense @ dense[q])[::-1][:10])
    holders = (dense > 0).sum(axis=0)
    assert sum(read) < 0.2 * sum(holders[terms].sum() for terms, _ in asked)


def test_built_index_stays_small():
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(0, 100_000, 1000)).astype(np.int32) for _ in range(1500)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    weight = np.ones(100_000)
    weights = np.concatenate([toxicity.unit_weights(weight, x, np.ones(len(x))) for x in rows]).astype(np.float32)
    ones = np.ones(1500, int)
    index = toxicity.Index({}, weight, at, np.concatenate(rows), weights, ones, ones, np.arange(1500), 0.1, 0.1)
    tracemalloc.start()
    index.nearest(rows[0], weights[: at[1]], 10)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # The postings, the frequent terms, four numbers a term; no bounds of blocks before a search needs them.
    assert held < 8 * at[-1] + 4 * 512 * 1500 + 5 * 8 * 100_000 + 1_000_000


def test_building_an_index_takes_little_beside_it():
    """Sorting took several copies of all entries at once, frequent ones too, in every task that searched."""
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 3000, 2000) ** 2 // 90).astype(np.int32) for _ in range(2000)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    weights = np.concatenate([toxicity.unit_weights(np.ones(100_000), x, np.ones(len(x))) for x in rows]).astype(np.float32)
    ones = np.ones(2000, int)
    index = toxicity.Index({}, np.ones(100_000), at, np.concatenate(rows), weights, ones, ones, np.arange(2000), 0.1, 0.1)
    tracemalloc.start()
    index._build()
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    often = int(np.sort(np.bincount(index.columns))[-512:].sum())
    assert len(index.postings) == at[-1] - often < at[-1]
    assert most < held + 4 * at[-1] + 4_000_000
