import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.llm import lm
from epochlens.llm.queries import op11_maxent


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return [*out, lm.END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def base(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    found = []
    for i, t in rows:
        w = words_of(t)
        found.append((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return sorted(found)


def scored(docs):
    found = lm.scores(docs, ~lm.held_out(F.col("doc_id"))).withColumn("held_out", lm.held_out(F.col("doc_id")))
    return found.collect()


@pytest.fixture(scope="module")
def two_languages():
    """Texts in which the words before tell which words can follow."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        letters = "abcde" if i % 2 else "vwxyz"
        ending = "en" if i % 2 else "um"
        rows.append((i, " ".join("".join(r.choice(list(letters), r.integers(1, 4))) + ending for _ in range(60))))
    return rows


def test_base_counts_and_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "Aa aA b\x0bc " * 40), (None, "aa"), (None, "aa"), (7, "Ä ä \x1c \t\r"), (11, "x" * 200_000 + " aa"), (12, "unseen words here"), (2, "aa b")]
    found = scored(docs_of(rows))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == base(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert scored(docs_of([])) == []


def test_no_training_text(docs_of):
    only_held = next(i for i in range(100) if held(i))
    found = scored(docs_of([(only_held, "some words")]))
    assert (found[0]["n_known"], found[0]["train_tokens"]) == (0, 0)
    assert math.isfinite(found[0]["score"])


def test_context_beats_word_counts(docs_of, two_languages):
    found = [r for r in scored(docs_of(two_languages)) if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found) + 0.15 * sum(r["n_tokens"] for r in found)


def test_blocks_do_not_change_counts(docs_of, two_languages, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4_000)
    monkeypatch.setattr(lm, "PIECE_TOKENS", 130)
    docs = docs_of([*two_languages, (1000, "vum " * 3_000)]).repartition(3)
    found = scored(docs)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == base([*two_languages, (1000, "vum " * 3_000)])
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_probabilities_sum_to_one():
    """Over all seen words and one unseen word of each subclass, in any context, after learning."""
    r = np.random.default_rng(1)
    words = sorted({"".join(r.choice(list("abcdefgh"), r.integers(1, 5))).encode() for _ in range(500)})
    leaves = np.array([lm.leaf_of(w) for w in words])
    counts = r.integers(1, 9, len(words))
    totals, distinct = np.bincount(leaves, counts, lm.WAYS**2), np.bincount(leaves, minlength=lm.WAYS**2)
    model = lm.Model(totals, distinct)
    hashes = lm.word_hashes(words)
    text = r.integers(0, len(words), 5_000)
    rows, leaf = lm.contexts(text, np.array([5_000]), hashes, leaves)
    met = np.zeros((lm.LEVELS * lm.FEATURES, lm.ROWS), np.int64)
    before = model.log_leaf(rows, leaf).sum()
    model.learn(rows, leaf, met)
    assert model.log_leaf(rows, leaf).sum() > before
    assert (met.sum(axis=1) == 5_000).all()
    unseen = np.arange(lm.WAYS**2)
    total = 0.0
    for word in range(len(words)):
        rows, leaf = lm.contexts(np.array([3, 8, word]), np.array([3]), hashes, leaves)
        total += math.exp(model.log_leaf(rows, leaf)[-1] + model.word_share(counts, leaves)[word])
    # An unseen word's context rows depend on the words before and on its own class only.
    for cls in unseen:
        rows, leaf = lm.contexts(np.array([3, 8, len(words)]), np.array([3]), np.append(hashes, np.uint64(0)), np.append(leaves, cls))
        total += math.exp(model.log_leaf(rows, leaf)[-1] + model.word_share(np.zeros(1), np.array([cls]))[0])
    assert abs(total - 1) < 1e-4


def test_learning_step_against_plain_loops():
    """One gradient step over tokens that share rows of weights."""
    words = [b"aa", b"ba", b"ca", b"da"]
    leaves, hashes = np.array([lm.leaf_of(w) for w in words]), lm.word_hashes(words)
    text = np.array([0, 1, 0, 1, 2, 3, 0, 1])
    make = lambda: lm.Model(np.bincount(leaves, [3, 3, 1, 1], lm.WAYS**2), np.bincount(leaves, minlength=lm.WAYS**2))
    rows, leaf = lm.contexts(text, np.array([8]), hashes, leaves)
    model, plain = make(), make()
    model.learn(rows, leaf, np.zeros((lm.LEVELS * lm.FEATURES, lm.ROWS), np.int64))
    for level in range(lm.LEVELS):
        gradient = plain.outcomes(level, rows, leaf // lm.WAYS)
        for t in range(8):
            gradient[t, leaf[t] % lm.WAYS if level else leaf[t] // lm.WAYS] -= 1
        for table in range(level * lm.FEATURES, (level + 1) * lm.FEATURES):
            for row in set(rows[table].tolist()):
                g = sum(gradient[t] for t in range(8) if rows[table][t] == row)
                expected = -lm.RATE * g / math.sqrt(1e-3 + float(g @ g))
                np.testing.assert_allclose(model.weights[table, row], expected, rtol=1e-4, atol=1e-6)


def test_query_on_the_given_table(spark):
    found = op11_maxent(spark, "/root/testdata/sf0.001").collect()
    docs = {(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == base(sorted(docs))
