import re

import pytest

from epochlens.llm import decontaminate

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in ids if x is not None}
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture()
def tables(spark, docs_of, prose):
    passage, other = prose(1, 40), prose(2, 25)
    p = passage.split()
    items = [(1, passage), (2, other), (3, passage), (4, "alpha beta gamma"), (5, None), (6, ""), (7, "lone"), (None, prose(9, 12)), (8, "same " * 30),
             (10, " ".join(p[5:14])), (11, prose(8, 10))]
    rows = [
        (1, passage.upper() + " tail"), (2, "head, " + " - ".join(p[3:13]) + "; tail"), (3, " ".join(p[3:12])), (4, "x Alpha, BETA gamma y"),
        (5, None), (6, ""), (7, "a lone wolf"), (8, prose(9, 12)), (9, "same " * 500), (10, " ".join(p[:20]) + " z " + " ".join(p[20:])),
        (11, prose(3, 3000) + " " + " ".join(p[10:30]) + " " + prose(4, 3000)), (12, passage + " " + passage), (None, passage), (12, passage + " " + passage),
        (13, prose(8, 10)), (14, " ".join(p[5:14])), (15, "été ΑΒΓ " + other),
    ]
    return rows, items, docs_of(rows), spark.createDataFrame([(*i, "q") for i in items], "item_id bigint, text string, gram string")


def test_against_brute_force(tables):
    rows, items, docs, benchmark = tables
    got = decontaminate.contamination(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=str) == brute(rows, items)
    assert all(r.n_items == len(r.item_ids) for r in got)


def test_dropping_and_empty_tables(tables):
    rows, items, docs, benchmark = tables
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [r[0] for r in brute(rows, items) if not r[4]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


def test_every_window_keeps_its_smallest_gram():
    import numpy as np

    hashes = np.array([5, 3, 3, 9, 1, 1, 7, 8], np.uint64)
    at = decontaminate.selected(hashes, 3)
    for i, place in enumerate(at.tolist()):
        part = hashes[i : i + 3]
        assert hashes[place] == part.min() and place == i + 2 - int(part[::-1].argmin())
