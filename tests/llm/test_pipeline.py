import random

import pytest

import corpus_pipeline
from epochlens.llm import decontaminate, mixing, simhash, toxicity
from epochlens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, docs_of, prose, tmp_path_factory):
    r = random.Random(2)
    path = tmp_path_factory.mktemp("tables")
    passage = prose(9000, 40)
    rows, labels = [], []
    for i in range(300):
        words = prose(i, r.randint(20, 200)).split()
        if i % 7 == 0:
            for w in r.sample(["zzrude", "zzvile", "zzfoul"], 2):
                words.insert(r.randrange(len(words)), w)
        if i % 25 == 3:
            words[5:5] = passage.split()[10:30]
        rows.append((i, " ".join(words), f"src{i % 5 if i % 3 else 0}"))
        labels.append((i, 1, int(i % 7 == 0)))
    long = prose(7000, 4000)
    rows += [(1000 + i, long + " " + prose(i, 1), "src1") for i in range(6)] + [(1100 + i, rows[1][1], "src2") for i in range(20)]
    rows += [(2000, None, None), (2001, "", "src1"), (None, "no id here", "src1"), (2, rows[2][1], rows[2][2])]
    docs_of(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_one_after_another(spark, folder, tmp_path):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_duplicates", "drop_contaminated", "mix_sources", "encode_tokens"]
    docs = given = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert i == 4 or out.columns == given.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
    clean, single, uncontaminated, mixed, coded = kept
    assert not any(i is not None and i < 300 and i % 7 == 0 for i in clean) and {2000, 2001, None} <= set(clean)
    assert sum(i is not None and (1100 <= i < 1120 or i == 1) for i in single) == 1 and single.count(2) == 1
    assert len([i for i in single if i is not None and 1000 <= i < 1006]) < 6
    assert not any(i is not None and i < 300 and i % 25 == 3 for i in uncontaminated) and set(uncontaminated) <= set(single)
    assert set(mixed) <= set(uncontaminated) and coded == mixed
    starts = sorted((r.start, r.n_tokens) for r in docs.collect())
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))


def test_each_stage_does_what_its_operator_says(spark, folder):
    docs, labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert ids(toxicity.drop_toxic(docs, labels)) == sorted((i for i in ids(docs) if i not in bad), key=str)
    first = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {i for i in ids(simhash.keep_first(docs)) if i is not None} <= first
    dirty = {r.doc_id for r in decontaminate.contamination(docs, items).where("contaminated").collect()}
    assert ids(decontaminate.drop_contaminated(docs, items)) == sorted((i for i in ids(docs) if i not in dirty), key=str)
    assert ids(mixing.mixed(docs)) == sorted((r.doc_id for r in mixing.mixture(docs).collect() for _ in range(r.copies)), key=str)


def test_run_and_registration(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_edited_copies_leave_the_near_duplicate_stage(spark, folder, docs_of, prose):
    text = prose(8000, 300).split()
    copies = [(i, " ".join(text[:40 * i] + ["edited"] + text[40 * i + 1 :])) for i in range(1, 7)]
    half = [(20, " ".join(text[:200]) + " " + prose(8001, 100))]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of([*copies, *half]), folder)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 20]
