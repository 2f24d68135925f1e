import hashlib
import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from epochlens.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, cost int, part string, digest string"
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p", "d") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def all_repairs(rows, faults):
    """Every edit sequence with at most two insertions in a row, best first: exhaustive search by position and state."""
    states = {"-": (0, "", [])}
    step = {"-": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(table):
        for _ in range(2):
            more = dict(table)
            for s, (cost, audit, kept) in table.items():
                for t in step[s]:
                    if t in name:
                        value = (cost + 5, audit + "I", [*kept, (name[t], "")])
                        more[t] = min(more.get(t, value), value)
            table = more
        return table

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        states = inserted(states)
        after = {}
        for s, (cost, audit, kept) in states.items():
            options = [(s, (cost + 2, audit + "D", kept))]
            if fault not in ("blank", "duplicate"):
                left = 5 * (fault == "truncated")
                for t in step[s]:
                    if role[:1] == t:
                        options.append((t, (cost + left, audit + "K", [*kept, (role, text)])))
                    if t in name:
                        options.append((t, (cost + 1 + left, audit + "R", [*kept, (name[t], text)])))
            for t, value in options:
                after[t] = min(after.get(t, value), value)
        states = after
    states = inserted(states)
    return min(states[s] for s in "-a" if s in states)


def plain(rows):
    found = []
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in left if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            core = text.strip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = all_repairs(own, faults)
        count = Counter(faults)
        digest = hashlib.sha256("\n".join(":".join(k) for k in kept).encode()).hexdigest()
        found.append((str(conv), gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest))
    return sorted(found)


def found(spark, rows):
    return sorted((str(r[0]), *r[1:]) for r in cv.repairs(table(spark, rows)).collect())


@pytest.fixture(scope="module")
def talk():
    import random

    r = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(r.randint(0, 9)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "u", None])
            text = r.choice(["Yes.", "No", " ", "", "So? \n", None, f"Word {r.random()}.", f"Word {r.random()}", " "])
            rows.append((conv, r.choice([turn, turn, turn, None, turn * 3, -turn]), role, text))
    return rows


def test_against_exhaustive_search(spark, talk):
    assert found(spark, talk) == plain(talk)


def test_segments_join_to_the_same_repairs(spark, talk, monkeypatch):
    monkeypatch.setattr(cv, "SEGMENT", 2)
    assert found(spark, talk) == plain(talk)


def test_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"T {t}." if t % 7 else "same") for t in range(3_000)]
    rows += [(2, 5, "user", "again.")] * 500 + [(2, 6, "assistant", "x" * 300_000 + ".")]
    assert found(spark, rows) == plain(rows)


def test_nulls_and_nothing_left(spark):
    dropped = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (dropped, 0, "user", "gone.")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows)[0 if str(dropped) < "None" else 1][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, []) == []


def test_repaired_rows_are_those_of_the_hash(spark, talk):
    hashes = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in cv.repairs(table(spark, talk)).collect()}
    rows = cv.repaired(table(spark, talk)).orderBy("conv_id", "place").collect()
    for conv, own in itertools.groupby(rows, key=lambda r: r["conv_id"]):
        own = list(own)
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["role"] is not None)
        assert ("".join(r["edit"] for r in own), hashlib.sha256(text.encode()).hexdigest()) == hashes[conv]


def test_a_hot_conversation_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(20_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    per_task = cv.segments(cv.entries(cv.damaged(rows))).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(per_task) > 2


def test_agenda_needs_all_antecedents():
    def add(*values):
        return sum(v[0] for v in values) + 1, "".join(v[1] for v in values)

    deductions = [(("a", "b"), add, "c"), (("a",), add, "c2"), (("c", "c2"), add, "goal"), (("missing", "a"), add, "goal")]
    assert cv.lightest([("a", (1, "x")), ("b", (4, "y"))], deductions, ["goal"]) == {"goal": (9, "xyx")}
    assert cv.lightest([("a", (1, "x"))], deductions, ["goal"]) == {}
