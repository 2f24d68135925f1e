import random
import zlib

import numpy as np
import pytest

from epochlens.llm import rans, tokens
from epochlens.llm.queries import vocabulary


@pytest.mark.parametrize("n", [0, 1, 31, rans.BLOCK, rans.BLOCK + 1, 5 * rans.BLOCK + 7])
def test_round_trip(n):
    ids = np.minimum((np.random.default_rng(n).pareto(0.8, n) * 2).astype(np.int64), 60_000).astype(np.uint32)
    table = rans.Table.of(ids)
    payload, marks = rans.encode(ids, table)
    again = rans.Table.unpack(table.pack())
    assert (again.symbols == table.symbols).all() and (again.freqs == table.freqs).all()
    assert (rans.decode(payload, marks, again, n) == ids).all()
    if n > 3 * rans.BLOCK:
        assert (rans.decode(payload, marks, again, n, 1, 3) == ids[rans.BLOCK : 3 * rans.BLOCK]).all()
        entropy = -(np.unique(ids, return_counts=True)[1] / n * np.log2(np.unique(ids, return_counts=True)[1] / n)).sum()
        assert len(payload) * 8 / n < entropy * 1.05 + 0.3


def test_damage_is_noticed():
    ids = np.arange(40_000, dtype=np.uint32) % 300
    table = rans.Table.of(ids)
    payload, marks = rans.encode(ids, table)
    with pytest.raises(ValueError):
        rans.decode(payload[:1000] + b"?" + payload[1001:], marks, table, len(ids))
    with pytest.raises(ValueError):
        rans.decode(payload[:-1], marks, table, len(ids))


def test_words_one_after_another_are_the_whole_text():
    from tokenizers import Tokenizer

    spec = open(vocabulary(), encoding="utf-8").read()
    plain = Tokenizer.from_str(spec)
    plain.encode_special_tokens = True
    r = random.Random(4)
    parts = [" ", " ", "  ", "   ", "\n", "\t", "\x1c", "\x85", " ", "'s", "the", "Foo", "é", "12", ",", "...", "<|endoftext|>", "\U0001f600", "\0", "é"]
    batch = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    found = tokens.Encoder(spec).encode(batch)
    assert [x.tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in batch]


def test_words_of_letters_are_not_searched_for_their_heads(monkeypatch):
    seen = []
    head = tokens._HEAD
    monkeypatch.setattr(tokens, "_HEAD", type("Head", (), {"match": staticmethod(lambda w: seen.append(w) or head.match(w))}))
    encoder = tokens.Encoder(open(vocabulary(), encoding="utf-8").read())
    encoder.encode(["the quick brown fox, jumped over\tlazy dogs 12 ²³"])
    assert sorted(seen) == ["fox,", "over\tlazy"]


def test_files_hold_every_document(spark, docs_of, prose, tmp_path):
    from tokenizers import Tokenizer

    rows = [(5, prose(1, 50)), (2, None), (9, ""), (None, "null id"), (3, prose(2, 6000)), (5, "again five"), (7, "tied"), (7, "tied"), (1, "été \U0001f600")]
    path = str(tmp_path / "files")
    tokens.write_tokens(docs_of(rows), path, vocabulary(), group=1000)
    got = tokens.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5, 7, 7, 9]
    plain = Tokenizer.from_file(vocabulary())
    want = sorted(str((d, plain.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    assert sorted(str((r.doc_id, r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert tokens.tokenized(docs_of(rows).limit(0), vocabulary()).count() == 0
