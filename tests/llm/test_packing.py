import zlib

import numpy as np
import pytest

from gridloom.llm.packing import Limits, Packer, Piece, all_but_first, pack_documents
from gridloom.llm.tokens import word_file

TEXTS = ["", None, "Hello  world\n\tit's 123 <|endoftext|> x", "Ünïcode ﬁne space\x1c ǅ Σας", "a " * 9000, "word", "word",
         "one two three " * 700, "b́e é  x"]


def padding(lengths, full=4096):
    return sum(0 if n & (n - 1) == 0 else full - n for n in lengths)


def test_round_trip(spark):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(word_file())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string").repartition(2)
    rows = pack_documents(docs).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    assert padding(sum(r.length for r in p) for p in sequences.values()) == 0
    for i, t in enumerate(TEXTS):
        want = model.encode(t or "", add_special_tokens=False).ids + [2]
        got = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0] + [r.length for r in got])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in got) == np.array(want, "<u4").tobytes()
        assert all(r.doc_tokens == len(want) for r in got)


def test_empty_and_null_ids(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack_documents(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")).where("doc_id IS NULL").count() >= 2


@pytest.mark.parametrize("limits", [Limits(64, 3, 40, 256), Limits(64, 2, 64, 64), Limits(64, 64, 5, 500)])
def test_limits_hold(limits):
    rng = np.random.default_rng(1)
    out, given = [], []
    packer = Packer(limits, out.append)
    for i in range(300):
        ids = np.arange(rng.integers(1, 200), dtype=np.uint32)
        loss = np.r_[0, np.cumsum(rng.random(len(ids)) < 0.5)] if i % 2 else all_but_first(ids)
        given.append(len(ids))
        packer.add(Piece(i, ids, loss, 0, len(ids)))
    packer.finish()
    for pieces in out:
        assert sum(p.end - p.start for p in pieces) <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p.demand()[1] for p in pieces) <= limits.loss
    taken = np.zeros(300, int)
    for p in (p for pieces in out for p in pieces):
        taken[p.key] += p.end - p.start
    assert taken.tolist() == given
