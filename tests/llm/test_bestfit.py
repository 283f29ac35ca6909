import zlib

import numpy as np
import pytest

from gridloom.llm.bestfit import Plan, cuts, pack, pack_documents
from gridloom.llm.tokens import FileTokenizer, byte_file, word_file

TEXTS = ["", None, "Hello  world\n\tit's 123 <|endoftext|> x", "Ünïcode ﬁne space\x1c ǅ Σας", "a " * 9000, "word", "word",
         "one two three " * 700, "b́e é  x", " " * 50_000 + "x", "x y"]


def fills(rows):
    """Tokens of each sequence, after checking that offsets are gapless."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
    return [sum(n for _, n in parts) for parts in sequences.values()]


def test_round_trip(spark):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(byte_file())
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, length string, sequence_id int").repartition(3)
    rows = pack_documents(docs).collect()
    assert max(fills(rows)) <= 2048
    for i, t in enumerate(TEXTS):
        want = model.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in got] == cuts(len(want), 2048) and [r.piece for r in got] == list(range(len(got)))
        assert b"".join(bytes(r.ids) for r in got) == np.array(want, "<u4").tobytes()
        assert all(r.length == 2048 for r in got[1:])


@pytest.mark.parametrize("path", [byte_file(), word_file()])
def test_ids_equal_the_tokenizers(path):
    from tokenizers import Tokenizer
    model, own = Tokenizer.from_file(path), FileTokenizer(path)
    assert own.fast is not None
    rng = np.random.default_rng(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{chr(c)} a{chr(c)}1{chr(c)}" for c in points[i:i + 500]) for i in range(0, len(points), 20_000)]
    alphabet = list("abcXYZéÀßÆ'.,!*$&_<|>09 \n\t\x01\x1c  ǅİΣςﬁ　") + ["don't", "I'LL", "<|endoftext|>", "é"]
    texts += ["".join(rng.choice(alphabet, 60)) for _ in range(400)]
    letters = list("aeioustnrlhdcmpgbfvwyéüöäèàçßñ'- ETAO.0")
    texts += ["".join(rng.choice(letters, 4000)) for _ in range(40)]
    pieces = list(model.get_vocab())
    texts += [" ".join(p.replace("</w>", "") for p in rng.choice(pieces, 500)) for _ in range(40)]
    texts += [chr(c) + "x" for c in range(256)]
    for t, want in zip(texts, model.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(t).tolist() == want.ids


def test_memory_does_not_grow_with_words():
    import psutil
    own, rng = FileTokenizer(word_file()), np.random.default_rng(1)
    own.encode("warm up")
    before = psutil.Process().memory_info().rss
    for _ in range(20):  # a million distinct words
        own.encode(" ".join("".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (50_000, 9))))
    assert psutil.Process().memory_info().rss - before < 64 << 20


def test_long_text_in_blocks():
    from gridloom.llm import tokens
    own = FileTokenizer(word_file())
    text = "Some words, isn't 12 of\tthem\n " * 60_000 + "x" * 100_000
    assert len(text) > tokens.BLOCK
    assert own.encode(text).tolist() == own.encode(text[:30]).tolist() * 60_000 + own.encode("x" * 100_000).tolist()


def test_edges(spark):
    schema = "doc_id long, text string"
    assert pack_documents(spark.createDataFrame([], schema)).collect() == []
    rows = pack_documents(spark.createDataFrame([(None, None), (None, None), (1, "")], schema)).collect()
    assert [r.length for r in rows] == [1, 1, 1] and fills(rows) == [3]
    pieces = spark.createDataFrame([(5, 9, "a")], "length int, offset int, slice string")
    assert [tuple(r) for r in pack(pieces, capacity=8).collect()] == [(5, "a", 0, 0)]
    with pytest.raises(Exception, match="lengths must be"):
        pack(pieces, capacity=4).collect()


def brute_force(lengths, capacity):
    """The method one document at a time: greedy pairs of large ones, then best fit, longest first."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    rooms = []
    while large:
        n = large.pop(0)
        mate = next((i for i, p in enumerate(large) if n + p <= capacity), None)
        rooms.append(capacity - n - (large.pop(mate) if mate is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(best)
            rooms.append(best - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_one_at_a_time(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(3, 60))
    lengths = rng.integers(1, capacity + 1, rng.integers(1, 200)) if seed % 2 else np.minimum(rng.geometric(0.15, 200), capacity)
    plan = Plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))), capacity)
    rooms = sorted(r for r, groups in plan.open.items() for count, _ in groups for _ in range(count))
    assert rooms == brute_force(lengths.tolist(), capacity)


def test_every_rank_has_its_place(spark):
    rng = np.random.default_rng(7)
    lengths = np.r_[np.minimum(rng.geometric(0.03, 3000), 100), np.full(1500, 40)].tolist()  # a third of one length
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id int, length int").repartition(7)
    rows = pack(df, capacity=100).collect()
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    assert sorted(100 - f for f in fills(rows)) == brute_force(lengths, 100)


def test_query(spark):
    import __spark_entry__ as entry
    from tokenizers import Tokenizer
    sf = "/root/testdata/sf0.001"
    model = Tokenizer.from_file(byte_file())
    rows = entry.queries()["op13_best_fit"](spark, sf).collect()
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(model.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (at, n) in enumerate(cuts(len(ids), 2048)):
            want[d.doc_id, k] = (at, n, zlib.crc32(ids[at:at + n].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert sorted(2048 - f for f in fills(rows)) == brute_force([n for _, n, _ in want.values()], 2048)
