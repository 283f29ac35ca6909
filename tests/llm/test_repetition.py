"""Texts that the base rule keeps and the coverage rules reject, one per limit, and texts that both keep."""

import numpy as np
import pytest

from gridloom.llm.common import RollingHash
from gridloom.llm.repetition import LIMITS, LINE_LIMIT, SCHEMA, measure, repetition_report

NAMES = [c.split()[0] for c in SCHEMA.split(", ")][1:]


def words(rng, n, letters=5):
    return ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, letters))]


def verdict(text):
    return dict(zip(NAMES, measure(np.frombuffer(text.encode(), np.uint8), RollingHash())))


def short_lines(rng):
    """A line of three words after every line of its own: no window of five words repeats."""
    return "\n".join(x for _ in range(30) for x in (" ".join(words(rng, 8)), "read more here"))


def one_block(rng, n):
    """A block of n long words, twice, in a text of short ones."""
    block = " ".join(words(rng, n, 12))
    return " ".join([*words(rng, 100, 4), block, *words(rng, 100, 4), block, *words(rng, 100, 4)])


def test_each_limit_rejects_what_the_base_rule_keeps():
    rng = np.random.default_rng(0)
    lines = verdict(short_lines(rng).replace("read more here", "continue reading elsewhere"))
    assert not lines["base_failed"] and not lines["kept"] and lines["n_repeat_words"] == 0
    assert lines["dup_line_chars"] > LINE_LIMIT * lines["word_chars"]
    for n in LIMITS:
        # Blocks of n words, each twice: too short for the next longer n-gram.
        blocks = [words(rng, n, 14) for _ in range(300 // (14 * n // 5))]
        text = words(rng, 12 * len(blocks) * n, 4)
        for i, b in enumerate(blocks * 2):
            text[11 * i * (n + 1) % len(text):0] = [*words(rng, 2, 4), *b, *words(rng, 2, 4)]
        while verdict(" ".join(text))["base_failed"]:
            text += words(rng, 10, 4)
        got = verdict(" ".join(text))
        share = got[f"dup_{n}_chars"] / got["word_chars"]
        assert not got["base_failed"] and share > LIMITS[n] and not got["kept"], (n, share)


def test_one_long_repeated_block():
    got = verdict(one_block(np.random.default_rng(1), 35))
    assert not got["base_failed"] and not got["kept"] and got["dup_10_chars"] > LIMITS[10] * got["word_chars"]


def test_clean_texts_stay():
    rng = np.random.default_rng(2)
    assert verdict(" ".join(words(rng, 300)))["kept"]
    passage = " ".join(words(rng, 12))
    assert verdict(" ".join([*words(rng, 60), passage, *words(rng, 60), passage]))["kept"]
    assert verdict("\n".join([*(" ".join(words(rng, 9)) for _ in range(20)), "the end", "the end"]))["kept"]


def test_long_and_odd_texts(spark):
    rng = np.random.default_rng(3)
    long = " ".join(words(rng, 400_000))
    rows = [(1, long), (2, long + "\n" + long), (3, None), (4, ""), (5, "\x0b é " * 40), (5, "\x0b é " * 40)]
    got = {(r.doc_id, r.n_words, r.kept) for r in repetition_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 400_000, True), (2, 800_000, False), (3, 0, False), (4, 0, False), (5, 40, False)}


@pytest.mark.parametrize("text,n,dup", [("a b c d e a b c d e", 10, 10), ("a b c d e f a b c d", 10, 0), ("x", 1, 0)])
def test_counts_by_hand(text, n, dup):
    got = verdict(text)
    assert (got["n_words"], got["n_repeat_words"]) == (n, dup)
