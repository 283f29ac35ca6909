import hashlib
import math

import numpy as np
import pytest

from gridloom.llm import codes


def brute_force(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, code, error, label_error) and codebooks, one part and entry at a time on Python integers."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    ints = [[math.floor(c) * scale if abs(c) >= 2 ** 53 else math.floor(c * scale) for c in [*v, *[0.0] * (dim - len(v))]] for _, v, _ in kept]
    width = dim // parts
    cut = [[x[p * width:(p + 1) * width] for p in range(parts)] for x in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def nearest(p, x):
        return min(((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p])))

    for _ in range(rounds):
        found = [[nearest(p, x[p])[1] for x in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, f in zip(cut, found[p]) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, "".join(f"{nearest(p, x[p])[1]:02x}" for p in range(parts)), sum(nearest(p, x[p])[0] for p in range(parts)), g)
           for (i, _, g), x in zip(kept, cut)]
    total = {}
    for _, _, e, g in out:
        total[g] = total.get(g, 0) + e
    return [(i, g, c, e, total[g]) for i, c, e, g in out], books


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got, books = codes.compress(df, **options)
    want, want_books = brute_force(rows, **options)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert books.entries == want_books
    text = ",".join(str(c) for part in want_books for e in part for c in e)
    assert books.digest() == hashlib.sha256(text.encode()).hexdigest()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 8))
    rows = [(int(i), (centres[i % 9] + 0.1 * rng.normal(size=8)).tolist(), int(i % 3)) for i in rng.permutation(150)]
    check(spark, rows, entries=20)


def test_ties_repeats_and_lengths(spark):
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (1, [0.25] * 8, 1), (None, [0.5] * 3, None), (2, [], None), (3, None, 1),
            (4, [float("nan")] * 8, 1), (5, [None] * 8, 2), (6, [-0.0001] * 5, 2), (None, [1.0] * 8, None), (7, [float("inf")] * 8, 2)]
    check(spark, rows)
    check(spark, rows, entries=2, rounds=2)
    check(spark, [(1, [], 1), (2, [], 1)])


@pytest.mark.parametrize("size", [2.0 ** 17, 2.0 ** 20 + 1 / 256, 2.0 ** 21 + 1 / 512])
def test_large_components(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (size * rng.choice([-1, 1, 1 + 2 ** -14], 4) + rng.normal(size=4)).tolist(), i % 2) for i in range(40)]
    check(spark, rows, entries=8)


def test_beyond_64_bits(spark):
    # An outlier that is an entry of its own has no error, however large it is; one that is not cannot be told.
    check(spark, [(1, [1e30, -3e25, 0.0, 1.0], 1), (2, [0.0, 1.0, 2.0, 3.0], 1)])
    rows = spark.createDataFrame([(1, [0.0], 1), (2, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(rows, entries=1)[0].collect()


def test_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)]):
        got, books = codes.compress(spark.createDataFrame(rows, schema))
        assert got.collect() == [] and books is None and got.columns == ["id", "label", "code", "error", "label_error"]


def test_masks_keep_every_nearest():
    rng = np.random.default_rng(5)
    for n, dim in ((1, 3), (64, 2), (65, 5), (256, 16)):
        entries = rng.integers(-50, 50, (n, dim))
        x = rng.integers(-60, 60, (300, dim))
        full = ((x[:, None] - entries[None]) ** 2).sum(-1)
        index, d = codes.Book(entries).nearest(x)
        assert (index == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        assert codes.Book(entries).candidates(x).shape == (300, -(-n // 64))
