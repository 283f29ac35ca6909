import itertools
import math
import zlib
from collections import Counter

import numpy as np

from gridloom.llm import hmm


def small_model(rng, k=3):
    emit = np.zeros((hmm.CLASSES, k))
    emit[:5] = rng.dirichlet(np.ones(5), k).T
    return hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit)


def paths(model, text):
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
        yield path, p


def test_recursions_match_sums_over_paths():
    rng = np.random.default_rng(2)
    model = small_model(rng)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (4, 1, 6, 4, 2)]
    layout = hmm.Layout(texts)
    got = hmm.forward(model, layout)[0]
    for i, value in zip(layout.order, got):
        assert math.isclose(value, math.log(sum(p for _, p in paths(model, texts[i]))), rel_tol=1e-9)
    start, move, emit = hmm.expected(model, layout)
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3))
    for text in texts:
        total = sum(p for _, p in paths(model, text))
        for path, p in paths(model, text):
            want[0][path[0]] += p / total
            for t, s in enumerate(path):
                want[2][text[t], s] += p / total
                if t:
                    want[1][path[t - 1], s] += p / total
    for a, b in zip((start, move, emit), want):
        assert np.allclose(a, b)


def test_query_base_and_gain(spark):
    from gridloom.llm.hmm import op5
    rows = op5(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    split = {i: [*t.encode().lower().split(), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        ws = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edges(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a b a"), (None, None), (1, "a b a"), (2, "")], "doc_id long, text string")
    rows = hmm.language_model_scores(docs, F.lit(None).cast("boolean")).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 4, 4] and all(np.isfinite(r.score) for r in rows)
    alone = hmm.language_model_scores(docs, F.lit(True)).collect()
    assert all(r.score == r.base_score and r.n_known == 0 for r in alone)
    assert hmm.language_model_scores(docs.limit(0), F.lit(False)).count() == 0
