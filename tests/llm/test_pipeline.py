"""The pipeline's stages against plain versions of what they promise, each on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as p
from gridloom.llm.mixing import WEIGHTS
from gridloom.llm.repetition import LIMITS, LINE_LIMIT
from test_near import brute_force
from test_private import brute

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def fine(text):
    """The quality rules, on lists of words."""
    words = WORD.findall(text or "")
    chars = sum(map(len, words))

    def inside(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        return {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + n)}

    if len(words) < 10 or 100 * len(inside(5)) > 20 * len(words):
        return False
    lines = [line for line in text.split("\n") if WORD.search(line)]
    again = sum(len(w) for i, line in enumerate(lines) if line in lines[:i] for w in WORD.findall(line))
    return again <= LINE_LIMIT * chars and all(sum(len(words[i]) for i in inside(n)) <= limit * chars for n, limit in LIMITS.items())


def redact(text):
    out, at = [], 0
    for start, end, kind in brute(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def targets(sizes):
    """Water-filling by repeated clamping: the excess of full sources goes to the others by weight."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(sources)}
    left, open_, out = 1.5 * sum(sizes.values()), set(sources), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, given = docs.columns, [docs.collect()]
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, SF_DIR))
        assert docs.columns == columns, name
        given.append(docs.collect())
    start, kept, distinct, clean, mixed = given

    assert Counter(kept) == Counter(r for r in start if fine(r.text))

    texts = sorted({r.text for r in kept})
    classes = dict(zip(texts, brute_force(texts)))
    groups = defaultdict(list)
    for r in kept:
        groups[classes[r.text]].append(r.doc_id)
    assert sorted(r.doc_id for r in distinct) == sorted(min(ids) for ids in groups.values()) and set(distinct) <= set(kept)

    by_id = {r.doc_id: r for r in distinct}
    assert len(clean) == len(distinct)
    for r in clean:
        old = by_id[r.doc_id]
        assert r.text == redact(old.text) and r.n_chars == len(r.text) and r[2:4] == old[2:4]

    size = {r.doc_id: len(WORD.findall(r.text)) for r in clean}
    sizes = Counter()
    for r in clean:
        sizes[r.source] += size[r.doc_id]
    want, taken, times = targets(sizes), Counter(), Counter(mixed)
    assert set(times) <= set(clean) and max(times.values()) <= 2
    for r, n in times.items():
        taken[r.source] += n * size[r.doc_id]
    for source, target in want.items():
        whole = int(target // sizes[source])
        assert all(whole <= times[r] <= whole + 1 for r in clean if r.source == source)
        assert abs(taken[source] - target) <= max(size[r.doc_id] for r in clean if r.source == source)

    from gridloom.llm.tokens import word_file
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(word_file())
    pieces = p.STAGES[-1][1](spark, docs, SF_DIR).collect()
    ids = {r.doc_id: np.array([*model.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in clean}
    covered = Counter()
    for r in pieces:
        assert bytes(r.ids) == ids[r.doc_id][r.start:r.start + r.length].tobytes()
        covered.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    assert covered == Counter({(r.doc_id, i): n for r, n in times.items() for i in range(len(ids[r.doc_id]))})
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 4096


def test_run_equals_the_stages(spark):
    rows = p.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0
