"""Hidden Markov language model: Baum-Welch counts aggregated across partitions, exact likelihoods by scaled recursion.

States emit word classes: the HEAD most frequent training words are classes of their own, all other words share TAIL
classes by hash. A word of a shared class then comes with its smoothed share of the class, counted over the whole
training corpus. So the tables in each task have a fixed size, while the counts behind every word are exact: those of
head words go along with the tasks, those of other words meet their texts in a join by word.

Texts are tokenized once and written as class numbers. A pass over them runs the recursions for many texts at a time,
step by step; an expectation step emits one row of state counts per class and task, which Spark sums by class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table, text_bytes, word_blocks
from gridloom.plans.registry import query
from gridloom.session import materialize

STATES, PASSES = 8, 2
HEAD, TAIL = 49_152, 8_192
END = HEAD + TAIL
CLASSES = END + 1
#: Texts that start the states (about so many), and steps of that start.
START_TEXTS, START_STEPS = 2_000, 12
#: Tokens whose recursions run together; longer texts than LONG run with their like.
TOGETHER, LONG = 600_000, 2_048
#: Share of the corpus distribution in the emissions of each state, and pseudo-transitions.
CORPUS_SHARE, PRIOR = 0.3, 50.0
FLUSH_WORDS = 200_000


def _split(text: bytes) -> Iterator[list[bytes]]:
    return word_blocks(text.lower())


def _counted(texts: DataFrame) -> DataFrame:
    """(word, n) partial counts of texts (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                for words in _split(data[a:b].tobytes()):
                    counts.update(words)
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "word binary, n long")


def _with_levels(counts: DataFrame) -> tuple[DataFrame, int]:
    """counts (word, c) with a level that rises with c, and the least level above which there are at most HEAD words.

    There are a few thousand levels whatever the counts, so that only those are collected to find the limit.
    """
    high = 4096 + F.floor(256 * (F.log2("c") - 12))
    counts = counts.withColumn("level", F.when(F.col("c") < 4096, F.col("c")).otherwise(high).cast("long"))
    least, words = 0, 0
    for level, n in sorted(((r.level, r.n) for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        words += n
        if words > HEAD:
            least = level
            break
    return counts, least


def _encoded(rows: DataFrame, head: dict[bytes, tuple[int, int]]) -> DataFrame:
    """rows (id, held_out, text) as class numbers, with what the head words add to the base score, and the other words."""
    names = ["id", "held_out", "n_tokens", "head_known", "head_log", "classes", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for w, (i, _) in head.items()}
        logs = np.zeros(HEAD)
        for i, c in head.values():
            logs[i] = np.log10(c + 0.5)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            data, at = text_bytes(batch.column(2))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                parts, rest = [], []
                for words in _split(data[a:b].tobytes()):
                    found = np.array([index.get(w, -1) for w in words], np.int64)
                    for i in np.flatnonzero(found < 0).tolist():
                        rest.append(words[i])
                        found[i] = HEAD + zlib.crc32(words[i]) % TAIL
                    parts.append(found)
                classes = np.concatenate([*parts, [END]]).astype(np.uint16)
                known = classes[classes < HEAD]
                for k, v in enumerate((len(classes), len(known), float(logs[known].sum()), classes.tobytes(), rest)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()),
                 pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.binary()))], names)

    return rows.mapInArrow(run, "id long, held_out boolean, n_tokens long, head_known long, head_log double, classes binary, tail array<binary>")


class Model:
    """start (K), move (K, K) and emit (CLASSES, K), each a probability."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start, move, emit, corpus: np.ndarray) -> "Model":
        """``emit`` counts (CLASSES, K), smoothed with the class distribution of the corpus."""
        own = emit / np.maximum(emit.sum(axis=0), 1e-300)
        emit = (1 - CORPUS_SHARE) * own + CORPUS_SHARE * corpus[:, None]
        move = move + PRIOR / len(move) * (0.1 + 0.9 * len(move) * np.eye(len(move)))
        return cls((start + 1) / (start + 1).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Layout:
    """Texts side by side, longest first: step t holds the t-th class of each text that is long enough."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        self.active = len(texts) - np.cumsum(np.bincount(sizes))[:-1]
        self.offsets = np.r_[0, np.cumsum(self.active)]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.rank = np.repeat(np.arange(len(sizes)), sizes)
        at = self.offsets[step] + self.rank
        self.classes = np.empty(len(at), np.uint16)
        self.classes[at] = np.concatenate([texts[i] for i in self.order])
        place = np.empty(len(at), np.int64)
        place[at] = self.rank
        self.rank = place


def forward(model: Model, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(natural log likelihood per text in the order of the layout, scaled forward values, scales)."""
    emitted = model.emit[layout.classes]
    alpha, scale = emitted, np.empty(len(emitted))
    before = None
    for t, n in enumerate(layout.active.tolist()):
        o = layout.offsets[t]
        now = emitted[o:o + n]
        now *= model.start if before is None else before[:n] @ model.move
        s = scale[o:o + n] = now.sum(axis=1)
        now /= s[:, None]
        before = now
    likelihood = np.bincount(layout.rank, np.log(scale), layout.active[0] if len(layout.active) else 0)
    return likelihood, alpha, scale


def expected(model: Model, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, move, emit) of the texts under the model."""
    _, alpha, scale = forward(model, layout)
    k = len(model.start)
    beta = np.ones((int(layout.active[0]), k))
    move, gamma = np.zeros((k, k)), alpha.copy()
    for t in range(len(layout.active) - 2, -1, -1):
        o, n, n_next = layout.offsets[t], int(layout.active[t]), int(layout.active[t + 1])
        p = layout.offsets[t + 1]
        ahead = model.emit[layout.classes[p:p + n_next]] * beta[:n_next] / scale[p:p + n_next, None]
        move += alpha[o:o + n_next].T @ ahead
        beta[:n_next] = ahead @ model.move.T
        gamma[o:o + n_next] *= beta[:n_next]
    emit = np.stack([np.bincount(layout.classes, gamma[:, j], CLASSES) for j in range(k)], axis=1)
    return gamma[:int(layout.active[0])].sum(axis=0), move * model.move, emit


def _together(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple[pa.RecordBatch, int, np.ndarray]]]:
    """Texts gathered up to TOGETHER tokens, long ones apart, as (batch, row, classes)."""
    waiting: dict[bool, list] = {False: [], True: []}
    held = {False: 0, True: 0}
    for batch in batches:
        for i, raw in enumerate(batch.column(column)):
            classes = np.frombuffer(raw.as_py(), np.uint16)
            kind = len(classes) > LONG
            waiting[kind].append((batch, i, classes))
            held[kind] += len(classes)
            if held[kind] > TOGETHER:
                yield waiting[kind]
                waiting[kind], held[kind] = [], 0
    yield from (w for w in waiting.values() if w)


def _step(training: DataFrame, model: Model, corpus: np.ndarray) -> Model:
    """One Baum-Welch pass over training (classes)."""
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        for group in _together(batches, 0):
            found = expected(model, Layout([c for _, _, c in group]))
            start, move, emit = start + found[0], move + found[1], emit + found[2]
        used = np.flatnonzero(emit.any(axis=1))
        rows = np.concatenate([emit[used], move, start[None]])
        keys = np.concatenate([used, -1 - np.arange(k), [-1 - k]])
        weights = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), k).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), weights], ["class", "w"])

    sums = (training.mapInArrow(run, "class int, w array<double>").groupBy("class")
            .agg(*[F.sum(F.col("w")[j]).alias(f"w{j}") for j in range(k)]).collect())  # CLASSES + k + 1 rows at most
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
    for row in sums:
        c, w = row[0], row[1:]
        if c >= 0:
            emit[c] = w
        elif c == -1 - k:
            start[:] = w
        else:
            move[-1 - c] = w
    return Model.from_counts(start, move, emit, corpus)


def _first_model(texts: list[np.ndarray], corpus: np.ndarray, states: int) -> Model:
    """States from a mixture of class distributions over some texts, with transitions that mostly stay."""
    rng = np.random.default_rng(11)
    lengths = np.array([len(t) for t in texts])
    classes = np.concatenate(texts)
    text = np.repeat(np.arange(len(texts)), lengths)
    weight = rng.dirichlet(np.full(states, 0.1), len(texts))
    for _ in range(START_STEPS):
        emit = np.stack([np.bincount(classes, weight[text, j], CLASSES) for j in range(states)], axis=1)
        prior = weight.mean(axis=0) + 1e-3
        logs = np.log(np.maximum(Model.from_counts(prior, np.eye(states), emit, corpus).emit, 1e-300))
        score = np.stack([np.bincount(text, logs[classes, j], len(texts)) for j in range(states)], axis=1) + np.log(prior)
        score -= score.max(axis=1, keepdims=True)
        weight = np.exp(score)
        weight /= weight.sum(axis=1, keepdims=True)
    return Model.from_counts(weight.sum(axis=0), np.eye(states) * len(classes) / states, emit, corpus)


def _likelihoods(encoded: DataFrame, model: Model) -> DataFrame:
    """(uid, log10) of encoded (uid, classes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _together(batches, 1):
            layout = Layout([c for _, _, c in group])
            found = forward(model, layout)[0] / np.log(10)
            uids = [group[i][0].column(0)[group[i][1]].as_py() for i in layout.order]
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(found)], ["uid", "log10"])

    return encoded.select("uid", "classes").mapInArrow(run, "uid long, log10 double")


def language_model_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                          states: int = STATES, passes: int = PASSES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows where ``held_out`` is not true (null counts as not). Null and blank texts are the end token
    alone. Repeated rows count and are scored each; null ids stay null; other columns are not read. Without training
    rows the score is the base score; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = materialize(_counted(rows.where("NOT held_out").select("text")).groupBy("word").agg(F.sum("n").alias("c")))
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    texts = rows.where("NOT held_out").count()
    tokens, distinct = words + texts, kinds + (texts > 0)
    counts, least = _with_levels(counts)
    top = sorted(counts.where(F.col("level") > least).collect(), key=lambda r: (-r.c, bytes(r.word)))  # HEAD rows at most
    head = {bytes(r.word): (i, r.c) for i, r in enumerate(top)}

    encoded = materialize(_encoded(rows, head).withColumn("uid", F.monotonically_increasing_id()))
    place = (F.lit(HEAD) + F.pmod(F.crc32("word"), F.lit(TAIL))).cast("int")
    tail_words = counts.where(F.col("level") <= least)
    tail_words = materialize(tail_words.withColumn("class", place))
    per_class = tail_words.groupBy("class").agg(F.sum("c").alias("class_c"), F.count("*").alias("class_v")).collect()  # TAIL rows at most
    sums = {r["class"]: (r.class_c, r.class_v) for r in per_class}

    rest = encoded.select("uid", F.explode("tail").alias("word")).join(tail_words.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sizes = np.full(TAIL, np.log10(0.5))
    for k, (n, v) in sums.items():
        sizes[k - HEAD] = np.log10(n + 0.5 * (v + 1))
    share = F.log10(c + 0.5)
    rest = rest.groupBy("uid").agg(F.sum(share).alias("tail_log"), F.sum((c > 0).cast("long")).alias("tail_known"))
    out = encoded.select("uid", "id", "held_out", "n_tokens", "head_known", "head_log", "classes").join(rest, "uid", "left")
    tail_log, tail_known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    end_log, all_log = float(np.log10(texts + 0.5)), float(np.log10(tokens + 0.5 * (distinct + 1)))
    base = F.col("head_log") + tail_log + end_log - F.col("n_tokens") * all_log
    shown = [F.col("id"), F.col("held_out"), F.col("n_tokens"), (F.col("head_known") + tail_known + int(texts > 0)).alias("n_known"),
             F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score")]
    if texts == 0:
        return out.select(*shown, base.alias("score"))

    seen = np.zeros(CLASSES)
    for i, r in enumerate(top):
        seen[i] = r.c
    for k, (n, _) in sums.items():
        seen[k] = n
    seen[END] = texts
    seen[:len(top)] += 0.5
    seen[HEAD:] += 0.5
    corpus = seen / seen.sum()
    training = encoded.where("NOT held_out").select("classes")
    chosen = encoded.where("NOT held_out AND n_tokens > 1").where(
        F.pmod(F.xxhash64("uid", F.lit("start")), F.lit(1 << 30)) < int(min(1.0, START_TEXTS / texts) * (1 << 30)))
    start = [np.frombuffer(r.classes, np.uint16) for r in chosen.select("classes").limit(2 * START_TEXTS).collect()]
    model = _first_model(start or [np.array([END], np.uint16)], corpus, states)
    for _ in range(passes):
        model = _step(training, model, corpus)
    scored = materialize(_likelihoods(encoded, model.__class__(model.start, model.move, _with_sizes(model.emit, sizes))))
    return out.drop("classes").join(scored, "uid").select(*shown, (F.col("log10") + tail_log).alias("score"))


def _with_sizes(emit: np.ndarray, log10_sizes: np.ndarray) -> np.ndarray:
    """Emissions of shared classes divided by the smoothed size of the class: times a word's count they are its share."""
    emit = emit.copy()
    emit[HEAD:END] /= 10 ** log10_sizes[:, None]
    return emit


@query("op5_hidden_markov")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return language_model_scores(table(spark, sf_dir, "documents"), held_out).withColumnRenamed("id", "doc_id")
