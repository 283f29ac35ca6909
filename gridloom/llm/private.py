"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds choose.

Spans of the four strict formats are always taken. Looser generators propose overlapping spans besides; trees over the
format of a span and its context, fitted here on a bounded sample, decide about those. What overlaps a strict span is no
example, as it is never scored. Private examples are strict spans rewritten into loose forms where they stand, and loose
spans that a check of their own confirms (``confirmed``); the others are examples of what is not private, but for those
beside a word such as tel or mail, which may be either. Texts are scanned in one narrow pass; nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.boosting import BoostedTrees
from gridloom.llm.common import table, text_bytes
from gridloom.plans.registry import query

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is always entered at its first one: from a later one nothing more could match.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Loose formats, as further kinds of span.
GENERATORS = {
    "mailbox": re.compile(r"[\w.+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[\w-]{1,64}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]{1,32}){1,4}"),
    "number": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){6,24}(?![0-9])"),
    "dial": re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{2,4}(?![0-9])"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
}
_CONTEXT = re.compile(r"(?i)\b(mail|contact|tel|phone|call|fax|mobile|card|visa|account|iban|ssn|address|ip|host)\b")
#: Documents and spans in the fitting sample at most (the documents on average), share of it that calibrates, and the
#: precision that a threshold must reach there.
SAMPLE_DOCS, SAMPLE_SPANS, CALIBRATE, PRECISION = 20_000, 100_000, 0.3, 0.995


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    """Start of the run of mailbox characters that ends at ``at``, not before ``least``."""
    step = 64
    while True:
        low = max(least, at - step)
        found = _LOCAL.search(text, low, at)
        start = found.start() if found else at
        if start > low or low == least:
            return start
        step *= 4


def strict_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strict formats, by start and then kind as listed in KINDS."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, end)
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Spans of the loose formats; they may overlap one another and the strict ones."""
    return sorted((m.start(), m.end(), kind) for kind, pattern in GENERATORS.items() for m in pattern.finditer(text))


def valid_account(body: str) -> bool:
    """Whether an account number has the check digits of an IBAN."""
    digits = "".join(str(int(c, 36)) for c in (body[4:] + body[:4]).replace(" ", ""))
    return int(digits) % 97 == 1


_AT, _DOT = re.compile(r"\x20?[(\[]at[)\]]\x20?"), re.compile(r"\x20?[(\[]dot[)\]]\x20?")
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def confirmed(body: str, kind: str) -> bool:
    """Whether a loose span is private by a check of its own: check digits, or a mailbox once (at) and (dot) are undone."""
    if kind == "account":
        return valid_account(body)
    if kind == "mailbox":
        return bool(_AT.search(body) and _MAILBOX.fullmatch(_DOT.sub(".", _AT.sub("@", body))))
    digits = re.sub("[^0-9]", "", body)
    return kind == "number" and "." in body and len(re.findall("[0-9]+", body)) > 2 and 12 <= len(digits) <= 19 and _luhn(digits)


def rewritten(body: str, kind: str) -> list[tuple[str, int]]:
    """Loose forms of a strict span, each with 1 if it is still private: chosen by a hash of the span."""
    choice = zlib.crc32(body.encode())
    if kind == "email":
        at, dot = ((" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."))[choice % 4]
        name, domain = body.split("@")
        return [(name + at + domain.replace(".", dot), 1)]
    if kind == "phone":
        return [(body[1:], 1)]
    if kind == "card":
        digits = re.sub("[^0-9]", "", body)
        number = digits[:len(digits) // 4 * 4]
        right = 98 - int(number + "131400") % 97  # D and E are 13 and 14
        wrong = 2 + (right - 1 + choice % 96) % 97
        groups = lambda x, gap: gap.join(x[i:i + 4] for i in range(0, len(x), 4))
        gap = " " * (choice // 96 % 2)
        return [(groups(digits, "."), 1), (groups(f"DE{right:02d}{number}", gap), 1), (groups(f"DE{wrong:02d}{number}", gap), 0)]
    return []


def examples(text: str) -> list[tuple[list[float], int, str]]:
    """(features, 1 if private else 0, kind) of what the loose formats find in ``text`` and in rewritten forms of its strict spans."""
    strict, out = strict_spans(text), []
    taken = merged(strict)
    for s in proposals(text):
        if _overlaps(s, taken):
            continue
        private = confirmed(text[s[0]:s[1]], s[2])
        if private or s[2] == "account" or not _CONTEXT.search(text[max(0, s[0] - 40):s[0]]):
            out.append((features(text, s), int(private), s[2]))
    for start, end, kind in strict:
        before, after = text[max(0, start - 80):start], text[end:end + 80]
        for form, private in rewritten(text[start:end], kind):
            near = before + form + after
            at = (len(before), len(before) + len(form))
            out += [(features(near, s), private, s[2]) for s in proposals(near)
                    if s[0] < at[1] and at[0] < s[1] and (s[2] == "account") == (form[:2] == "DE" and kind == "card")]
    return out


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    start, end, kind = span
    body = text[start:end]
    digits = [c for c in body if c.isdigit()]
    groups = re.findall(r"[0-9]+", body)
    before, after = text[max(0, start - 40):start], text[end:end + 20]
    return [
        list(GENERATORS).index(kind), end - start, len(digits), len(groups), max(map(len, groups), default=0),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, body.count("."), body.count("-"), body.count(" "),
        body.count("("), body.count("@"), sum(c.isalpha() for c in body), sum(c.isupper() for c in body),
        float(bool(digits) and _luhn("".join(c for c in digits if c.isascii()))),
        float(before[-1:].isalnum()), float(before.rstrip()[-1:] == "+"), float(after[:1].isalnum()),
        float(kind == "account" and valid_account(body)), float(bool(_AT.search(body))),
        float(bool(_CONTEXT.search(before))), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
    ]


def _overlaps(span, taken: list[tuple[int, int]]) -> bool:
    """Whether ``span`` shares a character with one of ``taken``, sorted and merged."""
    i = bisect_right(taken, (span[1] - 1, float("inf")))
    return i > 0 and taken[i - 1][1] > span[0]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s[0], s[1]) for s in spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


class Detector:
    """Thresholds per loose kind over the trees; without a model only strict spans are found."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: dict[str, float] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    @classmethod
    def fit(cls, rows: list[tuple[list[float], int, str]]) -> "Detector":
        """rows: (features, 1 if private, kind), as ``examples`` gives them."""
        if len({y for _, y, _ in rows}) < 2 or len(rows) < 50:
            return cls()
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        kinds = np.array([r[2] for r in rows])
        held = np.random.default_rng(7).random(len(rows)) < CALIBRATE
        if len(set(y[~held])) < 2:
            return cls()
        trees = BoostedTrees().fit(x[~held], y[~held])
        score, thresholds = trees.score(x), {}
        for kind in GENERATORS:
            part = held & (kinds == kind)
            order = np.argsort(-score[part], kind="stable")
            if len(order) < 20:
                continue
            precision = np.cumsum(y[part][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(precision >= PRECISION)
            if len(good):
                last = np.r_[score[part][order], 0.0][good[-1]:good[-1] + 2]  # midway to what would spoil it, if anything
                thresholds[kind] = float(max(last.mean() if good[-1] + 1 < len(order) else 0.5, 0.5))
        return cls(trees, thresholds)

    def spans(self, text: str) -> tuple[list, list]:
        """(strict spans, further spans): the further ones share no character with a strict one or each other."""
        strict = strict_spans(text)
        if not self.thresholds:
            return strict, []
        taken = merged(strict)
        loose = [s for s in proposals(text) if s[2] in self.thresholds and not _overlaps(s, taken)]
        if not loose:
            return strict, []
        scored = zip(self.trees.score(np.array([features(text, s) for s in loose])).tolist(), loose)
        more: list = []
        # The longest first, so that no part of a number stays behind.
        for p, s in sorted((x for x in scored if x[0] >= self.thresholds[x[1][2]]), key=lambda x: (x[1][0] - x[1][1], -x[0], x[1])):
            if not any(s[0] < o[1] and o[0] < s[1] for o in more):
                more.append(s)
        return strict, sorted(more)


_DIGIT_OR_AT = np.isin(np.arange(256), list(b"0123456789@([")).astype(bool)


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts, blank where nothing could match."""
    data, at = text_bytes(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield data[a:b].tobytes().decode() if b > a and _DIGIT_OR_AT[data[a:b]].any() else ""


def fit_detector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """A detector fitted on the examples of about SAMPLE_DOCS documents, chosen by a hash of the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in _texts(batch.column(0)):
                out += examples(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.list_(pa.float64())), pa.array([o[1] for o in out], pa.int32()),
                 pa.array([o[2] for o in out], pa.string())], ["x", "y", "kind"])

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("private")), F.lit(1 << 30))
    rows = docs.where(place < int(share * (1 << 30))).select(text_col).mapInArrow(run, "x array<double>, y int, kind string")
    found = [(list(r.x), r.y, r.kind) for r in rows.limit(SAMPLE_SPANS).collect()]
    return Detector.fit(sorted(found))


def find_private(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, more) for every row: arrays of (start, end, kind) in code points, end exclusive.

    ``spans`` are the strict ones, ``more`` those that the detector adds. Null texts read as empty and have none. Ids
    may be null or repeat; other columns are not read; no rows give no rows.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    span_sql = "array<struct<start:int,end:int,kind:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detector.spans(t) for t in _texts(batch.column(1))]
            lists = [[[dict(zip(("start", "end", "kind"), s)) for s in f[i]] for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists[0], span), pa.array(lists[1], span)], ["id", "spans", "more"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, f"id long, spans {span_sql}, more {span_sql}")


def redacted(docs: DataFrame, detector: Detector, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by its kind, as in [EMAIL]; overlapping spans become one replacement.

    Null texts stay null. ``chars_col``, if such a column exists, becomes the new number of code points; all else stays.
    """
    def clean(text: str) -> str:
        strict, more = detector.spans(text)
        spans = sorted(strict + more)
        out, at = [], 0
        for start, end in merged(spans):
            kind = next(s[2] for s in spans if s[0] == start)
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            old = batch.column(i)
            data, at = text_bytes(old)
            new = [None if not ok else clean(data[a:b].tobytes().decode()) for ok, a, b in
                   zip(old.is_valid().to_pylist(), at[:-1].tolist(), at[1:].tolist())]
            columns = list(batch.columns)
            columns[i] = pa.array(new, batch.schema.field(i).type)
            if chars_col in batch.schema.names:
                j = batch.schema.get_field_index(chars_col)
                sizes = pa.array([None if t is None else len(t) for t in new], pa.int64())
                columns[j] = sizes.cast(batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op6_boosted_spans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_private(docs, fit_detector(docs))
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, *GENERATORS))), s["kind"])
    every = F.array_sort(F.transform(F.concat("spans", "more"), lambda s: F.struct(
        s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(every).alias("spans"))
