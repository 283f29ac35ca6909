"""Repair of conversations by the cheapest edits, as integer minima over a graph of rows and role states.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. Every way to the end of a conversation weighs
one integer: its high digits are the cost, its low ones the audit letters of its edits (three bits each, D I K R as 1 to
4, first letter first, zeros after the last), so the least integer is the least cost and, of those, the least audit by
ASCII. No state of the graph ever needs more than its least integer.

Rows are range-partitioned by conversation and turn, so a conversation may lie in several slices. Those that lie wholly
inside one and are short are repaired where they are. The others travel as blocks of bounded size: a block's rows make a
4 x 4 matrix of integers, from the state before it to the state after it, and matrices multiply (minimum for sum, joining
of letters for product) like those of any shortest path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gridloom.functions.order import beside
from gridloom.llm.common import table
from gridloom.plans.registry import query
from gridloom.session import materialize

#: Rows of a block, and bytes of text after which a block ends.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Results, patterns and text held before an output batch leaves.
FLUSH = 2000
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: Nothing yet, after system, after user, after assistant; the state after a user or assistant row is put next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPACE = r"\x20\x09-\x0D"


Vector = list  # an integer per state, None where there is no way


class Weights:
    """Integers of ``width`` letters below the cost."""

    def __init__(self, width: int):
        self.width, self.shift = width, 3 * width
        self.mask = (1 << self.shift) - 1

    def before(self, letter: int, cost: int, rest: int | None) -> int | None:
        """The weight of an edit and what follows it."""
        if rest is None:
            return None
        return (((rest >> self.shift) + cost) << self.shift) | (letter << (self.shift - 3)) | ((rest & self.mask) >> 3)

    def letters(self, weight: int) -> str:
        return format(weight & self.mask, "o").zfill(self.width).rstrip("0").translate(str.maketrans("1234", LETTERS))


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def backwards(pattern: str, after: Vector, w: Weights) -> Vector:
    """Least weights from each state before the rows of ``pattern``, given those after them.

    A row is b (blank) or d (duplicate), else the initial of its role, x for other roles; upper case if truncated. Two
    inserts in a row never pay: they lead back to the same state, or from the start or a system row to one that can
    do no more than the state before them can, but for ending, for which deleting the system row is cheaper.
    """
    for row in reversed(pattern):
        first = row.lower()
        extra = row != first
        here = []
        for q in range(4):
            best = w.before(DELETE, 3, after[q])
            if first not in "bd":
                to = SYSTEM if first == "s" and q == START else NEXT[q] if first == ("", "", "u", "a")[NEXT[q]] else None
                if to is not None:
                    best = _least(best, w.before(KEEP, extra, after[to]))
                if to != NEXT[q]:
                    best = _least(best, w.before(REROLE, 2 + extra, after[NEXT[q]]))
            here.append(best)
        after = [_least(here[q], w.before(INSERT, 2, here[NEXT[q]])) for q in range(4)]
    return after


def ending(w: Weights) -> Vector:
    """Weights after the last row: an end that the pattern allows, or one more row that leads to it."""
    done = [0, None, None, 0]
    return [_least(done[q], w.before(INSERT, 2, done[NEXT[q]])) for q in range(4)]


def solve(pattern: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation."""
    w = Weights(2 * len(pattern) + 1)
    best = backwards(pattern, ending(w), w)[START]
    return best >> w.shift, w.letters(best)


class Matrix:
    """Least weights of a run of rows, from each state before them to each after."""

    def __init__(self, width: int, rows: list[Vector]):
        self.w, self.rows = Weights(width), rows

    @classmethod
    def of(cls, pattern: str) -> Matrix:
        w = Weights(2 * len(pattern))
        columns = [backwards(pattern, [0 if q == end else None for q in range(4)], w) for end in range(4)]
        return cls(w.width, [list(r) for r in zip(*columns)])

    @classmethod
    def end(cls) -> Matrix:
        w = Weights(1)
        return cls(1, [[v, None, None, None] for v in ending(w)])

    def _join(self, a: int | None, b: int | None, other: Weights) -> int | None:
        if a is None or b is None:
            return None
        low = a & self.w.mask
        free = ((low & -low).bit_length() - 1) // 3 if low else self.w.width  # letters not taken
        cost = (a >> self.w.shift) + (b >> other.shift)
        return (cost << (self.w.shift + other.shift)) | (low << other.shift) | ((b & other.mask) << (3 * free))

    def then(self, other: Matrix) -> Matrix:
        return Matrix(self.w.width + other.w.width,
                      [[_least(*(self._join(self.rows[q][m], other.rows[m][end], other.w) for m in range(4))) for end in range(4)]
                       for q in range(4)])


class Product:
    """Product of matrices that arrive in order; only factors of like size are multiplied, as in merging."""

    def __init__(self):
        self.stack: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix) -> None:
        size = 1
        while self.stack and self.stack[-1][0] <= size:
            n, left = self.stack.pop()
            size, m = n + size, left.then(m)
        self.stack.append((size, m))

    def total(self) -> Matrix:
        out = Matrix.end()
        for _, m in reversed(self.stack):
            out = m.then(out)
        return out


def apply_edits(audit: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[dict], int]:
    """Repaired turns of the given rows from ``state`` on, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append({"role": ROLES[state], "text": ""})
            continue
        if letter == "K":
            state = SYSTEM if state == START and roles[at][:1] == "s" else NEXT[state]
            out.append({"role": roles[at], "text": texts[at]})
        elif letter == "R":
            state = NEXT[state]
            out.append({"role": ROLES[state], "text": texts[at]})
        at += 1
    return out, state


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone, id, copy): the test damage by crc32(conv_id:turn) % 20.

    Null roles and texts, and null ids and turns within the key, read as one space. 0 drops the row (``gone``), 1
    empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name(conv_col), F.lit(":"), name(turn_col)).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(name(text_col), "[.!?]", "")).otherwise(name(text_col))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                F.when(kind == 4, "user").otherwise(name(role_col)).alias("role"), text.alias("text"),
                                (kind == 0).alias("gone"), F.monotonically_increasing_id().alias("id"),
                                F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copies")


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
_TURNS = "turns array<struct<role string, text string>>"
#: Of a block: its rows as a pattern, their initials and digests, the turns seen, roles and texts.
_BLOCK = ("slice int, number int, pattern string, initials string, digests array<binary>, first_turn long, last_turn long, n_turns long, "
          "roles array<string>, texts array<string>")
_FIRST = f"{_REPORT}, {_TURNS}, {_BLOCK}"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def _illegal(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in (initials[i:i + 2] for i in range(len(initials) - 1)))


class _Run:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv_id: int | None, open_: bool):
        self.conv_id, self.open, self.number = conv_id, open_, 0
        self.clear()

    def clear(self) -> None:
        self.codes, self.roles, self.texts, self.turns = [], [], [], []
        self.seen: set = set()
        self.n_bytes = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, whole: bool) -> None:
        first = _initial(role)
        if blank:
            self.codes.append("b")
        elif (role, text) in self.seen:
            self.codes.append("d")
        else:
            self.seen.add((role, text))
            self.codes.append(first if whole else first.upper())
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.n_bytes += len(role) + len(text)

    def block(self, slice_: int) -> dict:
        turns = [t for t in self.turns if t is not None]
        digests = [hashlib.md5(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest() if c not in "bd" else None
                   for c, r, t in zip(self.codes, self.roles, self.texts)]
        out = {"conv_id": self.conv_id, "slice": slice_, "number": self.number, "pattern": "".join(self.codes),
               "initials": "".join(map(_initial, self.roles)), "digests": digests, "first_turn": turns[0] if turns else None,
               "last_turn": turns[-1] if turns else None, "n_turns": len(set(turns)), "roles": self.roles, "texts": self.texts}
        self.number += 1
        self.clear()
        return out

    def report(self, solved) -> dict:
        pattern, turns = "".join(self.codes), [t for t in self.turns if t is not None]
        cost, audit = solved(pattern)
        return {"conv_id": self.conv_id, **counts_of(pattern), "illegal": _illegal("".join(map(_initial, self.roles))),
                "gaps": turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0, "cost": cost, "audit": audit,
                "turns": apply_edits(audit, self.roles, self.texts)[0]}


def counts_of(pattern: str) -> dict:
    return {"blank": pattern.count("b"), "duplicate": pattern.count("d"), "truncated": sum(c.isupper() for c in pattern)}


def _slices(rows: DataFrame, block_rows: int) -> DataFrame:
    """Reports and turns of the conversations that are short and wholly inside a slice, blocks of the others (_FIRST)."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "id", "copy"]
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    ordered = (rows.withColumn("digest", F.md5("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
               .select("conv_id", "turn", "role", "text", "gone", blank.alias("blank"), whole.alias("whole")))

    schema = _arrow(_FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, solved = TaskContext.get().partitionId(), lru_cache(1 << 16)(solve)
        out: list[dict] = []
        now: _Run | None = None
        held = 0
        for batch in batches:
            for conv_id, turn, role, text, gone, blank, whole in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        held += now.n_bytes
                        out.append(now.block(slice_) if now.open else now.report(solved))
                    now = _Run(conv_id, now is None)  # the first one may have begun before
                if len(now.codes) >= block_rows or now.n_bytes >= BLOCK_BYTES:
                    now.open = True
                    held += now.n_bytes
                    out.append(now.block(slice_))
                if not gone:
                    now.add(turn, role, text, blank, whole)
                if len(out) >= FLUSH or held >= BLOCK_BYTES:
                    yield _batch(out, schema)
                    out, held = [], 0
        if now is not None:
            out.append(now.block(slice_))  # the last one may go on
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(run, _FIRST)


def _with_earlier(blocks: DataFrame) -> DataFrame:
    """Blocks with ``earlier``: digests that occur in an earlier block of the same conversation."""
    conv = F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv")
    place = F.struct("slice", "number")
    each = blocks.select(*conv, place.alias("place"), F.explode(F.array_distinct(F.array_compact("digests"))).alias("digest"))
    first = each.groupBy("no_conv", "conv", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = (each.join(first, ["no_conv", "conv", "digest"]).where("place > first")
             .groupBy("no_conv", "conv", "place").agg(F.collect_list("digest").alias("earlier")))
    return (blocks.select("*", *conv, place.alias("place")).join(later, ["no_conv", "conv", "place"], "left"))


def _streamed(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over whole conversations, their blocks in order, a batch at a time."""
    return rows.repartition("no_conv", "conv").sortWithinPartitions("no_conv", "conv", "slice", "number").mapInArrow(run, schema)


_PRODUCT = "no_conv boolean, conv long, slice int, number int, pattern string, initials string, first_turn long, last_turn long, n_turns long, width int, weights array<binary>"


def _matrices(blocks: DataFrame) -> DataFrame:
    """Blocks (_PRODUCT) with later duplicates marked and their matrix."""
    schema = _arrow(_PRODUCT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                earlier = set(r["earlier"] or ())
                pattern = "".join("d" if d in earlier else c for c, d in zip(r["pattern"], r["digests"]))
                m = Matrix.of(pattern)
                weights = [None if v is None else v.to_bytes(v.bit_length() // 8 + 1, "big") for row in m.rows for v in row]
                out.append({**r, "pattern": pattern, "width": m.w.width, "weights": weights})
            yield _batch(out, schema)

    return blocks.select("no_conv", "conv", "slice", "number", "pattern", "initials", "digests", "first_turn", "last_turn", "n_turns",
                         "earlier").mapInArrow(run, _PRODUCT)


class _Long:
    """What is known of a conversation in blocks, from its blocks in order."""

    def __init__(self):
        self.product, self.blocks, self.initials = Product(), [], ""
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = None
        self.n_turns = 0

    def add(self, r: dict) -> None:
        weights = [None if v is None else int.from_bytes(v, "big") for v in r["weights"]]
        self.product.add(Matrix(r["width"], [weights[q:q + 4] for q in range(0, 16, 4)]))
        self.blocks.append((r["slice"], r["number"], r["pattern"]))
        for k, n in counts_of(r["pattern"]).items():
            self.counts[k] += n
        self.counts["illegal"] += _illegal(self.initials + r["initials"])
        self.initials = r["initials"][-1:] or self.initials
        if r["first_turn"] is not None:
            self.n_turns += r["n_turns"] - (self.last == r["first_turn"])
            self.first = r["first_turn"] if self.first is None else self.first
            self.last = r["last_turn"]

    def rows(self, key: dict) -> Iterator[dict]:
        """The report, then the letters of each block; an insert goes to the block of the row after it."""
        total = self.product.total()
        best = total.rows[START][0]
        audit = total.w.letters(best)
        gaps = self.last - self.first + 1 - self.n_turns if self.first is not None else 0
        yield {**key, **self.counts, "gaps": gaps, "cost": best >> total.w.shift, "audit": audit}
        at, state = 0, START
        for i, (slice_, number, pattern) in enumerate(self.blocks):
            start, before, row = at, state, 0
            while at < len(audit) and (row < len(pattern) or i == len(self.blocks) - 1):
                letter = audit[at]
                if letter != "D":
                    kept_system = state == START and letter == "K" and pattern[row].lower() == "s"
                    state = SYSTEM if kept_system else NEXT[state]
                row += letter != "I"
                at += 1
            yield {**key, "slice": slice_, "number": number, "letters": audit[start:at], "state": before}


_SOLVED = ("no_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "slice int, number int, letters string, state int")


def _solved(matrices: DataFrame) -> DataFrame:
    """Reports and block letters (_SOLVED) of the conversations in blocks."""
    schema = _arrow(_SOLVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, _Long()
        for batch in batches:
            for r in batch.to_pylist():
                k = {"no_conv": r["no_conv"], "conv": r["conv"]}
                if k != key:
                    if key is not None:
                        yield from _in_batches(now.rows(key), schema)
                    key, now = k, _Long()
                now.add(r)
        if key is not None:
            yield from _in_batches(now.rows(key), schema)

    return _streamed(matrices, run, _SOLVED)


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == FLUSH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _repaired_blocks(blocks: DataFrame, solved: DataFrame) -> DataFrame:
    """(no_conv, conv, slice, number, turns): what the letters make of each block."""
    ddl = f"no_conv boolean, conv long, slice int, number int, {_TURNS}"
    schema = _arrow(ddl)
    letters = solved.where("letters IS NOT NULL").select("no_conv", "conv", "slice", "number", "letters", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([{**r, "turns": apply_edits(r["letters"], r["roles"], r["texts"], r["state"])[0]} for r in batch.to_pylist()], schema)

    return (blocks.join(letters, ["no_conv", "conv", "slice", "number"])
            .select("no_conv", "conv", "slice", "number", "roles", "texts", "letters", "state").mapInArrow(run, ddl))


def repair(rows: DataFrame, *, block_rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of the conversations in ``rows`` (conv_id, turn, role, text, gone, id, copy).

    The first result has a row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. The second
    holds the turns, (conv_id, whole, slice, number, turns): a conversation's turns in order of slice and number, in
    one row if ``whole``. Rows that are ``gone`` only keep their conversation alive; one without others has zeros, an
    empty audit and no turns. Order is by turn, nulls first, then role, then the text's MD5, so equal rows lie side by
    side. Null conversation ids are one conversation; roles and texts must not be null; no rows give no rows.
    """
    first = materialize(_slices(rows, block_rows))
    short = first.where("cost IS NOT NULL")
    key = F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv")
    blocks = first.where("cost IS NULL")
    solved = materialize(_solved(_matrices(_with_earlier(blocks))))
    conv_id = F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")
    names = [f.split()[0] for f in _REPORT.split(", ")]
    reports = short.select(*names).unionByName(solved.where("letters IS NULL").select(conv_id, *names[1:]))
    long_turns = _repaired_blocks(blocks.select("*", *key), solved).select(conv_id, F.lit(False).alias("whole"), "slice", "number", "turns")
    return reports, short.select("conv_id", F.lit(True).alias("whole"), F.lit(0).alias("slice"), F.lit(0).alias("number"), "turns").unionByName(long_turns)


def turns_text(turns: str = "turns") -> Column:
    return F.concat_ws("\n", F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the second result of ``repair``; a conversation in blocks passes its task as a stream."""
    ddl = "conv_id long, repaired_sha256 string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, some = None, hashlib.sha256(), False

        def result() -> pa.RecordBatch:
            return _batch([{"conv_id": None if key[0] else key[1], "repaired_sha256": sha.hexdigest()}], schema)

        for batch in batches:
            for no_conv, conv, n, text in zip(*(batch.column(c) for c in ("no_conv", "conv", "n", "text"))):
                here = no_conv.as_py(), conv.as_py()
                if here != key:
                    if key is not None:
                        yield result()
                    key, sha, some = here, hashlib.sha256(), False
                if n.as_py():
                    sha.update((b"\n" if some else b"") + text.as_buffer().to_pybytes())
                    some = True
        if key is not None:
            yield result()

    whole = turns.where("whole").select("conv_id", F.sha2(turns_text(), 256).alias("repaired_sha256"))
    rest = turns.where("NOT whole").select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"),
                                           "slice", "number", F.size("turns").alias("n"), turns_text().alias("text"))
    return whole.unionByName(_streamed(rest, run, ddl))


def repaired_with_digest(rows: DataFrame, *, block_rows: int = BLOCK) -> DataFrame:
    """The reports of ``repair`` with the digest of each conversation's turns."""
    reports, turns = repair(rows, block_rows=block_rows)
    return beside(reports, digests(turns), ["conv_id"])


def _edit_sql(first: str, extra: str, after) -> str:
    """SQL of the weights (cost c, audit a) before a row, from those after it: ``after(q)`` is SQL of state q."""
    def before(letter, cost, rest):
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a}}"

    def row(q):
        options = [before("D", 3, after(q))]
        kept = {START: [("s", SYSTEM), ("u", USER)], SYSTEM: [("u", USER)], USER: [("a", ASSISTANT)], ASSISTANT: [("u", USER)]}[q]
        none = "{'c': 1000000000, 'a': ''}"
        options += [f"CASE WHEN {first} = '{i}' THEN {before('K', extra, after(to))} ELSE {none} END" for i, to in kept]
        options.append(f"CASE WHEN {first} IN ('b', 'd') THEN {none} ELSE {before('R', f'2 + {extra}', after(NEXT[q]))} END")
        return f"least({', '.join(options)})"

    def state(q):
        return f"least({row(q)}, {before('I', 2, row(NEXT[q]))})"

    return "{" + ", ".join(f"'q{q}': {state(q)}" for q in range(4)) + "}"


def _sql() -> str:
    step = _edit_sql("lower(x)", "CAST(x <> lower(x) AS INT)", lambda q: f"acc.q{q}")
    end = "{'q0': {'c': 0, 'a': ''}, 'q1': {'c': 1000000000, 'a': ''}, 'q2': {'c': 2, 'a': 'I'}, 'q3': {'c': 0, 'a': ''}}"
    pair = "CASE WHEN i IN ('s', 'u', 'a') THEN i ELSE 'x' END"
    return rf"""WITH tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) AS r(n)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM kinds, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n, left(role, 1) AS i FROM damaged),
coded AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
  WHEN regexp_matches(text, '[.!?][{SPACE}]*\z') THEN {pair} ELSE upper({pair}) END AS code,
  lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM placed),
found AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (WHERE code = 'b') AS blank, count(*) FILTER (WHERE code = 'd') AS duplicate, count(*) FILTER (WHERE code <> lower(code)) AS truncated,
  count(*) FILTER (WHERE n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list_reduce(list(code ORDER BY n DESC), lambda acc, x: {step}, {end}).q0 AS best FROM coded GROUP BY conv_id),
edits AS (SELECT conv_id, unnest(string_split(best.a, '')) AS e, generate_subscripts(string_split(best.a, ''), 1) AS pos FROM found WHERE best.a <> ''),
counted AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS n, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS made FROM edits),
made AS (SELECT c.conv_id, pos, made, e, role, text, bool_or(made = 1 AND e = 'K' AND lower(code) = 's') OVER (PARTITION BY c.conv_id) AS system
  FROM counted AS c LEFT JOIN coded AS d ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.n AND c.e <> 'I' WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (made - CAST(system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS t FROM made GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN found AS f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN texts AS x ON o.conv_id IS NOT DISTINCT FROM x.conv_id"""


@query("op11_integer_repair", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_with_digest(damaged(table(spark, sf_dir, "conversations")))
