"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Each text is measured alone, in one narrow pass over Arrow batches: no shuffle, and memory of one batch. Rolling
hashes of the words, and of windows of words, come from prefix sums in numpy; no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import RollingHash, repeated, table, text_bytes, word_bounds
from gridloom.plans.registry import query

#: n-gram length -> largest share of the characters of words that duplicated n-grams may cover. The base rule counts words
#: and allows a fifth of them; measured in characters, blocks of long words pass it that fill more of the text. A single
#: repeated passage fills up to 0.214 of documents that are labelled good, so 5 and 7 stay above that, and 10 above 0.191.
LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
#: Largest share of the characters of words in lines that repeat an earlier line: lines of fewer than five words, between
#: others, are no repeated window. Published quality rules use a fifth; documents labelled good stay below 0.107.
LINE_LIMIT = 0.20
MIN_WORDS = 10
BASE_WINDOW, BASE_PERCENT = 5, 20
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_5_chars long, dup_7_chars long, dup_10_chars long, dup_line_chars long")


def covered(codes: np.ndarray, n: int, hashes: RollingHash) -> np.ndarray:
    """Whether each word lies in a window of n words that the text holds twice or more."""
    marks = np.zeros(len(codes) + 1, np.int64)
    if len(codes) > n:
        twice = repeated(hashes.windows(codes, n)).astype(np.int64)
        marks[:len(twice)] += twice
        marks[n:n + len(twice)] -= twice
    return np.cumsum(marks[:-1]) > 0


def measure(text: np.ndarray, hashes: RollingHash) -> tuple:
    """The columns of SCHEMA after doc_id, for one text given as UTF-8 bytes."""
    starts, ends = word_bounds(text)
    n_words = len(starts)
    if n_words == 0:
        return (0, 0, int(_SYMBOL[text].sum()), 0, 0, True, False, 0, 0, 0, 0)
    chars = np.zeros(len(text) + 1, np.int64)
    np.cumsum((text & 0xC0) != 0x80, out=chars[1:])
    lengths = chars[ends] - chars[starts]
    word_chars = int(lengths.sum())
    byte_codes = hashes.byte_codes[text]
    codes = hashes.slices(byte_codes, starts, ends)

    breaks = np.flatnonzero(text == 10)
    line_starts, line_ends = np.r_[0, breaks + 1], np.r_[breaks, len(text)]
    first = np.searchsorted(starts, line_starts)
    last = np.searchsorted(starts, line_ends)
    full = last > first
    line_starts, line_ends, first, last = line_starts[full], line_ends[full], first[full], last[full]
    _, kept_lines = np.unique(hashes.slices(byte_codes, line_starts, line_ends), return_index=True)
    later = np.ones(len(line_starts), bool)
    later[kept_lines] = False
    sums = np.r_[0, np.cumsum(lengths)]
    dup_line_chars = int((sums[last] - sums[first])[later].sum())

    in_ngrams = {n: covered(codes, n, hashes) for n in {BASE_WINDOW, *LIMITS}}
    n_repeat = int(in_ngrams[BASE_WINDOW].sum())
    dup_chars = {n: int(lengths[in_ngrams[n]].sum()) for n in LIMITS}
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > BASE_PERCENT * n_words
    kept = (not base_failed and dup_line_chars <= LINE_LIMIT * word_chars
            and all(dup_chars[n] <= limit * word_chars for n, limit in LIMITS.items()))
    return (n_words, word_chars, int(_SYMBOL[text].sum()), int(later.sum()), n_repeat, base_failed, kept,
            *dup_chars.values(), dup_line_chars)


def _measured(batch: pa.RecordBatch, text_col: str, hashes: RollingHash) -> list[tuple]:
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
    return [measure(data[a:b], hashes) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, coverage and verdict of every row of ``docs``; one row out per row in, whatever repeats.

    Null and blank texts have no word: they fail with zero counts. A null id stays null. Only the two named columns
    are read, so further columns may have any name. An empty table gives an empty table.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_()}[part.split()[1]] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash()
        for batch in batches:
            columns = list(zip(*_measured(batch, "text", hashes))) or [()] * (len(names) - 1)
            arrays = [batch.column(0).cast(pa.int64())] + [pa.array(c, t) for c, t in zip(columns, types[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)


def keep_unrepetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text passes the rules. Null texts go."""
    verdict = SCHEMA.split(", ").index("kept boolean") - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash()
        for batch in batches:
            yield batch.filter(pa.array([row[verdict] for row in _measured(batch, text_col, hashes)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _coverage_sql(n: int) -> str:
    return f"""
    win{n} AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) c FROM (
        SELECT rid, unnest(range(1, len(ws) - {n} + 2)) pos,
               unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: list_slice(ws, i, i + {n} - 1))) gram
        FROM w WHERE len(ws) >= {n})),
    cov{n} AS (SELECT rid, count(*) n_in, sum(length(word)) chars_in FROM (
        SELECT DISTINCT x.rid, x.pos, x.word FROM
            (SELECT rid, unnest(range(pos, pos + {n})) pos FROM win{n} WHERE c > 1) r JOIN x USING (rid, pos)) GROUP BY rid)"""


_LIMIT_SQL = " AND ".join(f"coalesce(c{n}.chars_in, 0) <= {limit!r} * word_chars" for n, limit in LIMITS.items())
SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws FROM d),
x AS (SELECT rid, unnest(range(1, len(ws) + 1)) pos, unnest(ws) word FROM w),
{", ".join(_coverage_sql(n) for n in LIMITS)},
lines AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) k FROM
    (SELECT rid, unnest(string_split(t, chr(10))) line FROM w)
    WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 0),
l AS (SELECT rid, count(*) n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) chars FROM lines WHERE k > 1 GROUP BY rid),
b AS (SELECT w.rid, doc_id, len(ws) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols FROM w),
r AS (SELECT b.*, coalesce(l.n, 0) n_dup_lines, coalesce(c5.n_in, 0) n_repeat_words,
      n_words < {MIN_WORDS} OR 100 * coalesce(c5.n_in, 0) > {BASE_PERCENT} * n_words base_failed,
      coalesce(c5.chars_in, 0) dup_5_chars, coalesce(c7.chars_in, 0) dup_7_chars, coalesce(c10.chars_in, 0) dup_10_chars,
      coalesce(l.chars, 0) dup_line_chars, coalesce(l.chars, 0) <= {LINE_LIMIT!r} * word_chars AND {_LIMIT_SQL} fine
      FROM b LEFT JOIN l USING (rid) LEFT JOIN cov5 c5 USING (rid) LEFT JOIN cov7 c7 USING (rid) LEFT JOIN cov10 c10 USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept,
       dup_5_chars, dup_7_chars, dup_10_chars, dup_line_chars FROM r"""


@query("op7_repetition_coverage", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_report(table(spark, sf_dir, "documents"))
