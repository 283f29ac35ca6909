"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams. One pass over the texts writes the posting lists
of those trigrams (and of no others: what no rule asks for is never read); intersecting the lists of a rule gives the
documents that can match it, and only these are verified with the expression. A rule without mandatory trigrams has no
such query: its expression scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.trigrams import Query, trigram_query, trigrams
from gridloom.plans.registry import ORACLES, query
from gridloom.session import materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``, of which those stay whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed rules. A run of hexadecimal digits is maximal, as are the characters after AKIA, so their least length can
#: stand in the expression; that of an assigned value cannot, as a value too short still uses up its text.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Public token formats that the base rules do not name.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
#: Parts that each posting list is dealt into, so that a trigram found everywhere does not fill one task.
LIST_PARTS = 64


def posting_lists(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(trigram, id) for every trigram of ``vocabulary`` (lower case) in a text of ``docs`` (id, text)."""
    lowered = docs.select("id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in vocabulary]))
    return (lowered.select("id", F.explode(found).alias("trigram"))
            .repartition(F.col("trigram"), F.pmod(F.xxhash64("id"), F.lit(LIST_PARTS)))
            .sortWithinPartitions("trigram", "id"))


def _holds(q: Query, found: Column) -> Column:
    def every(alternative):
        return reduce(lambda a, b: a & b, [F.array_contains(found, t) for t in sorted(alternative)])

    clauses = [reduce(lambda a, b: a | b, [every(a) for a in sorted(clause, key=sorted)]) for clause in q]
    return reduce(lambda a, b: a & b, clauses)


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, kinds): the rules whose trigram query the postings of a document satisfy; only documents with one."""
    sets = postings.groupBy("id").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("found")), F.lit(k)) for k, q in queries.items()]))
    return sets.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind) in code points, end exclusive.

    Matches and the gaps between them alternate through the text, so their lengths add up to the positions.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, rule.pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("v"))
    empty = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)")

    def step(acc, piece):
        start = acc["at"] + F.char_length(piece["gap"])
        end = start + F.coalesce(F.char_length(piece["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        spans = F.when(F.char_length(piece["v"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of ``docs``; spans: sorted array of (start, rank, end, kind).

    Null texts read as empty and have no span. Ids may be null or repeat: the index only narrows down where to look,
    each row's own text decides. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    vocabulary = sorted(set().union(*(trigrams(q) for q in indexed.values())) if indexed else set())
    if vocabulary:
        found = materialize(candidates(materialize(posting_lists(rows, vocabulary)), indexed))
        rows = rows.join(found.withColumnRenamed("id", "id_"), F.col("id").eqNullSafe(F.col("id_")), "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)")
    per_rule = []
    for rank, rule in enumerate(rules):
        gate = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.col("text").rlike(rule.pattern)
        per_rule.append(F.when(gate, rule_spans(F.col("text"), rule, rank)).otherwise(none))
    return rows.select("id", F.array_sort(F.concat(*per_rule)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_trigram_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.expr(f"filter(spans, s -> s.rank = {i})")).cast("long").alias(f"n_{rule.kind}")
              for i, rule in enumerate(BASE_RULES)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def _spans_sql(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(m{rank}) + 1), lambda i: {{
        start: CAST(list_sum(list_transform(g{rank}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{rank}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        k: {rank}, stop: CAST(list_sum(list_transform(g{rank}[1:i], lambda x: length(x))) + list_sum(list_transform(m{rank}[1:i], lambda x: length(x))) AS BIGINT),
        kind: '{rule.kind}', size: length(v{rank}[i])}}), lambda s: s.size >= {rule.least})""", f"""
        regexp_extract_all(t, '{pattern}') m{rank}, regexp_extract_all(t, '{pattern}', {rule.group}) v{rank}, string_split_regex(t, '{pattern}') g{rank}"""


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = [_spans_sql(r, i) for i, r in enumerate(rules)]
    names = ", ".join(f"list_count(list_filter(s, lambda x: x.k = {i})) n_{r.kind}" for i, r in enumerate(BASE_RULES))
    text = "array_to_string(list_transform({}, lambda x: concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
    p AS (SELECT *, {", ".join(x[1] for x in parts)} FROM d),
    a AS (SELECT doc_id, list_sort(flatten([{", ".join(x[0] for x in parts)}])) s FROM p)
    SELECT doc_id, {names}, sha256(coalesce({text.format(f"list_filter(s, lambda x: x.k < {len(BASE_RULES)})")}, '')) base_sha256,
           coalesce({text.format("s")}, '') spans FROM a"""


ORACLES["op1_trigram_index"] = sql()
