"""Quality rules kept as a bitmask ledger.

Every rule is measured once per document; the ledger keeps the measurements and one bit per failed rule.
Policies (name, version, mask) choose afterwards which rules count: a document is kept if ``failed & mask`` is 0.
Changing a policy, or asking what a rule alone costs, only reads the ledger.  All expressions are native and
stay inside the row, so nothing is shuffled.

Edge cases: null text has no words; a blank text measures 0 everywhere and fails ``few_words``; repeated rows are
judged one by one; long texts are measured whole; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, read_table

_SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit of each rule: the position in this list.  Bits are never given to another rule; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("capitals", "100 * n_upper > 40 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
BIT = {name: 1 << n for n, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: (policy, version) -> mask.
POLICIES = {("base", 1): BASE, ("strict", 1): (1 << 5) - 1, ("strict", 2): (1 << len(RULES)) - 1}
IN_FORCE = ("strict", 2)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once (a lambda would compute it for every element)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs again: sort (hash, place), keep those with an equal neighbour, add up gaps."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        equal = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, k: equal(x, k - 1) | equal(x, k + 1))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return bind(bind(ranked, places), total)


def _repeat_words(words: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    counted = bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, measurements) per row; with ``carry`` the whole row beside them, as ``_row``."""
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("body"),
                       *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")] if carry else []))
    carried = ["_row"] if carry else []
    trimmed = F.btrim("body", F.lit(_SPACE_CHARACTERS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    from_words = bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again")))
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    from_lines = bind(lines, lambda line: F.struct(F.size(line).alias("n"), (F.size(line) - F.size(F.array_distinct(line))).alias("again")))
    long = lambda c: c.cast("bigint")
    return rows.select("doc_id", "body", *carried, from_words.alias("w"), from_lines.alias("l")).select(
        "doc_id", *carried, long(F.col("w.n")).alias("n_words"), long(F.length(F.translate("body", _SPACE_CHARACTERS, ""))).alias("word_chars"),
        long(F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).alias("n_symbols"),
        long(F.length("body") - F.length(F.regexp_replace("body", r"\p{Lu}+", ""))).alias("n_upper"),
        long(F.col("l.n")).alias("n_lines"), long(F.col("l.again")).alias("n_dup_lines"), long(F.col("w.again")).alias("n_repeat_words"))


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, measurements, failed): bit n of ``failed`` is set if rule n fails."""
    bits = None
    for name, failing in RULES:
        bit = F.when(F.expr(failing), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measures(docs, carry).withColumn("failed", bits)


def passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")) == 0


def apply_policies(kept: DataFrame, policies: dict[tuple[str, int], int]) -> DataFrame:
    """The ledger with one row per policy: (policy, version, kept) added."""
    table = F.array(*[F.struct(F.lit(name).alias("policy"), F.lit(version).alias("version"), F.lit(mask).cast("bigint").alias("mask")) for (name, version), mask in policies.items()])
    rows = kept.select("*", F.explode(table).alias("p"))
    return rows.select(*kept.columns, "p.policy", "p.version", (F.col("failed").bitwiseAND(F.col("p.mask")) == 0).alias("kept"))


def ablations(kept: DataFrame, mask: int) -> DataFrame:
    """(rule, n_failed, n_only): documents that fail a rule of the policy, and those that only this rule rejects.

    The ledger is first counted by bit pattern, so at most one row per pattern is worked on.
    """
    patterns = kept.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("bigint").alias("bit")) for name, bit in BIT.items() if bit & mask])
    rows = patterns.select("failed", "n", F.explode(table).alias("r")).filter(F.col("failed").bitwiseAND(F.col("r.bit")) != 0)
    return rows.groupBy("r.rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def keep_good(docs: DataFrame, mask: int = POLICIES[IN_FORCE]) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, in its columns."""
    return ledger(docs, carry=True).filter(passes(mask)).select("_row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = ledger(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(POLICIES[IN_FORCE]).alias("kept"), "failed")


QUERIES = {"op8_quality_rules": op8_quality_rules}
#: The same in DuckDB.
_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS v FROM d),
m AS (SELECT d.r, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
 length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper, len(v) AS n_lines, len(v) - len(list_distinct(v)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
 FROM d JOIN l ON l.r = d.r LEFT JOIN c ON c.r = d.r),
f AS (SELECT *, 
"""


def _sql() -> str:
    bits = " + ".join(f"CASE WHEN {failing} THEN {BIT[name]} ELSE 0 END" for name, failing in RULES)
    return f"""{_SQL} CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (failed & {BASE}) <> 0 AS base_failed, (failed & {POLICIES[IN_FORCE]}) = 0 AS kept, failed FROM f"""


ORACLES = {"op8_quality_rules": _sql()}
