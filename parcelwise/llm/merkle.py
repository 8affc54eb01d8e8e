"""Merkle manifest of a table of documents: a tree per language, one over the languages, and a proof for every row.

Rows are ranked inside their language without gathering it (range sort, counts per sorted part, prefix sums), then cut
into aligned blocks of ``FANOUT ** BLOCK_LEVELS`` leaves.  A block folds its own levels.  The levels above it come from a
butterfly exchange: in round r the blocks whose numbers differ only in digit r (base ``FANOUT``) swap the roots they have,
at most ``FANOUT`` of them, and each one hashes the common ancestor for itself.  So after the last round every block
holds the root and the siblings of all its ancestors; nothing is handed down again.  Where the last group of blocks is
ragged, the blocks it has answer in turn for those it lacks.  The subroots of the languages go through the same exchange.

A leaf is the hash of (doc_id, source, lang, n_chars, text), each as byte count, colon and value, or ``-`` if null.
A run of nodes becomes the hash of their hexadecimal texts, a run of one too, until one node is left.

Edge cases: null lang is a language of its own, before all others, and an empty text lang another; null ids come first
and are never tampered with; rows that repeat an id are ordered by their leaf, so equal rows are interchangeable; an empty
table has no rows and no root; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, read_table, remove, stored

FANOUT = 8
BLOCK_LEVELS = 3
FIELDS = (("doc_id", "bigint"), ("source", "string"), ("lang", "string"), ("n_chars", "bigint"), ("text", "string"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<left:string,right:string>"


def leaf_digest(values: list[Column]) -> Column:
    """Hash of the values, each with its byte count; null is ``-``."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): ``tree`` names the language, ``tampered`` is the leaf after tampering, null where there is none."""
    value = {name: column(docs, name, kind) for name, kind in FIELDS}
    texts = {name: v.cast("string") for name, v in value.items()}
    lowered = texts | {"text": F.translate(texts["text"], _UPPER, _LOWER)}
    struck = F.crc32(texts["doc_id"].cast("binary")) % 3 == 0
    # Null first, then the names in byte order.
    tree = F.when(value["lang"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value["lang"]))
    return docs.select(tree.alias("tree"), value["doc_id"].alias("doc_id"), leaf_digest(list(texts.values())).alias("leaf"), F.when(struck, leaf_digest(list(lowered.values()))).alias("tampered"))


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, their rank in ``tree`` from 0, and ``n``, the rows of that tree; ``order`` settles the rank."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")]
    lines = stored(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_line", F.monotonically_increasing_id()), name)
    # The upper bits of a line number are its part; the lines of a tree are consecutive in a part.
    part = F.shiftright("_line", 33)
    counts = lines.groupBy("tree", part.alias("_part")).agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    return lines.withColumn("_part", part).join(bases, ["tree", "_part"]).withColumn("at", F.col("_line") + F.col("_shift")).drop("_line", "_part", "_shift")


def _joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def _parents(level: Column) -> Column:
    """The hashes of the runs of a level."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(_joined(F.slice(level, i * FANOUT + 1, FANOUT)), 256))


def _siblings(level: Column, i: Column) -> Column:
    """The others of node i's run, left and right of it."""
    digit = i % FANOUT
    left, right = F.slice(level, i - digit + 1, digit), F.slice(level, i + 2, F.lit(FANOUT - 1) - digit)
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def blocks(ranked: DataFrame) -> DataFrame:
    """(tree, at, n, root, leaves, items, level1, ...): an aligned block of leaves, its root, its rows and the hashes of its own levels.

    The siblings of the rows are about ten times the size of the rows, and a reader takes many blocks at once; so they are made from the
    levels (``inner_path``) only where the rows leave.
    """
    most = FANOUT**BLOCK_LEVELS
    slot = (F.col("at") % most).cast("int").alias("slot")
    held = ranked.groupBy("tree", F.floor(F.col("at") / most).alias("block"), F.col("n").alias("leaves")).agg(F.sort_array(F.collect_list(F.struct(slot, "doc_id", "leaf", "tampered"))).alias("items"))
    held = held.withColumn("level0", F.transform("items", lambda x: x["leaf"]))
    for k in range(BLOCK_LEVELS):
        held = held.withColumn(f"level{k + 1}", F.when(F.col("leaves") > FANOUT**k, _parents(F.col(f"level{k}"))))
    root = F.coalesce(*[F.get(F.col(f"level{k}"), F.lit(0)) for k in range(BLOCK_LEVELS, -1, -1)])
    kept = [f"level{k}" for k in range(1, BLOCK_LEVELS)]
    return held.select("tree", F.col("block").alias("at"), F.ceil(F.col("leaves") / most).alias("n"), root.alias("root"), "leaves", "items", *kept)


def inner_path(i: Column) -> Column:
    """The siblings of leaf i of a block inside the block; needs its levels from ``level0`` on and ``leaves``."""
    steps = [F.when(F.col("leaves") > FANOUT**k, _siblings(F.col(f"level{k}"), F.floor(i / FANOUT**k).cast("int"))) for k in range(BLOCK_LEVELS)]
    return F.array_compact(F.array(*steps))


def butterfly(nodes: DataFrame) -> DataFrame:
    """(tree, at, root, path) from (tree, at, n, root): the root of the whole tree and the way up to it, for every node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    state = nodes.select("tree", "at", "n", "root", F.array().cast(f"array<{_STEP}>").alias("path"))
    span = 1
    while span < most:
        state = _swap(state, span)
        span *= FANOUT
    return state.select("tree", "at", "root", "path")


def _swap(state: DataFrame, span: int) -> DataFrame:
    """One round: nodes that differ only in one digit of ``at`` meet and hash their common ancestor, each for itself."""
    at, n, wide = F.col("at"), F.col("n"), span * FANOUT
    low = at % span
    present = F.least(F.lit(span), n - (at - low))  # nodes of its own group
    asked = F.least(F.lit(span), n - (at - at % wide))  # nodes of the fullest group it meets
    sent = state.select("tree", "at", "n", "root", "path", F.floor(at / wide).alias("high"), F.floor(at % wide / span).cast("int").alias("digit"), low.alias("mine"), F.explode(F.sequence(low, asked - 1, present)).alias("low"))
    own = F.col("low") == F.col("mine")
    node = F.struct("digit", own.alias("own"), "root", F.when(own, F.col("at")).alias("at"), F.when(own, F.col("path")).alias("path"))
    met = sent.groupBy("tree", "n", "high", "low").agg(F.sort_array(F.collect_list(node)).alias("met"))
    met = met.withColumn("roots", F.transform("met", lambda x: x["root"])).withColumn("parent", F.sha2(_joined(F.col("roots")), 256))
    goes_on = F.col("n") > span
    after = F.transform("met", lambda x, i: F.struct(
        x["own"].alias("own"), x["at"].alias("at"), F.when(goes_on, F.col("parent")).otherwise(x["root"]).alias("root"),
        F.when(goes_on, F.concat(x["path"], F.array(_siblings(F.col("roots"), i)))).otherwise(x["path"]).alias("path")))
    return met.select("tree", "n", F.explode(F.filter(after, lambda x: x["own"])).alias("x")).select("tree", "x.at", "n", "x.root", "x.path")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path) per row; ``path`` holds the siblings of every level up to the root."""
    made = stored(leaves(docs), "merkle-leaves")
    held = stored(blocks(positions(made, ["doc_id", "leaf"], "merkle-ordered")), "merkle-blocks")
    low = stored(butterfly(held.select("tree", "at", "n", "root")), "merkle-subtrees")
    subroots = low.filter("at = 0").select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "root")
    ranked = stored(positions(subroots, ["lang_tree"], "merkle-languages"), "merkle-subroots")
    top = ranked.drop("root").join(butterfly(ranked), ["tree", "at"]).select(F.col("lang_tree").alias("tree"), F.col("root").alias("top"), F.col("path").alias("last"))
    known = held.drop("n", "root").join(low, ["tree", "at"]).join(top, "tree").withColumn("level0", F.transform("items", lambda x: x["leaf"]))
    each = F.transform("items", lambda x: F.struct(
        x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["tampered"].alias("tampered"), F.concat(inner_path(x["slot"]), F.col("path"), F.col("last")).alias("path")))
    remove(made)
    # No block is empty.  For an inner explode Spark infers a filter on the array, which would make it twice.
    return known.select(F.col("root").alias("subroot"), F.col("top").alias("root"), F.explode_outer(each).alias("x")).select("x.doc_id", "x.leaf", "x.tampered", "subroot", "root", "x.path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path as one text, level by level."""
    return _joined(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row with its proof, checked against the leaf that tampering leaves."""
    found = manifest(read_table(spark, sf_dir, "documents"))
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 7, top_levels: int = 4) -> str:
    """The same in SQL, level by level over lists; enough for ``8 ** levels`` rows a language."""
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END"
    row = lambda text: "sha256(" + " || ".join(map(part, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"
    bit = "lambda x, z: xor(x >> 1, 3988292384 * (x & 1))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([0,0,0,0,0,0,0,0]::BIGINT[], {bit}, xor(a, b)), 4294967295::BIGINT), 4294967295)"
    parents = lambda x: f"CASE WHEN len({x}) > 1 THEN list_transform(range(0, (len({x}) + 7) // 8), lambda i: sha256(array_to_string({x}[i * 8 + 1 : i * 8 + 8], ''))) END"

    def chain(name: str, source: str, letter: str, count: int) -> str:
        steps = [f"{name}0 AS (SELECT *, {parents(letter + '0')} AS {letter}1 FROM {source})"]
        steps += [f"{name}{k} AS (SELECT *, {parents(letter + str(k))} AS {letter}{k + 1} FROM {name}{k - 1})" for k in range(1, count)]
        return ", ".join(steps)

    def climb(name: str, source: str, letter: str, place: str, count: int) -> str:
        steps = []
        for k in range(count):
            at, before = f"({place} // {8**k})", source if k == 0 else f"{name}{k - 1}"
            left = f"array_to_string({letter}{k}[{at} // 8 * 8 + 1 : {at}], '')"
            right = f"array_to_string({letter}{k}[{at} + 2 : {at} // 8 * 8 + 8], '')"
            more = f"{letter}{k + 1} IS NOT NULL"
            steps.append(f"{name}{k} AS (SELECT * EXCLUDE (proof, folded), CASE WHEN {more} THEN proof || {left} || {right} ELSE proof END AS proof, CASE WHEN {more} THEN sha256({left} || folded || {right}) ELSE folded END AS folded FROM {before})")
        return ", ".join(steps)

    first = lambda letter, count: "coalesce(" + ", ".join(f"{letter}{k}[1]" for k in range(count, -1, -1)) + ")"
    return f"""
WITH d AS (SELECT doc_id, lang, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
g AS (SELECT lang, list(leaf ORDER BY p) AS l0 FROM r GROUP BY lang),
{chain('c', 'g', 'l', levels)},
s AS (SELECT *, {first('l', levels)} AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q FROM c{levels - 1}),
h AS (SELECT list(subroot ORDER BY q) AS t0 FROM s),
{chain('e', 'h', 't', top_levels)},
j AS (SELECT r.doc_id, r.leaf, r.p, '' AS proof, coalesce(r.tampered, r.leaf) AS folded, s.* EXCLUDE (lang), e{top_levels - 1}.*, {first('t', top_levels)} AS root
  FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang, e{top_levels - 1}),
{climb('k', 'j', 'l', 'p', levels)}, {climb('m', f'k{levels - 1}', 't', 'q', top_levels)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM m{top_levels - 1}"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": _sql()}
