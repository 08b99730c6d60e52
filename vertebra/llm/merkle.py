"""Merkle manifest of a dataset by slot pivots.

The nodes of a tree are rows (tree, index, digest).  A group-by on the parent's index with one
conditional aggregate per slot spreads a parent's children into columns; concatenating the
columns and hashing gives the parent, and leaving out a node's own slot column gives its
siblings.  One pivot spreads ``LEVELS`` levels at once (``FANOUT ** LEVELS`` slots), whose inner
nodes are hashed from the columns within the row, so a tree of n leaves takes
log(n) / LEVELS rounds, each a fraction of the one before.

Proofs come from the top down: a round's row is joined with the proof of its top node, and each
child's siblings are put before it.  Leaves meet the last row at a ``FANOUT ** LEVELS``-th of
their number, so no proof is shuffled per leaf.  Every lang has a tree; their subroots are the
leaves of one more.  Leaves are ranked over range blocks: no task sees a whole lang.

Built-in functions only; one digest or number per step is all that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import ranked, with_blocks
from .common import stash

FANOUT, LEVELS = 2, 4
SPAN = FANOUT ** LEVELS
#: Fixed value: one of so many documents is tampered with.
TAMPERED = 7

_TREE = ["_tree"]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts, one after the other; nulls are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def field(value: Column | str) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | str = "n_chars") -> Column:
    return digest(field("doc_id"), field("source"), field("lang"), field(n_chars), field("text"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf of every row of ``docs``, and tampered: the leaf after n_chars + 1
    where 7 divides crc32 of the decimal doc_id (null elsewhere, and where doc_id is null)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("leaf"), F.when(hit, leaf(more)).alias("tampered"))


def _height(most: int) -> int:
    """Levels over ``most`` leaves."""
    height = 0
    while FANOUT ** height < most:
        height += 1
    return height


def _levels(wide: DataFrame, below: int) -> DataFrame:
    """``wide`` (``_n``, ``_index`` of its top nodes, slot columns ``_c0_*``) with the columns
    ``_c1_*`` to the top's ``_c{LEVELS}_0``; its slots are ``below`` levels above the leaves.
    Level k exists where more than ``FANOUT ** k`` leaves do; a lone node goes up as it is."""
    for i in range(LEVELS):
        level, size = below + i, SPAN // FANOUT ** (i + 1)
        made = {}
        for j in range(size):
            place = F.col("_index") * size + j  # of the parent, on its level
            children = [F.col(f"_c{i}_{FANOUT * j + k}") for k in range(FANOUT)]
            there = place <= F.expr(f"(_n - 1) div {FANOUT ** (level + 1)}")
            made[f"_c{i + 1}_{j}"] = F.when(F.col("_n") > FANOUT ** level, F.when(there, digest(*children))).otherwise(F.col(f"_c{i}_{j}"))
        wide = wide.withColumns(made)
    return wide


def build(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds over ``nodes`` (_tree, _index, _n leaves of the tree, _hash), and the root of
    each tree (_tree, _n, _hash)."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    rounds: list[DataFrame] = []
    for below in range(0, _height(most), LEVELS):
        slot = F.col("_index") % SPAN
        wide = nodes.groupBy("_tree", F.expr(f"_index div {SPAN}").alias("_index")).agg(
            F.max("_n").alias("_n"), *[F.max(F.when(slot == j, F.col("_hash"))).alias(f"_c0_{j}") for j in range(SPAN)])
        rounds.append(stash(wide, f"merkle-{name}-{below}"))
        nodes = _levels(rounds[-1], below).select("_tree", "_index", "_n", F.col(f"_c{LEVELS}_0").alias("_hash"))
    return rounds, nodes.select("_tree", "_n", "_hash")


def _siblings(slot: Column, below: int) -> Column:
    """Siblings of a slot's node and of the nodes over it in the row, bottom up: those to the
    left and those to the right, as texts; levels that do not exist are left out."""
    found = []
    for i in range(LEVELS):
        columns = F.array(*[F.col(f"_c{i}_{j}") for j in range(SPAN // FANOUT ** i)])
        place = F.floor(slot / FANOUT ** i).cast("int")
        own = place % FANOUT
        pair = F.struct(F.array_join(F.slice(columns, place - own + 1, own), "").alias("left"),
                        F.array_join(F.slice(columns, place + 2, FANOUT - 1 - own), "").alias("right"))
        found.append(F.when(F.col("_n") > FANOUT ** (below + i), pair))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def proofs(nodes: DataFrame, rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with _proof and the other columns of ``tops`` (_tree, _proof: one row per tree):
    the siblings on the way to their tree's root, an array of (left, right), then the tree's."""
    if not rounds:
        return nodes.join(tops, "_tree")
    told = [c for c in tops.columns if c not in ("_tree", "_proof")]
    above = tops.withColumn("_index", F.lit(0).cast("long"))
    for r in range(len(rounds) - 1, 0, -1):
        below = r * LEVELS
        rows = _levels(rounds[r].join(above, ["_tree", "_index"]), below)
        slots = rows.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SPAN - 1)))).where(
            F.get(F.array(*[F.col(f"_c0_{j}") for j in range(SPAN)]), F.col("_slot")).isNotNull())
        above = slots.select("_tree", (F.col("_index") * SPAN + F.col("_slot")).alias("_index"), *told,
                             F.concat(_siblings(F.col("_slot"), below), "_proof").alias("_proof"))
    rows = _levels(rounds[0].join(above, ["_tree", "_index"]), 0)
    inner = [f"_c{i}_{j}" for i in range(LEVELS) for j in range(SPAN // FANOUT ** i)]
    rows = rows.select("_tree", F.col("_index").alias("_up"), "_proof", *told, *inner)
    met = nodes.withColumn("_up", F.expr(f"_index div {SPAN}")).join(rows, ["_tree", "_up"])
    return met.select(*nodes.columns, *told, F.concat(_siblings(F.col("_index") % SPAN, 0), "_proof").alias("_proof"))


def fold(node: Column, proof: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(proof, node, lambda acc, x: digest(x["left"], acc, x["right"]))


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (a table with lang, doc_id, leaf) with subroot, root and proof, the siblings
    from the leaf to the root: an array of (left, right) texts, empty where a node has none.

    Per lang (null is one), leaves ascend by doc_id (null first; equal ones by leaf, equal
    leaves in any order, which changes nothing).  Runs of ``FANOUT`` become their digest until
    one node remains; the subroots by lang (null first, bytewise) likewise.  Other columns of
    ``rows`` are kept.  An empty table gives no rows.
    """
    kept = rows.columns
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "lang"))
    # the row number splits the blocks of a document repeated many times
    first = stash(rows.withColumns({"_tree": tree, "_row": F.monotonically_increasing_id()}), "merkle-leaves")
    order = ["doc_id", "leaf", "_row"]
    blocks = stash(with_blocks(first, [*_TREE, *order]), "merkle-blocks")
    nodes = stash(ranked(blocks, _TREE, order, "_index", "_n").drop("_row").withColumn("_hash", F.col("leaf")), "merkle-nodes")
    rounds, tops = build(nodes.select("_tree", "_index", "_n", "_hash"), "lang")
    subs = tops.select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_hash")
    subs = stash(ranked(stash(with_blocks(subs, ["_tree", "_name"]), "merkle-tops"), _TREE, ["_name"], "_index", "_n"), "merkle-subroots")
    high, roots = build(subs.select("_tree", "_index", "_n", "_hash"), "root")
    none = F.array().cast("array<struct<left:string,right:string>>")
    roots = roots.select("_tree", F.col("_hash").alias("root"), none.alias("_proof"))
    tops = proofs(subs, high, roots).select(F.col("_name").alias("_tree"), F.col("_hash").alias("subroot"), "root", "_proof")
    return proofs(nodes, rounds, tops).select(*kept, "subroot", "root", F.col("_proof").alias("proof"))


def op13(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``
    (doc_id, source, lang, n_chars, text; others are not read).

    Nulls in any column are part of the leaf as ``-``; a row without doc_id is a leaf like any
    other, first of its lang, and never tampered with; repeated rows are leaves of their own.
    """
    found = manifest(leaves(docs))
    proof = digest(F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), ""))
    return (found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"),
                         fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


SQL_OP13 = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS chars_more,
    coalesce(strlen(text) || ':' || text, '-') AS body FROM documents),
bytes AS (SELECT doc_id, CAST(CAST(doc_id AS VARCHAR) AS BLOB) AS b FROM documents),
poly(i, c) AS (
  SELECT i, c FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, strlen(d) + 1), lambda k: CAST(ord(d[k]) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS d FROM documents WHERE doc_id IS NOT NULL), (SELECT list(c ORDER BY i) AS t FROM poly)),
leaf AS (
  SELECT f.doc_id, lang, sha256(head || chars || body) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || chars_more || body) ELSE sha256(head || chars || body) END AS used,
    row_number() OVER (PARTITION BY lang ORDER BY f.doc_id NULLS FIRST, sha256(head || chars || body)) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n
  FROM f LEFT JOIN crc ON f.doc_id = crc.doc_id),
tree(lang, lvl, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM leaf
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 2),
sub AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
high(lvl, i, n, h) AS (
  SELECT 0, i, n, subroot FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 2),
steps AS (
  SELECT leaf.doc_id, leaf.lang, leaf.i, t.lvl AS k, (leaf.i >> t.lvl) % 2 AS side, s.h AS sibling
  FROM leaf JOIN (SELECT DISTINCT lang, lvl, n FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM leaf.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM leaf.lang AND s.lvl = t.lvl AND s.i = xor(leaf.i >> t.lvl, 1)
  UNION ALL
  SELECT leaf.doc_id, leaf.lang, leaf.i, 1000 + t.lvl, (sub.i >> t.lvl) % 2, s.h
  FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang, (SELECT DISTINCT lvl FROM high WHERE n > 1) t
  LEFT JOIN high s ON s.lvl = t.lvl AND s.i = xor(sub.i >> t.lvl, 1)),
paths AS (
  SELECT lang, i, list(struct_pack(side := side, sibling := coalesce(sibling, '')) ORDER BY k) AS path, string_agg(coalesce(sibling, ''), '' ORDER BY k) AS siblings
  FROM steps GROUP BY lang, i),
folded AS (
  SELECT leaf.doc_id, leaf.lang, leaf.leaf, coalesce(siblings, '') AS siblings,
    list_reduce(list_concat([used], list_transform(coalesce(path, []), lambda x: x.side || x.sibling)),
      lambda a, x: CASE WHEN x[1] = '1' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded
  FROM leaf LEFT JOIN paths ON paths.lang IS NOT DISTINCT FROM leaf.lang AND paths.i = leaf.i)
SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root,
  folded = (SELECT h FROM high WHERE n = 1) AS verified
FROM folded JOIN sub ON sub.lang IS NOT DISTINCT FROM folded.lang
"""
