"""Merkle manifest of a table: nested structs rolled up digit by digit in bounded blocks, proofs exploded out of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import dense_ordinal
from ..session import written

_LEVELS = 4  # levels of one block: fan_out ** 4 nodes are nested in one row, however large the tree
_PROOF = "array<struct<position:int,siblings:array<string>>>"
_ABOVE = f"array<struct<proof:{_PROOF},subroot:string,root:string>>"


def leaf(*fields: Column) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def step(node: Column, s: Column) -> Column:
        before = F.slice(s["siblings"], F.lit(1), s["position"])
        after = F.slice(s["siblings"], s["position"] + 1, F.size(s["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)

    return F.aggregate(proof, start, step)


def siblings(proof: Column) -> Column:
    """All digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "")


def _rolled(nodes: DataFrame, fan_out: int, above: DataFrame | None = None) -> DataFrame:
    """``g, block, n, hash`` of every block; with ``above`` also the nested ``kids`` and the block's own ``above``.

    ``nodes`` has ``g, r, n, hash`` (rank and number of nodes in the tree ``g``)
    and, with ``above``, ``item``. One shuffle deals whole blocks to tasks; the rank
    digits are then grouped away from the last to the first without another one. The
    proof of a block comes as one more row of its group, so nothing is joined. A
    level exists where its tree still has several nodes.
    """
    digits = [F.expr(f"cast(r div {fan_out**j}L % {fan_out} as int)").alias(f"d{j}") for j in range(_LEVELS)]
    kept = ["hash"] if above is None else ["hash", "item"]
    rows = nodes.select("g", F.expr(f"r div {fan_out**_LEVELS}L").alias("block"), "n", *digits, *kept)
    rows = rows.select("g", "block", "n", *[f"d{j}" for j in range(1, _LEVELS)],
                       F.struct(F.col("d0").alias("d"), *kept).alias("node"),
                       F.array().cast(_ABOVE).alias("above"))
    if above is not None:
        none = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields}
        rows = rows.union(above.select("g", F.col("r").alias("block"), *[
            none[c].alias(c) for c in rows.columns[2:-1]], F.array("above").cast(_ABOVE).alias("above")))
    rows = rows.repartition("g", "block")
    for j in range(_LEVELS):
        keys = ["g", "block", *[f"d{i}" for i in range(j + 1, _LEVELS)]]
        rows = rows.groupBy(*keys).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list("node")).alias("kids"),
            F.flatten(F.collect_list("above")).alias("above"))
        joined = F.sha2(F.array_join(F.col("kids")["hash"], ""), 256)
        rows = rows.withColumn("hash", F.when(F.col("n") > fan_out**j, joined).otherwise(F.get(F.col("kids")["hash"], F.lit(0))))
        if j + 1 < _LEVELS:
            kept = ["hash"] if above is None else ["hash", "kids"]
            node = F.when(F.size("kids") > 0, F.struct(F.col(f"d{j + 1}").alias("d"), *kept))
            rows = rows.withColumn("node", node).drop("kids", "hash")
    return rows


def _climbed(nodes: DataFrame, most: int, fan_out: int) -> list[DataFrame]:
    """Tables of nodes from the given ones up to the one node of every tree, a block's levels apart."""
    span, tables = fan_out**_LEVELS, [nodes]
    while len(tables) == 1 or most > 1:
        up = _rolled(tables[-1], fan_out).select(
            "g", F.col("block").alias("r"), F.expr(f"(n + {span - 1}) div {span}L").alias("n"), "hash")
        tables.append(written(up, "merkle-nodes"))
        most = -(-most // span)
    return tables


def _with_step(under: str, exists: Column) -> Callable[[Column, Column], Column]:
    """What is under a node of ``kids``, with the node's place and its run's others put before the steps so far."""
    def run(kid: Column, i: Column) -> Column:
        hashes = F.col("kids")["hash"]
        others = F.concat(F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.size(hashes)))
        step = F.array(F.struct(i.alias("position"), others.alias("siblings")))
        own = F.when(exists, F.concat(step, "own")).otherwise(F.col("own"))
        return F.struct(own.alias("own"), kid[under].alias(under))

    return run


def _emitted(nodes: DataFrame, above: DataFrame, fan_out: int) -> DataFrame:
    """``g, item, above`` of every node: the proof of its block, completed by the steps inside the block."""
    rows = _rolled(nodes, fan_out, above).select(
        "g", "n", "kids", F.get("above", F.lit(0)).alias("above"), F.array().cast(_PROOF).alias("own"))
    for j in reversed(range(_LEVELS)):
        under = "kids" if j else "item"
        kids = F.transform("kids", _with_step(under, F.col("n") > fan_out**j))
        rows = rows.select("g", "n", "above", F.explode(kids).alias("kid"))
        rows = rows.select("g", "n", "above", "kid.own", f"kid.{under}")
    full = F.struct(F.concat("own", "above.proof").alias("proof"), F.col("above.subroot"), F.col("above.root"))
    return rows.select("g", "item", full.alias("above"))


def prove(
    leaves: DataFrame, *, group_col: str = "lang", order: tuple[str, ...] = ("doc_id",), leaf_col: str = "leaf",
    fan_out: int = 8,
) -> DataFrame:
    """Every row with ``subroot`` (of its group's tree), ``root`` and ``proof``, which leads from its leaf to the root.

    A proof is a list of ``position`` (place of the node among its run) and
    ``siblings`` (digests of the run's others), from the leaf upwards; ``fold``
    recomputes the root. In each group leaves stand in ``order`` (nulls first, ties
    by digest), and every ``fan_out`` consecutive nodes become the SHA-256 of their
    hex digests until one node, the subroot, is left. Subroots by group value (null
    first, bytewise) likewise give the root. A lone leaf is its subroot.

    A null group is a group; repeated rows are leaves of their own. An empty table
    gives no rows. Columns named subroot, root or proof are replaced, all others kept.

    Bounded: at most ``fan_out ** 4`` nodes are nested in a row; the tree above the
    blocks is climbed the same way, over a table ``fan_out ** 4`` times smaller.
    """
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    narrow = leaves.select(F.col(group_col).alias("g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                           F.col(leaf_col).alias("hash"), F.struct(*kept).alias("item"))
    ordinals = dense_ordinal(narrow, "g", *[f"_o{i}" for i in range(len(order))], "hash", name="at")
    sizes = written(ordinals.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("n")), "merkle-groups")
    firsts = sizes.select(F.col("g").alias("_g"), "first", "n")  # a row per group: its file size tells Spark whether to broadcast
    nodes = ordinals.join(firsts, F.col("g").eqNullSafe(F.col("_g"))).select(
        "g", (F.col("at") - F.col("first")).alias("r"), "n", "hash", "item")
    groups, most = sizes.agg(F.count("*"), F.max("n")).first()
    trees = _climbed(nodes, most or 0, fan_out)

    tops = dense_ordinal(trees[-1].select("g", "hash"), "g", name="r", unique=True)
    tops = tops.select(F.lit(0).alias("g"), "r", F.lit(groups).cast("long").alias("n"), "hash", F.struct(F.col("g").alias("key"), "hash").alias("item"))
    upper = _climbed(tops, groups, fan_out)
    none = F.array().cast(_PROOF)
    above = upper[-1].select("g", "r", F.struct(
        none.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("above"))
    for table in reversed(upper[1:-1]):
        above = _above(table, above, fan_out)
    found = _emitted(tops, above, fan_out)
    above = written(found.select(F.col("item.key").alias("g"), F.lit(0).cast("long").alias("r"), F.struct(
        F.col("above.proof"), F.col("item.hash").alias("subroot"), F.col("above.root")).alias("above")), "merkle-above")
    for table in reversed(trees[1:-1]):
        above = _above(table, above, fan_out)
    return _emitted(nodes, above, fan_out).select("item.*", "above.subroot", "above.root", "above.proof")


def _above(table: DataFrame, above: DataFrame, fan_out: int) -> DataFrame:
    """Proofs of a table of upper nodes, written for the blocks below them."""
    found = _emitted(table.withColumn("item", F.struct("r")), above, fan_out)
    return written(found.select("g", F.col("item.r").alias("r"), "above"), "merkle-above")


#: CRC-32 of a decimal number, bit by bit (fixed values: initial and final mask, reversed polynomial).
_SQL_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SQL_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _FIELDS) + ")"

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_SQL_LEAF} AS leaf FROM documents
), shown AS (
  SELECT d.doc_id, {_SQL_LEAF} AS shown FROM (SELECT * REPLACE (
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text) FROM documents) d
), up AS (
  SELECT 0 AS level, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r,
    count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, lang, r // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM up
  WHERE n > 1 GROUP BY level, lang, r // 8
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, r, n, h FROM subroots
  UNION ALL
  SELECT level + 1, r // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM top
  WHERE n > 1 GROUP BY level, r // 8
), root AS (SELECT h AS root FROM top WHERE n = 1),
steps AS (
  SELECT lang, level, r // 8 AS run, list(h ORDER BY r) AS hs FROM up WHERE n > 1 GROUP BY ALL
), top_steps AS (
  SELECT level, r // 8 AS run, list(h ORDER BY r) AS hs FROM top WHERE n > 1 GROUP BY ALL
), placed AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.doc_id) - 1 AS r, s.r AS top_r, s.h AS subroot
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
), proofs AS (
  SELECT p.doc_id, s.level, (p.r // pow(8, s.level)::BIGINT) % 8 AS pos, s.hs FROM placed p
  JOIN steps s ON p.lang IS NOT DISTINCT FROM s.lang AND s.run = p.r // pow(8, s.level + 1)::BIGINT
  UNION ALL
  SELECT p.doc_id, 1000 + s.level, (p.top_r // pow(8, s.level)::BIGINT) % 8, s.hs FROM placed p
  JOIN top_steps s ON s.run = p.top_r // pow(8, s.level + 1)::BIGINT
), listed AS (
  SELECT doc_id, list({{'hs': hs, 'pos': pos}} ORDER BY level) AS steps,
    string_agg(array_to_string(hs[1:pos] || hs[pos + 2:], ''), '' ORDER BY level) AS others FROM proofs GROUP BY doc_id
), folded AS (
  SELECT p.doc_id, 1 AS i, coalesce(steps, []) AS steps,
    CASE WHEN {_SQL_CRC} % 3 = 0 THEN shown ELSE leaf END AS h
  FROM placed p JOIN shown USING (doc_id) LEFT JOIN listed USING (doc_id)
  UNION ALL
  SELECT doc_id, i + 1, steps, sha256(array_to_string(steps[i].hs[1:steps[i].pos], '') || h || array_to_string(steps[i].hs[steps[i].pos + 2:], ''))
  FROM folded WHERE i <= len(steps)
)
SELECT p.doc_id, p.leaf, p.subroot, root.root, sha256(coalesce(l.others, '')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM placed p CROSS JOIN root JOIN folded f ON f.doc_id = p.doc_id AND f.i = len(f.steps) + 1 LEFT JOIN listed l ON l.doc_id = p.doc_id
"""
