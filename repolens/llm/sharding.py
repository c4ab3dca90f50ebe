"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws one number per child from the hash of its key and the child's name, scaled by the child's weight (-ln(u) / weight;
a node's weight is the sum below it), and descends into the smallest. A draw depends on the key and that child alone. If a subtree's weight
rises, rows move only into it; if it falls, only out of it; all else stays. Placement is a chain of Spark expressions: no exchange, no
user function.

The default tree has ``BASE_SHARDS`` shards as regions of two racks of two. Each further shard opens a region of its own, so a growing
cluster takes rows only into the new shard, as the law ``key`` asks.

Nulls: a null key is hashed as the text ``null``; a null text has no bytes. Rows that repeat get the same shard and slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import let, numbered

BASE_SHARDS, RACK_SHARDS, REGION_RACKS = 16, 2, 2
Tree = list[list[list[tuple[int, float]]]]  #: regions of racks of (shard, weight)


def tree(n_shards: int, weights: dict[int, float] | None = None, base: int = BASE_SHARDS) -> Tree:
    """The default layout of ``n_shards`` shards; a shard's weight is 1 unless given."""
    if n_shards < 1:
        raise ValueError("a tree needs a shard")
    leaf = lambda s: (s, float((weights or {}).get(s, 1.0)))
    first = min(n_shards, base)
    racks = [[leaf(s) for s in range(i, min(i + RACK_SHARDS, first))] for i in range(0, first, RACK_SHARDS)]
    regions = [racks[i : i + REGION_RACKS] for i in range(0, len(racks), REGION_RACKS)]
    return regions + [[[leaf(s)]] for s in range(first, n_shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of md5, which other engines compute alike."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 13), 16, 10).cast("long").cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(weight)


def _descend(key: Column, nodes: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; an only child needs none."""
    alive = [n for n in nodes if n[1] > 0]
    if len(alive) == 1:
        return alive[0][2]
    draws = F.array(*[_draw(key, name, weight) for name, weight, _ in alive])

    def pick(d: Column) -> Column:
        at = F.array_position(d, F.array_min(d))
        value = alive[-1][2]
        for i in range(len(alive) - 2, -1, -1):
            value = F.when(at == i + 1, alive[i][2]).otherwise(value)
        return value

    return let(draws, pick)


def shard_of(key: Column, layout: Tree) -> Column:
    """The shard of a key (text)."""
    regions = []
    for g, racks in enumerate(layout):
        below = []
        for r, shards in enumerate(racks):
            leaves = [(f"s{s}", w, F.lit(s)) for s, w in shards]
            if total := sum(w for _, w in shards):
                below.append((f"g{g}r{r}", total, _descend(key, leaves)))
        if below:
            regions.append((f"g{g}", sum(w for _, w, _ in below), _descend(key, below)))
    if not regions:
        raise ValueError("every weight is 0")
    return _descend(key, regions)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = BASE_SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): one row for each row of ``docs``. The text is read once and never shuffled."""
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    placed = docs.select(
        F.col(f"`{key}`"),
        (F.octet_length(full) + 1).cast("long").alias("size"),
        F.crc32(full.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(name, tree(n_shards, weights)).cast("int").alias("shard"),
        shard_of(name, tree(n_shards + 1, weights)).cast("int").alias("grown_shard"),
    )
    order = [F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col("size"), F.col("text_crc32")]
    return numbered(placed, order, "slot", within="shard")


def _sql() -> str:
    """The default tree with every draw spelt out."""
    draw = lambda name, w: f"-ln((('0x' || substr(md5(k || '/{name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(2**52)}) / {w}"

    def pick(nodes: list[tuple[str, float, str]]) -> str:
        if len(nodes) == 1:
            return nodes[0][2]
        draws = "[" + ", ".join(draw(n, w) for n, w, _ in nodes) + "]"
        return f"CASE list_position({draws}, list_min({draws})) " + " ".join(f"WHEN {i} THEN {v}" for i, (_, _, v) in enumerate(nodes, 1)) + " END"

    def shard(layout: Tree) -> str:
        regions = []
        for g, racks in enumerate(layout):
            below = [(f"g{g}r{r}", sum(w for _, w in shards), pick([(f"s{s}", w, str(s)) for s, w in shards])) for r, shards in enumerate(racks)]
            regions.append((f"g{g}", sum(w for _, w, _ in below), pick(below)))
        return pick(regions)

    # the checksum, byte by byte, with the usual table of 256 remainders
    return f"""
WITH t AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS remainders),
a AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(doc_id::VARCHAR, '') AS o, strlen(coalesce(text, '')) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
b AS (
  SELECT doc_id, o, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, remainders[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc,
    {shard(tree(BASE_SHARDS))} AS shard, {shard(tree(BASE_SHARDS + 1))} AS grown FROM a, t)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY o, size, crc) - 1)::BIGINT AS slot,
  grown::INTEGER AS grown_shard FROM b"""


SQL = _sql()
