"""Mixing sources to target weights by capped water-filling, and seeded sampling of whole and fractional repetitions.

Every source gets a share of ``share`` times all sizes by its weight, is clamped at ``max_epochs`` times its own size, and the excess goes to
the open sources by weight until none is above its clamp. Each round is one aggregate over one row per source; a round clamps at least one
source or is the last. A source's target is then met to the word: every document is taken as often as whole repetitions fit, and the rest is
a seeded sample without replacement, in md5 order, whose last document is taken in part.

The sample's threshold is found without sorting a source in one task: sizes are summed in cells of the hash for each source, running sums in two levels
find the cell in which the target falls, and only that cell's documents (``CELL_ROWS`` at most, on average) are ordered. The hash covers id and text, so that
rows with null or equal ids spread out too. Words are counted once: sizes and hashes are written to the shared folder before anything is summed.

Nulls: a null text has no words, takes part with size 0 and is taken 0 times; a null source is a source, last in order. Rows that repeat are
told apart by nothing and are interchangeable. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.common import cut, n_words, stash

WEIGHTS, SHARE, MAX_EPOCHS, SEED, CELL_ROWS = (3, 1, 2), 1.5, 2.0, "mix-1", 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, size) -> (source, source_size, target, whole_target). ``sizes`` has a row per document."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    spaced = cut(totals)
    n = spaced.count()
    place = _ordinal(spaced, n)
    state = cut(place.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int")).alias("weight"), F.col("ord")))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    every = state.agg(F.sum("source_size")).first()[0] or 0
    budget = share * every
    level = None  # a source's target is min(cap, weight * level)
    while n:
        clamped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        open_weight, used = state.agg(F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, cap))).first()
        if not open_weight:
            break
        new = (budget - (used or 0.0)) / open_weight
        if level is not None and new <= level:
            break
        level = new
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return state.select("source", "source_size", target.cast("double").alias("target"))


def _ordinal(sources: DataFrame, n: int) -> DataFrame:
    """``ord``: place by code point, null last. Ranges of the sorted sources are numbered apart, so that no task sees all."""
    key = [F.col("source").asc_nulls_last()]
    parts = max(1, n // 200_000 + 1)
    ranged = cut(sources.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*key)) - 1)
    return ranked.join(starts, "_part").withColumn("ord", F.col("_start") + F.col("_rank")).drop("_part", "_start", "_rank")


def _digest(key: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"/{seed}/"), F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, carry: list[str] | None = None) -> DataFrame:
    """(key, [carried columns], size, source_size, target, taken): one row for each row of ``docs``. Texts aren't shuffled unless carried."""
    size = n_words(F.col("text")) if size is None else size
    carried = [F.col(f"`{c}`").alias(f"_c_{c}") for c in (carry or [])]
    digest = _digest(F.col(f"`{key}`"), F.col("`text`") if "text" in docs.columns else F.lit(""), seed)
    rows = stash(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").cast("string").alias("source"), size.cast("long").alias("size"), digest.alias("_hash"), *carried), "sizes")
    digits = len(f"{rows.count() // CELL_ROWS:x}")  # of the hash that name a cell
    sized = rows.withColumn("_cell", F.conv(F.substring("_hash", 1, digits), 16, 10).cast("long"))
    targets = cut(source_targets(rows.select("source", "size"), weights, share, max_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("_whole", whole.cast("long")).withColumn("_rest", (F.round("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    # where in the hash order does each source's remainder end?
    cells = sized.groupBy("source", "_cell").agg(F.sum("size").alias("_in_cell")).withColumn("_span", F.shiftright("_cell", 4 * (digits // 2)))
    # running sums in two levels: of the cells in a span of cells, and of the spans; a source with n cells has about the root of n in either
    spans = cells.groupBy("source", "_span").agg(F.sum("_in_cell").alias("_in_span"))
    ahead = Window.partitionBy("source").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("source").alias("_t"), F.col("_span").alias("_p"), F.coalesce(F.sum("_in_span").over(ahead), F.lit(0)).alias("_ahead"))
    before = Window.partitionBy("source", "_span").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.withColumn("_inside", F.coalesce(F.sum("_in_cell").over(before), F.lit(0)))
    starts = inside.join(spans, F.col("source").eqNullSafe(F.col("_t")) & (F.col("_span") == F.col("_p"))).select(
        F.col("source").alias("_s"), F.col("_cell").alias("_c"), (F.col("_ahead") + F.col("_inside")).alias("_before"), "_in_cell"
    )
    plans = plan.select(F.col("source").alias("_t"), "source_size", "target", "_whole", "_rest")
    known = starts.join(plans, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    joined = sized.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))).drop("_s", "_c")
    edge = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_in_cell") > F.col("_rest"))
    salt = F.when(edge, F.lit(None).cast("string")).otherwise(F.col("_hash"))  # rows off the edge need no order: they are spread
    order = Window.partitionBy("source", "_cell", salt).orderBy("_hash", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.when(edge, F.coalesce(F.sum("size").over(order), F.lit(0))).otherwise(0)
    part = F.when(edge, F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - ahead))).otherwise(F.when(F.col("_before") + F.col("_in_cell") <= F.col("_rest"), F.col("size")).otherwise(0))
    return joined.select(
        F.col("_key").alias(key), "source", *[F.col(f"_c_{c}").alias(c) for c in (carry or []) if c not in (key, source)], "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: ``docs`` with each row repeated as often as it is taken, the last repetition cut to the words taken.

    A repetition cut within a document holds its first words joined by single spaces. ``n_chars`` follows the text where there is one.
    """
    from repolens.llm.common import words

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    taken = mix(docs.select("doc_id", "source", "text", row.alias("_row")), seed=seed, carry=["_row"])
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - full * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = taken.select("_row", F.explode(copies).alias("_words"))
    text = F.when(F.col("_words") < 0, F.col("_row.text")).otherwise(F.array_join(F.slice(words(F.col("_row.text")), 1, F.greatest(F.col("_words"), F.lit(0))), " "))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("_words") < 0, F.col("_row.n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))
        else:
            cols.append(F.col(f"_row.`{c}`").alias(c))
    return out.select(*cols)


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null') || '/{SEED}/' || coalesce(text, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
  FROM d GROUP BY source),
t AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap, {SHARE} * sum(source_size) OVER () AS budget,
    coalesce(sum({MAX_EPOCHS} * source_size) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight,
    row_number() OVER (ORDER BY {MAX_EPOCHS} * source_size / weight, source) AS place
  FROM s WINDOW w AS (ORDER BY {MAX_EPOCHS} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((budget - capped) / open_weight, place) AS level FROM t WHERE (budget - capped) / open_weight <= cap / weight),
g AS (SELECT source, source_size, least(cap, weight * level)::DOUBLE AS target FROM t, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS whole FROM g),
r AS (
  SELECT doc_id, size, source_size, target, whole, round(target)::BIGINT - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM r"""
