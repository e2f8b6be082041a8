"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to token budgets, whole epochs first.

Every source gets a share of all words by its weight, at most ``MAX_EPOCHS`` times its own size; what is cut off is
shared again among the others by weight, which ends in target = min(MAX_EPOCHS * size, level * weight) for one level
for all. A source takes whole epochs of all its documents first. The rest of its budget is filled in the order of
exponential keys -ln(u) / quality, so that documents of more weight tend to come first; the last one is cut at the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import store, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_A_RANGE = 20_000
LEAST_RANGES = 256


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number between 0 and 1 by the MD5 of seed and id, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with target. Weights repeat over the sources by code point, null last.

    With the sources by rising most * size / weight, those before a place are full; the level is what is left over
    the weights that are left, at the first place where it doesn't exceed the source's own bound.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("bound", most * F.col("source_size") / F.col("weight"))
    rising = Window.orderBy("bound", F.col("source").asc_nulls_last())
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("here", left / open_weight)
    fits = F.when(F.col("here") <= F.col("bound"), F.struct("bound", F.col("here")))
    ranked = ranked.withColumn("level", F.min(fits).over(everything)["here"])
    full = F.col("bound") <= F.col("level")
    return ranked.select("source", "source_size", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) from labels (doc_id, quality 0/1): 2 for high, 0.5 for low."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("label"))
    return best.where("label in (0, 1)").select("doc_id", F.when(F.col("label") == 1, 2.0).otherwise(0.5).alias("quality"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and taken (words, repeats counted).

    ``quality`` is a table (doc_id, quality), a positive number each; absent and null ones count as 1, the largest of
    a repeated doc_id is taken. It is joined once the texts are counted, so no text is shuffled. Null sources are one source, null texts have size 0
    and are taken 0 words. Equal keys are ordered by id, size and a hash of the text. An empty table gives none.

    One source may hold most rows: prefix sums are made within ranges of the keys, as many a source as give about
    ``ROWS_A_RANGE`` rows of the whole table, and the ranges' totals are added before.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    if quality is not None:
        best = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
        base = base.hint("merge").join(best, "doc_id", "left")
    else:
        base = base.withColumn("quality", F.lit(1.0))
    weight = F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(1e-9))
    base = base.withColumn("key", -F.log(uniform(F.col("doc_id"))) / weight).drop("quality")
    base = base.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    base = store(base, "sizes")
    # 1 - exp(-key) is spread evenly where all documents weigh 1.
    ranges = max(LEAST_RANGES, base.count() // ROWS_A_RANGE)
    base = base.withColumn("part", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("int"))
    parts = base.groupBy("s", "source", "part").agg(F.sum("size").alias("words"))
    sizes = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    sizes = sizes.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ahead = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("source", "words")
    offsets = store(offsets.join(sizes, "s"), "offsets")
    within = Window.partitionBy("s", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, ["s", "part"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("ahead") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
