"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the mix; complete epochs of the source come first, and the rest is drawn: each
document gets an exponential key divided by its quality weight, and documents are taken in order of key until their
words fill what is left of the target.

No source is sorted in one task: keys fall into ranges, the ranges of each source are summed, and only the range in
which a source reaches its target is ordered. What comes out is one bound per source, so that any table with the same
documents can be cut by it without a shuffle.

Edge cases: a null text has size 0; a null source is a source of its own, ordered last; rows of equal key are ordered
by id, and rows that repeat an id are taken together; a table without words has targets of 0 and takes nothing. Words
taken are whole documents: the last one drawn is taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import WORD, Scratch

RANGES = 1024
#: Bits of the digest that make a key, all of them exact in a double.
_UNIFORM = "(conv(substr(md5(concat(cast(doc_id as string), ':', '{seed}')), 1, 13), 16, 10) + 1.0D) / 4503599627370497.0D"


def key_columns(seed: str) -> list:
    """Size in words, exponential key over the document's quality weight, and the key's range.

    The weight is 0.25 plus 0.75 times the share of distinct words.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    size = F.size(words)
    weight = 0.25 + 0.75 * F.coalesce(F.try_divide(F.size(F.array_distinct(words)), size), F.lit(0.0))
    return [size.cast("long").alias("__mix_size"), (-F.log(F.expr(_UNIFORM.format(seed=seed))) / weight).alias("__mix_key")]


def keyed(docs: DataFrame, seed: str, keep: list[str]) -> DataFrame:
    made = docs.select(*keep, *key_columns(seed))
    return made.withColumn("__mix_range", F.least(F.lit(RANGES - 1), F.floor((1 - F.exp(-0.6 * F.col("__mix_key"))) * RANGES)).cast("int"))


def share_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """source, n, target from (source, n): ``total_share`` of all words by weight; what exceeds ``most_epochs`` of a source goes to the others.

    Sources that reach their cap are those whose cap is least for their weight. In that order, the level that is left
    for a source and those after it is the rest of the words over the rest of the weights; the first source whose share
    at its level stays below its cap sets the level for all from there on. One row per source is ordered, nothing else.
    """
    by_name, by_cap = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    weighed = sizes.select("source", "n", (F.lit(most_epochs) * F.col("n")).alias("cap"), F.get(F.lit([float(w) for w in weights]), place % len(weights)).alias("weight"), F.sum("n").over(all_).alias("all"))
    left = total_share * F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = weighed.select("*", F.row_number().over(by_cap).alias("i"), (left / F.sum("weight").over(after)).alias("level"))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("i", "level"))
    shared = levels.select("*", F.min(free).over(all_).alias("first"))
    capped = F.col("first").isNull() | (F.col("i") < F.col("first.i"))
    return shared.select("source", "n", F.when(capped, F.col("cap")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def source_bounds(keys: DataFrame, tmp: Scratch, **shares) -> DataFrame:
    """One row per source: its size, target, complete epochs, and the range and (key, id) up to which documents are drawn.

    A table of ``tmp``; ``shares`` are those of ``share_targets``. No row of it passes through the driver.
    """
    ranges = tmp.store(keys.groupBy("source", "__mix_range").agg(F.sum("__mix_size").alias("__mix_range_size")))
    shared = share_targets(ranges.groupBy("source").agg(F.sum("__mix_range_size").alias("n")), **shares)
    epochs = F.floor(F.coalesce(F.try_divide("target", "n"), F.lit(0.0)))
    plan = shared.select(F.col("source").alias("b_source"), F.col("n").alias("source_size"), "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("n")).alias("rest"))
    plan = tmp.store(plan)
    upto = Window.partitionBy("source").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.withColumn("start", F.coalesce(F.sum("__mix_range_size").over(upto), F.lit(0)))
    last = summed.join(plan, F.col("source").eqNullSafe(F.col("b_source"))).where("start < rest and start + __mix_range_size >= rest")
    last = tmp.store(last.select("b_source", F.col("__mix_range").alias("last_range"), "start", "rest"))
    within = Window.partitionBy("b_source").orderBy("__mix_key", "doc_id", "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = keys.join(last, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("__mix_range") == F.col("last_range")))
    edge = edge.withColumn("ahead", F.col("start") + F.coalesce(F.sum("__mix_size").over(within), F.lit(0)))
    drawn = F.when(F.col("ahead") + F.col("__mix_size") / 2 < F.col("rest"), F.struct("__mix_key", "doc_id"))
    ends = edge.groupBy(F.col("b_source").alias("e_source")).agg(F.first("last_range").alias("last_range"), F.max(drawn).alias("bound"))
    met = plan.join(ends, F.col("b_source").eqNullSafe(F.col("e_source")), "left")
    out = tmp.store(
        met.select(
            "b_source", "source_size", "target", "epochs", F.coalesce("last_range", F.lit(-1)).alias("last_range"), F.coalesce("bound.__mix_key", F.lit(-1.0)).alias("last_key"), F.col("bound.doc_id").alias("last_id"),
        )
    )
    tmp.drop(ranges, plan, last)
    return out


def _mixed(docs: DataFrame, seed: str, keep: list[str], shares: dict, tmp: Scratch) -> DataFrame:
    slim = tmp.store(keyed(docs, seed, ["doc_id", "source"]))
    bounds = source_bounds(slim, tmp, **shares)
    bounds = bounds.select(*(F.col(c).alias(f"__mix_{c}") for c in bounds.columns))
    own = lambda c: F.col(f"__mix_{c}")
    rows = slim if set(keep) <= set(slim.columns) else keyed(docs, seed, keep)
    # Spark sends the bounds to every task while their table is small, and else joins by source, splitting large ones
    met = rows.join(bounds, F.col("source").eqNullSafe(own("b_source")))
    low = F.lit(-(1 << 63))
    at_bound = (own("key") < own("last_key")) | ((own("key") == own("last_key")) & (F.coalesce("doc_id", low) <= F.coalesce(own("last_id"), low)))
    drawn = (own("range") < own("last_range")) | ((own("range") == own("last_range")) & at_bound)
    return met.withColumn("__mix_taken", own("epochs") + F.coalesce(drawn, F.lit(False)).cast("long"))


def mix_sources(docs: DataFrame, seed: str = "mix-1", tmp: Scratch | None = None, **shares) -> DataFrame:
    """doc_id, source, size, source_size, target and epochs: how often the mix takes each row.

    ``shares`` are those of ``share_targets``; the result is read from tables of ``tmp``.
    """
    mixed = _mixed(docs, seed, ["doc_id", "source"], shares, tmp or Scratch(docs.sparkSession))
    names = {"size": "__mix_size", "source_size": "__mix_source_size", "target": "__mix_target", "epochs": "__mix_taken"}
    return mixed.select("doc_id", "source", *(F.col(c).alias(n) for n, c in names.items()))


def take_mix(docs: DataFrame, seed: str = "mix-1", tmp: Scratch | None = None, **shares) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with the columns of ``docs``."""
    mixed = _mixed(docs, seed, docs.columns, shares, tmp or Scratch(docs.sparkSession)).where("__mix_taken > 0")
    return mixed.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_taken").cast("int")))).select(*docs.columns)
