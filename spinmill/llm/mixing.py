"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_WORD, settled, sized, whole

#: Bits of the hash that each histogram resolves, and how many histograms are made at most.
BITS, LEVELS = 12, 4
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """__source, source_size, target: shares of all sizes by weight, none above `most` times its source's size.

    What the stopped sources can't take is shared again by weight until none is above its bound. In order of bound over
    weight the stopped ones come first, so running sums give the last share without a loop. Only these aggregated rows
    meet in one task.
    """
    per = sizes.groupBy("__source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("w", F.get(w, (F.row_number().over(order) - 1) % len(weights)))
    ranked = Window.orderBy(F.col("source_size") / F.col("w"), F.col("__source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "w_all": F.sum("w").over(everything),
        "cap": F.col("source_size") * F.lit(float(most)),
    })
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("share", share).withColumn("stops", F.col("cap") <= F.col("share") * F.col("w"))
    last = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("w"), F.col("share")))).over(everything)["share"]
    return per.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(last * F.col("w"))).select("__source", "source_size", "target")


def _histogram_level(rows: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """bounds with the boundary bucket resolved by BITS more bits.

    bounds: __source, prefix (the hash bits settled so far), left (words still wanted below the boundary). Only rows
    in a source's boundary bucket are summed; a source has 2^BITS sums at most.
    """
    on = rows["__source"].eqNullSafe(bounds["b_source"])
    if level > 1:
        on &= F.shiftrightunsigned(rows["__h"], 64 - BITS * (level - 1)) == bounds["prefix"]
    inside = rows.join(bounds, on)
    bucket = F.shiftrightunsigned("__h", 64 - BITS * level)
    sums = inside.groupBy("b_source", "left", bucket.alias("bucket")).agg(F.sum("size").alias("s"))
    run = Window.partitionBy("b_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(run), F.lit(0)))
    # The last bucket that begins at or below what is left holds the boundary.
    hit = sums.where(F.col("before") <= F.col("left")).groupBy("b_source").agg(F.max_by(F.struct("bucket", "before", "s", "left"), "bucket").alias("x"))
    return hit.select("b_source", F.col("x.bucket").alias("prefix"), (F.col("x.left") - F.col("x.before")).alias("left"), F.col("x.s").alias("edge"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, most: int = MOST_REPEATS, levels: int = LEVELS) -> DataFrame:
    """id_col, source_col, size, source_size, target, taken, repeats: how often the mix takes each row.

    A source whose target is q whole sizes and a rest takes each document q times; those whose hash lies below the
    source's threshold once more. The threshold comes from sums by source and hash bucket: the boundary bucket alone is
    summed again by further bits. Budgets nest: a larger target keeps all that a smaller one takes. The bucket at the
    edge is taken if that comes nearer to the target. Null texts have size 0; null is a source like another, the last.
    Rows alike in id and text share a hash and go together. Empty tables give no rows.
    """
    rows = settled(docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
        F.regexp_count(whole(text_col), F.lit(WS_WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("__h"),
    ))
    per = source_targets(rows, weights, most).withColumns({
        "q": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumn("left", F.greatest(F.col("target") - F.col("q") * F.col("source_size"), F.lit(0.0)))
    per = settled(per)
    bounds = per.where("source_size > 0").select(F.col("__source").alias("b_source"), F.lit(0).cast("long").alias("prefix"), "left")
    for level in range(1, levels + 1):
        bounds = settled(_histogram_level(rows, bounds, level))
    # Unsigned order of the settled bits; the edge bucket counts if at least half of it is wanted.
    bounds = bounds.select("b_source", "prefix", (F.col("left") * 2 >= F.col("edge")).alias("edge_in"))
    per = per.join(bounds, per["__source"].eqNullSafe(bounds["b_source"]), "left").select(F.col("__source").alias("p_source"), "source_size", "target", "q", "prefix", "edge_in")
    per = settled(per)
    per = sized(per, per.count())  # a row for each source
    high = F.shiftrightunsigned("__h", 64 - BITS * levels)
    once_more = F.when(F.col("prefix").isNull(), False).otherwise((high < F.col("prefix")) | ((high == F.col("prefix")) & F.col("edge_in")))
    out = rows.join(per, rows["__source"].eqNullSafe(per["p_source"]))
    repeats = F.least(F.col("q") + once_more.cast("long"), F.lit(most).cast("long"))
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))
