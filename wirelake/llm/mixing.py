"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sizes are summed by source, targets are proportional to the weights, a source whose target is above
``max_epochs`` times its size is clamped there and the excess goes to the others by weight until none
is above. A source that is to be read e times gives every document floor(e) whole repetitions; the
fractional repetition goes to the documents that come first in a seeded hash order, up to the point
where their sizes sum to the fraction. That point is found from a histogram of hash buckets, and only
the documents of each source's one boundary bucket are put in order: of a source whose documents have ids of their own, one of
``BUCKETS`` parts. Rows with one doc_id and size (repeated ones, null ids) share a bucket.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; documents of
size 0 take 0 words; repeated rows count each for itself; an empty table gives an empty result. Columns
other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets a source for the search of its boundary.
BUCKETS = 4096
#: Sources up to this many are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (_skey, _size, _weight) with _target; the driver holds two sums only."""
    total = sources.agg(F.sum("_size").alias("t")).first()["t"] or 0
    cap = F.col("_size") * max_epochs
    lam = None
    while True:
        free = F.lit(True) if lam is None else F.col("_weight") * lam <= cap
        row = sources.agg(
            F.sum(F.when(~free, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(free, F.col("_weight")).otherwise(0)).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        new = (total - row["fixed"]) / row["weight"]
        if lam is not None and new <= lam:
            break
        lam = new
    return sources.withColumn("_target", F.least(cap.cast("double"), F.col("_weight") * F.lit(float(lam or 0.0))))


def weigh(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """_weight by rank of _skey in code point order.

    The rank is made of ranges: a range partition's offset, and the place inside it.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(sources.repartitionByRange(parts, "_skey").withColumn("_part", F.spark_partition_id()), "mix-sources")
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # As many rows as shuffle partitions at most.
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("_skey")) - 1
    weight = F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    return ranged.join(F.broadcast(offsets.drop("_n")), "_part").withColumn("_weight", weight).drop("_part", "_before")


def marked(docs: DataFrame, seed: int) -> DataFrame:
    """_row (all columns), and what the mix needs: _skey, _size, _place in a seeded order, _bucket of it."""
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2"))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_skey"), words(F.col("text")).alias("_size"))
    rows = rows.withColumn("_place", F.xxhash64(F.lit(seed), F.col("_row.doc_id"), F.col("_size")))
    return rows.withColumn("_bucket", F.pmod("_place", F.lit(BUCKETS)).cast("int"))


def plan_of(rows: DataFrame, max_epochs: int, cycle: tuple[int, ...]) -> DataFrame:
    """For each source: its size, target, whole repetitions, and where the fractional one ends."""
    histogram = written(rows.groupBy("_skey", "_bucket").agg(F.sum("_size").alias("_part_size")), "mix-histogram")
    sizes = histogram.groupBy("_skey").agg(F.sum("_part_size").alias("_size"))
    filled = water_fill(written(weigh(sizes, cycle), "mix-weights"), max_epochs)
    epochs = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(F.lit(0.0))
    filled = filled.withColumn("_whole", F.floor(epochs)).withColumn("_rest", (epochs - F.floor(epochs)) * F.col("_size"))

    # The bucket in which each source's fractional repetition ends: BUCKETS rows a source at most.
    running = F.sum("_part_size").over(W.partitionBy("_skey").orderBy("_bucket"))
    ends = (
        histogram.withColumn("_upto", running)
        .join(filled.select("_skey", "_rest"), "_skey")
        .where(F.col("_upto") >= F.col("_rest"))
        .groupBy("_skey")
        .agg(F.min("_bucket").alias("_end"), F.min_by(F.col("_upto") - F.col("_part_size"), "_bucket").alias("_below"))
    )
    plan = filled.join(ends, "_skey", "left")
    return written(plan.select("_skey", F.col("_size").alias("source_size"), F.col("_target").alias("target"), "_whole", "_rest", F.coalesce("_end", F.lit(BUCKETS)).alias("_end"), F.coalesce("_below", F.lit(0)).alias("_below")), "mix-plan")


def carried_out(rows: DataFrame, plan: DataFrame, max_epochs: int) -> DataFrame:
    """``rows`` with source_size, target, and the repetitions of each document."""
    small = plan.count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(plan) if small else plan, "_skey")
    # Of a boundary bucket, documents go in by hash while the middle of each still lies below the end.
    edge = joined.where((F.col("_bucket") == F.col("_end")) & (F.col("_size") > 0))
    order = W.partitionBy("_skey").orderBy("_place", "_row.doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("_upto", F.col("_below") + F.sum("_size").over(order)).withColumn("_extra", (F.col("_upto") - F.col("_size") / 2 <= F.col("_rest")).cast("int"))
    inner = joined.where((F.col("_bucket") != F.col("_end")) | (F.col("_size") == 0)).withColumn("_extra", (F.col("_bucket") < F.col("_end")).cast("int"))
    repeats = F.when(F.col("_size") > 0, F.least(F.col("_whole") + F.col("_extra"), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    return inner.unionByName(edge.drop("_upto")).withColumn("_repeats", repeats)


def mix(docs: DataFrame, max_epochs: int = 3, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats for each row of ``docs``.

    ``repeats`` is how often the mix takes the document, ``taken`` the words that makes.
    """
    rows = written(marked(docs.select("doc_id", "source", "text"), seed).withColumn("_row", F.struct("_row.doc_id")), "mix-rows")
    out = carried_out(rows, plan_of(rows, max_epochs, cycle), max_epochs)
    return out.select("_row.doc_id", F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), (F.col("_repeats") * F.col("_size")).alias("taken"), F.col("_repeats").alias("repeats"))


def take(docs: DataFrame, max_epochs: int = 3, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """The documents of the mix, with all their columns and size, source_size, target, taken and repeats.

    Columns of the same names are replaced. Documents that the mix doesn't take are not among them.
    """
    rows = marked(docs, seed)
    plan = plan_of(written(rows.select("_skey", "_bucket", "_size"), "mix-rows"), max_epochs, cycle)
    own = ["size", "source_size", "target", "taken", "repeats"]
    out = carried_out(rows, plan, max_epochs).where("_repeats > 0")
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in own], F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), (F.col("_repeats") * F.col("_size")).alias("taken"), F.col("_repeats").alias("repeats"))
