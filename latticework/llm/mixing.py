"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. The
expected copies are summed along an order of the source's documents, one random
offset is added to the sums, and a document is emitted once for each integer
that its own stretch of the sum crosses. As the order runs by size, the words
taken from a source differ from its target by about one large document.

Scale: the sums are taken in two levels, inside cells of (source, size class,
hash bucket) and over the cells, so a source that holds a third of all rows is
spread over many tasks. Only the small table of cells is summed by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, cut, small

#: Size classes per doubling, rows aimed at in a cell's bucket, least buckets.
CLASSES, CELL_ROWS, BUCKETS = 6, 50_000, 32
SOURCES_PER_TASK = 100_000


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Targets of (source, source_size) rows: source, source_size, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. A target stops at ``cap`` times its source's size; the
    excess is shared again by weight until none is above.
    """
    n = sizes.count()
    ranged = sizes.repartitionByRange(max(1, -(-n // SOURCES_PER_TASK)), F.col("source").asc_nulls_last())
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()), "sources")
    before, starts = 0, []
    for part, rows in sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, before))
        before += rows
    starts = ranged.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weigh = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    ranged = cut(ranged.join(F.broadcast(starts), "part").withColumn("weight", weigh).withColumn("most", cap * F.col("source_size")), "weights")
    total = ranged.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("most") < level * F.col("weight")
        held, free, count = ranged.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if count == capped or not free:
            break
        capped, level = count, max(level, (total - (held or 0.0)) / free)
    return ranged.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, source) is taken.

    Returns doc_id, source, size, source_size, target, copies, taken and the
    columns of ``keep``. Null and empty texts have size 0 and are taken 0 words;
    a null source is a source of its own. Equal rows each get a place of their
    own in the order. An empty table gives an empty result. The offset is a hash
    of seed and source, so reruns agree. Extra columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), *keep)
    if not keep:
        sized = cut(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_source = cut(by_source, "by_source")
    rows = by_source.agg(F.sum("rows"), F.count("*")).first()
    targets = source_targets(by_source.select("source", "source_size"), weights, cap)
    buckets = max(BUCKETS, (rows[0] or 0) // CELL_ROWS)
    cells = sized.withColumn("class", F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int"))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    key = ["skey", "class", "bucket"]
    counts = cells.groupBy(*key).agg(F.count("*").alias("n"))
    over = Window.partitionBy("skey").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id"))
    targets = targets.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    placed = cells.withColumn("rank", rank).join(starts, key).join(small(targets, rows[1], BROADCAST_ROWS), "skey")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a multiple of 2^-20: sums with whole rates stay exact
    offset = F.pmod(F.xxhash64(F.lit(seed), "skey"), F.lit(1 << 20)) / float(1 << 20)
    upto = F.col("before") + F.col("rank")
    copies = (F.floor(offset + upto * rate) - F.floor(offset + (upto - 1) * rate)).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mixed(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    A document of no words is left out, as no target asks for it.
    """
    names = docs.columns
    held = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    taken = mix(held.select("doc_id", "text", "source", "_row"), seed, weights, cap, keep=("_row",))
    taken = taken.where("taken > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
