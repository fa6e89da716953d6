"""Mix sources to target weights with Efraimidis-Spirakis sampling.

Each document's key is an exponential variate divided by its quality weight; a smaller key comes first.  A source with
more words wanted than it has gives complete epochs (every document that many times), then a fractional selection: its
documents in key order as long as the running sum of sizes stays within the budget, and the one document left over
whose size is nearest to what is still missing, if it brings the sum nearer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, unique_name

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
SEED = 20240117
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.1 the more of the text's characters are symbols."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 8 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights go to sources in code-point order, null last.  Targets share the sum of all sizes by weight; those above
    ``max_epochs`` times their source stop there and the excess is shared again among the others, until none is above.
    Each round reads two sums; no list of sources leaves the executors.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex().map(
        lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    rows = spark.createDataFrame(ordered, "source string, source_size long, at long")
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = materialise(rows.select("source", "source_size", cycle.alias("weight")), "sources")
    cap = F.col("source_size") * max_epochs
    total = rows.agg(F.sum("source_size").alias("all")).first()["all"] or 0
    level = 0.0  # words per unit of weight
    while total:
        above = F.col("weight") * level > cap
        s = rows.agg(F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if not s["w"]:
            break
        new = (total - (s["capped"] or 0)) / s["w"]
        if new <= level:
            break
        level = new
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, source) is taken.

    Returns (row, doc_id, source, size, source_size, target, times, taken); ``row`` is a hash of the row's doc_id, source and
    text.  A null text has size 0 and is never short of its share: documents without words are taken once per epoch
    at no cost.  Equal rows share a key and are told apart by an arbitrary rank; the rows taken stay the same
    multiset.  Reruns agree.  No documents, no rows.
    """
    text = F.col("text").cast("string")
    row = F.xxhash64("doc_id", "source", text)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), row), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    narrow = materialise(docs.select(
        row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(text).alias("size"), (-F.log(u) / quality_weight(text)).alias("key")), "mix-rows")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs)
    # every (source, slice) is a small group, also of a source that holds a third of all rows
    slices = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = narrow.withColumn("slice", F.least(F.lit(slices - 1), F.floor((1 - F.exp(-F.col("key"))) * slices)).cast("int"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    goals = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - epochs * F.col("source_size"))
    ground = materialise(_per_source(
        keyed.groupBy("source", "slice").agg(F.sum("size").alias("n")).select(
            "source", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), goals), "mix-slices")
    running = _per_slice(keyed.withColumn("upto", F.sum("size").over(inside)), ground)
    in_prefix = (F.col("upto") + F.col("base") <= F.col("budget")) & (F.col("budget") > 0)
    first = materialise(running.withColumn("in_prefix", in_prefix).drop("upto", "base"), "mix-prefix")
    discard(narrow)
    # the document that best closes the gap, by a partial aggregate over all that the prefix left
    got = first.groupBy("source").agg(F.sum(F.when(F.col("in_prefix"), F.col("size")).otherwise(0)).alias("got"))
    gap = F.col("budget") - F.col("got")
    gaps = _per_source(ground.select("source", "slice", "budget"), got).select("source", "slice", gap.alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    close = (_per_slice(first.where(~F.col("in_prefix") & (F.col("size") > 0)), gaps).where(off < F.col("gap"))
             .groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "row")).alias("best"))
             .select("source", F.col("best.row").alias("closing")))
    marked = _per_slice(first, _per_source(ground.select("source", "slice"), close))
    rank = F.row_number().over(Window.partitionBy("row", "in_prefix").orderBy("key"))  # of equal rows, one closes the gap
    closes = ~F.col("in_prefix") & F.coalesce(F.col("row") == F.col("closing"), F.lit(False)) & (F.col("rank") == 1)
    out = marked.withColumn("rank", rank).withColumn(
        "times", (F.col("epochs") + F.when(F.col("in_prefix") | closes, 1).otherwise(0)).cast("int"))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "times",
                      (F.col("times") * F.col("size")).alias("taken"))


def _per_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of two tables with a few rows per source."""
    right = right.withColumnRenamed("source", "of_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")


def _per_slice(rows: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by (source, slice): no partition gets all rows of a large source."""
    right = right.withColumnRenamed("source", "of_source").withColumnRenamed("slice", "of_slice")
    return rows.join(right, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slice") == F.col("of_slice")),
                     "left").drop("of_source", "of_slice")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with the columns of ``docs``."""
    row, times, nth = unique_name(docs, "row"), unique_name(docs, "times"), unique_name(docs, "nth")
    taken = mix(docs, **kw).groupBy("row").agg(F.sum("times").alias("times"), F.count("*").alias("n")).select(
        F.col("row").alias(row), F.col("times").alias(times), F.col("n").alias(nth))
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.col("source").cast("string"), F.col("text").cast("string")))
    # equal rows share the sum of their times: each takes the whole part, the first few one more
    rank = F.row_number().over(Window.partitionBy(row).orderBy(row))
    each = keyed.join(taken, row).withColumn(
        times, (F.floor(F.col(times) / F.col(nth)) + F.when(rank <= F.col(times) % F.col(nth), 1).otherwise(0)).cast("int"))
    return each.where(F.col(times) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth)).drop(nth)
