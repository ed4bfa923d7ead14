"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Whole copies of all its documents are certain; what is left is a
sample without replacement with unequal probabilities: they grow with a document's weight, by default the square root
of its size, so that the sample leans to longer documents, and are scaled to the rest of the source's target.
Documents whose probability reaches 1 are certain too and the others are scaled anew. The rest are ranked by the odds
of a random number divided by the odds of their inclusion, and the best ranks are taken until the words reach the
rest of the target.

Defined results: words are maximal runs of non-blank characters; a null or empty text has size 0 and never
changes a total. Sources are ordered by code point with null, a source of its own, last. The random number is a
digest of id, text and seed, so reruns agree; repeated rows are interchangeable and each may be taken. A source
without words has target 0. An empty table stays empty. Input columns are kept unless they carry the name of an
output column, which replaces them.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertloom.llm.quality import words
from alertloom.llm.rows import with_row_ids
from alertloom.operators.ranking import join_on, range_bucket, running
from alertloom.session import cut_lineage

WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2


def uniform(seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a digest of ``doc_id`` and ``text``."""
    blank = F.lit("")
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), blank), F.md5(F.coalesce("text", blank)))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """``source, source_size, target`` from ``sizes (source, source_size)``, one row per source.

    ``share`` of all words goes out by weight; a target stops at ``copies`` times its source's size and the
    excess is shared anew by weight. The fixed point is ``min(cap, weight * level)``: with sources in the order
    of cap over weight, a source is full if the level that its predecessors leave is at least its own.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumns({"_w": cycle, "_cap": F.lit(float(copies)) * F.col("source_size")})
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everyone = W.partitionBy()
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "_left": F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_weight": F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    level = F.col("_left") / F.col("_weight")
    ranked = ranked.withColumns({"_level": level, "_full": F.col("_cap") / F.col("_w") <= level})
    reached = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source", "_level"))).over(everyone)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * reached["_level"]))
    return ranked.select("source", "source_size", target.alias("target"))


def inclusion_scales(rows: DataFrame) -> DataFrame:
    """``source, _scale, _top`` from ``rows (source, size, _w, _rest)``: inclusion probability per weight, and the largest
    weight that is not certain.

    With the heaviest documents certain, the scale of the others is what they leave of the rest over the sum of weight
    times size; it holds from the first weight on whose probability stays below 1. A row per distinct weight
    decides, not one per document.
    """
    by_weight = rows.groupBy("source", "_w").agg(F.sum("size").cast("double").alias("_s"), F.max("_rest").alias("_rest"))
    heavier = W.partitionBy("source").orderBy(F.col("_w").desc()).rowsBetween(W.unboundedPreceding, -1)
    others = W.partitionBy("source").orderBy("_w").rowsBetween(W.unboundedPreceding, W.currentRow)
    left = F.col("_rest") - F.coalesce(F.sum("_s").over(heavier), F.lit(0.0))
    scale = left / F.nullif(F.sum(F.col("_s") * F.col("_w")).over(others), F.lit(0.0))
    open_ = by_weight.withColumn("_c", F.coalesce(scale, F.lit(0.0))).where(F.col("_c") * F.col("_w") < 1)
    return open_.groupBy("source").agg(F.max_by("_c", "_w").alias("_scale"), F.max("_w").alias("_top"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = 1,
                preference: Column | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``size, source_size, target, copies, taken``.

    ``copies`` is how often the mix repeats the document, ``taken`` the words that makes. ``preference``, a column of
    positive whole numbers with few distinct values next to the documents, replaces the weight 1 + floor(sqrt(size)).
    """
    size = F.size(words(F.col("text"))).cast("long")
    weight = F.floor(F.sqrt("size")).cast("long") + 1 if preference is None else preference.cast("long")
    # written without the texts, which are read once
    sized = cut_lineage(docs.withColumns({"size": size, "_u": uniform(seed), "_key": F.xxhash64("text")}).withColumn("_w", weight)
                        .drop("text", "source_size", "target", "copies", "taken"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, copies)
    rows = join_on(sized, targets, ["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_whole", F.floor(ratio)).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    rows = join_on(rows, inclusion_scales(rows), ["source"], "left")
    odds, pi = F.col("_u") / (1 - F.col("_u")), F.col("_scale") * F.col("_w")
    rank = F.when(F.col("_w") > F.col("_top"), F.lit(-1.0)).when(F.col("_scale") > 0, odds / (pi / (1 - pi))).otherwise(odds)
    rows = rows.withColumn("_rank", rank)
    rows = running(rows, ["source"], range_bucket(rows, ["source"], ["_rank"]), ["_rank", F.col("doc_id").asc_nulls_last(), "_key"],
                   F.col("size"), "_before", "sum", False)
    chosen = (F.col("_rest") > 0) & (F.col("_before") + F.col("size") / 2.0 <= F.col("_rest"))
    rows = rows.withColumn("copies", (F.col("_whole") + F.when(chosen, 1).otherwise(0)).cast("int"))
    rows = rows.withColumn("taken", F.col("size") * F.col("copies"))
    return rows.drop("_u", "_w", "_whole", "_scale", "_top", "_rank", "_rest", "_before", "_key")


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; rows that repeat in the input are taken one by one."""
    numbered = with_row_ids(docs)
    taken = mix_sources(numbered.select("_row", "doc_id", "source", "text"), **how).where("copies > 0").select("_row", "copies")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")
    return numbered.join(taken, "_row").select(*docs.columns, copies).drop("_copy")
