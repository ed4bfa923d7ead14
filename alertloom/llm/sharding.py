"""K-d tree partitioning of documents into shards of near equal bytes, in Spark's own functions only.

A node that stands for several shards is split along its widest metadata dimension at the weighted quantile
that gives each side its number of shards (the weighted median for an even number). The quantiles of all nodes
of a level are found together by histograms that refine the one bar holding the quantile; a histogram has at
most ``BARS`` rows per node and no rows are sorted. Rows equal in a dimension are told apart by a hash of their
row number, so a value that holds a third of all rows can be cut anywhere.

Defined results: the size of a row is the UTF-8 bytes of its text plus 8, and 8 for a null text. A null in a
dimension sorts first. Repeated rows are placed one by one. An empty table stays empty. Input columns that
carry the name of an output column are replaced.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.llm.rows import with_row_ids
from alertloom.operators.ranking import number_rows
from alertloom.session import cut_lineage, release

SHARDS, OVERHEAD = 24, 8
BARS, PASSES = 4096, 3
VALUE_BITS, TIE_BITS = 20, 32
ROWS_PER_BUCKET = 100_000


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def dimensions(df: DataFrame) -> dict[str, Column]:
    """Numeric metadata of ``df``: text size on a log scale, and a code for each of the columns at hand."""
    found = {"_size": F.ln(size_of(F.col("text")).cast("double"))}
    for name in ("source", "lang"):
        if name in df.columns:
            found[f"_{name}"] = F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))).cast("double")
    if "doc_id" in df.columns:
        found["_doc_id"] = F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))
    return found


def _keys(rows: DataFrame, dims) -> DataFrame:
    """One integer per dimension: the value's place between its minimum and maximum, then the hash that breaks ties."""
    bounds = rows.agg(*[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.shiftrightunsigned(F.xxhash64("_row"), 64 - TIE_BITS)
    top = float(2**VALUE_BITS - 1)
    out = {}
    for d in dims:
        low, high = bounds[f"lo{d}"], bounds[f"hi{d}"]
        place = (F.col(d) - low) / (high - low) * top if high is not None and high > low else F.lit(0.0)
        out[d] = F.shiftleft(F.floor(place).cast("long"), TIE_BITS) + tie
    return rows.withColumns(out)


def _split_points(rows: DataFrame, dims) -> DataFrame:
    """``base, dim, cut`` for every node ``(base, k)`` with more than one shard; keys up to ``cut`` go left."""
    open_rows = rows.where("k > 1")
    spans = open_rows.groupBy("base", "k").agg(
        F.sum("size").alias("total"), *[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    widths = F.array(*[F.struct((F.col(f"hi{d}") - F.col(f"lo{d}")).alias("width"), F.lit(-i).alias("nth"), F.lit(d).alias("dim"),
                                F.col(f"lo{d}").alias("lo"), F.col(f"hi{d}").alias("hi")) for i, d in enumerate(dims)])
    want = F.col("total") * F.floor(F.col("k") / 2) / F.col("k")
    state = spans.select("base", F.array_max(widths).alias("w"), want.alias("want")) \
        .select("base", F.col("w.dim").alias("dim"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), "want", F.lit(0).cast("double").alias("below"))
    state = cut_lineage(state)
    for turn in range(PASSES):
        state = state.withColumn("step", F.greatest(F.lit(1).cast("long"), F.ceil((F.col("hi") - F.col("lo") + 1) / BARS)))
        joined = open_rows.join(state, "base").withColumn("key", _key_of(dims)).where("key between lo and hi")
        bars = joined.groupBy("base", F.floor((F.col("key") - F.col("lo")) / F.col("step")).alias("bar")).agg(F.sum("size").alias("w"))
        # few rows per node; summing the bars of a node in order needs no more than BARS values
        order = F.array_sort(F.collect_list(F.struct("bar", "w")))
        per_node = bars.groupBy("base").agg(order.alias("bars")).join(state, "base")
        zero = F.struct(F.col("below").alias("sum"), F.lit(None).cast("long").alias("bar"), F.col("below").alias("before"))
        # a first bar always holds when no bar reaches the wanted sum: then the last one does
        step = lambda a, x: F.when(a["bar"].isNotNull() & (a["sum"] >= F.col("want")), a).otherwise(
            F.struct((a["sum"] + x["w"]).alias("sum"), x["bar"].alias("bar"), a["sum"].alias("before")))
        hit = per_node.withColumn("hit", F.aggregate("bars", zero, step))
        lo = F.col("lo") + F.col("hit.bar") * F.col("step")
        old = state
        state = cut_lineage(hit.select("base", "dim", lo.alias("lo"), F.least("hi", lo + F.col("step") - 1).alias("hi"), "want",
                                       F.col("hit.before").alias("below"), F.col("hit.sum").alias("through")))
        if hasattr(old, "_cut_path"):
            release(old)
        state = _kept(state, state.drop("through")) if turn < PASSES - 1 else state
    nearer = F.col("through") - F.col("want") <= F.col("want") - F.col("below")
    return _kept(state, state.select("base", "dim", F.when(nearer, F.col("hi")).otherwise(F.col("lo") - 1).alias("cut")))


def _kept(cut, view):
    view._cut_path = cut._cut_path
    return view


def _key_of(dims) -> Column:
    return reduce(lambda x, d: F.when(F.col("dim") == d, F.col(d)).otherwise(x), dims[1:], F.col(dims[0]))


def kd_shards(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``_row, shard`` for ``rows (_row, size, *dims)``; the dimensions are numbers."""
    now = cut_lineage(_keys(rows.select("_row", "size", *dims), dims).withColumns({"base": F.lit(0), "k": F.lit(shards)}))
    most = shards
    while most > 1:
        points = _split_points(now, dims)
        left = F.floor(F.col("k") / 2).cast("int")
        stays = F.col("dim").isNull() | (_key_of(dims) <= F.col("cut"))
        placed = now.join(points, "base", "left").select(
            "_row", "size", *dims,
            F.when(stays, F.col("base")).otherwise(F.col("base") + left).alias("base"),
            F.when(F.col("dim").isNull(), F.col("k")).when(stays, left).otherwise(F.col("k") - left).alias("k"))
        old, now = now, cut_lineage(placed)
        release(old, points)
        most = most - most // 2
    return _kept(now, now.select("_row", F.col("base").alias("shard"), "size"))


def numbered(shard_rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard; no task numbers more than about ``ROWS_PER_BUCKET`` rows."""
    spread = max(1, shard_rows.count() // ROWS_PER_BUCKET)
    bucket = F.pmod(F.xxhash64("_row"), F.lit(spread))
    out = number_rows(shard_rows, ["shard"], bucket, ["_row"], "_slot")
    return out.withColumn("slot", F.col("_slot") - 1).drop("_slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per row of ``docs``.

    With ``target_bytes`` there are as many shards as it takes for leaves of about that size.
    """
    dims = dimensions(docs)
    facts = with_row_ids(docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                                     *[c.alias(n) for n, c in dims.items()]))
    placed = numbered(kd_shards(facts, list(dims), shards if target_bytes is None else _leaves(facts, target_bytes)))
    out = facts.select("_row", "doc_id", "text_crc32").join(placed, "_row")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _leaves(facts: DataFrame, target_bytes: int) -> int:
    total = facts.agg(F.sum("size").alias("s")).first()["s"] or 0
    return max(1, -(-total // target_bytes))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``."""
    rows = with_row_ids(docs.drop("shard", "slot"))
    dims = dimensions(rows)
    facts = rows.select("_row", size_of(F.col("text")).alias("size"), *[c.alias(n) for n, c in dims.items()])
    placed = numbered(kd_shards(facts, list(dims), shards)).drop("size")
    return rows.join(placed, "_row").drop("_row")
