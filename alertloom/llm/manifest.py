"""Merkle manifest of a dataset: leaf coordinates by ranks in bitmaps, levels by keyed slot arrays.

*Coordinates.* The ids of a group are a bitmap, kept as its non-empty words of 64 ids; parts merge by bitwise or
before and after the shuffle. A directory counts rows before every word: inside a container of 1024 words, and over
the containers of a group by a running fold in ranges. The coordinate of a row is the directory's count before its
word plus the set bits below its id, so rows are never sorted. Ids that repeat have one bit; their words also list
how many rows more they stand for, and rows of one id are told apart by their digests.

*Levels.* Nodes whose coordinates agree up to the last ``HEIGHT`` digits to base ``FAN`` meet in one array with a slot
per coordinate, which is reduced ``HEIGHT`` levels at once; its root goes on as a node of the next stage. A billion
leaves take four stages of one shuffle, each ``FAN ** HEIGHT`` times smaller than the one before. Written stages hold
all levels of their arrays, so proofs go down from the root by joining each array with the path above it.

Defined results: groups are ordered null first, then by UTF-8 bytes; the leaves of a group by id, null first, then by
digest (equal rows have equal digests and take any order). A null value is digested as ``-``, any other as its
UTF-8 byte count, ``:`` and itself, so an empty text differs from a missing one. An empty table has no rows and no
root. Extra columns neither enter a digest nor get lost names: only the named columns are read.
"""

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.operators.ranking import number_rows, range_bucket, running
from alertloom.session import cut_lineage, release

FAN, HEIGHT = 3, 5
SLOTS = FAN**HEIGHT
WORD, CONTAINER = 6, 10  # 2 ** 6 ids in a word, 2 ** 10 words in a container
NO_ID = -(1 << 60)  # the word of null ids, below those of all others
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns) -> Column:
    """Digest of a row's values, each with its length, so that no two rows share an input."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _bitmap(rows: DataFrame) -> DataFrame:
    """``_g, _w, bits, n, more``: the non-empty words, written; ``more`` lists the ids with further rows."""
    ids = rows.groupBy("_g", "_w", "_low").agg(F.count(F.lit(1)).alias("n"))
    further = F.when(F.col("n") > 1, F.struct("_low", (F.col("n") - 1).alias("n")))
    return cut_lineage(ids.groupBy("_g", "_w").agg(F.bit_or(F.expr("shiftleft(1L, _low)")).alias("bits"), F.sum("n").alias("n"), F.collect_list(further).alias("more")))


def _directory(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words with the rows before them, ``_g, n_leaves``)."""
    words = words.withColumn("_c", F.shiftright("_w", CONTAINER))
    containers = cut_lineage(words.groupBy("_g", "_c").agg(F.sum("n").alias("n")))
    before = running(containers, ["_g"], range_bucket(containers, ["_g"], ["_c"]), ["_c"], F.col("n"), "_before", "sum", False)
    # collected per container: at most 2 ** CONTAINER words
    inside = words.groupBy("_g", "_c").agg(F.array_sort(F.collect_list(F.struct("_w", "bits", "n", "more"))).alias("_ws"))
    counts = F.transform("_ws", lambda x: x["n"])
    upto = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
    placed = inside.withColumn("_sums", upto).join(before.select("_g", "_c", "_before"), ["_g", "_c"])
    placed = placed.select("_g", "_before", "_sums", F.posexplode("_ws").alias("_i", "_x"))
    directory = placed.select("_g", "_x._w", "_x.bits", "_x.more", (F.col("_before") + F.get("_sums", F.col("_i"))).alias("before"))
    return directory, containers.groupBy("_g").agg(F.sum("n").alias("n_leaves"))


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows (_g, id, leaf, ...)``, a written table, with ``place`` (from 0) among the ``n`` leaves of the group."""
    low = F.coalesce(F.col("id").bitwiseAND((1 << WORD) - 1).cast("int"), F.lit(0))
    keyed = rows.withColumns({"_w": F.coalesce(F.shiftright("id", WORD), F.lit(NO_ID)), "_low": low})
    words = _bitmap(keyed)
    directory, sizes = _directory(words)
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, _low)")))
    more = F.aggregate(F.filter("more", lambda x: x["_low"] < F.col("_low")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    ranked = keyed.join(directory, ["_g", "_w"]).withColumns({
        "place": F.col("before") + below + more, "_tied": F.exists("more", lambda x: x["_low"] == F.col("_low"))})
    ranked = cut_lineage(ranked.drop("bits", "more", "before"))
    tied = ranked.where("_tied")
    if not tied.isEmpty():
        order = ["leaf", "_u"]
        numbered = number_rows(tied, ["_g", "_w", "_low"], range_bucket(tied, ["_g", "_w", "_low"], order), order, "_t")
        numbered = numbered.withColumn("place", F.col("place") + F.col("_t") - 1).drop("_t")
        ranked = ranked.where("NOT _tied").unionByName(numbered)
    return ranked.drop("_w", "_low", "_tied").join(sizes.withColumnRenamed("n_leaves", "n"), "_g")


def _levels(digests: Column, n: Column) -> Column:
    """The next level: every ``FAN`` consecutive digests become one, unless the group has come down to its root."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(digests) / FAN).cast("int") - 1)
    up = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, FAN * i + 1, FAN), ""), 256))
    return F.when(n > 1, up).otherwise(digests)


def _rise(nodes: DataFrame) -> tuple[list, DataFrame]:
    """(written stages from the leaves up, ``_g, subroot``) of ``nodes (_g, place, n, digest, payload)``."""
    stages, roots = [], None
    while True:
        slots = F.array_sort(F.collect_list(F.struct("place", "digest", "payload")))
        blocks = nodes.groupBy("_g", "n", F.expr(f"place div {SLOTS}").alias("block")).agg(slots.alias("slots"))
        blocks = blocks.withColumn("l0", F.transform("slots", lambda x: x["digest"]))
        for i in range(HEIGHT):
            blocks = blocks.withColumn(f"l{i + 1}", _levels(F.col(f"l{i}"), F.ceil(F.col("n") / FAN**i)))
        blocks = cut_lineage(blocks.withColumn("slots", F.transform("slots", lambda x: x["payload"])))
        stages.append(blocks)
        left = F.ceil(F.col("n") / SLOTS)
        up = blocks.select("_g", F.col("block").alias("place"), left.alias("n"), F.col(f"l{HEIGHT}")[0].alias("digest"))
        done = up.where("n = 1").select("_g", F.col("digest").alias("subroot"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = up.where("n > 1").withColumn("payload", F.struct(F.col("place").alias("id")))
        if nodes.isEmpty():
            return stages, roots


def _siblings(i: int) -> Column:
    """The digests beside a node's ancestor at level ``i`` of its array: before it and after it."""
    at = F.expr(f"_p div {FAN ** i}").cast("int")
    mine, run = at % FAN, at - at % FAN
    before = F.array_join(F.slice(f"l{i}", run + 1, mine), "")
    after = F.array_join(F.slice(f"l{i}", run + mine + 2, FAN - 1 - mine), "")
    return F.when(F.ceil(F.col("n") / FAN**i) > 1, F.struct(before.alias("before"), after.alias("after")))


def _descend(stages, ends: DataFrame) -> DataFrame:
    """``payload, digest, path`` of all leaves, with the columns that ``ends (_g, path, ...)`` has per group."""
    carried = [c for c in ends.columns if c not in ("_g", "path")]
    above = None
    for blocks in reversed(stages):
        last = blocks.where(F.ceil(F.col("n") / SLOTS) == 1).join(ends, "_g")
        if above is not None:
            last = last.unionByName(blocks.join(above, ["_g", "block"]).select(*last.columns))
        slot = last.select("*", F.posexplode("slots").alias("_p", "payload"))
        path = F.concat(F.array_compact(F.array(*[_siblings(i) for i in range(HEIGHT)])), F.col("path"))
        rows = slot.select("_g", "payload", F.get("l0", F.col("_p")).alias("digest"), path.alias("path"), *carried)
        above = rows.select("_g", F.col("payload.id").alias("block"), "path", *carried) if blocks is not stages[0] else rows
    return above.drop("_g")


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` leads to beside the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of ``path``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def merkle_manifest(docs: DataFrame, fields=FIELDS, group="source", id_col="doc_id", found: Column = None) -> DataFrame:
    """``id, leaf, found, subroot, root, path`` for every row of ``docs``; ``path`` lists the siblings up to the root.

    ``found`` is another digest per row to be checked later, by default the leaf itself.
    """
    leaf = leaf_digest(fields)
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(name.alias("_g"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), (leaf if found is None else found).alias("found"))
    rows = cut_lineage(rows.withColumn("_u", F.monotonically_increasing_id()))
    nodes = coordinates(rows).select("_g", "place", "n", F.col("leaf").alias("digest"), F.struct("id", "found").alias("payload"))
    stages, roots = _rise(nodes)
    release(rows)
    roots = cut_lineage(roots.withColumn("_all", F.lit("")))
    numbered = number_rows(roots, ["_all"], range_bucket(roots, ["_all"], ["_g"]), ["_g"], "place")
    total = roots.agg(F.count(F.lit(1))).scalar()
    tops = numbered.select(F.col("_all").alias("_g"), (F.col("place") - 1).alias("place"), total.alias("n"), F.col("subroot").alias("digest"),
                           F.struct(F.col("_g").alias("id")).alias("payload"))
    upper, top = _rise(tops)
    none = F.array().cast("array<struct<before:string,after:string>>")
    over = _descend(upper, top.select("_g", F.col("subroot").alias("root"), none.alias("path")))
    ends = cut_lineage(over.select(F.col("payload.id").alias("_g"), "path", "root", F.col("digest").alias("subroot")))
    return _descend(stages, ends).select("payload.id", F.col("digest").alias("leaf"), "payload.found", "subroot", "root", "path")
