"""Near-duplicate groups by one-permutation MinHash.

One scan hashes the distinct five-word shingles of every text. A single hash both assigns a shingle to one of
128 bins and ranks it there; empty bins copy a non-empty one picked by optimal densification. Four bins make a
band, 32 bands a signature. Texts with equal shingle sets form a class, and only classes go on. In every band
bucket the smallest member is the centre of a star; star edges are confirmed on the full shingle sets. Where
confirmed edges leave a bucket in several components, its largest one sends another centre to all members
outside it, ``STARS`` times or until a round adds no link; the pairs of a round are at most the rows of the buckets. Members of
buckets that are then still in several components are joined exactly: shingles are ordered by how many members
have them, those of one component only first, and two members of different components can be similar enough only
if they share a shingle early in both orders (prefix and position filter of set-similarity joins). So no link of
two members of a bucket stays unseen, and pairs inside a component are never made. What remains are pairs close
below the threshold: members whose differences are just too many. At a similarity of 0.75 the bands
miss a pair with a probability of 5e-6.

Defined results: words are maximal runs of non-blank characters with A-Z lower-cased; a text of one to four
words is one shingle; texts that are null, empty or blank have an empty set and link with nothing. Rows are
linked, not ids: repeated rows and rows sharing an id each count. ``component_id`` is the smallest id of the
component, null ids aside; a row without words keeps its own id. Extra columns are not read.
Shingles are compared by a 64-bit hash of their words.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import hashing as H
from alertloom.llm.components import components
from alertloom.session import cut_lineage, read_cuts, release

SHINGLE, BINS, ROWS, BANDS = 5, 128, 4, 32
PERCENT = 75
STARS, PART = 2, 1024
_SPACE = H.space_table()
_MULTIPLY = H.seeds(SHINGLE, 2)
_LENGTH = H.seeds(SHINGLE + 1, 6)
_BAND = H.seeds(ROWS, 3)
_BAND_NO = H.seeds(BANDS, 4)
_SET = H.seeds(2, 5)


def shingle_sets(column):
    """Sorted distinct shingle hashes of each text of an Arrow column: (values, offsets)."""
    data, offsets = H.column_bytes(column)
    start, end, first = H.words(data, offsets, _SPACE)
    hashed = H.word_hashes(data, start, end)
    count = np.diff(first)
    rolled = np.zeros(max(len(hashed) - SHINGLE + 1, 0), H.U64)
    for k in range(SHINGLE):
        rolled += hashed[k : len(rolled) + k] * _MULTIPLY[k]
    rolled = H.mix(rolled + _LENGTH[SHINGLE])
    sets = []
    for i, n in enumerate(count):
        at = first[i]
        if n >= SHINGLE:
            sets.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            total = (hashed[at : at + n] * _MULTIPLY[:n]).sum(dtype=H.U64, keepdims=True)
            sets.append(H.mix(total + _LENGTH[n]))
        else:
            sets.append(np.zeros(0, H.U64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, H.U64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(values, offsets):
    """(len(offsets) - 1) x BINS minima of non-empty sorted sets, empty bins densified."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cell = rows * BINS + (values >> H.U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    out = np.zeros((len(offsets) - 1) * BINS, H.U64)
    filled = np.zeros(len(out), bool)
    out[cell[lead]], filled[cell[lead]] = values[lead], True
    open_cells = np.flatnonzero(~filled)
    attempt = 0
    while len(open_cells):
        attempt += 1
        seed = (open_cells % BINS + BINS * attempt).astype(H.U64) * _SET[1]
        donor = open_cells - open_cells % BINS + (H.mix(seed) % H.U64(BINS)).astype(np.int64)
        found = filled[donor]
        out[open_cells[found]] = out[donor[found]]
        open_cells = open_cells[~found]
    return out.reshape(-1, BINS)


def band_keys(signature):
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    return H.mix((grouped * _BAND).sum(axis=2, dtype=H.U64) + _BAND_NO)


def _sketch(stream):
    for whole in stream:
        for batch in H.batches(whole):
            values, offsets = shingle_sets(batch.column("text"))
            size = np.diff(offsets)
            some = np.flatnonzero(size)
            node = np.zeros(len(size), np.int64)
            keys = np.zeros((len(size), BANDS), np.int64)
            if len(some):
                total = np.add.reduceat(H.mix(values * _SET[0]), offsets[some])
                node[some] = H.mix(total + size[some].astype(H.U64)).view(np.int64)
                packed = np.concatenate([[0], np.cumsum(size[some])])
                keys[some] = band_keys(signatures(values, packed)).view(np.int64)
            bands = pa.ListArray.from_arrays(np.arange(0, (len(size) + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text_key"), pa.array(size), pa.array(node, mask=size == 0), bands],
                ["doc_id", "_text_key", "n_shingles", "node", "bands"])


def _sets(stream):
    for whole in stream:
        for batch in H.batches(whole):
            values, offsets = shingle_sets(batch.column("text"))
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "shingles"])


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, _text_key, n_shingles, node, bands``: ``node`` identifies the shingle set, null if it is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_key"), "text")
    return rows.mapInArrow(_sketch, "doc_id long, _text_key long, n_shingles long, node long, bands array<long>")


def _shingles(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the given classes, from one text of each."""
    wanted = classes.join(nodes, "node").select("node", F.col("any_id").alias("_id"), F.col("any_key").alias("_key"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_key"), "text")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    texts = rows.join(wanted, on).select("node", "text").dropDuplicates(["node"])
    return cut_lineage(texts.mapInArrow(_sets, "node long, shingles array<long>"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have enough in common."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b") \
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
    size_a, size_b = F.size("_a"), F.size("_b")
    near = 100 * F.least(size_a, size_b) >= PERCENT * F.greatest(size_a, size_b)
    common = F.size(F.array_intersect("_a", "_b"))
    return cut_lineage(both.where(near).where(100 * common >= PERCENT * (size_a + size_b - common)).select("a", "b"))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels (node, label)`` of all nodes after the links ``found`` join components."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    between = found.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    step = components(between).select(F.col("node").alias("label"), F.col("label").alias("_next"))
    return cut_lineage(labels.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label")))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def linked_classes(docs: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, (node, label)): the distinct sets, and a component label for every linked one."""
    found = sketched.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("min_id"), F.min_by(F.struct("doc_id", "_text_key"), F.col("_text_key")).alias("_any"), F.first("bands").alias("bands"))
    classes = cut_lineage(found.select("node", "min_id", F.col("_any.doc_id").alias("any_id"), F.col("_any._text_key").alias("any_key"), "bands"))
    in_band = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = in_band.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1")
    rest = cut_lineage(in_band.join(shared, "bucket"))
    tested = [cut_lineage(_pairs(rest.select(F.col("centre").alias("a"), F.col("node").alias("b"))))]
    nodes = rest.select("node").distinct()
    sets = _shingles(docs, classes, nodes)
    labels = _merged(nodes.withColumn("label", F.col("node")), _confirmed(tested[0], sets))
    for turn in range(1, STARS + 1):
        live = rest.select("bucket", "node", "members").join(labels, "node")
        parts = live.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("_pick"))
        split = parts.groupBy("bucket").agg(F.max(F.struct("n", "label", "_pick")).alias("_top"), F.count(F.lit(1)).alias("_parts"))
        split = split.where("_parts > 1").select("bucket", F.col("_top.label").alias("top"), F.col("_top._pick.node").alias("centre"))
        # the largest part of a bucket sends another centre to all members outside it
        met = live.join(split, "bucket").where("label <> top").select(F.col("centre").alias("a"), F.col("node").alias("b"))
        pairs = cut_lineage(_pairs(met).join(read_cuts(tested), ["a", "b"], "left_anti"))
        found = _confirmed(pairs, sets)
        tested.append(pairs)
        if found.isEmpty():
            break
        old, labels = labels, _merged(labels, found)
        release(old, found)
    labels = _joined(rest, labels, sets, tested)
    release(rest, sets, *tested)
    return classes, labels


def _joined(rest: DataFrame, labels: DataFrame, sets: DataFrame, tested: list) -> DataFrame:
    """``labels`` after an exact similarity join between the components that share a bucket.

    ``left`` counts the shingles of a member from one on in the common order, those other components have too.
    At the first shingle that two members share, the smaller ``left`` bounds what they have in common. Members of
    the largest component that a shingle has never meet each other, and a frequent shingle is dealt in parts.
    """
    placed = rest.select("bucket", "node").join(labels, "node")
    split = placed.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("bucket")
    live = cut_lineage(placed.join(split, "bucket").select("node", "label").distinct())
    owned = cut_lineage(sets.join(live, "node").select("node", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")))
    known = owned.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    known = known.where("_low < _high").select("shingle", "n")
    ranked = owned.join(known, "shingle").groupBy("node", "label", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("_order"))
    needed = F.ceil(F.col("size") * F.lit(PERCENT) / 100).cast("int")
    early = F.slice("_order", F.lit(1), F.greatest(F.size("_order") - needed + 1, F.lit(0)))
    early = ranked.select("node", "label", "size", F.size("_order").alias("_n"), F.posexplode(early).alias("_at", "_one"))
    early = cut_lineage(early.select("node", "label", "size", F.col("_one.shingle").alias("shingle"), (F.col("_n") - F.col("_at")).alias("left")))
    parts = early.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("_top"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_parts"))
    several = several.where("_parts > 1").select("shingle", F.col("_top.label").alias("top"), F.ceil(F.col("_n") / PART).cast("int").alias("deal"))
    meeting = cut_lineage(early.join(several, "shingle"))
    every = meeting.select("shingle", F.pmod(F.xxhash64("node"), F.col("deal")).cast("int").alias("part"), F.col("node").alias("b"),
                           F.col("label").alias("_b"), F.col("size").alias("_size"), F.col("left").alias("_left"))
    outer = meeting.where("label <> top").select("shingle", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("part"), F.col("node").alias("a"),
                                                 "label", "size", "left", "top")
    enough = (100 + PERCENT) * F.least("left", "_left") >= PERCENT * (F.col("size") + F.col("_size"))
    met = outer.join(every, ["shingle", "part"]).where((F.col("label") != F.col("_b")) & ((F.col("_b") == F.col("top")) | (F.col("a") < F.col("b"))) & enough)
    pairs = cut_lineage(_pairs(met.select("a", "b")).join(read_cuts(tested), ["a", "b"], "left_anti"))
    found = _confirmed(pairs, sets)
    tested.append(pairs)
    if not found.isEmpty():
        old, labels = labels, _merged(labels, found)
        release(old)
    release(live, owned, early, meeting, found)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    ``kept`` is true where ``doc_id`` is the component's; it is also true for a row that can have no component
    because it has neither words nor an id. ``_text_key`` (a hash of the text) tells rows of one id apart.
    """
    return _marked(docs).drop("_label")


def _marked(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the component as ``_label``, also where no row of it has an id; null without words."""
    sketched = cut_lineage(sketch(docs))
    classes, labels = linked_classes(docs, sketched)
    whole = classes.select("node", "min_id").join(labels, "node", "left").select("node", "min_id", F.coalesce("label", "node").alias("label"))
    least = whole.groupBy("label").agg(F.min("min_id").alias("component_id"))
    named = cut_lineage(whole.join(least, "label").select("node", "component_id", F.col("label").alias("_label")))
    out = sketched.drop("bands").join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "_text_key", "_label")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: its smallest id and, of several texts with that id or none, one.

    Rows without words have no group and all stay.
    """
    bare = F.col("_label").isNull()
    group = ["_label", F.when(bare, F.col("doc_id")).alias("_i"), F.when(bare, F.col("_text_key")).alias("_k")]
    stays = _marked(docs).where("kept").groupBy(*group).agg(F.min(F.struct("doc_id", "_text_key")).alias("_m"), F.max("n_shingles").alias("_n"))
    names = docs.columns
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_k": F.xxhash64("text")})
    other = stays.select(F.col("_m.doc_id").alias("_i2"), F.col("_m._text_key").alias("_k2"), "_n")
    joined = keyed.join(other, keyed["_id"].eqNullSafe(other["_i2"]) & (keyed["_k"] == other["_k2"]))
    without = joined.where("_n = 0").select(*names)
    return without.unionByName(joined.where("_n > 0").dropDuplicates(["_id", "_k"]).select(*names))
