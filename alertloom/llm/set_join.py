"""Exact Jaccard join of word n-gram sets that skips by relations between sets.

Texts with equal sets form a class, and only classes go on. A link needs ``PERCENT`` of the shingles of either set in
the other, so a set with more than the rest of them in no other class links with nothing: a fixed quarter of all
shingles (by hash) shows that for most sets, all shingles of the remaining ones for the others.

*Index.* The shingles of a set are ordered by how many sets have them, rare ones first, and the index holds those
before which a link must show. The list of a shingle is cut into blocks by set size. An entry knows how many
shingles of its set are left from its position on, so it knows the largest partner it can still link with, and
skips all blocks of the list beyond: deep positions meet only blocks of small sets.

*Answers.* In each block the set with the most common shingles is a pivot, and every set is compared with the one it
meets most, twice; copies gather around what they were made from. A set
linked to a pivot is represented by it, and its misses are its shingles that the pivot lacks. Of the sets of other
components only representatives meet. What two representatives have in common, plus the misses of two of their
sets, bounds what those have in common: where that is too little, all pairs of the two groups are answered at once.
The other groups' sets meet in the blocks of the index, each pair under the bound of its own misses, and are
compared on their full sets. Before any comparison, parities of the shingles in 512 parts bound the difference of two
sets from below; a representative's bits serve its whole group, less the farthest member's difference. Pairs inside a
component are never made. So no link between components stays unseen, while a family of copies costs a comparison per
copy.

Defined results: words are maximal runs of non-blank characters with A-Z lower-cased; a text of fewer than
``SHINGLE`` words, but not none, is one shingle; texts that are null, empty or blank have an empty set and link with
nothing. Rows are linked, not ids: repeated rows and rows sharing an id each count. ``component_id`` is the smallest
id of the component, null ids aside (null if it has none); a row without words keeps its own id. An empty table
gives an empty result. Extra columns are not read. Shingles are compared by a 64-bit hash of their words.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertloom.llm import hashing as H
from alertloom.llm.components import components
from alertloom.session import cut_lineage, read_cuts, release

SHINGLE, PERCENT, SAMPLE, STARS, PART, WORDS = 4, 85, 4, 2, 1024, 8
FILTER_BITS = 1 << 24
_SPACE = H.space_table()
_MULTIPLY = H.seeds(SHINGLE, 12)
_LENGTH = H.seeds(SHINGLE + 1, 16)
_SET = H.seeds(1, 15)


def shingle_sets(column):
    """Distinct shingle hashes of each text of an Arrow column: (values, offsets)."""
    data, offsets = H.column_bytes(column)
    start, end, first = H.words(data, offsets, _SPACE)
    hashed = H.word_hashes(data, start, end)
    rolled = np.full(max(len(hashed) - SHINGLE + 1, 0), _LENGTH[SHINGLE])
    for k in range(SHINGLE):
        rolled += hashed[k : len(rolled) + k] * _MULTIPLY[k]
    rolled = H.mix(rolled)
    sets = []
    for at, to in zip(first[:-1], first[1:]):
        n = to - at
        if n >= SHINGLE:
            sets.append(np.unique(rolled[at : to - SHINGLE + 1]))
        elif n:
            sets.append(H.mix((hashed[at:to] * _MULTIPLY[:n]).sum(dtype=H.U64, keepdims=True) + _LENGTH[n]))
        else:
            sets.append(np.zeros(0, H.U64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, H.U64)), np.concatenate([[0], np.cumsum(sizes)])


def _list_array(values, offsets):
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _nodes(values, offsets):
    """Identity of each of some non-empty sets: a hash of its shingles and their number."""
    total = np.add.reduceat(H.mix(values * _SET[0]), offsets[:-1])
    return H.mix(total + np.diff(offsets).astype(H.U64)).view(np.int64)


def _sketch(stream):
    for whole in stream:
        for batch in H.batches(whole):
            values, offsets = shingle_sets(batch.column("text"))
            size = np.diff(offsets)
            some = np.flatnonzero(size)
            node = np.zeros(len(size), np.int64)
            if len(some):
                node[some] = _nodes(values, np.concatenate([[0], np.cumsum(size[some])]))
            part = values % H.U64(SAMPLE) == 0
            kept = np.concatenate([[0], np.cumsum(part)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text_key"), pa.array(size), pa.array(node, mask=size == 0), _list_array(values[part], kept)],
                ["doc_id", "_text_key", "n_shingles", "node", "sample"])


def _parities(values, offsets):
    """``WORDS`` * 64 bits per non-empty set: which of as many parts of all shingles hold an odd number of its own.

    A shingle that two sets do not share changes one bit, so the bits in which they differ are at most the shingles
    in which they differ.
    """
    part = (values >> H.U64(40)) % H.U64(64 * WORDS)
    bit = H.U64(1) << (part % H.U64(64))
    words = [np.bitwise_xor.reduceat(np.where(part // H.U64(64) == w, bit, H.U64(0)), offsets[:-1]) for w in range(WORDS)]
    flat = np.stack(words, axis=1).ravel()
    return _list_array(flat, np.arange(0, len(flat) + 1, WORDS))


def _places(a, b):
    """Bits of rows in a filter, from two columns of numbers."""
    a, b = (pc.fill_null(x, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(H.U64) for x in (a, b))
    return (H.mix(a * _SET[0] + b) % H.U64(FILTER_BITS)).astype(np.int64)


def _bitmap(rows: DataFrame, a: str, b: str):
    """A broadcast filter of ``FILTER_BITS`` bits, however many rows there are: true where a row's bit is set."""
    def mark(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(a), batch.column(b)))], ["place"])

    marks = rows.select(*dict.fromkeys([a, b])).mapInArrow(mark, "place long")
    marks = marks.groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in marks.collect():  # at most FILTER_BITS / 64 rows
        words[r.word] = r.bits
    return rows.sparkSession.sparkContext.broadcast(np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool))


def _passing(wanted, a, b):
    def read(stream):
        for batch in stream:
            yield batch.filter(pa.array(wanted.value[_places(batch.column(a), batch.column(b))]))
    return read


def _full(wanted):
    """``node, size, bits, shingles`` of the rows that pass a filter."""
    def read(stream):
        for whole in _passing(wanted, "doc_id", "_text_key")(stream):
            for batch in H.batches(whole):
                values, offsets = shingle_sets(batch.column("text"))
                sizes = np.diff(offsets)[np.diff(offsets) > 0]  # an empty text may pass by chance
                if len(sizes):
                    kept = np.concatenate([[0], np.cumsum(sizes)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_nodes(values, kept)), pa.array(sizes.astype(np.int32)), _parities(values, kept), _list_array(values, kept)],
                        ["node", "size", "bits", "shingles"])
    return read


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_key"), "text")


def _linkable(size, unshared) -> Column:
    return 100 * (F.col(size) - F.col(unshared)) >= PERCENT * F.col(size)


def _enough(common: Column, size: Column, other: Column) -> Column:
    """Whether ``common`` shingles make two sets of these sizes similar."""
    return (100 + PERCENT) * common >= PERCENT * (size + other)


def _near(a: Column, b: Column, size: Column, other: Column, slack=0) -> Column:
    """Whether the bits ``a`` and ``b`` allow two sets of these sizes to be similar, each up to ``slack`` in all from them."""
    differ = sum([F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)], F.lit(0)) - slack
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (size + other)


def _open_classes(sketched: DataFrame) -> DataFrame:
    """``node, any_id, any_key`` of the classes that the sampled shingles leave open: one text of each, written.

    The sample is counted twice: first over all classes, then over those still open, which share less.
    """
    found = sketched.where("node IS NOT NULL").groupBy("node").agg(
        F.min_by(F.struct("doc_id", "_text_key"), F.col("_text_key")).alias("_any"), F.max("n_shingles").alias("size"))
    open_ = found.select("node", "size", F.col("_any.doc_id").alias("any_id"), F.col("_any._text_key").alias("any_key"))
    samples = sketched.where("node IS NOT NULL")
    for _ in range(2):
        # a shingle is of one class if all its rows name the same one; copies of a text repeat it
        alone = samples.select("node", F.explode("sample").alias("shingle")).groupBy("shingle").agg(
            F.min("node").alias("node"), F.max("node").alias("_high")).where("node = _high")
        alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("_alone"))
        left = open_.join(alone, "node", "left").withColumn("_alone", F.coalesce("_alone", F.lit(0))).where(_linkable("size", "_alone"))
        open_ = cut_lineage(left.drop("_alone"))
        # sets that pass by chance only make a shingle look shared
        samples = sketched.select("node", "sample").where("node IS NOT NULL")
        samples = samples.mapInArrow(_passing(_bitmap(open_, "node", "node"), "node", "node"), samples.schema)
    return open_.drop("size")


def _sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, size, bits, shingles`` of the given classes, a written table.

    A bitmap of the wanted rows, of a fixed size whatever their number, goes to the scan, so that texts nobody asks for
    are neither split nor shuffled; the join decides about the few that pass by chance.
    """
    wanted = _bitmap(classes, "any_id", "any_key")
    found = _texts(docs).mapInArrow(_full(wanted), "node long, size int, bits array<long>, shingles array<long>")
    # join and distinct ask for the same partitioning: the sets are shuffled once
    return found.join(classes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _block(size: Column) -> Column:
    return F.floor(F.ln(size) * 25).cast("int")


def _index(sets: DataFrame) -> DataFrame:
    """``shingle, node, size, weight, left, block, deepest``: the entries of all lists, written.

    ``weight`` is the mean logarithm of how many sets have a shingle of the set: what copies are made from has more than they.

    ``left`` counts the shingles of the set from the entry on that other sets have too. ``deepest`` is the last block
    of smaller or equal sets that the entry may link with; the first is given by its size.
    """
    owned = sets.select("node", F.explode("shingles").alias("shingle"))
    # one shuffle of two numbers a shingle; the sets of a shingle pass through one task, unread beyond their count
    known = owned.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("shingle"))).where("n > 1")
    ranked = known.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("_order"), F.sum(F.ln("n")).alias("_log"))
    ranked = ranked.join(sets.select("node", "size"), "node").withColumn("weight", F.col("_log") / F.col("size"))
    needed = F.ceil(F.col("size") * F.lit(PERCENT) / 100).cast("int")
    early = F.slice("_order", F.lit(1), F.greatest(F.size("_order") - needed + 1, F.lit(0)))
    early = ranked.select("node", "size", "weight", F.size("_order").alias("_n"), F.posexplode(early).alias("_at", "_one"))
    left = F.col("_n") - F.col("_at")
    largest = F.least(F.col("size"), F.floor((100 + PERCENT) * left / PERCENT) - F.col("size"))
    return cut_lineage(early.select(F.col("_one.shingle").alias("shingle"), "node", "size", F.round("weight", 3).alias("weight"), left.alias("left"), _block(F.col("size")).alias("block"),
                                    _block(F.greatest(largest, F.lit(1))).alias("deepest")))


def _probes(entries: DataFrame) -> DataFrame:
    """Entries once per block of smaller or equal sets that they do not skip, as ``block``."""
    low = _block(F.ceil(F.col("size") * F.lit(PERCENT) / 100))
    return entries.withColumn("block", F.explode(F.sequence(F.least(low, F.col("deepest")), F.col("deepest"))))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, linked`` of the pairs ``(a, b)``, on full sets, written."""
    # only the sets that are asked for are shuffled
    named = lambda c: sets.join(pairs.select(F.col(c).alias("node")).distinct(), "node", "left_semi")
    side = lambda c: named(c).select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("common", F.size(F.array_intersect("_a", "_b")))
    return cut_lineage(both.select("a", "b", "common", _enough(F.col("common"), F.size("_a"), F.size("_b")).alias("linked"),
                                   F.size("_a").alias("size_a"), F.size("_b").alias("size_b")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, label)`` after ``links (a, b)`` join components, written."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    step = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    step = step.select(F.col("node").alias("label"), F.col("label").alias("_next"))
    return cut_lineage(labels.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label")))


def _unordered(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())


def _stars(entries: DataFrame, sets: DataFrame) -> list:
    """What the sets have in common with a pivot, as written tables; the second round is among those that the first left alone.

    A set is compared with the pivot that it meets in most blocks.
    """
    made, free = [], entries
    side = lambda c: sets.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("size").alias(f"size_{c}"))
    for _ in range(STARS):
        pivots = free.groupBy("shingle", "block").agg(F.max(F.struct("weight", "node", "size", "left")).alias("p"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        may = (F.col("node") != F.col("p.node")) & _enough(F.least("left", "p.left"), F.col("size"), F.col("p.size"))
        met = free.join(pivots, ["shingle", "block"]).where(may).groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(
            F.count(F.lit(1)).alias("_n"))
        met = met.join(side("a"), "a").join(side("b"), "b").where(_near(F.col("bits_a"), F.col("bits_b"), F.col("size_a"), F.col("size_b")))
        pairs = cut_lineage(met.groupBy("b").agg(F.max_by("a", F.struct("_n", "a")).alias("a")).select("a", "b"))
        made.append(_overlaps(pairs, sets))
        release(pairs)
        done = read_cuts(made).where("linked")
        done = done.select(F.col("a").alias("node")).union(done.select(F.col("b").alias("node"))).distinct()
        free = entries.join(done, "node", "left_anti")
    return made


def _mixed(entries: DataFrame) -> DataFrame:
    """The entries of shingles that sets of several components have."""
    several = entries.groupBy("shingle").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    return entries.join(several.select("shingle"), "shingle", "left_semi")


def _represented(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, rep, miss, far``: the linked pivot of a set, or itself, the set's shingles that it lacks, and all that they differ in."""
    miss = F.col("size_b") - F.col("common")
    best = links.groupBy(F.col("b").alias("node")).agg(
        F.min(F.struct(F.col("a").alias("rep"), miss.alias("miss"), (miss + F.col("size_a") - F.col("common")).alias("far"))).alias("_m"))
    return nodes.join(best, "node", "left").select(
        "node", F.coalesce("_m.rep", "node").alias("rep"), F.coalesce("_m.miss", F.lit(0)).alias("miss"), F.coalesce("_m.far", F.lit(0)).alias("far"))


def _groups(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """``rep, miss, far, least, most, bits``: the bounds of the sets that a representative stands for, written."""
    of = entries.groupBy("rep").agg(F.max("miss").alias("g_miss"), F.max("far").alias("g_far"), F.min("size").alias("g_least"), F.max("size").alias("g_most"))
    return cut_lineage(of.join(sets.select(F.col("node").alias("rep"), F.col("bits").alias("g_bits")), "rep"))


def _met_representatives(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of representatives of different components that meet in a block their sets do not skip."""
    facts = [F.max("left").alias("left"), F.min("size").alias("size"), F.min("label").alias("label")]
    index = entries.groupBy("shingle", "block", "rep").agg(*facts)
    lists = index.groupBy("shingle", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    lists = lists.select("shingle", "block", F.ceil(F.col("_n") / PART).cast("int").alias("deal"), "_low", "_high")
    asks = _probes(entries).groupBy("shingle", "block", "rep").agg(*facts).join(lists, ["shingle", "block"])
    # a list of one component has nothing for that component; a long list is dealt in parts
    asks = asks.where("NOT (label = _low AND label = _high)").join(groups, "rep").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    asks = asks.select("shingle", "block", "part", F.col("rep").alias("a"), *[F.col(c).alias(f"_{c}") for c in ("label", "left", "size", "g_bits", "g_far", "g_most")])
    dealt = index.join(lists, ["shingle", "block"]).join(groups, "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("deal")).cast("int"))
    met = asks.join(dealt.select("shingle", "block", "part", F.col("rep").alias("b"), "label", "left", "size", "g_bits", "g_far", "g_most"), ["shingle", "block", "part"])
    near = _near(F.col("g_bits"), F.col("_g_bits"), F.col("g_most"), F.col("_g_most"), F.col("g_far") + F.col("_g_far"))
    return _unordered(met.where((F.col("_label") != F.col("label")) & _enough(F.least("left", "_left"), F.col("size"), F.col("_size")) & near))


def _met_sets(entries: DataFrame, groups: DataFrame, answers: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets that the answers of their representatives do not settle."""
    label = entries.groupBy("rep").agg(F.min("label").alias("label"))
    known = groups.join(label, "rep")
    side = lambda c: known.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("g_miss", "g_least", "label")])
    open_ = answers.where("NOT linked").select("a", "b", "common").join(side("a"), "a").join(side("b"), "b").where("label_a <> label_b AND g_miss_a + g_miss_b > 0")
    open_ = open_.where(_enough(F.col("common") + F.col("g_miss_a") + F.col("g_miss_b"), F.col("g_least_a"), F.col("g_least_b")))
    open_ = open_.select(F.col("a").alias("rep"), F.col("b").alias("_to"), "common").union(open_.select("b", "a", "common"))
    to = groups.select(F.col("rep").alias("_to"), *[F.col(c).alias(f"_{c}") for c in ("g_miss", "g_far", "g_least", "g_most", "g_bits")])
    open_ = cut_lineage(open_.join(to, "_to"))
    # a set goes on only against representatives that it is near to itself
    members = entries.select("node", "rep", "size", "miss").distinct().join(sets.select("node", "bits"), "node")
    may = _enough(F.col("common") + F.col("miss") + F.col("_g_miss"), F.col("size"), F.col("_g_least"))
    near = _near(F.col("bits"), F.col("_g_bits"), F.col("size"), F.col("_g_most"), F.col("_g_far"))
    wanted = cut_lineage(members.join(open_, "rep").where(may & near).select("node", "_to", "common", "bits"))
    asks = _probes(entries.drop("rep")).join(wanted, "node").select(
        "shingle", "block", F.col("_to").alias("rep"), "common", F.col("node").alias("a"), *[F.col(c).alias(f"_{c}") for c in ("left", "size", "miss", "bits")])
    held = entries.join(wanted.select(F.col("_to").alias("rep")).distinct(), "rep", "left_semi").join(sets.select("node", "bits"), "node")
    met = asks.join(held.select("shingle", "block", "rep", F.col("node").alias("b"), "left", "size", "miss", "bits"), ["shingle", "block", "rep"])
    most = F.least(F.least("left", "_left"), F.col("common") + F.col("miss") + F.col("_miss"))
    pairs = _unordered(met.where(_enough(most, F.col("size"), F.col("_size")) & _near(F.col("bits"), F.col("_bits"), F.col("size"), F.col("_size"))))
    release(open_, wanted)
    return pairs


def linked_classes(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """``node, label``: a component label for every class that the counts of shingles leave open."""
    sets = cut_lineage(_sets_of(docs, _open_classes(sketched)))
    lists = _index(sets)
    stars = _stars(lists, sets)
    links = read_cuts(stars).where("linked")
    nodes = lists.select("node").distinct()
    labels = _merged(nodes.withColumn("label", F.col("node")), links)
    entries = cut_lineage(_mixed(lists.join(_represented(nodes, links).join(labels, "node"), "node")))
    groups = _groups(entries, sets)
    pairs = _met_representatives(entries, groups)
    answers = _overlaps(pairs, sets)
    after = _merged(labels, answers.where("linked"))
    now = cut_lineage(_mixed(entries.drop("label").join(after, "node")))
    rest = _met_sets(now, groups, answers, sets)
    found = _overlaps(rest, sets)
    out = _merged(after, found.where("linked"))
    release(sets, lists, *stars, labels, groups, entries, pairs, answers, after, now, rest, found)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text)``."""
    sketched = cut_lineage(_texts(docs).mapInArrow(_sketch, "doc_id long, _text_key long, n_shingles long, node long, sample array<long>"))
    labels = linked_classes(docs, sketched)
    classes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("_min"))
    whole = classes.join(labels, "node", "left").select("node", "_min", F.coalesce("label", "node").alias("label"))
    least = whole.groupBy("label").agg(F.min("_min").alias("component_id"))
    named = cut_lineage(whole.join(least, "label").select("node", "component_id"))
    out = sketched.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
