"""Benchmark passages in documents, found by Wu-Manber search over words.

The windows of all benchmark items (ten consecutive words, or the whole of a shorter item) are the patterns.
A table gives for every block of words how far a search may skip; where it says zero, the hash of the pattern's
last and first block picks the patterns to try, and their words are compared directly. Cursors for stretches
of all texts of a batch advance together.

The benchmark is a stated pattern set: it goes to the executors in blocks of at most ``BLOCK_BYTES``, one
broadcast and one pass over the documents each, however many there are. Documents are never shuffled for a
single block.

Defined results: words are runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond ASCII;
null and empty texts have none and are clean, and an item without words matches nothing. An item whose id is
null marks words as hit but is not listed; an id that occurs on several rows is listed once. Repeated document
rows each give a row. Without benchmark rows every document is clean. Extra columns are not read.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import hashing as H

WINDOW = 10
BLOCK_BYTES = 4 << 20
STRETCH = 64
_SEP = H.non_alnum_table()
_FACTOR = H.seeds(WINDOW, 11)
_SCAN = "doc_id long, _text_key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _combine(hashed, at, n):
    out = np.zeros(len(at), H.U64)
    for k in range(n):
        out += hashed[at + k] * _FACTOR[k]
    return H.mix(out)


def _normal(raw):
    lowered = H.LOWER[np.frombuffer(raw, np.uint8)]
    lowered[_SEP[lowered]] = 32
    return b" ".join(lowered.tobytes().split())


class Patterns:
    """Shift table and buckets for the windows of one length."""

    def __init__(self, length, hashed, at, text, item):
        self.length = length
        self.block = min(length, 2)
        most = length - self.block + 1
        bits = max(12, int(4 * most * max(len(at), 1)).bit_length())
        self.mask = H.U64((1 << min(bits, 22)) - 1)
        self.shift = np.full(int(self.mask) + 1, most, np.uint8)
        for j in range(most):
            cell = (_combine(hashed, at + j, self.block) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, cell, most - 1 - j)
        key = self.key(hashed, at)
        order = np.argsort(key, kind="stable")
        self.keys, self.text, self.item = key[order], [text[i] for i in order], item[order]

    def key(self, hashed, at):
        """Hash of the last and the first block of the windows that start at ``at``."""
        suffix = _combine(hashed, at + self.length - self.block, self.block)
        return H.mix(suffix + _combine(hashed, at, self.block) * _FACTOR[2])

    def search(self, hashed, first):
        """(start word, pattern) candidates in texts whose words begin at ``first``."""
        begin, end = first[:-1] + self.length - 1, first[1:]
        n = np.maximum(-((begin - end) // STRETCH), 0)
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        cursor = begin[text] + nth * STRETCH
        stop = np.minimum(cursor + STRETCH, end[text])
        starts, patterns = [], []
        while len(cursor):
            jump = self.shift[(_combine(hashed, cursor - self.block + 1, self.block) & self.mask).astype(np.int64)]
            here = cursor[jump == 0] - self.length + 1
            if len(here):
                key = self.key(hashed, here)
                low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                many = high - low
                starts.append(np.repeat(here, many))
                patterns.append(np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many))
            cursor = cursor + np.maximum(jump, 1)
            alive = cursor < stop
            cursor, stop = cursor[alive], stop[alive]
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts), np.concatenate(patterns)) if starts else (none, none)


def compile_patterns(rows):
    """``Patterns`` by length from ``(item index, text)`` rows."""
    texts = pa.array([t for _, t in rows], pa.large_string())
    data, offsets = H.column_bytes(texts)
    start, end, first = H.words(data, offsets, _SEP)
    hashed = H.word_hashes(data, start, end)
    at = {}
    for i, (item, _) in enumerate(rows):
        n = int(first[i + 1] - first[i])
        length = min(n, WINDOW)
        for j in range(n - length + 1 if n else 0):
            at.setdefault(length, []).append((int(first[i]) + j, item))
    out = []
    for length, found in sorted(at.items()):
        where = np.array([x for x, _ in found], np.int64)
        text = [_normal(data[start[x] : end[x + length - 1]].tobytes()) for x in where]
        out.append(Patterns(length, hashed, where, text, np.array([i for _, i in found], np.int64)))
    return out


def find(column, patterns):
    """For an Arrow column: words per text, hit spans ``(text, start, end)`` in words, ``(text, item)`` pairs."""
    data, offsets = H.column_bytes(column)
    start, end, first = H.words(data, offsets, _SEP)
    hashed = H.word_hashes(data, start, end)
    cover = np.zeros(len(start) + 1, np.int32)
    pairs, normal = set(), {}
    for p in patterns:
        for w, k in zip(*p.search(hashed, first)):
            raw = data[start[w] : end[w + p.length - 1]].tobytes()
            if raw not in normal:
                normal[raw] = _normal(raw)
            if normal[raw] == p.text[k]:
                cover[w] += 1
                cover[w + p.length] -= 1
                pairs.add((int(np.searchsorted(first, w, "right")) - 1, int(p.item[k])))
    hit = np.zeros(len(start) + 2, bool)
    hit[1:-1] = np.cumsum(cover)[:-1] > 0
    opens, closes = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    return np.diff(first), first, opens, closes, sorted(pairs)


def _scanner(shared):
    def scan(stream):
        names, rows = shared.value
        patterns = compile_patterns(rows)
        for whole in stream:
            for batch in H.batches(whole):
                n, first, opens, closes, pairs = find(batch.column("text"), patterns)
                spans, items = [[] for _ in n], [[] for _ in n]
                for a, b in zip(opens.tolist(), closes.tolist()):
                    while a < b:  # a run may go on from one text into the next
                        t = int(np.searchsorted(first, a, "right")) - 1
                        stop = min(b, int(first[t + 1]))
                        spans[t].append({"start": a - int(first[t]), "end": stop - int(first[t])})
                        a = stop
                for t, i in pairs:
                    if names[i] is not None:
                        items[t].append(names[i])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_text_key"), pa.array(n.astype(np.int64)), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "_text_key", "n_words", "spans", "items"])

    return scan


def pattern_blocks(benchmark: DataFrame):
    """Blocks ``(names, [(index, text)])`` of at most about ``BLOCK_BYTES`` of item text.

    Items are first cut into overlapping pieces, so that one huge item spreads over blocks too.
    """
    piece = 20 * BLOCK_BYTES // 1024  # words; the overlap keeps every window inside a piece
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text", words.alias("w")).where(F.size("w") > 0)
    long = items.where(F.size("w") > piece).select("name", F.col("w"), F.explode(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1), F.lit(piece))).alias("at"))
    cut = long.select("name", F.array_join(F.slice("w", F.col("at"), piece + WINDOW - 1), " ").alias("text"))
    rows = items.where(F.size("w") <= piece).select("name", "text").unionByName(cut).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64).alias("s")).first()["s"] or 0
    count = -(-2 * total // BLOCK_BYTES) if total > BLOCK_BYTES else 1
    for k in range(count):
        block = rows if count == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k)
        got = block.collect()
        names = sorted({r["name"] for r in got}, key=lambda x: (x is not None, x or ""))
        index = {x: i for i, x in enumerate(names)}
        yield names, [(index[r["name"]], r["text"]) for r in got]


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, _text_key, n_words, spans, items`` for every row of ``docs (doc_id, text)``.

    ``spans`` are the hit word ranges, ``items`` the ids of the benchmark items that occur.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_key"), "text")
    scans = [rows.mapInArrow(_scanner(spark.sparkContext.broadcast(block)), _SCAN) for block in pattern_blocks(benchmark)]
    if len(scans) == 1:
        return scans[0]
    merged = reduce(DataFrame.unionByName, scans).groupBy("doc_id", "_text_key").agg(
        (F.count(F.lit(1)) / len(scans)).cast("int").alias("_rows"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return merged.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_rows")))).drop("_", "_rows")


def hit_words(spans):
    """Words covered by spans that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"),
        F.greatest(a["reach"], s["end"]).alias("reach"))
    return F.aggregate(F.sort_array(spans), start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``find_overlaps`` with ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    found = find_overlaps(docs, benchmark)
    named = F.array_join(F.array_sort("items"), ",")
    return found.withColumns({
        "n_hit": hit_words(F.col("spans")), "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(named, 256),
    }).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without rows that hold a benchmark window; one pass without a shuffle for each block of patterns."""
    spark = docs.sparkSession
    for block in pattern_blocks(benchmark):
        docs = docs.mapInArrow(_filter(spark.sparkContext.broadcast(block)), docs.schema)
    return docs


def _filter(shared):
    def clean(stream):
        patterns = compile_patterns(shared.value[1])
        for whole in stream:
            for batch in H.batches(whole):
                _, first, opens, closes, _ = find(batch.column("text"), patterns)
                yield batch.filter(pa.array(~hit_texts(first, opens, closes)))

    return clean


def hit_texts(first, opens, closes):
    """True for every text that a run of hit words reaches into."""
    n = len(first) - 1
    low = np.searchsorted(first, opens, "right") - 1
    high = np.searchsorted(first, closes - 1, "right") - 1
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high + 1, -1)
    return np.cumsum(change)[:n] > 0
