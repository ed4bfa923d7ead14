"""Repeated byte strings across documents, by longest-previous-factor arrays over routed fragments.

Equal strings of 200 bytes must meet without one suffix array of the whole corpus. In every 200-byte window the
32-byte piece with the smallest hash is its anchor, so equal windows have equal anchors at equal offsets, and
neighbouring windows mostly share theirs. Stretches of windows travel under the hash of their anchor:

1. stretches whose anchor occurs once hold no repeated window;
2. stretches equal as a whole (same bytes, same offsets) are repeated, all windows of them;
3. of what is left, one copy of each stretch goes as a fragment to the task of its anchor. There the fragments are
   sorted as suffixes up to 200 bytes by prefix doubling; previous and next smaller positions in suffix order tell
   which windows have an earlier factor of that length, and the same on reversed positions a later one.

Anchors with more than ``MOST_FRAGMENTS`` different stretches skip step 3: their windows are counted one by one
by hash, with map-side combine, so no task holds a group that grows with the corpus.

Defined results: a null text has no bytes; documents are told apart by id and text, repeated rows are documents
of their own with equal texts, and null ids work like others. Texts shorter than 200 bytes lose nothing. Equality
of stretches is decided by 64-bit hashes of anchor and stretch together. Extra columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import hashing as H
from alertloom.session import cut_lineage, release

LENGTH, PIECE = 200, 32
SPAN = LENGTH - PIECE + 1
MOST_FRAGMENTS = 20_000
TASK_BYTES = 4 << 20
_LOW = H.U64((1 << 21) - 1)


def stretches(column):
    """Windows of an Arrow column as stretches of equal anchor: (text, start, last start, anchor hash, stretch hash, offset)."""
    data, offsets = H.column_bytes(column)
    out = []
    closed = np.zeros(len(data) + 1, np.int32)  # windows may not reach into the next text
    np.add.at(closed, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(closed, offsets[1:], -1)
    valid = np.cumsum(closed)[: len(data)] == 0
    step = H.SLICE - LENGTH
    for w0 in range(0, max(len(data) - LENGTH + 1, 0), step):
        w1 = min(w0 + step, len(data) - LENGTH + 1)
        sums = H.prefix(data[w0 : w1 + LENGTH - 1])
        n = len(sums) - PIECE
        at = np.arange(n)
        piece = H.range_hash(sums, at, at + PIECE)
        anchor = _window_minimum((piece & ~_LOW) | at.astype(H.U64), w1 - w0)
        edge = (anchor[1:] != anchor[:-1]) | (valid[w0 + 1 : w1] != valid[w0 : w1 - 1])
        start = np.concatenate([[0], np.flatnonzero(edge) + 1])
        last = np.concatenate([start[1:], [w1 - w0]]) - 1
        start, last = start[valid[w0 + start]], last[valid[w0 + start]]
        a = anchor[start]
        text = np.searchsorted(offsets, w0 + start, "right") - 1
        base = w0 - offsets[text]
        out.append((text, start + base, last + base, piece[a].view(np.int64), H.range_hash(sums, start, last + LENGTH).view(np.int64), a - start))
    if not out:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(x) for x in zip(*out)]


def _window_minimum(key, windows):
    """Place of the smallest of every ``SPAN`` keys; a key's low bits are its place, so the leftmost wins ties."""
    padded = np.full(-(-len(key) // SPAN) * SPAN, H.U64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows]) & _LOW).astype(np.int64)


def _anchors(stream):
    for whole in stream:
        for batch in H.batches(whole):
            text, start, last, anchor, stretch, offset = stretches(batch.column("text"))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_text_key").take(take), pa.array(start.astype(np.int32)), pa.array(last.astype(np.int32)),
                 pa.array(anchor), pa.array(stretch), pa.array(offset.astype(np.int32))],
                ["doc_id", "_text_key", "start", "last", "anchor", "stretch", "offset"])


def suffix_classes(data, starts):
    """(order, class) of ``starts`` sorted as suffixes by their first ``LENGTH`` bytes; equal beginnings share a class."""
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    n = len(data) + LENGTH
    key = np.zeros(n, H.U64)
    for k in range(8):
        key = (key << H.U64(8)) | padded[k : n + k]
    rank, have = _ranks(key), 8
    while have * 2 <= LENGTH:
        ahead = np.zeros(n, H.U64)
        ahead[: n - have] = rank[have:]
        rank, have = _ranks((rank << H.U64(32)) | ahead), have * 2
    key = (rank[starts] << H.U64(32)) | rank[starts + LENGTH - have]
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    return order, np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]) if len(order) else np.zeros(0, np.int64)


def _ranks(key):
    order = np.argsort(key)
    sorted_ = key[order]
    out = np.empty(len(key), H.U64)
    out[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]).astype(H.U64)
    return out


def previous_smaller(values):
    """For each place the nearest earlier one with a smaller value, -1 if there is none."""
    at = np.arange(len(values)) - 1
    active = np.flatnonzero(at >= 0)
    while len(active):
        active = active[values[at[active]] >= values[active]]
        at[active] = at[at[active]]  # what a larger neighbour skips is larger too
        active = active[at[active] >= 0]
    return at


def has_previous_factor(position, classes):
    """True where an earlier position has the same first ``LENGTH`` bytes: the longest previous factor is that long."""
    before = previous_smaller(position)
    after = len(position) - 1 - previous_smaller(position[::-1])[::-1]
    found = np.zeros(len(position), bool)
    for other in (before, after):
        inside = (other >= 0) & (other < len(position))
        found[inside] |= classes[other[inside]] == classes[inside]
    return found


def repeated_windows(fragments, first_only):
    """For byte strings in order of their place: per string, the starts of windows that occur elsewhere (or earlier)."""
    data = np.frombuffer(b"".join(fragments), np.uint8)
    sizes = np.array([len(x) for x in fragments], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[owner] + inside
    order, classes = suffix_classes(data, starts)
    position = starts[order]
    found = has_previous_factor(position, classes)
    if not first_only:
        found |= has_previous_factor(-position, classes)
    hit = np.zeros(len(starts), bool)
    hit[order] = found
    return owner[hit], inside[hit]


def _fragments(stream):
    """Bytes of the wanted stretches of each text; the windows of crowded anchors as hashes."""
    for whole in stream:
        for batch in H.batches(whole):
            rows = []
            for doc_id, key, text, wanted in zip(*[batch.column(c) for c in ("doc_id", "_text_key", "text", "wanted")]):
                raw = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    piece = raw[w["start"] : w["last"] + LENGTH]
                    head = (doc_id.as_py(), key.as_py(), w["anchor"], w["n"])
                    if not w["crowded"]:
                        rows.append((*head, w["start"], w["offset"], piece))
                    else:
                        for i in range(w["last"] - w["start"] + 1):
                            rows.append((*head, w["start"] + i, w["offset"] - i, hashlib.blake2b(piece[i : i + LENGTH], digest_size=16).digest()))
            c = list(zip(*rows)) if rows else [[]] * len(_FRAGMENT)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(c, _FRAGMENT)], schema=_FRAGMENT)


_FRAGMENT = pa.schema([("doc_id", pa.int64()), ("_text_key", pa.int64()), ("anchor", pa.int64()), ("n", pa.int64()), ("start", pa.int32()), ("offset", pa.int32()), ("data", pa.binary())])


def _match(first_only):
    def run(stream):
        held, size, last = [], 0, None
        for batch in stream:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "doc_id", "_text_key", "start", "n", "data")]):
                if size >= TASK_BYTES and row[0] != last:
                    yield _spans(held, first_only)
                    held, size = [], 0
                if held and held[-1][:4] == row[:4]:
                    continue  # the same stretch, read from a repeated row
                held.append(row)
                size += len(row[5])
                last = row[0]
        yield _spans(held, first_only)

    return run


def _spans(held, first_only):
    held = sorted(held, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
    owner, inside = repeated_windows([r[5] for r in held], first_only) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    edge = np.flatnonzero((owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)) + 1 if len(owner) else np.zeros(0, np.int64)
    a, b = np.concatenate([[0], edge]).astype(int), np.concatenate([edge, [len(owner)]]).astype(int)
    rows = [(held[owner[i]], int(inside[i]), int(inside[j - 1])) for i, j in zip(a, b) if j > i]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[1] for r, _, _ in rows], pa.int64()), pa.array([r[2] for r, _, _ in rows], pa.int64()),
         pa.array([r[3] + x for r, x, _ in rows], pa.int32()), pa.array([r[3] + y + LENGTH for r, _, y in rows], pa.int32())],
        ["doc_id", "_text_key", "start", "end"])


def _cut_out(stream):
    for whole in stream:
        for batch in H.batches(whole):
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw = (text.as_py() or "").encode()
                merged, kept, at = [], [], 0
                for s in sorted((x["start"], x["end"]) for x in spans.as_py() or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in merged], kept))
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(list(c[i]), pa.int64()) for i in range(3)], pa.array(list(c[3])),
                 pa.array(list(c[4]), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(list(c[5]), pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])


def find_repeats(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """``doc_id, _text_key, start, end``: byte ranges that strings of 200 bytes found elsewhere cover, unmerged.

    With ``keep_first`` only strings that occur earlier count, by id, text key and position; else all copies do.
    """
    rows = _keyed(docs)
    anchors = cut_lineage(rows.mapInArrow(_anchors, "doc_id long, _text_key long, start int, last int, anchor long, stretch long, offset int"))
    again = anchors.groupBy("anchor").count().where("count > 1").select("anchor")
    shared = cut_lineage(anchors.join(again, "anchor"))
    release(anchors)
    same = ["anchor", "stretch", "offset", "start_to_last"]
    shared = shared.withColumn("start_to_last", F.col("last") - F.col("start"))
    place = F.struct("doc_id", "_text_key", "start")
    kinds = cut_lineage(shared.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest"))
    open_ = groups.where(F.col("kinds") > 1) if keep_first else groups.where((F.col("kinds") > 1) & (F.col("fewest") == 1))
    wanted = kinds.join(open_.select("anchor", (F.col("kinds") > MOST_FRAGMENTS).alias("crowded")), "anchor")
    by_text = wanted.groupBy("first.doc_id", "first._text_key").agg(F.collect_list(F.struct(
        F.col("first.start").alias("start"), (F.col("first.start") + F.col("start_to_last")).alias("last"), "anchor", "offset", "n", "crowded")).alias("wanted"))
    fragments = _with_text(rows, by_text, "inner").mapInArrow(
        _fragments, "doc_id long, _text_key long, anchor long, n long, start int, offset int, data binary")
    fragments = cut_lineage(fragments)
    whole = fragments.where(F.octet_length("data") >= LENGTH).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "_text_key", "start")
    matched = whole.mapInArrow(_match(keep_first), "doc_id long, _text_key long, start int, end int")
    single = fragments.where(F.octet_length("data") < LENGTH).distinct()
    counted = single.groupBy("anchor", "offset", "data").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "_text_key", "start")).alias("first")).where("times > 1")
    crowded = single.join(counted, ["anchor", "offset", "data"])
    if keep_first:
        crowded = crowded.where(F.struct("doc_id", "_text_key", "start") != F.col("first"))
    crowded = crowded.select("doc_id", "_text_key", "start", (F.col("start") + LENGTH).alias("end"))
    equal = shared.join(kinds.where("n > 1"), same)
    if keep_first:
        equal = equal.where(place != F.col("first"))
    equal = equal.select("doc_id", "_text_key", "start", (F.col("last") + LENGTH).alias("end"))
    return equal.unionByName(matched).unionByName(crowded)


def _keyed(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_key"), "text")


def _with_text(rows, other, how):
    right = other.withColumnsRenamed({"doc_id": "_i", "_text_key": "_k"})
    return rows.join(right, rows["doc_id"].eqNullSafe(right["_i"]) & (rows["_text_key"] == right["_k"]), how).drop("_i", "_k")


def remove_repeats(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept`` for every row of ``docs (doc_id, text)``.

    ``removed`` are the merged byte ranges, ``kept`` the bytes that stay.
    """
    found = find_repeats(docs, keep_first)
    spans = found.groupBy("doc_id", "_text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return _with_text(_keyed(docs), spans, "left").mapInArrow(
        _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>, kept binary")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` of all copies, without the bytes themselves."""
    return remove_repeats(docs).drop("removed", "kept")
