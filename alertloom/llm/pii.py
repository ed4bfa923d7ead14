"""Personal data by fixed formats and by contextual patterns that are bootstrapped from them.

One scan finds the spans of the fixed formats and every identifier-like token with the lexical patterns it
stands in (the word or two words before it, the words around it, the beginning of its own token). Spark then
scores the graph of patterns and instances in rounds: known instances give a pattern its confidence, patterns
over a threshold give their other instances a score, and good instances are known in the next round, until a round
finds none. Spans of
instances under a promoted pattern join the fixed ones, which always stay.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans. Rows are told
apart by id and text, so repeated rows get equal results and null ids work like others. Where a discovered span
overlaps a fixed one it is dropped. Long tokens and texts are scanned in linear time. Extra columns are not read.
"""

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.session import cut_lineage, release

BASE = ("email", "ip", "card", "phone")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_INSTANCE = 3, 0.6, 0.75
MIN_LENGTH, LONG_WORD = 8, 60
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot start inside a run of digits that it could also start before
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# seeds beside the fixed formats: cloud access key ids, and long hexadecimal strings as keys are written
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}<>\"'"
_VALUE = re.compile(r"[A-Za-z0-9_+/.-]+=*")
_DIGIT = re.compile(r"[0-9]")


def emails(text):
    floor = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = at = found.end() if found else at + 1
        if found:
            yield start, at


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    """``(kind, start, end)`` of the fixed formats, by kind as listed and then by start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _word(text):
    word = _DIGIT.sub("0", text.lower())
    return word if len(word) <= LONG_WORD else "#" + hashlib.sha1(word.encode()).hexdigest()


def occurrences(text, spans):
    """``(start, end, kind or None, instance, patterns)`` of fixed-format spans and identifier-like tokens."""
    if not _DIGIT.search(text) and not spans:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    taken = sorted((s, e) for _, s, e in spans)
    found = [(s, e, k) for k, s, e in spans]
    for s, e in tokens:
        if e - s < MIN_LENGTH:
            continue
        raw = text[s:e]
        if not _DIGIT.search(raw):
            continue
        cut = max(raw.rfind("=", 0, len(raw) - 1), raw.rfind(":", 0, len(raw) - 1)) + 1
        body = raw[cut:]
        left = len(body) - len(body.lstrip(_EDGE))
        value = body.strip(_EDGE)
        begin = s + cut + left
        if len(value) < MIN_LENGTH or not _DIGIT.search(value) or not _VALUE.fullmatch(value):
            continue
        i = bisect.bisect_left(taken, (begin + len(value), 0)) - 1
        if i >= 0 and taken[i][1] > begin:
            continue
        found.append((begin, begin + len(value), "secret" if _SECRET.fullmatch(value) else None))
    out = []
    for s, e, kind in found:
        here = bisect.bisect_right(starts, s) - 1
        after = bisect.bisect_left(starts, e)
        one = _word(text[starts[here - 1] : ends[here - 1]]) if here > 0 else "^"
        two = _word(text[starts[here - 2] : ends[here - 2]]) if here > 1 else "^"
        then = _word(text[starts[after] : ends[after]]) if after < len(starts) else "$"
        inside = _word(text[starts[here] : s])
        patterns = [f"1 {one} {inside}", f"2 {two} {one} {inside}", f"3 {one} {inside} _ {then}"] + ([f"0 {inside}"] if inside else [])
        out.append((s, e, kind, text[s:e], patterns))
    return out


_SCAN = pa.schema([
    ("doc_id", pa.int64()), ("_text_key", pa.int64()), ("base", pa.string()), ("counts", pa.list_(pa.int64())),
    ("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])))])


def _scan(stream):
    for batch in stream:
        base, counts, found = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append(written(spans))
            counts.append([sum(k == kind for k, _, _ in spans) for kind in BASE])
            found.append([dict(zip(("start", "end", "kind", "instance", "patterns"), x)) for x in occurrences(text, spans)])
        arrays = [pa.array(x, f.type) for x, f in zip((base, counts, found), list(_SCAN)[2:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text_key"), *arrays], schema=_SCAN)


def bootstrap(edges: DataFrame) -> DataFrame:
    """``pattern, kind, confidence`` of promoted patterns from ``edges (pattern, instance, kind)``; null kinds are unknown.

    Rounds go on until one finds no new instance. What is known stays known, so they end.
    """
    edges = cut_lineage(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    known = cut_lineage(edges.where("seed is not null").groupBy("instance").agg(F.max("seed").alias("kind")))
    while True:
        marked = edges.join(known, "instance", "left")
        counts = marked.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
        total = counts.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("top"))
        confidence = F.col("top.n") / F.col("all")
        promoted = total.where((F.col("top.n") >= MIN_SUPPORT) & (confidence >= MIN_CONFIDENCE))
        good = cut_lineage(promoted.select("pattern", F.col("top.kind").alias("kind"), confidence.alias("confidence")))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))
        open_ = edges.join(known.select("instance"), "instance", "left_anti")
        fresh = open_.join(good, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score")).where(F.col("score") >= MIN_INSTANCE)
        best = cut_lineage(fresh.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("_b")).select("instance", F.col("_b.kind").alias("kind")))
        if best.isEmpty():
            release(edges, known, best)
            return good
        old, known = known, cut_lineage(known.unionByName(best))
        release(old, best, good)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, _text_key, counts, base, extra`` for every row of ``docs (doc_id, text)``.

    ``base`` are the fixed-format spans as written text, ``counts`` their number by kind, ``extra`` the spans
    ``(kind, start, end)`` that bootstrapped patterns add.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_key"), "text")
    kinds = "doc_id long, _text_key long, base string, counts array<long>, found array<struct<start:int,end:int,kind:string,instance:string,patterns:array<string>>>"
    scanned = cut_lineage(rows.mapInArrow(_scan, kinds))
    flat = scanned.where(F.size("found") > 0).select("doc_id", "_text_key", F.explode("found").alias("x")) \
        .select("doc_id", "_text_key", "x.*").select("doc_id", "_text_key", "start", "end", "kind", "instance", F.explode("patterns").alias("pattern"))
    good = bootstrap(flat.select("pattern", F.sha1("instance").alias("instance"), "kind"))
    fixed = F.col("kind").isin(*BASE)
    seen = flat.where(fixed.isNull() | ~fixed).distinct().join(good.withColumnRenamed("kind", "_kind"), "pattern", "left")
    spans = seen.groupBy("doc_id", "_text_key", "start", "end", "kind").agg(F.max(F.struct("confidence", "_kind")).alias("_b")) \
        .select("doc_id", "_text_key", F.coalesce("kind", F.when(F.col("_b.confidence").isNotNull(), F.col("_b._kind"))).alias("kind"), "start", "end").where("kind is not null")
    extra = spans.groupBy("doc_id", "_text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra")) \
        .select(F.col("doc_id").alias("_i"), F.col("_text_key").alias("_k"), "extra")
    joined = scanned.drop("found").join(extra, scanned["doc_id"].eqNullSafe(extra["_i"]) & (scanned["_text_key"] == extra["_k"]), "left").drop("_i", "_k")
    return joined.withColumn("extra", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>")))


def personal_data(docs: DataFrame) -> DataFrame:
    """``find_personal_data`` with counts as columns, ``base_sha256`` and ``spans``, all spans as written text."""
    found = find_personal_data(docs)
    base = F.filter(F.split("base", ","), lambda x: x != "")
    as_struct = lambda x: F.struct(F.array_position(F.array(*[F.lit(k) for k in BASE]), x[0]).alias("nth"), x[0].alias("kind"), x[1].cast("int").alias("start"), x[2].cast("int").alias("end"))
    fixed = F.transform(base, lambda x: as_struct(F.split(x, ":")))
    rank = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in BASE]), k), F.lit(0).cast("long")), F.lit(len(BASE) + 1).cast("long"))
    more = F.transform("extra", lambda x: F.struct(rank(x["kind"]).alias("nth"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    said = F.transform(F.array_sort(F.concat(fixed, more)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    counts = {f"n_{k}": F.col("counts")[i] for i, k in enumerate(BASE)}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2("base", 256).alias("base_sha256"), F.array_join(said, ",").alias("spans"))
