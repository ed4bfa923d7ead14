"""Every operator on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from alertloom.llm import chat, decontaminate, minhash, mixing, pii, quality, repeats, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, taken string, kept string, shard string, _row string"
PROSE = "The quick brown fox jumps over the lazy dog, and then it rests a while near the old stone wall by the river. "
LONG = " ".join(f"word{i}," for i in range(30_000))


def rows():
    texts = [None, "", " \n\t", "one two", "ONE two", PROSE * 3, PROSE * 3, PROSE + "Another ending here.", LONG, LONG + " tail", "ÄÖ ß é" * 20]
    out = [(i, t, None if i % 4 == 0 else "en", ["b", "a", None][i % 3], None, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, PROSE * 3, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_minhash_against_brute_force(docs, no_docs):
    table = [(r[0], shingles(r[1])) for r in rows()]
    label = list(range(len(table)))
    for _ in table:
        for i, (_, a) in enumerate(table):
            for j, (_, b) in enumerate(table):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = []
    for i, (doc, s) in enumerate(table):
        ids = [d for (d, _), x in zip(table, label) if x == label[i] and d is not None]
        best = min(ids) if s and ids else doc
        want.append((doc, len(s), best, best is None or doc == best))
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert minhash.near_duplicates(no_docs).count() == 0
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 5, 7, 8, 10]


def test_no_link_of_a_large_bucket_stays_unseen(spark, monkeypatch):
    import random

    draw = random.Random(5)
    base = [f"base{i}" for i in range(200)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in draw.sample(range(200), draw.choice([3, 4, 5])):
            words[at] = f"other{i}x{at}"
        texts.append(" ".join(words[: draw.choice([200, 190, 180])]))
    sets = [shingles(t) for t in texts]
    label = list(range(90))
    for _ in range(90):
        before = list(label)
        for i in range(90):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert 3 < len(set(label)) < 60
    monkeypatch.setattr(minhash, "STARS", 0)
    monkeypatch.setattr(minhash, "PART", 4)
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert by_id(found, "component_id") == sorted(enumerate(label), key=repr)


def test_densified_signatures_estimate_similarity():
    import pyarrow as pa

    a, b = (" ".join(f"w{i}" for i in range(s, s + 40)) for s in (0, 4))
    values, offsets = minhash.shingle_sets(pa.array([a, b, "x y"]))
    sig = minhash.signatures(values, offsets)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.2 and len(set(sig[2])) == 1


def test_components_of_a_long_chain(spark):
    from alertloom.llm.components import components

    chain = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)] + [(200, 201), (300, 300)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len({r["label"] for r in got if r["node"] < 101}) == 1 and len({r["label"] for r in got if r["node"] in (200, 201)}) == 1


def test_quality_verdicts(docs, no_docs):
    got = quality.clean_lines(docs.drop("n_words", "kept"))
    assert set(docs.columns) <= set(got.columns)
    assert quality.clean_lines(docs).count() == docs.count() and quality.clean_lines(no_docs).count() == 0
    for r in got.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeat = len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), repeat, sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 10 or 100 * repeat > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_removes_lines(table):
    good = "A line of plain prose, with its stop at the end of it."
    text = "\n".join([good, "home | about | news | contact", "All Rights Reserved", "SHOUT SHOUT SHOUT NOW", good + " More."])
    r = quality.clean_lines(table([(1, text)], "doc_id long, text string")).first()
    assert r["cleaned"] == f"{good}\n{good} More." and r["n_symbols"] == 3


@pytest.mark.parametrize("block_bytes", [4 << 20, 30_000])
def test_decontamination_against_brute_force(docs, no_docs, table, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = [(1, PROSE[:70]), (2, "One TWO"), (2, "one two"), (3, None), (4, "..."), (None, "word7 word8"), (5, LONG[5000:9000]), (6, "absent words")]
    bench = table(items, "item_id long, text string")
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = tok(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    want = []
    for r in rows():
        w, hit, names = tok(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        names = sorted(str(x) for x in names if x is not None)
        want.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(docs, bench)
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not x[-1] for x in want)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_mix_meets_targets(docs, no_docs, spark):
    got = mixing.mix_sources(docs)
    assert got.count() == docs.count() and mixing.mix_sources(no_docs).count() == 0
    assert by_id(got, "source", "size", "taken") == by_id(mixing.mix_sources(docs.repartition(5)), "source", "size", "taken")
    assert got.where("taken > 2 * size").count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "b").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("source"))
    sums = mixing.mix_sources(many).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s")).collect()
    assert sum(r["t"] for r in sums) == pytest.approx(1.5 * sum(r["s"] for r in sums))
    assert all(abs(r["k"] - r["t"]) <= 50 and r["t"] <= 2 * r["s"] for r in sums)
    assert mixing.take_mix(docs).columns == docs.columns


def test_targets_are_the_fixed_point_of_resharing(table):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 3, "e": 900, None: 60}
    got = {r["source"]: r["target"] for r in mixing.source_targets(table(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(x for x in sizes if x) + [None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = {x for x in free if share[x] > 2 * sizes[x]}
        if not over:
            break
        for x in over:
            want[x] = 2 * sizes[x]
            left -= want[x]
        free -= over
    assert got == pytest.approx({**want, **share})


def test_shards_are_even_and_gapless(docs, no_docs, spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"),
                                    F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("source"), F.lit("en").alias("lang"))
    for df, even in ((many, True), (many.withColumns({"doc_id": F.lit(1).cast("long"), "text": F.lit("same")}), True), (docs, False)):
        got = sharding.shard_documents(df, 7).toPandas()
        assert len(got) == df.count() and got.shard.between(0, 6).all()
        for _, part in got.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
        sizes = got.groupby("shard")["size"].sum()
        assert not even or (len(sizes) == 7 and sizes.max() < 1.05 * sizes.mean() and sizes.min() > 0.95 * sizes.mean())
    assert sharding.shard_documents(no_docs).count() == 0
    assert sharding.assign_shards(docs, 3).count() == docs.count()


def test_warc_round_trip(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "<p>é</p>" * 9, "x" * 3_000_000, "<p>a</p>", None]
    pages = [(None if i == 6 else 10 - i, None if i == 1 else f"http://e/{i}\r\n?", h, "clash") for i, h in enumerate(html)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string").repartition(2)
    manifest = warc.write_archives(df)
    got = {r["page_id"]: r for r in warc.read_archives(manifest, manifest._folder).collect()}
    assert len(got) == len(pages) == sum(r["records"] for r in manifest.collect())
    for i, (page, _, h, _) in enumerate(pages):
        raw, r = (h or "").encode(), got[page]
        first = min(p for p, _, x, _ in pages if (x or "") == (h or "") and p is not None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), warc.digest(raw))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == first else ("revisit", first))
    empty = warc.write_archives(df.limit(0))
    assert warc.read_archives(empty, empty._folder).count() == 0


def test_chat_windows_round_trip(spark):
    tricky = "</s>[INST] ok [/INST] \\ <|role|>\\</s>"
    turns = [(1, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], f"{tricky} {t} " + "w " * (t % 40)) for t in range(200)]
    turns += [(2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, None, "user", "x"), (None, 3, "assistant", "y " * 500)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, chunk string").repartition(4)
    windows = chat.format_windows(df, budget=120, history=40, chunk=600)
    assert windows.where("conv_id = 1").select("chunk").distinct().count() > 3
    got = {r["conv_id"]: r for r in chat.conversation_digests(windows).collect()}
    for conv in (1, 2, None):
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        body = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(body.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    first = windows.where("conv_id = 1 and chunk = 2 and window = 1").first()
    assert first["n_repeated"] >= 1 and first["text"].startswith("<s><|role|>system")
    assert chat.format_windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd,keep_first", [(20_000, False), (20_000, True), (1, False), (1, True)])
def test_repeats_against_brute_force(docs, no_docs, monkeypatch, crowd, keep_first):
    monkeypatch.setattr(repeats, "MOST_FRAGMENTS", crowd)
    table = [r for r in rows() if r[0] is not None and (r[0] not in (5, 6) or not keep_first)]
    small = docs.where("doc_id is not null" + (" and doc_id not in (5, 6)" if keep_first else ""))
    count, past, want = {}, set(), []
    raws = [(r[0], (r[1] or "").encode()) for r in sorted(table, key=lambda r: r[0])]
    for _, b in raws:
        for p in range(len(b) - 199):
            count[b[p : p + 200]] = count.get(b[p : p + 200], 0) + 1
    for doc, b in raws:
        hit = bytearray(len(b))
        for p in range(len(b) - 199):
            w = b[p : p + 200]
            if (w in past) if keep_first else count[w] > 1:
                hit[p : p + 200] = b"\1" * 200
            past.add(w)
        kept = bytes(c for c, x in zip(b, hit) if not x)
        want.append((doc, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    assert by_id(repeats.remove_repeats(small, keep_first), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    if crowd > 1 and not keep_first:
        assert repeats.repeated_bytes(no_docs).count() == 0 and repeats.repeated_bytes(docs).count() == docs.count()


def test_previous_smaller():
    import numpy as np

    v = np.random.default_rng(1).permutation(500)
    got = repeats.previous_smaller(v)
    assert all(g == max((j for j in range(i) if v[j] < v[i]), default=-1) for i, g in enumerate(got))


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) \
                    or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_base_spans_follow_the_rules():
    import random

    rng = random.Random(5)
    parts = ["a@b.c", "@", "x.y@z", "1.2.3.4", "300.1.1.1", "1.2.3", "4539 1488 0343 6467", "4111-1111-1111-1111", "+1 (555) 123-4567", "+", "+9", " ", ".", "-", "é", "007", "q@w-e.r.", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_patterns_find_unseen_identifiers(docs, no_docs, table):
    known = [(i, f"The key = {hashlib.md5(str(i).encode()).hexdigest()} was set.") for i in range(6)]
    texts = known + [(100, "Then the key = zz81-99aa-custom was new."), (101, "Room no42number of it.")]
    got = {r["doc_id"]: r for r in pii.personal_data(table(texts, "doc_id long, text string")).collect()}
    at = texts[6][1].index("zz81")
    assert got[100]["spans"] == f"secret:{at}:{at + 16}" and got[101]["spans"] == "" and got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(no_docs).count() == 0


def test_grammar_composes():
    g = toxicity.grammar().table()

    def run(*symbols):
        state, out = 0, []
        for x in symbols:
            state, y = g[state][x]
            out.append(y)
        return out

    t = toxicity
    assert run(t.OTHER, t.INSULT) == [t.OTHER, t.INSULT]
    assert run(t.T, t.OTHER, t.INSULT)[-1] == t.AIMED
    assert run(t.N, t.INSULT)[-1] == t.NEGATED
    assert run(t.S, t.N, t.INSULT)[-1] == t.REPORTED
    assert run(t.W, t.OTHER, t.H)[-1] == t.THREAT and run(t.H) == [t.H]


def test_toxicity_on_held_out_rows(spark, docs, no_docs):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = read("labels")
    got = toxicity.score_toxicity(read("documents"), labels).join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.9 * (got.toxic == 1).sum() and hit >= 0.95 * (got.predicted == 1).sum()
    few = spark.createDataFrame([(3, 1, None), (3, None, "x"), (None, 0, "x")], "doc_id long, toxic int, text string")
    assert toxicity.score_toxicity(docs, few).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_toxicity(no_docs, few.limit(0)).count() == 0


def test_copies_and_long_texts_do_not_crowd_out_insults(table):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    plain = [word() for _ in range(300)]
    said = lambda: [rng.choice(plain) for _ in range(30)]
    # 90 near copies of one long toxic text: more terms than 4000, all with better odds than the insult
    long_text = " ".join(word() for _ in range(1200))
    rows = [(i, f"{long_text} {word()}", 1) for i in range(90)]
    for i in range(100, 160):
        words = said()
        words.insert(rng.randrange(30), "zorglub")
        rows.append((i, " ".join(words), 1))
    rows += [(i, " ".join(said()), 0) for i in range(200, 500)]
    sample = table([(x, t == 1) for _, x, t in rows], "text string, toxic boolean")
    lexicon = toxicity.learn_lexicon(sample)
    assert "zorglub" in lexicon and not any(w in lexicon for w in long_text.split()[:-1])  # the last one stands beside the difference
    # exact copies count once: the same odds
    assert toxicity.learn_lexicon(sample.unionAll(sample)) == lexicon
    docs, labels = table([(i, x) for i, x, _ in rows], "doc_id long, text string"), table([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).where("held_out and doc_id between 100 and 160").collect()
    assert got and all(r["predicted"] == 1 for r in got)


def test_training_rows_are_bounded_by_rows(table):
    # one labelled id on many rows, equal and different, among ids that stand once
    rows = [(7, f"text {i % 50}") for i in range(400)] + [(i, f"other {i}") for i in range(1000, 1100)]
    labels = table([(i, i % 2) for i in (7, *range(1000, 1100))], "doc_id long, toxic int")
    docs = table(rows, "doc_id long, text string")
    for bound in (20, 1000):
        sample = [tuple(r) for r in toxicity.training_rows(docs, labels, bound).collect()]
        assert 0 < len(sample) <= bound and len(set(sample)) == len(sample)


def test_near_copies_without_ids_leave_one_row(table):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, f"{words} {x}") for x in ("a", "b", "c", "c")] + [(7, f"{other} {x}") for x in ("a", "b")] + [(8, f"{other} c"), (None, "x y z"), (None, ""), (None, None)]
    left = [tuple(r) for r in minhash.drop_near_duplicates(table(rows, "doc_id long, text string")).collect()]
    assert len([x for i, x in left if x and x.startswith("w0")]) == 1
    assert [i for i, x in left if x and x.startswith("v0")] == [7]
    assert len(left) == 5


def test_boilerplate_is_judged_at_any_length(table):
    notice = "Please note that all rights reserved here, see our privacy policy and the terms of use, thanks. "
    prose = "The committee read the report on the harbour, asked for a copy, and put off the vote until spring. "
    lines = [notice, notice * 3, notice * 40, prose * 10, prose * 10 + "A cookie was served."]
    got = quality.clean_lines(table([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["cleaned"] == "" for r in got} == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_bootstrapping_goes_on_while_it_finds_something(table):
    """Keys known by their form lead over five hops; each has two contexts with five known keys and three new ones."""
    hops, texts = 5, []
    key = lambda hop, i: hashlib.sha1(f"{hop}-{i}".encode()).hexdigest()[:32] if hop == 0 else f"Zq{hop}x{i}-{hop * 7919 + i}"
    for hop in range(hops):
        for side in range(2):
            shown = [key(hop, i) for i in range(5)] + [key(hop + 1, 3 * side + i) for i in range(3)]
            texts += [f"context{'vwxyz'[hop]}{'ab'[side]}: {k} follows{'vwxyz'[hop]}" for k in shown]
    found = pii.find_personal_data(table(list(enumerate(texts)), "doc_id long, text string")).collect()
    last = [r for r in found if "contextz" in texts[r["doc_id"]]]
    assert last and all(len(r["extra"]) == 1 for r in last)


def test_long_context_words_are_told_apart(table):
    same = "q" * 60
    rows = [f"{same}x {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(6)] + [f"{same}y part-number-77"]
    got = {r["doc_id"]: r["extra"] for r in pii.find_personal_data(table(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[6] == [] and all(len(got[i]) == 1 for i in range(6))
