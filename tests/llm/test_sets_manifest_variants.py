"""Spelling variants, Merkle manifest and set-relation join against plain Python, on awkward and skewed rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from alertloom.llm import manifest, queries, set_join, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _g string, _c int, word string"
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(40_000))


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a long text, columns with names used inside."""
    same = "One copied text, with some words in it\nand a second line."
    rows = [(1, same), (1, same), (2, same), (None, same), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, "tiny"), (7, "tiny"),
            (8, "TINY"), (-5, same + " more"), (9, LONG), (10, LONG + " end"), (2, "another text under the id of a copy"), (None, "tiny"), (2**62, "x" * 50_000), (11, "x" * 50_001)]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (4, None) else "a" if i < 6 else "b", None if t is None else len(t), 1, "g", 2, "w")
                                  for i, t in rows], SCHEMA)


def near_copies(spark, seed=2):
    """A large family of copies with a few words changed, two families that share half of their words, loose texts."""
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(3):
        base = [rnd.choice(words) for _ in range(120)]
        for _ in range(60):
            copy = list(base)
            for at in rnd.sample(range(120), rnd.choice([0, 1, 2, 3, 4, 5])):
                copy[at] = rnd.choice(words[:40])
            texts.append(copy)
        half = base[:60] + [rnd.choice(words) for _ in range(60)]
        texts += [half[: rnd.randrange(100, 121)] for _ in range(10)]
    texts += [[rnd.choice(words[:30]) for _ in range(rnd.randrange(1, 12))] for _ in range(150)]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


# set-relation join

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def joined(rows):
    """Sorted (doc_id, n_shingles, component_id) by comparing all pairs of sets."""
    sets = [(r.doc_id, frozenset(shingles(r.text))) for r in rows]
    kinds = sorted({s for _, s in sets if s}, key=lambda s: (len(s), sorted(s)))
    parent = {s: s for s in kinds}

    def top(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if 100 * len(a) >= 85 * len(b) and 100 * len(a & b) >= 85 * len(a | b):
                parent[top(a)] = top(b)
    least = defaultdict(list)
    for i, s in sets:
        if s and i is not None:
            least[top(s)].append(i)
    return Counter((i, len(s), min(least[top(s)], default=None) if s else i) for i, s in sets)


@pytest.mark.parametrize("make", [awkward, near_copies])
def test_join_equals_all_pairs(spark, make):
    docs = make(spark)
    assert Counter(map(tuple, set_join.jaccard_components(docs).collect())) == joined(docs.collect())


def test_join_parts_and_no_stars(spark, monkeypatch):
    """Long lists dealt in many parts, and representatives that stand for themselves only."""
    monkeypatch.setattr(set_join, "PART", 3)
    monkeypatch.setattr(set_join, "STARS", 1)
    docs = near_copies(spark, 5)
    assert Counter(map(tuple, set_join.jaccard_components(docs).collect())) == joined(docs.collect())


def test_join_settles_groups_by_representatives(spark):
    """Two families whose pivots do not link, but some of whose members do: the link is found between the members."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    other = list(base)
    for at in range(0, 200, 34):
        other[at] = f"o{at}"
    texts = []
    for family in (base, other):
        for k in range(8):
            copy = list(family)
            for at in rnd.sample(range(0, 200, 34), 2) if k else []:
                copy[at] = base[at] if family is other else f"o{at}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, set_join.jaccard_components(docs).collect())) == joined(docs.collect())


# Merkle manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def beside(tree, i):
    out = []
    for level in tree[:-1]:
        run = i - i % 3
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
        i //= 3
    return out


def manifest_of(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id, r.source, r.lang, r.n_chars, r.text))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    over = levels([trees[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = beside(trees[s], i) + beside(over, k)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*r[:4], text))
            for a, b in path:
                folded = digest(a, folded, b)
            out[r[0], leaf(r), trees[s][-1][0], over[-1][0], digest(*[a + b for a, b in path]), folded, folded == over[-1][0]] += 1
    return out


def written(docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_manifest_of_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    assert Counter(map(tuple, queries.op12_merkle_manifest(spark, written(docs, tmp_path)).collect())) == manifest_of(docs.collect())


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_of_many_sources(spark, tmp_path, monkeypatch, height):
    """Sources of 1 to 800 leaves, far and negative ids, one id on many rows, arrays of several heights."""
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "SLOTS", 3**height)
    rnd = random.Random(height)
    rows = [(rnd.choice([i, -i, i << 40, 77]), f"t{rnd.randrange(50)}\n", rnd.choice(["big"] * 8 + ["", "é", None, "a", "Z"]), 3) for i in range(1500)]
    rows += [(77, "same", "big", 4)] * 40 + [(i, "only", f"s{i}", 4) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("lang", F.lit("en"))
    assert Counter(map(tuple, queries.op12_merkle_manifest(spark, written(docs, tmp_path)).collect())) == manifest_of(docs.collect())


# spelling variants

def variants_of(rows):
    counts = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: {x for x in words if one_edit(w, x)} for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, words[w], len(near[w]), form.get(w), words.get(form.get(w)), root))
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at:] == b[at + 1:]


def typed(spark):
    """Words over three letters, so that most have many near words; a third of them begin alike; runs of one letter."""
    rnd = random.Random(4)
    words = ["aaa" * (i % 3) + "".join(rnd.choice("abé") for _ in range(rnd.randrange(4, 9))) for i in range(700)]
    words += ["a" * k for k in range(5, 14)] * 3 + ["frequent"] * 400 + ["frequentt"] * 30 + ["frequenttt"] * 3 + ["Fréquent×÷", "fréquent×÷"]
    return spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(150)] + [(None, "frequent 1frequent2 x")] * 2,
                                 "doc_id long, text string")


@pytest.mark.parametrize("most", [3, 25, 20_000])
@pytest.mark.parametrize("make", [typed, awkward])
def test_variants_equal_all_pairs(spark, make, most):
    docs = make(spark)
    found = [tuple(r) for r in variants.spelling_variants(docs, most).collect()]
    assert len(found) == len(set(found)) and set(found) == variants_of(docs.collect())


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("aaaa bbé" + "c" * 40 + " d-e") * 5
    whole = variants.runs(text.encode())
    for size in (1, 7, 64):
        monkeypatch.setattr(variants, "PIECE", size)
        assert variants.runs(text.encode()) == whole


def test_acceptor_is_minimal_and_exact():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(200)})
    built = variants.Acceptor(words)

    def language(state):
        return frozenset(c + rest for c, to in built.arcs[state].items() for rest in language(to)) | (frozenset([""]) if built.final[state] else frozenset())

    assert language(built.start) == set(words)
    assert len({language(s) for s in range(len(built.arcs))}) == len(built.arcs)
    pairs = [frozenset(p) for p in variants.OneEdit(built).pairs()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_empty_tables(spark, tmp_path):
    none = awkward(spark).limit(0)
    where = written(none, tmp_path)
    for name in ("op11_spelling_variants", "op12_merkle_manifest", "op13_set_relation_join"):
        assert getattr(queries, name)(spark, where).collect() == []
