"""Spelling variants by finite-state composition.

The vocabulary is an acceptor A, minimised; E is the transducer that copies its input but for one inserted, deleted
or replaced symbol. A o E o A accepts the pairs of near words. Before its edit a path has read the same symbols on
both sides, so it stands in one state of A twice; after it, it accepts what the two states reached have in common.

*Initial states.* Paths are partitioned by the state in which they start, that is by a prefix. A prefix with more than
``MOST`` words below it is split by its next symbol, again and again, so a part holds at most ``MOST`` words however
the vocabulary is skewed. Paths that edit below a part's state are enumerated in one task per part. Paths that edit
at a split state leave the part: what follows the edit must be equal on both sides, an equality that Spark joins
on, for the words below split states only; at most one word per letter of the alphabet shares such a key.

*Enumeration.* A part's acceptor is built from its sorted words, merging states with equal right languages as they are
left. A walk in the composition takes an edit only if the two states it leads to have a common word, which is decided
once per pair of states. An edit stands at the first symbol where the two words differ, so every pair comes out once.

Defined results: runs are maximal sequences of ``LETTERS`` in the text with A-Z lower-cased; null and empty texts have
none; repeated rows count each. Where the crc32 of ``<doc_id>:<run>`` (null id: nothing before the colon) is a
multiple of ``EVERY``, one symbol of the run goes. Ties of the largest count go to the word smallest in code points. A
form has at least ``RATIO`` times the count of its variant, so forms of forms end after a few steps. An empty table
gives an empty result. Extra columns are not read.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import hashing as H
from alertloom.session import cut_lineage, release

LETTERS = "A-Za-zÀ-ÿ"
EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10
MOST = 20_000
PIECE = 1 << 20
_RUN = re.compile(f"[{LETTERS}]+")


def runs(text: bytes):
    """Counts of the runs in a UTF-8 text, A-Z lower-cased, a piece of it at a time."""
    whole = text.lower().decode()  # bytes lower-case A-Z only
    found, at = Counter(), 0
    while at < len(whole):
        end = at + PIECE
        cut = _RUN.match(whole, end) if end < len(whole) and _RUN.match(whole[end - 1]) else None
        end = cut.end() if cut else end
        found.update(_RUN.findall(whole, at, end))
        at = end
    return found


def _counted(stream):
    for whole in stream:
        for batch in H.batches(whole):
            words = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                head = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in runs(text.as_py() or b"").items():
                    if len(word) < LEAST_LENGTH:
                        continue  # a deletion only makes it shorter
                    h = zlib.crc32(word.encode(), head)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    words[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words of ``docs (doc_id, text)`` with enough symbols and occurrences."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """Minimal deterministic acceptor of sorted words: ``arcs[state]`` maps symbols to states."""

    def __init__(self, words):
        self.arcs, self.final, self._known = [], [], {}
        path, before = [[{}, False]], ""  # states of the last word, still open
        for word in words:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            self._close(path, before, same)
            path += [[{}, False] for _ in word[same:]]
            path[-1][1] = True
            before = word
        self._close(path, before, 0)
        self.start = self._state(path[0])

    def _close(self, path, word, down_to):
        """Give the states of ``word`` below depth ``down_to`` their numbers."""
        while len(path) > down_to + 1:
            state = self._state(path.pop())
            path[-1][0][word[len(path) - 1]] = state

    def _state(self, open_state):
        arcs, final = open_state
        key = (final, tuple(arcs.items()))  # sorted words add arcs in order
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._known[key]


class OneEdit:
    """The composition of an acceptor, the one-edit transducer and the acceptor again."""

    def __init__(self, acceptor):
        self.a, self._common, self._edits = acceptor, {}, {}

    def _meet(self, p, q):
        """Pairs of states that one symbol leads to on both sides, with the symbol."""
        left, right = self.a.arcs[p], self.a.arcs[q]
        if len(left) > len(right):
            return [(c, left[c], right[c]) for c in right if c in left]
        return [(c, left[c], right[c]) for c in left if c in right]

    def has_common(self, p, q):
        """Whether a word leads from both states to a final one; decided without recursion, as words may be long."""
        todo = [(p, q)]
        while todo:
            pair = todo[-1]
            if pair in self._common:
                todo.pop()
                continue
            if pair[0] == pair[1] or (self.a.final[pair[0]] and self.a.final[pair[1]]):
                self._common[pair] = True
                continue
            after = [(s, t) for _, s, t in self._meet(*pair)]
            if any(self._common.get(x) for x in after):
                self._common[pair] = True
                continue
            open_ = [x for x in after if x not in self._common]
            if open_:
                todo.append(open_[0])
            else:
                self._common[pair] = False
        return self._common[p, q]

    def edits(self, state):
        """The productive edits at a state: (symbol read, symbol written or none, state, state)."""
        if state not in self._edits:
            arcs = list(self.a.arcs[state].items())
            out = [(c, d, p, q) for i, (c, p) in enumerate(arcs) for d, q in arcs[i + 1 :] if self.has_common(p, q)]
            for c, p in arcs:
                # what follows a deleted symbol begins with another one, or it would be deleted later
                if (self.a.final[state] and self.a.final[p]) or any(s != c and self.has_common(t, u) for s, t, u in self._meet(p, state)):
                    out.append((c, "", p, state))
            self._edits[state] = out
        return self._edits[state]

    def common(self, p, q, but=""):
        """All words that lead from both states to final ones; the first symbol is not ``but``."""
        todo = [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            if self.a.final[p] and self.a.final[q]:
                yield read
            todo += [(s, t, read + c) for c, s, t in self._meet(p, q) if (read or c != but) and self.has_common(s, t)]

    def pairs(self):
        """Every accepted pair once."""
        todo = [(self.a.start, "")]
        while todo:
            state, read = todo.pop()
            for c, d, p, q in self.edits(state):
                for rest in self.common(p, q, "" if d else c):
                    yield read + c + rest, read + d + rest
            todo += [(s, read + c) for c, s in self.a.arcs[state].items()]


def _enumerated(table: pa.Table) -> pa.Table:
    counts = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
    a, b = [], []
    for x, y in OneEdit(Acceptor(sorted(counts))).pairs():
        a.append(x)
        b.append(y)
    sides = [pa.array(a, pa.string()), pa.array([counts[x] for x in a], pa.int64()), pa.array(b, pa.string()), pa.array([counts[x] for x in b], pa.int64())]
    return pa.table(sides, ["a", "n_a", "b", "n_b"])


def partitioned(words: DataFrame, most=MOST) -> DataFrame:
    """``words (word, n)``, a written table, with ``depth``, the length of the prefix that is its part."""
    parts, open_, depth = [], words, 0
    while True:
        prefix = F.substring("word", 1, depth)
        big = cut_lineage(open_.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_p"))
        if big.isEmpty():
            return _all([*parts, open_.withColumn("depth", F.lit(depth))])
        keyed = open_.withColumn("_p", prefix)
        parts.append(cut_lineage(keyed.join(big, "_p", "left_anti").select("word", "n", F.lit(depth).alias("depth"))))
        open_ = cut_lineage(keyed.join(big, "_p", "left_semi").select("word", "n"))
        release(big)
        depth += 1


def _all(tables):
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_pairs(words: DataFrame, most=MOST) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words of ``words (word, n)``, a written table, that one edit makes equal, once."""
    placed = cut_lineage(partitioned(words, most))
    inside = placed.select(F.expr("substring(word, 1, depth)").alias("part"), "word", "n").groupBy("part")
    inside = inside.applyInArrow(_enumerated, "a string, n_a long, b string, n_b long")
    at_split = placed.where("depth > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    at_split = at_split.withColumn("c", F.expr("substring(word, k + 1, 1)"))
    rest = F.expr("concat(substring(word, 1, k), substring(word, k + 2))")
    short = at_split.where("c <> ''").select("k", rest.alias("rest"), "word", "n", "c")
    other = short.select("k", "rest", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("d"), F.lit(True).alias("same"))
    whole = at_split.select("k", F.col("word").alias("rest"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("d"), F.lit(False).alias("same"))
    met = short.join(other.unionByName(whole), ["k", "rest"]).where("(same AND c < d) OR (NOT same AND c <> d)")
    return inside.unionByName(met.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "b", "n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms from a word on, for words that have one."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        after = cut_lineage(now.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        release(now)
        now = after
        if after.where("_moved").isEmpty():
            return after.drop("_moved")


def spelling_variants(docs: DataFrame, most=MOST) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``docs``."""
    words = cut_lineage(vocabulary(docs))
    pairs = near_pairs(words, most)
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("_w"), F.col("n_b").alias("_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n_a"), F.col("a").alias("_w"), F.col("n_a").alias("_n")))
    best = both.groupBy("word", "n_a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_w").alias("form"))).alias("_m"))
    large = -F.col("_m.neg") >= RATIO * F.col("n_a")
    near = cut_lineage(best.select("word", "n_near", F.when(large, F.col("_m.form")).alias("form"), F.when(large, -F.col("_m.neg")).alias("form_n")))
    out = words.join(near, "word", "left").join(_roots(near.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
