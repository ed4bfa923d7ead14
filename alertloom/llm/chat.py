"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into chunks and, within a chunk, into turn-aligned windows. A
window repeats the system turn and as much recent history as a budget allows; loss counts only for assistant
texts that no earlier window holds. Chunks are formatted in parallel, so a conversation of any length is never
in one task: a turn near the end of a chunk also travels to the next one as history, and the system turn to all.

Template: ``<s>``, then per turn ``<|role|>role<|text|>text</s>``. Control strings inside roles and texts get a
backslash after their first character, and backslashes are doubled, so reading back is exact.

Defined results: turns are ordered by turn (null first), role and text; repeated rows are turns of their own. A
null text or role is empty. Rows without a conversation id form one conversation. A turn longer than the budget
is a window of its own, whole. An empty table gives no windows. Extra columns are not read.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.quality import words
from alertloom.operators.ranking import join_on, running

BUDGET, HISTORY, CHUNK = 512, 128, 64 * 512
TURN_OVERHEAD = 4
TURNS_PER_BUCKET = 1024
# fixed strings: this template's own marks and those of other common chat formats
CONTROL = ["<s>", "</s>", "<|role|>", "<|text|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(x) for x in CONTROL))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|role\|>(.*?)<\|text\|>(.*?)</s>", re.DOTALL)
_WINDOW = "conv_id long, chunk long, window long, n_repeated int, text string, loss array<struct<start:int,end:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(repeated, fresh):
    """(text, loss spans) of a window from ``(role, text)`` turns."""
    out, at, loss = ["<s>"], 3, []
    for turns, counts in ((repeated, False), (fresh, True)):
        for role, text in turns:
            head, body = f"<|role|>{escape(role)}<|text|>", escape(text)
            if counts and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            out += [head, body, "</s>"]
            at += len(head) + len(body) + 4
    return "".join(out), loss


def read_back(text: str, n_repeated: int, loss):
    """(new turns, texts under the loss mask), unescaped, from a window."""
    turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
    return turns[n_repeated:], [unescape(text[s["start"] : s["end"]]) for s in loss]


class _Packer:
    """Greedy windows of one chunk; holds at most one window, the history and the system turn."""

    def __init__(self, budget, history):
        self.budget, self.limit = budget, history
        self.system, self.past, self.fresh, self.used = None, [], [], 0

    def repeated(self):
        kept = [(r, t) for r, t, _ in self.past]
        return kept if self.system is None else [self.system[:2], *kept]

    def remember(self, turn):
        if turn[0] == "system" and self.system is None:
            self.system = turn
            return
        self.past.append(turn)
        while self.past and sum(n for _, _, n in self.past) > self.limit:
            self.past.pop(0)

    def room(self):
        return self.budget - sum(n for _, _, n in self.past) - (self.system[2] if self.system else 0)

    def add(self, turn):
        done = None
        if self.fresh and self.used + turn[2] > self.room():
            done = self.flush()
        while not self.fresh and self.past and turn[2] > self.room():
            self.past.pop(0)  # history gives way to a long turn
        self.fresh.append(turn)
        self.used += turn[2]
        return done

    def flush(self):
        out = (len(self.repeated()), *render(self.repeated(), [x[:2] for x in self.fresh]))
        for x in self.fresh:
            self.remember(x)
        self.fresh, self.used = [], 0
        return out


def _windows(budget, history):
    def run(stream):
        key, packer, n, rows = None, None, 0, []

        def put(window):
            nonlocal n
            rows.append((*key, n, *window))
            n += 1

        started = False
        for batch in stream:
            for conv, chunk, kind, role, text, tokens in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "chunk", "kind", "role", "text", "tokens")]):
                if not started or key != (conv, chunk):
                    started = True
                    if packer is not None and packer.fresh:
                        put(packer.flush())
                    key, packer, n = (conv, chunk), _Packer(budget, history), 0
                if kind < 2:
                    packer.remember((role, text, tokens))
                elif (window := packer.add((role, text, tokens))) is not None:
                    put(window)
            yield _frame(rows)
            rows = []
        if packer is not None and packer.fresh:
            put(packer.flush())
        yield _frame(rows)

    return run


def _frame(rows):
    c = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), _LOSS)
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds)], ["conv_id", "chunk", "window", "n_repeated", "text", "loss"])


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, chunk, window, n_repeated, text, loss`` from ``turns (conv_id, turn, role, text)``.

    ``n_repeated`` turns at the start of ``text`` stand in an earlier window; ``loss`` holds the character ranges
    of new assistant texts. Budgets count blank-separated words and ``TURN_OVERHEAD`` for each turn.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), (F.size(words(F.col("text"))) + TURN_OVERHEAD).cast("long").alias("tokens"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(2**62)))
    placed = running(rows, ["conv_id"], bucket, order, F.col("tokens"), "before", "sum", False)
    placed = placed.withColumn("chunk", F.floor(F.col("before") / chunk))
    later = F.floor((F.col("before") + F.col("tokens") + history) / chunk)
    kinds = F.when(later > F.col("chunk"), F.array(F.struct(F.col("chunk"), F.lit(2).alias("kind")), F.struct(later.alias("chunk"), F.lit(1).alias("kind")))) \
        .otherwise(F.array(F.struct(F.col("chunk"), F.lit(2).alias("kind"))))
    sent = placed.withColumn("_to", F.explode(kinds)).select("conv_id", F.col("_to.chunk").alias("chunk"), F.col("_to.kind").alias("kind"), "turn", "role", "text", "tokens")
    system = rows.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("_s"))
    others = sent.where("chunk > 0 and kind = 2").select("conv_id", "chunk").distinct()
    leads = join_on(others, system, ["conv_id"]).select("conv_id", "chunk", F.lit(0).alias("kind"), "_s.turn", "_s.role", "_s.text", "_s.tokens")
    everything = sent.unionByName(leads).repartition("conv_id", "chunk")
    ordered = everything.sortWithinPartitions("conv_id", "chunk", "kind", *order)
    return ordered.mapInArrow(_windows(budget, history), _WINDOW)


def _digests(stream):
    """One row per conversation; windows arrive in order and only running digests are held."""
    key, state, rows, started = None, None, [], False

    def close():
        n, turns, chars, loss, total = state
        rows.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    for batch in stream:
        for conv, n_repeated, text, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss")]):
            if not started or conv != key:
                if started:
                    close()
                started, key, state = True, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            fresh, masked = read_back(text, n_repeated, spans)
            for role, said in fresh:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for said in masked:
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        yield _digest_frame(rows)
        rows = []
    if started:
        close()
    yield _digest_frame(rows)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest_frame(rows):
    c = list(zip(*rows)) if rows else [[]] * len(_DIGEST)
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(c, _DIGEST)], schema=_DIGEST)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation read back to; a digest is sequential, so one task streams a conversation."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "window")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
