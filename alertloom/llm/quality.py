"""Line-first cleaning of documents, in Spark's own functions only.

Each line is judged by punctuation, navigation, symbol and boilerplate rules. Lines that fail are removed, and
a document that loses too much of its text this way is rejected, like one that fails the word statistics.

Defined results: a null text has no words and no lines; it fails the base rules and its cleaned text is null.
An empty text fails them too and stays empty. Rows are judged one by one, so repeated rows and rows with null
ids get equal verdicts. The columns added replace input columns of the same name. An empty table stays empty.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "licensed under", "released under",
    "copyright", "cookie", "javascript", "sign in", "log in", "subscribe", "click here", "read more", "skip to content",
)
BOILERPLATE_SHARE = 20  # one word in so many inside a phrase is too much
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MAX_LOST = 0.65


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body names it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later filters and projections read but never compute again.

    A filter on a projected column makes Spark copy its expression into the filter; a generator stops that.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    stay = [c for c in df.columns if c not in columns]
    return df.select(*stay, made).select(*stay, *[F.col(f"_once.{n}").alias(n) for n in columns])


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are among ``chars``; one byte search for each, no per-character map."""
    found = [(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / len(c.encode()) for c in chars]
    return sum(found[1:], found[0]).cast("long")


def repeated_words(tokens: Column, size: int = 5) -> Column:
    """Words inside ``size``-word windows that the same text holds twice or more, first occurrence included."""

    def windows(h):
        inner = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        return F.slice(inner, 1, F.size(h) - (size - 1))

    def covered(at):
        gap = F.transform(at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, g: a + g)

    def from_order(order):
        at = F.transform(order, lambda s, j: F.when((F.get(order, j - 1)["h"] == s["h"]) | (F.get(order, j + 1)["h"] == s["h"]), s["i"]))
        return let(F.sort_array(F.filter(at, lambda p: p.isNotNull())), covered)

    def from_windows(w):
        order = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(order, from_order))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < size + 1, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), from_windows))


def line_fails(line: Column) -> Column:
    """True for a line that is navigation, symbols, shouting, unpunctuated running words or boilerplate, at any length."""
    n = count_of(line, " ") + 1
    bars = count_of(line, "|>»•·")
    navigation = (bars >= 2) & (bars * 5 >= n)
    symbols = count_of(line, "#*$%&|<>{}[]=~^\\") * 4 > n + 4
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n >= 3)
    unpunctuated = ~line.rlike("[.,;:!?…]") & (n >= 12)
    low = F.lower(line)
    said = reduce(lambda x, y: x | y, [low.contains(x) for x in BOILERPLATE])
    inside = sum([(F.octet_length(low) - F.octet_length(F.replace(low, F.lit(x), F.lit("")))) / len(x) * (x.count(" ") + 1) for x in BOILERPLATE], F.lit(0))
    boilerplate = F.when(said, inside * BOILERPLATE_SHARE >= n).otherwise(False)
    return navigation | symbols | shouting | unpunctuated | boilerplate


def judge(text: Column) -> dict[str, Column]:
    """Counts of a text and what its lines leave of it."""
    body = F.coalesce(text, F.lit(""))
    lines = F.split(body, "\n", -1)
    filled = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n")
    return {
        "_word": let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))),
        "word_chars": F.length(body) - count_of(body, BLANK_CHARS),
        "n_symbols": count_of(body, SYMBOLS),
        "n_dup_lines": let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long"),
        "_left": let(left, lambda x: F.struct(x.alias("text"), (F.length(x) - count_of(x, BLANK_CHARS)).alias("chars"))),
    }


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned, lost``.

    ``cleaned`` is the text without failing lines, ``lost`` the share of word characters that left with them.
    ``kept`` is false if the base rules fail (fewer than 10 words, or over 20 % of them in repeated windows of
    five) or ``lost`` exceeds ``max_lost``. A text without removed lines is returned as it is.
    """
    text = F.col("text")
    out = once(docs, judge(text)).withColumns({
        "n_words": F.col("_word.n"), "n_repeat_words": F.col("_word.repeated"), "cleaned": F.when(text.isNotNull(), F.col("_left.text")),
        "lost": F.when(F.col("word_chars") > 0, 1 - F.col("_left.chars") / F.col("word_chars")).otherwise(F.lit(0.0)),
    }).drop("_word", "_left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
