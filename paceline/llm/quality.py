r"""Line-first quality rules, JVM-side only.

Every line is judged by itself (symbols, shouting, punctuation, navigation, boilerplate),
failing lines go, and a document that loses too much of its text that way is rejected, as
is one that fails the document rules (few words, mostly repeated word windows).

Defined results: a null or empty text has no words and is rejected. Lines without a word
(empty, white space) pass and count for nothing. Equal rows are judged alike, every row by
itself. Extra columns pass through; a column whose name the operator needs for its own
results raises ``ValueError``. Texts of any length are judged whole, in time that grows as n log n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.text import free_name, let, lines, once, or_empty, word_chars, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
#: Fixed phrases of site furniture; a line of fewer than BOILERPLATE_CHARS characters that holds one fails.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies",
    "enable javascript", "sign up for our newsletter", "click here", "read more", "share this",
)
BOILERPLATE_CHARS = 160
NAVIGATION = "[|»›·•→]"
PUNCTUATION = "[.,;:!?…。！？،؟।]"
SYMBOL_SHARE, BAR_SHARE = 10, 3
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "cleaned")


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice among the windows of ``ws`` (told apart by 64-bit hashes)."""
    windows = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0)))
    hashes = F.transform(windows, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.when(same(i - 1) | same(i + 1), x["i"])

        starts = F.sort_array(F.filter(F.transform(s, twice), lambda p: p.isNotNull()))
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return let(hashes, count).cast("long")


def line_fails(line: Column) -> Column:
    """True for a line with words that breaks a rule. Cheap tests come first, counts only behind them."""
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) * SYMBOL_SHARE > F.length(line)
    shouting = line.contains("!!") & (F.upper(line) == line) & (F.length(line) >= 10)
    unpunctuated = ~line.rlike(PUNCTUATION)
    navigation = line.rlike(NAVIGATION) & (F.regexp_count(line, F.lit(NAVIGATION)) * BAR_SHARE > F.size(words(line)))
    low = F.lower(line)
    furniture = (F.length(line) < BOILERPLATE_CHARS) & reduce(lambda a, b: a | b, [low.contains(p) for p in BOILERPLATE])
    return has_word(line) & (unpunctuated | shouting | symbols | navigation | furniture)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with RESULTS appended: the measures, ``kept`` and the ``cleaned`` text."""
    clash = {c.lower() for c in docs.columns} & set(RESULTS)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results of this operator; rename them first")
    t = or_empty(F.col(text))

    def measured(ws: Column) -> Column:
        chars = F.length(F.array_join(ws, "")).cast("long")
        return F.struct(F.size(ws).cast("long").alias("n_words"), chars.alias("word_chars"), repeat_words(ws).alias("n_repeat_words"))

    def line_results(ls: Column) -> Column:
        dup = let(F.filter(ls, has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        bad = F.filter(ls, line_fails)

        def with_bad(b: Column) -> Column:
            lost = F.when(F.size(b) == 0, F.lit(0)).otherwise(word_chars(F.array_join(b, "")))
            cleaned = F.when(F.size(b) == 0, t).otherwise(F.array_join(F.filter(ls, lambda x: ~line_fails(x)), "\n"))
            return F.struct(dup.alias("n_dup_lines"), lost.cast("long").alias("lost_chars"), cleaned.alias("cleaned"))

        return let(bad, with_bad)

    w, l = free_name(docs, "__w"), free_name(docs, "__l")
    out = once(
        docs,
        let(words(t), measured).alias(w),
        let(lines(t), line_results).alias(l),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    n, repeats, chars = F.col(f"{w}.n_words"), F.col(f"{w}.n_repeat_words"), F.col(f"{w}.word_chars")
    failed = (n < MIN_WORDS) | (repeats * 100 > n * MAX_REPEAT_PERCENT)
    too_much = F.col(f"{l}.lost_chars") * 100 > chars * MAX_LOST_PERCENT
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.alias("n_words"), chars.alias("word_chars"), "n_symbols", F.col(f"{l}.n_dup_lines"), repeats.alias("n_repeat_words"),
        failed.alias("base_failed"), F.col(f"{l}.lost_chars"), (~failed & ~too_much).alias("kept"), F.col(f"{l}.cleaned"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; the columns of ``docs``, whatever their names."""
    aside = docs
    own = {c: c for c in docs.columns}
    for c in docs.columns:
        if c.lower() in RESULTS:
            own[c] = free_name(aside, f"_{c}")
            aside = aside.withColumnRenamed(c, own[c])
    judged = judge(aside).where("kept")
    return judged.select(*[(F.col("cleaned") if c == "text" else F.length("cleaned").cast("long") if c == "n_chars" else F.col(f"`{own[c]}`")).alias(c) for c in docs.columns])
