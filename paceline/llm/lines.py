r"""Exact line de-duplication over a corpus, JVM-side only.

The occurrences of long lines are written once as narrow rows (two 64-bit hashes of the line
key, document, position). They are range-partitioned by hash with document and position as
secondary order, and each run of equal hashes is streamed: its first row names the largest document,
its changes of document are counted. Runs are salted by document, so that one line in a third of all documents
spreads over SALTS runs, which meet again as one short row each. The result per document is a
keep bitmap in run-length form (kept, dropped, kept, ...), not the text; ``apply_bitmap`` brings it to the text.

Defined results: a null or empty text is one empty line, which stays. Rows with the same
document id are one document for counting; rows that are equal get the same bitmap. A null id counts
as one document that is smaller than any other. An empty table gives an empty result. Extra columns
pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.text import SPACE, free_name, let, lines, lower_ascii, or_empty
from paceline.session import cut

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 64


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def row_hash(text: Column) -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64(F.lit(7), or_empty(text))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, row_key, pos, h1, h2)`` of every line whose key has ``min_chars`` code points. The
    key is the line without white space at its ends and with A-Z in lower case."""
    keyed = F.transform(lines(F.col("text")), lambda x, i: let(line_key(x), lambda k: F.when(F.length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))))
    return docs.select("doc_id", row_hash(F.col("text")).alias("row_key"), F.inline(F.filter(keyed, lambda s: s.isNotNull())))


def shared_lines(occ: DataFrame, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """``(h1, h2, top)`` of keys found in at least ``min_docs`` documents; ``top`` is the largest one."""
    salted = occ.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "pos")
    ordered = salted.repartitionByRange(F.col("h1"), F.col("h2"), F.col("salt"))
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    before = F.lag("doc_id").over(run)
    place = F.row_number().over(run)
    streamed = ordered.select("h1", "h2", "doc_id", place.alias("place"), F.when((place == 1) | ~before.eqNullSafe(F.col("doc_id")), 1).otherwise(0).alias("new"))
    # one short row per run: its first row has the largest document
    by_key = streamed.groupBy("h1", "h2").agg(F.sum("new").alias("n_docs"), F.max(F.when(F.col("place") == 1, F.col("doc_id"))).alias("top"))
    return by_key.where(F.col("n_docs") >= min_docs).select("h1", "h2", "top")


def runs_of(dropped: Column, n_lines: Column) -> Column:
    """Run lengths (kept, dropped, kept, ...) of ``n_lines`` lines from sorted dropped positions."""
    def build(d: Column) -> Column:
        starts = F.filter(d, lambda p, i: F.coalesce(F.get(d, i - 1) + 1 != p, F.lit(True)))
        ends = F.filter(d, lambda p, i: F.coalesce(F.get(d, i + 1) - 1 != p, F.lit(True)))
        bounds = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.array(z["s"], z["e"] + 1)))
        edges = F.concat(F.array(F.lit(0)), bounds, F.array(n_lines))
        return let(edges, lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 1), lambda x, i: x - F.get(e, i)))

    return let(F.sort_array(dropped), build)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """``(doc_id, row_key, dropped)`` of each document that loses lines: the positions, sorted."""
    occ = cut(occurrences(docs, min_chars))
    shared = cut(shared_lines(occ, min_docs, salts))
    gone = occ.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    # equal rows have equal positions
    return gone.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def with_bitmap(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with ``n_lines``, ``keep_runs`` (the bitmap) and ``n_dropped`` appended; underscores in front of names that are taken."""
    its_id, its_key, its_dropped = (free_name(docs, c) for c in ("__id", "__key", "__dropped"))
    bitmaps = keep_bitmaps(docs, **options).select(F.col("doc_id").alias(its_id), F.col("row_key").alias(its_key), F.col("dropped").alias(its_dropped))
    joined = docs.join(bitmaps, F.col("doc_id").eqNullSafe(F.col(its_id)) & (row_hash(F.col("text")) == F.col(its_key)), "left")
    n = F.size(lines(F.col("text")))
    dropped = F.coalesce(F.col(its_dropped), F.array().cast("array<int>"))
    return joined.select(*[docs[c] for c in docs.columns], n.cast("long").alias(free_name(docs, "n_lines")), F.size(dropped).cast("long").alias(free_name(docs, "n_dropped")), runs_of(dropped, n).alias(free_name(docs, "keep_runs")))


def apply_bitmap(text: Column, runs: Column) -> Column:
    """The kept lines of ``text``, joined by a line feed."""
    flags = F.flatten(F.transform(runs, lambda r, i: F.array_repeat(i % 2 == 0, r)))
    kept = let(flags, lambda f: F.filter(lines(text), lambda x, i: F.get(f, i)))
    return F.when(F.size(runs) == 1, or_empty(text)).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, **options: int) -> DataFrame:
    """The columns of ``docs``; texts without their repeated lines."""
    marked = with_bitmap(docs, **options)
    text = apply_bitmap(F.col("text"), F.col(free_name(docs, "keep_runs")))
    held = marked.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns])
    return held.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else held
