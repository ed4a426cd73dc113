"""Operators on tables whose extra columns have the names of their results."""

from pyspark.sql import functions as F

from paceline.llm import html, lines, quality, simhash
from test_edges import GOOD, documents

SHARED = "this one line is shared by all of them."


def own(df, *names):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in names])


def test_clean_keeps_columns_named_like_results(spark):
    docs = own(documents(spark, [(1, GOOD + "\nno marks here", "a"), (2, "short", "b")]), *quality.RESULTS, "__w", "__l", "_kept")
    got = quality.clean(docs)
    assert got.columns == docs.columns
    (r,) = got.collect()
    assert (r["doc_id"], r["text"], r["n_chars"]) == (1, GOOD, len(GOOD)) and all(r[c] == f"own {c}" for c in [*quality.RESULTS, "__w", "__l", "_kept"])


def test_dedup_lines_keeps_columns_named_like_results(spark):
    names = ("n_lines", "n_dropped", "keep_runs", "__id", "__key", "__dropped", "row_key")
    docs = own(documents(spark, [(i, f"{SHARED}\nown {i}", "a") for i in range(3)]), *names)
    got = lines.dedup_lines(docs).orderBy("doc_id")
    assert got.columns == docs.columns
    assert [r["text"] for r in got.collect()] == ["own 0", "own 1", f"{SHARED}\nown 2"] and all(r[c] == f"own {c}" for r in got.collect() for c in names)


def test_extract_keeps_columns_named_like_results(spark):
    pages = own(spark.createDataFrame([(1, "<article><p>One and two.</p></article>")], "page_id long, html string"), "blocks", "text", "n_chars")
    (r,) = html.extract(pages).collect()
    assert all(r[c] == f"own {c}" for c in ("blocks", "text", "n_chars")) and (r["_text"], r["_n_chars"]) == ("One and two.", 12)


def test_keep_one_keeps_columns_named_like_its_own(spark):
    names = ("__h1", "__h2", "fp", "root", "component_id", "a.b")
    docs = own(documents(spark, [(1, GOOD, "a"), (2, GOOD, "a"), (3, "some other text", "b")]), *names)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    rows = got.orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [1, 3] and all(r[c] == f"own {c}" for r in rows for c in names)
