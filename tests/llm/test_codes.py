"""Vector codes: adaptive bounds against plain rounds on integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import codes

KINDS = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """``({vec_id: (code, error)}, books)`` by full searches."""
    kept = sorted((r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([[int(np.floor(1024 * c)) for c in r[1]] for r in kept], dtype=np.int64)
    w = x.shape[1] // parts
    code, error, books = np.zeros((len(x), parts), int), np.zeros(len(x), int), []
    for p in range(parts):
        mine = x[:, p * w : (p + 1) * w]
        book = mine[:entries].copy()
        for r in range(rounds + 1):
            sq = ((mine[:, None, :] - book[None]) ** 2).sum(2)
            code[:, p] = sq.argmin(1)
            if r < rounds:
                for e in set(code[:, p]):
                    book[e] = mine[code[:, p] == e].sum(0) // (code[:, p] == e).sum()
        error += sq.min(1)
        books.append(book)
    return [(r[0], bytes(c.tolist()), int(e)) for r, c, e in zip(kept, code, error)], np.array(books)


def check(spark, rows, **options):
    got = codes.compress(spark.createDataFrame(rows, KINDS).repartition(3), **options)
    want, books = plain(rows, **{k: v for k, v in options.items() if k != "first_b"})
    assert np.array_equal(got.books, books)
    assert sorted((str(r["vec_id"]), bytes(r["code"]), r["error"]) for r in got.rows.collect()) == sorted((str(i), c, e) for i, c, e in want)
    return got


@pytest.mark.parametrize("kind", ["spread", "crowded", "ties"])
@pytest.mark.parametrize("first_b", [2, 8])
def test_bounds_lose_nothing(spark, kind, first_b):
    rng = np.random.default_rng(len(kind))
    x = {
        "spread": rng.normal(size=(900, 8)),
        "crowded": rng.normal(size=(20, 8))[rng.integers(0, 20, 900)] + rng.normal(size=(900, 8)) * 0.02,
        "ties": rng.integers(0, 3, (900, 8)) / 256,  # many equal parts and equal distances
    }[kind]
    got = check(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(x)], entries=40, first_b=first_b)
    if kind == "crowded":  # bounds settle rows without any distance
        assert all(depths[:, 0].sum() > 0 for _, depths in got.history[1:])


def test_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), None if i % 2 else 1) for i in range(30)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], None), (None, rows[5][1], 2), (None, rows[5][1], 2)]
    rows += [(90, None, 1), (91, [None] + [0.0] * 7, 1), (92, [float("nan")] * 8, 1), (93, [float("inf")] * 8, 1), (-94, [0.0] * 8, 1), (95, [-0.0] * 8, 1)]
    got = check(spark, rows).rows  # fewer rows than entries
    check(spark, rows, entries=1)
    check(spark, [(1, [0.5] * 4, None)])
    check(spark, [(i, (rng.normal(size=4) * 30_000).tolist(), 1) for i in range(60)], entries=7)  # products beyond exact doubles
    summed = codes.with_label_error(got).collect()
    for label in (None, 1, 2):
        mine = [r for r in summed if r["label"] == label]
        assert mine and {r["label_error"] for r in mine} == {sum(r["error"] for r in mine)}
    empty = codes.compress(spark.createDataFrame([(1, None, 1)], KINDS))
    assert empty.rows.count() == 0 and codes.with_label_error(empty.rows).count() == 0 and codes.books_digest(empty.books)
    extra = spark.createDataFrame(rows[:9], KINDS).withColumns({c: F.lit("own") for c in ("x", "near", "bounds", "code", "error", "a.b")})
    assert codes.compress(extra).rows.columns == ["vec_id", "label", "code", "error"]
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError, match="equal parts"):
            codes.compress(spark.createDataFrame(bad, KINDS))
    with pytest.raises(Exception, match="after scaling"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], KINDS))


def test_b_follows_the_depth():
    depths = np.zeros(256, np.int64)
    depths[[0, 3, 9]] = 90, 7, 3
    assert codes.adapted(depths, 8) == 3
    depths[codes.ALL] = 50
    assert codes.adapted(depths, 8) == 16 == codes.adapted(depths, 16)
