"""LSH forest: components against brute force on full sets."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from paceline.llm import forest, queries
from test_contracts import WORD
from test_edges import ODD, documents, prose
from test_names import own


def naive_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def naive(texts):
    """``[(id, size, component, kept)]`` from ``[(id, text)]``; ids may repeat."""
    sets, root = [naive_set(t) for _, t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
            root[max(find(i), find(j))] = min(find(i), find(j))
    ids = [[d for k, (d, _) in enumerate(texts) if find(k) == find(i) and d is not None] for i in range(len(texts))]
    named = [min(x) if x and sets[i] else texts[i][0] for i, x in enumerate(ids)]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(texts, sets, named)), key=str)


def check(spark, texts):
    got = forest.groups(documents(spark, [(d, t, "s") for d, t in texts]).repartition(5)).collect()
    want = naive(texts)
    assert sorted((tuple(r) for r in got), key=str) == want
    return want


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"other{rng.random()}" if rng.random() < share else w for w in text.split())


def test_query_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.QUERIES["op11_minhash_forest"](spark, sf).collect()
    want = naive(list(zip(docs["doc_id"], docs["text"])))
    assert sorted((tuple(r) for r in got), key=str) == want and sum(not r[3] for r in want) > 5


def test_near_copies(spark):
    texts = [(i, prose(i, 60 + 40 * (i % 9))) for i in range(40)]
    for i in range(40):
        t = texts[i][1]
        texts += [(100 + i, changed(t, 0.01, i)), (200 + i, changed(t, 0.03, i)), (300 + i, " ".join(t.split()[: 55 - i])), (400 + i, t.upper())]
    kept = sum(r[3] for r in check(spark, texts))
    assert 60 < kept < 160


def test_a_crowd_of_near_copies(spark):
    base = prose(5, 300)
    want = check(spark, [(i, changed(base, 0.004, i)) for i in range(500)])
    assert sum(r[3] for r in want) < 20


def test_pairs_under_a_shared_template(spark):
    """300 pairs; any two texts have some 0.78 in common, those of a pair 0.816: every pair must be found, nothing else."""
    template = prose(1, 500)
    texts = []
    for i in range(300):
        rng = random.Random(i)
        new = lambda n: " ".join(f"n{rng.random()}" for _ in range(n))
        shared = new(10)
        texts += [(2 * i, f"{template} {shared} {new(54)}"), (2 * i + 1, f"{template} {shared} {new(54)}")]
    want = check(spark, texts)
    assert sum(r[3] for r in want) == 300


def test_neighbours_across_seams(spark):
    rows = [(7, 60, i.to_bytes(forest.DEEPER * 4, "big"), i, 100) for i in range(60)] + [(8 + i // 5, 5, b"\0" * forest.DEEPER * 4, 1000 + i, 100) for i in range(60)]
    members = spark.createDataFrame(rows, "region long, crowd long, path binary, set_id long, n long").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 50):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {(r["a"], r["b"]) for r in forest.neighbours(members).collect()}
            crowd = {(i - k, i) for i in range(60) for k in range(1, forest.BEST + 1) if i >= k}
            assert got == crowd | {(1000 + i, 1000 + j) for i, j in combinations(range(60), 2) if i // 5 == j // 5}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("chunk", [7, 512])
def test_chunks_of_a_region_are_exact(spark, chunk, monkeypatch):
    """Without any neighbours: what the chunks link connects all pairs of different groups."""
    monkeypatch.setattr(forest, "COLUMNS", 16)
    rng = random.Random(2)
    sets = {i: set(rng.sample(range(60), rng.randint(1, 25))) for i in range(80)}
    for i in range(80, 140):
        sets[i] = sets[i - 80] ^ {rng.randrange(60)}
    sets = {i: s for i, s in sets.items() if s}
    members = spark.createDataFrame([(r, len(sets), i, len(s)) for i, s in sets.items() for r in (1, 2)], "region long, crowd long, set_id long, n long")
    groups = spark.createDataFrame([(i, len(s), 1 if i < 30 else i) for i, s in sets.items()], "set_id long, n long, group long")
    full = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "set_id long, hashes array<long>")
    assert forest.tiles(members, groups)[0].select("region").distinct().count() == 1
    found = [(r["a"], r["b"]) for r in forest.across_groups(members, groups, full, 80, chunk).collect()]
    like = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    group = lambda i: 1 if i < 30 else i
    assert all(like(i, j) and group(i) != group(j) for i, j in found)
    near = [(i, j) for i, j in combinations(sorted(sets), 2) if group(i) != group(j) and like(i, j)]
    roots = []
    for links in (near, found):
        root = {i: group(i) for i in sets}
        for _ in root:
            for i, j in links:
                low = min(root[i], root[j])
                root = {k: low if r in (root[i], root[j]) else r for k, r in root.items()}
        roots.append(root)
    assert near and roots[0] == roots[1]


def test_edges(spark):
    check(spark, [(d, t) for d, t, _ in ODD])
    a, b = prose(1), prose(2)
    check(spark, [(None, a), (None, a + " x"), (5, b), (5, a), (-9, b + " y"), (3, "Two words"), (4, "two  WORDS"), (6, None), (None, " ")])
    assert forest.groups(documents(spark, [])).count() == 0
    docs = own(documents(spark, [(1, a, "s"), (2, a, "s")]), "n", "set_id", "group", "t1", "kept", "a.b")
    assert [tuple(r) for r in forest.groups(docs).orderBy("doc_id").collect()] == [(1, 77, 1, True), (2, 77, 1, False)]
    with pytest.raises(ValueError):
        forest.groups(docs, percent=50)
