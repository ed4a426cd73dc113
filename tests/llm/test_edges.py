"""Defined results of the operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import chat, html, lines, mixing, packing, pii, quality, simhash, topk, warc
from test_contracts import naive_components, naive_fingerprint, naive_spans, plain_clean

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = " ".join(f"word{i} number{i * 7 % 13}," for i in range(60)) + "."


def documents(spark, rows):
    full = [(i, t, None, s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, None, "a"), (2, "", None), (3, " \t\n\x0b ", "a"), (4, GOOD, None), (4, GOOD, None), (None, GOOD, "b"), (None, None, None),
    (-5, "é" * 40 + "\n" + GOOD, "b"), (6, "x " * 30000 + GOOD, "a"), (7, "y" * 200000, "a"), (8, GOOD + "\n" + GOOD, "ä"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_quality_edges(spark, odd, none):
    got = quality.judge(odd.withColumn("extra", F.lit(1))).toPandas()
    assert len(got) == len(ODD) and set(got["extra"]) == {1}
    want = [plain_clean(t) for _, t, _ in ODD]
    assert sorted(x for x in want if x is not None) == sorted(got[got["kept"]]["cleaned"])
    empty = got[got["text"].isna()]
    assert list(empty["n_words"]) == [0, 0] and not empty["kept"].any() and empty["base_failed"].all()
    assert quality.judge(none).count() == 0 and quality.clean(odd).columns == odd.columns
    with pytest.raises(ValueError, match="kept"):
        quality.judge(odd.withColumn("kept", F.lit(1)))


def test_repeated_windows_are_counted_once(spark):
    text = "a b c a b c a x y z b c a"
    n = spark.range(1).select(quality.repeat_words(F.split(F.lit(text), " ")).alias("n")).first()["n"]
    words = text.split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    assert n == len({i + o for i in range(len(words) - 2) for o in range(3) if grams[tuple(words[i : i + 3])] > 1})


@pytest.mark.parametrize("line", ["HOME | NEWS | SPORT | MORE", "BUY!! NOW!! CHEAP!!", "###a $$$b %%%c.", "no marks at all here", "Read more about this."])
def test_line_rules(spark, line):
    got = spark.createDataFrame([(line,), ("A plain line, with its marks.",), (" ",)], "x string").select("x", quality.line_fails(F.col("x")).alias("f")).collect()
    assert [r["f"] for r in got] == [True, False, False]


def test_line_dedup_edges(spark, odd, none):
    shared = "  THIS Line is Shared by Many É\t"
    rows = [(1, shared, "s"), (2, f"{shared.lower().replace('é', 'É')}\nx", "s"), (3, f"{shared}\n{shared}\n\nend\n", "s"), (None, shared, "s"), (5, "this line is shared by many é", "s")]
    got = lines.dedup_lines(documents(spark, rows)).orderBy("doc_id").collect()
    # the null id is the smallest document; 3 is the largest holder and keeps all its lines; é is not É
    assert [r["text"] for r in got] == ["", "", "x", f"{shared}\n{shared}\n\nend\n", "this line is shared by many é"]
    kept = lines.with_bitmap(odd)
    assert kept.count() == len(ODD) and lines.with_bitmap(none).count() == 0
    assert {r["n_lines"] for r in kept.where("doc_id = 2").collect()} == {1}


def test_bitmap_round_trip(spark):
    rng = random.Random(1)
    for _ in range(5):
        n = rng.randint(1, 40)
        gone = sorted(rng.sample(range(n), rng.randint(0, n)))
        text = "\n".join(f"l{i}" for i in range(n))
        df = spark.range(1).select(lines.runs_of(F.array(*map(F.lit, gone)).cast("array<int>"), F.lit(n)).alias("r"), F.lit(text).alias("t"))
        r = df.select("r", lines.apply_bitmap(F.col("t"), F.col("r")).alias("kept")).first()
        assert sum(r["r"]) == n and r["kept"] == "\n".join(f"l{i}" for i in range(n) if i not in gone)


def test_hot_line_over_few_salts(spark):
    rows = [(i, f"the one line that everybody has\nown {i}", "s") for i in range(300)]
    one, many = (lines.dedup_lines(documents(spark, rows), salts=s).orderBy("doc_id").collect() for s in (1, 64))
    assert one == many and Counter(r["text"].count("\n") for r in one) == {0: 299, 1: 1}


def test_simhash_edges(spark, odd, none):
    got = simhash.groups(odd).collect()
    fps = {i: naive_fingerprint(t) for i, t, _ in ODD if i is not None}
    want = naive_components(fps)
    assert len(got) == len(ODD)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert sorted(r["component_id"] for r in got if r["doc_id"] is None) == sorted([want[1], want[4]])
    assert simhash.groups(none).count() == 0
    assert Counter(r["doc_id"] for r in simhash.keep_one(odd).collect()) == Counter(set(want.values()))


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + "."


def test_keep_one_decides_row_by_row(spark):
    a, b, c, d, e = map(prose, range(5))
    rows = [
        (1, a, "s"), (None, a, "s"), (None, b, "s"), (None, c, "t"), (None, c, None),  # a copy and clean texts without an id
        (7, d, "s"), (7, e, "s"), (7, d, "s"), (9, e, "s"),  # two texts under one id, a repeated row, a copy of one
        (7, a, "s"),  # a copy of a smaller document beside clean texts of the same id
    ]
    got = simhash.keep_one(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", a), ("None", b), ("None", c), ("7", d), ("7", e)])
    again = simhash.keep_one(documents(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def clouds(n, seed):
    """Fingerprints at random and in dense clouds around a few of them."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 6, dtype=np.uint64)
    cloud = centres[rng.integers(0, 6, n)]
    for _ in range(4):
        cloud = cloud ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(np.concatenate([cloud, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))


@pytest.mark.parametrize("shard_rows", [20, 4096])
def test_tree_finds_every_link(spark, shard_rows):
    fps = clouds(700, shard_rows)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.components(simhash.links(df, shard_rows=shard_rows)).collect()
    roots = {r["node"]: r["root"] for r in found}
    signed = [int(x) for x in fps.view(np.int64)]
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    group = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for a, b in zip(i.tolist(), j.tolist()):
            least = min(group[signed[a]], group[signed[b]])
            changed |= group[signed[a]] != least or group[signed[b]] != least
            group[signed[a]] = group[signed[b]] = least
    assert {x: roots.get(x, x) for x in signed} == group and len(set(group.values())) < len(signed)


def test_mixing_edges(spark, odd, none):
    got = mixing.taken(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]
    assert mixing.targets([10, 1000, 10], [1, 1, 1]) == [30.0, 960.0, 30.0]
    assert sum(mixing.targets([5, 70, 3, 900], [1, 2, 3, 1])) == pytest.approx(978)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 40), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    docs = documents(spark, rows).withColumn("shard", F.lit("own"))
    taken = mixing.taken(docs).toPandas()
    by = taken.merge(docs.select("doc_id", "source").toPandas()).groupby("source").agg({"taken": "sum", "target": "first"})
    assert ((by["taken"] - by["target"]).abs() <= 40).all()
    mixed = mixing.mix(docs, shards=5).toPandas()
    assert Counter(mixed["doc_id"]) == Counter({r.doc_id: r.taken // r.size for r in taken.itertuples() if r.taken})
    sizes = mixed.groupby("_shard").size()
    assert len(sizes) == 5 and sizes.max() < 1.2 * sizes.min() and list(mixed["doc_id"]) == list(mixing.mix(docs, shards=5).toPandas()["doc_id"])


@pytest.mark.parametrize("fan_out", [2, 256])
def test_splitting_tree_spends_exact_quotas(spark, fan_out, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_OUT", fan_out)
    monkeypatch.setattr(mixing.split_node, "__defaults__", (fan_out,))
    quotas = np.array([5, 0, 1000, 37], dtype=np.int64)
    table = spark.createDataFrame(list(enumerate(quotas.tolist())), "rank int, items long")
    got = mixing.split_quotas(table, 7).toPandas()
    split = got.pivot_table(index="shard", columns="rank", values="items", fill_value=0).reindex(columns=range(4), fill_value=0).to_numpy().astype(int)
    assert (split.sum(axis=0) == quotas).all() and len(split) == 7 and np.ptp(split.sum(axis=1)) <= 3 and (split >= 0).all()
    for rank, part in got.sort_values("start").groupby("rank"):  # ranges lie end to end
        assert list(part["start"]) == [0, *part["items"].cumsum()[:-1]] and part["items"].sum() == quotas[rank]
    assert got.equals(mixing.split_quotas(table, 7).toPandas())


def test_the_query_is_dealt_to_many_even_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = mixing.plan(mixing.sized(docs)).where("shards IS NOT NULL")
    assert blocks.selectExpr("explode(shards) AS s").distinct().count() >= 8
    # a document is taken as often as shards draw it: without a shard's draw, nothing of it is taken
    mixed = mixing.mix(docs)
    dealt = mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    taken = mixing.taken(docs).toPandas()
    taken = taken[taken["size"] > 0].set_index("doc_id")
    assert ((taken["taken"] // taken["size"])[lambda n: n > 0].sort_index() == dealt.reindex(taken.index).dropna().sort_index()).all()


def test_shards_lie_one_to_a_partition(spark):
    docs = documents(spark, [(i, "w " * 20, f"s{i % 5}") for i in range(4000)])
    mixed = mixing.mix(docs, shards=12).withColumn("p", F.spark_partition_id())
    by = mixed.groupBy("p", "shard").count().collect()
    assert len(by) == 12 == len({r["p"] for r in by}) == len({r["shard"] for r in by})
    assert max(r["count"] for r in by) <= 2 * sum(r["count"] for r in by) / 12


def test_mix_keeps_columns_named_like_its_own(spark):
    docs = documents(spark, [(i, "w " * 20, f"s{i % 5}") for i in range(50)])
    own = ("__md5", "__source", "__block", "__n", "__plan", "__draws", "shard", "copy", "a.b")
    docs = docs.select("*", *[F.lit(7).alias(c) for c in own])
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "_shard", "_copy"] and all(r[c] == 7 for r in got.collect() for c in own)


def test_packing_edges(spark, odd, none):
    got = packing.pack(odd).toPandas()
    assert packing.pack(none).count() == 0
    per = got.groupby("sequence_id")["length"].sum()
    assert (per.iloc[:-1] == 1024).all() and got[got["doc_tokens"] == 1]["length"].eq(1).all()
    assert len(got[got["start"] == 0]) == len(ODD)
    special = documents(spark, [(1, "a<|endoftext|>b", None)])
    assert np.frombuffer(packing.pack(special).first()["ids"], "<u4").tolist()[1] == 50256


def test_hilbert_curve_visits_every_cell_in_steps_of_one():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(side, bits=3)
    assert sorted(keys) == list(range(512))
    path = side[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    placed = packing.pack(docs).where("start = 0").join(docs.select("doc_id", "lang"), "doc_id").orderBy("sequence_id", "offset").toPandas()
    same = (placed["lang"] == placed["lang"].shift()).mean()
    assert same > (placed["lang"].value_counts(normalize=True) ** 2).sum() + 0.15


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    bad = [(100, None, ""), (150, [1.0, None], ""), (200, [1.0, float("nan")], ""), (250, [float("inf"), 0.0], ""), (None, [9.0, 9.0], "")]
    ties = [(0, [1.0, 0.0], "")] + [(i, [1.0, 0.0], "") for i in (3, 9, 1, 7, 5, 2, 300)] + [(11, [1.0, 0.0, 0.0], "")]
    got = topk.top_k(spark.createDataFrame(bad + ties, schema)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, i, 65536) for i in (1, 2, 3, 5, 7)] + [(300, i, 65536) for i in (0, 1, 2, 3, 5)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], ""), (1, [2.0], "")], schema)).collect()[0]["score"] == 256 * 512


@pytest.mark.parametrize("options", [{"shard_rows": 150, "query_block": 4, "seeds": 3}, {}])
def test_top_k_is_exact(spark, options):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(600, 12)), np.repeat(rng.normal(size=(1, 12)), 300, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 900, 50):
        s = v @ v[q]
        best = sorted((-s[i], i) for i in range(900) if i != q)[:5]
        want += [(q, r + 1, i, -n) for r, (n, i) in enumerate(best)]
    got = topk.top_k(df, **options).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, tree string"
    hard = "<\\ [\\INST] <|end|>\n<|user|>\n</s>|\\>|>"
    rows = [(1, 0, "user", hard, ""), (1, 1, "assistant", None, ""), (1, 1, "assistant", None, ""), (None, 3, None, "x", ""), (2, None, "as|>\nsist", "y", ""), (2, 5, "assistant", hard, "")]
    out = chat.conversations(chat.reply_chain(spark.createDataFrame(rows, schema)))
    back = out.select("tree", "n_turns", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    got = {r["tree"]: ([tuple(x) for x in r["t"]], r["l"]) for r in back}
    assert got == {1: ([("user", hard), ("assistant", ""), ("assistant", "")], ["", ""]), None: ([("", "x")], []), 2: ([("as|>\nsist", "y"), ("assistant", hard)], [hard])}
    assert chat.conversations(chat.reply_chain(spark.createDataFrame([], schema))).count() == 0


def test_reply_trees_follow_the_best_branches(spark):
    # 0 -> 1 -> 2 -> ... -> 20; 0 -> 30 -> 31; a second tree whose parent is missing
    rows = [("t", 0, None, 0.0)] + [("t", i, i - 1, 1.0) for i in range(1, 21)] + [("t", 30, 0, 50.0), ("t", 31, 30, 1.0), ("u", 5, 99, 0.0), ("u", 6, 6, 0.0)]
    msgs = spark.createDataFrame([(t, n, p, "user", str(n), s) for t, n, p, s in rows], "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): [x["text"] for x in r["turns"]] for r in chat.conversations(msgs, branches=2).select("tree", "rank", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {("t", 1): ["0", "30", "31"], ("t", 2): [str(i) for i in range(21)], ("u", 1): ["5"], ("u", 2): ["6"]}
    with pytest.raises(ValueError, match="cycle"):
        chat.conversations(spark.createDataFrame([("t", 1, 2, "u", "", 0.0), ("t", 2, 1, "u", "", 0.0)], "tree string, node long, parent long, role string, text string, score double"))


def test_warc_edges(spark, tmp_path):
    schema = "page_id long, url string, html string, record_type string"
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
    pages = [(1, "http://x/%41 b\r\nc", trap, ""), (5, None, trap, ""), (5, None, trap, ""), (2, "u", None, ""), (3, "u", "", ""), (None, "u", "é", ""), (4, "u", "é", ""), (7, "u", "z" * 300000, "")]
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame(pages, schema), path, records_per_file=3)
    got = warc.read(spark, path)
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"] and bytes(r["payload"]).decode()) for r in got.collect()), key=str)
    want = [(1, "revisit", 5, len(trap), None), (5, "response", None, len(trap), trap), (5, "response", None, len(trap), trap), (2, "revisit", 3, 0, None), (3, "response", None, 0, b""), (None, "revisit", 4, 2, None), (4, "response", None, 2, "é"), (7, "response", None, 300000, "z" * 300000)]
    assert rows == sorted(((*w[:4], w[4] or w[4]) for w in want), key=str)
    assert got.where("page_id = 1").first()["url"] == "http://x/%41 b\r\nc" and got.where("page_id = 5").first()["url"] is None
    assert warc.read(spark, path, payload=False).where("record_type = 'revisit' and page_id >= 2").count() == 1
    warc.write(spark.createDataFrame([], schema), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_warc_pushes_predicates_down():
    reader = warc.WarcReader({"files": "file:///a\t9\nfile:///b\t9\nfile:///c\t9", "partitionbytes": "20"})
    from pyspark.sql.datasource import EqualTo, StringStartsWith
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("url",), "h")]))
    assert [type(f).__name__ for f in left] == ["StringStartsWith"] and len(reader.filters) == 1
    assert [p.paths for p in reader.partitions()] == [["file:///a", "file:///b"], ["file:///c"]]


@pytest.mark.parametrize("text, kinds", [
    ("mail john.doe@example.com or jane@b", ["john.doe@example.com"]),
    ("write to john (at) example [dot] com now", ["john (at) example [dot] com"]),
    ("write to john at example dot co dot uk.", ["john at example dot co dot uk"]),
    ("write to john@example dot com.", ["john@example dot com"]),
    ("mail jоhn@exаmple.com here", ["jоhn@exаmple.com"]),
    ("j​ohn＠example．com", ["j​ohn＠example．com"]),
    ("call plus four nine one seven six one two three four five six seven, please", ["plus four nine one seven six one two three four five six seven"]),
    ("host one nine two dot one six eight dot zero dot one up", ["one nine two dot one six eight dot zero dot one"]),
    ("card four five three two zero one five one one two eight three zero three six six.", ["four five three two zero one five one one two eight three zero three six six"]),
    ("look at this dot on the map at noon (at last) [or so]", []),
    ("one two three four five", []),
    (None, []),
])
def test_pii_disguises(text, kinds):
    plain = pii.find_plain(text or "")
    found = sorted(plain + pii.find_disguised(text or "", plain))
    assert [text[a:b] for a, _, b in found] == kinds


@pytest.mark.parametrize("text, plain, whole", [
    ("to jоhn@example.com now", "hn@example.com", "jоhn@example.com"),
    ("to john@example.cоm now", "john@example.c", "john@example.cоm"),
    ("call +49 176 12345６７ now", "+49 176 12345", "+49 176 12345６７"),
    ("host 10.1.2.3４ up", "10.1.2.3", "10.1.2.3４"),
])
def test_pii_disguise_beside_a_plain_fragment(text, plain, whole):
    base = pii.find_plain(text)
    added = pii.find_disguised(text, base)
    assert [text[a:b] for a, _, b in base] == [plain] and [text[a:b] for a, _, b in added] == [whole]
    assert {k for _, k, _ in base} == {k for _, k, _ in added}


@pytest.mark.parametrize("gap", list(pii.ZERO_WIDTH))
@pytest.mark.parametrize("kind, left, right", [
    ("email", "john@exa", "mple.com"), ("email", "jo", "hn@example.com"), ("email", "john", "@example.com"), ("email", "john@example.c", "om"),
    ("ip", "192.16", "8.1.1"), ("card", "45320151", "12830366"), ("card", "4532 0151 ", "1283 0366"), ("phone", "+49 176", " 12345678"), ("phone", "+", "49 176 12345678"),
])
def test_pii_deletion_as_the_only_disguise(kind, left, right, gap):
    whole = left + gap + right
    text = f"{gap}see {whole}{gap} and j@b.com here"
    base = pii.find_plain(text)
    added = pii.find_disguised(text, base)
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in added] == [(whole, kind)]


def test_pii_edges(spark, odd, none):
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab1203.@+-_ %(") for _ in range(rng.randint(0, 60)))
        assert pii.find_plain(t) == sorted((a, k, b) for k, s in enumerate(naive_spans(t)) for a, b in s), t
    long = "a" * 300000 + "1" * 300000 + "@" * 1000 + "+" * 100000 + " one" * 50000 + " at" * 50000 + " dot" * 50000 + "(at" * 50000
    assert pii.find_plain(long) == [] and pii.find_disguised(long, []) == []
    assert pii.detect(odd).count() == len(ODD) and pii.detect(none).count() == 0


def test_html_edges(spark):
    schema = "page_id long, url string, html string, blocks string"
    cases = {
        1: None, 2: "", 3: "<article><p>One &amp; two\n three<p>Four<br>five &am</article><p>out",
        4: "<body><article><h1>T</h1><p>Body text of the page.</p><div class=comments><p>I agree with all of this.</p></div></article><div class='ad'>Buy.</div>",
        5: "<main><p>Text &lt;b&gt; stays</p><script>if (a<b) x('</p>')</script><style>p{}</style><!-- gone --><form><p>Name</p></form><p>End &copy; 2</p></main><aside>Side.</aside>",
        6: "<article><p>Cut in a tag <b", 7: "plain words without any tag " * 4,
    }
    rows = [(i, None, h, "own") for i, h in cases.items()] + [(3, None, cases[3], "own")]
    with_own = spark.createDataFrame(rows, schema).drop("blocks")
    got = {r["page_id"]: r["text"] for r in html.extract(with_own).collect()}
    assert got[1] == got[2] == ""
    assert got[3] == "One & two three\nFour five &am"
    assert got[4] == "T\nBody text of the page."
    assert got[5] == "Text <b> stays\nEnd © 2"
    assert got[6] == "Cut in a tag"
    assert html.extract(with_own.limit(0)).count() == 0


def test_tree_holds_on_unseen_layouts(spark):
    """Block accuracy on pages with other sizes than the labelled ones."""
    model = html.train(spark)
    para = html._filler
    pages = [
        (f"<body><nav><a href=a>A</a></nav><article><header><h1>Head</h1></header><p>{para(33)}</p><p>{para(2)}</p></article><footer>{para(12)}</footer></body>", ["Head", para(33), para(2)]),
        (f"<div id=main-menu><a href=a>Home</a> <a href=b>Other</a></div><div class=entry-content><h2>Head</h2><p>{para(50)}</p><p>{para(45)}</p></div><div class=related-posts><p>{para(25)}</p></div>", ["Head", para(50), para(45)]),
        (f"<main><p>{para(28)}</p><ul><li>{para(6)}</li><li>{para(4)}</li></ul></main><div role=navigation>{para(30)}</div>", [para(28), para(6), para(4)]),
    ]
    rows = [(i, h) for i, (h, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert [got[i].split("\n") for i in range(len(pages))] == [t for _, t in pages] and model.depth >= 2


@pytest.mark.parametrize("text, kind", [
    ("write to 𝐣𝐨𝐡𝐧@example.com now", "email"), ("𝐣ohn@example.com", "email"), ("joɡh@example.com", "email"), ("joһn@example.com", "email"),
    ("john@ⓔxample.com", "email"), ("john@example·com", "email"), ("call +٤٩ ١٥٢ ٣٤٥ ٦٧٨٩", "phone"), ("call +①② ③④⑤ ⑥⑦⑧ ⑨⓪①", "phone"), ("call +49‑152‑345‑6789", "phone"),
    ("at 192·168·10·20 it is", "ip"), ("card ４１１１ １１１１ １１１１ １１１１ x", "card"),
])
def test_forms_and_confusables_are_seen_through(text, kind):
    spans = pii.find_disguised(text, pii.find_plain(text))
    k = pii.KINDS.index(kind)
    (found,) = [s for s in spans if s[1] == k]
    first = next(i for i, c in enumerate(text) if not c.isascii())
    assert found[0] <= first < found[2]


def test_long_runs_of_digit_words_are_cut_nowhere():
    words = " ".join(["one"] * 500)
    assert pii.rewrite(f"x {words} y").text == f"x {'1' * 500} y"


def warc_record(kind, block, *fields, eol="\r\n"):
    head = eol.join(["WARC/1.0", *([f"WARC-Type: {kind}"] if kind else []), *fields, f"Content-Length: {len(block)}"])
    return f"{head}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [
        warc_record("warcinfo", b"software: other\r\n"), warc_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Target-URI: <http://a/>"),
        warc_record("response", http + b"<p>one\r\n\r\ntwo</p>", "warc-target-uri:http://a/", "WARC-Payload-Digest: sha1:ABC", "WARC-Record-ID: <urn:uuid:1>"),
        warc_record("metadata", b"k: v", "X-Folded: a", " b"), warc_record("response", http + b"x" * 200_000), warc_record("revisit", b"", "WARC-Refers-To: <urn:uuid:1>"),
        warc_record("resource", b"plain"), warc_record(None, b""),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(b"".join(records))
    (tmp_path / "w/b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "w/c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "w/empty.warc").write_bytes(b"")
    path = f"file://{tmp_path}/w"
    rows = warc.read(spark, path).toPandas()
    assert len(rows) == 24
    for kind, n, payload in (("warcinfo", 17, b"software: other\r\n"), ("metadata", 4, b"k: v"), ("resource", 5, b"plain"), ("request", 0, b"")):
        mine = rows[rows["record_type"] == kind]
        assert list(mine["payload_bytes"]) == [n] * 3 and list(map(bytes, mine["payload"])) == [payload] * 3
    responses = rows[rows["record_type"] == "response"]
    assert sorted({(n, bytes(p)) for n, p in zip(responses["payload_bytes"], responses["payload"])}) == [(17, b"<p>one\r\n\r\ntwo</p>"), (200_000, b"x" * 200_000)]
    assert set(rows["url"].dropna()) == {"http://a/"} and set(rows["payload_digest"].dropna()) == {"ABC"} and rows["record_type"].isna().sum() == 3
    assert rows[rows["record_type"] == "revisit"]["payload"].isna().all()
    bare = warc.read(spark, path, payload=False).where("record_type = 'response' AND payload_bytes > 100").collect()
    assert [r["payload_bytes"] for r in bare] == [200_000] * 3 and all(r["payload"] is None for r in bare)


def test_archives_stay_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    pages = spark.createDataFrame([(i, "u", f"{i}" + "y" * 20_000) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) >= 5 and max(f.stat().st_size for f in files) < 60_000 and warc.read(spark, f"file://{tmp_path}/w").count() == 12
    reader = warc.WarcReader({"files": "file:///a\t9\nfile:///b\t9"})
    assert reader.partitions() and not reader.files
