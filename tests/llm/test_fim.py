"""Fill-in-the-middle: units and cuts from chunk summaries against a plain reading of the text, exact round trips."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paceline.llm import fim
from test_edges import GOOD, ODD, documents
from test_names import own

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def naive(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h1, h2, h3, h4 = fim.draws(doc_id)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows):
    got = fim.transform(documents(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    found = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["back"]) for r in got)
    want = [(d, t or "", *naive(d, t)) for d, t, _ in rows]
    assert found == sorted((str(d), n, form, str(p), str(m), out, t) for d, t, n, form, p, m, out in want)
    return {r["form"] for r in got}


@pytest.mark.parametrize("least, most", [(1, 4), (1, 7), (3, 40), (64, 4096)])
def test_units_do_not_depend_on_the_chunks(least, most):
    rng = random.Random(least * most)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", " ", "\n", " ", "é", "漢字", "\t ", "😀"]) for _ in range(rng.randrange(120)))
        data, units = text.encode(), UNIT.findall(text)
        ends = fim.chunk_ends(data, least, most)
        assert ends == sorted(set(ends)) and (ends[-1:] or [0])[0] == len(data)
        assert all(data[a:b].decode() for a, b in zip([0, *ends], ends))  # never inside a code point
        found = fim.Units(data, fim.Memo(64), ends)
        assert found.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert found.cut(k) == (len(head.encode()), len(head))


def test_rolling_hash_across_strips(monkeypatch):
    data = random.Random(3).randbytes(5000).replace(b"\x80", b"a")
    whole = fim.candidates(data)
    monkeypatch.setattr(fim, "STRIP", 97)
    assert fim.candidates(data) == whole and len(whole) > 5


def test_shared_passages_are_scanned_once():
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, memo = words(2000), fim.Memo()
    fim.Units(passage.encode(), memo)
    before, asked = memo.found, memo.asked
    for _ in range(20):
        fim.Units(f"{words(rng.randrange(5, 40))} {passage} {words(7)}".encode(), memo)
    assert memo.found - before > 0.9 * (memo.asked - asked)


def test_memo_is_bounded():
    memo = fim.Memo(1000)
    for i in range(500):
        memo(b"%0100d" % i)
    assert len(memo.young) + len(memo.old) <= 20


def test_round_trip_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["word", " ", "\n", "é", "<", "S", ">", "<S", "P>"]) for _ in range(rng.randrange(300))), "s") for i in range(300)]
    rows += [(1000 + i, f"{GOOD} {m} {GOOD}", "s") for i, m in enumerate(("<P>", "<S>", "<M>", "<Q>")) for _ in range(3)]
    assert check(spark, rows + ODD) == {"plain", "psm", "spm"}
    check(spark, [(i, " \n" * i, None) for i in range(20)])
    assert fim.transform(documents(spark, [])).count() == 0


def test_extra_columns(spark):
    docs = own(documents(spark, [(i, GOOD, "a") for i in range(8)]), *fim.RESULTS, "data", "a.b")
    got = fim.transform(docs)
    assert got.columns == [c for c in docs.columns if c != "text"] + [f"_{c}" for c in fim.RESULTS]
    assert all(r[c] == f"own {c}" for r in got.collect() for c in (*fim.RESULTS, "data", "a.b"))
