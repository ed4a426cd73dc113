"""The registered queries on the smallest tables, against independent brute-force versions."""

import hashlib
import html as html_lib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from compare import connect, difference
from paceline.llm import oracle, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).toPandas()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, sf, name):
    assert difference(rows(spark, sf, name), connect(sf).execute(oracle.SQL[name]).df()) is None


def test_all_are_registered():
    names = entry.queries()
    assert {m[1] for n in names if (m := re.match(r"op(\d+)_", n))} == {str(i) for i in range(1, 14)}
    assert "pipeline" in names and set(oracle.SQL) <= set(entry.oracle_sql())


def test_html(spark, sf):
    """The articles of the generated pages, cut out by their known markup."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    got = rows(spark, sf, "op1_html_extraction")
    assert len(got) == len(pages)
    for r in got.itertuples():
        raw = pages.loc[r.page_id, "html"]
        article = re.split(r"</article>", raw.split("<article>")[1])[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        clean = [re.sub(r"\s+", " ", html_lib.unescape(p)).strip() for p in parts]
        assert r.text == "\n".join(p for p in clean if p)
        assert r.n_chars == len(r.text)


def check_packing(got, docs):
    """Every token in one piece, sequences gapless and full but for the last one."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in got.itertuples():
        pieces[r.doc_id].append(r)
    for d in docs.itertuples():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(pieces.pop(d.doc_id), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine] == [r.ids_crc32 for r in mine]
    assert not pieces
    filled = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024
        filled += s["length"].sum() == 1024
    assert filled >= got["sequence_id"].nunique() - 1


def test_packing(spark, sf, docs):
    check_packing(rows(spark, sf, "op2_packing"), docs)


def naive_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps):
    """``{doc: smallest doc reachable}`` from ``{doc: fingerprint}``."""
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_simhash(spark, sf, docs):
    got = rows(spark, sf, "op5_simhash")
    fps = {d.doc_id: naive_fingerprint(d.text) for d in docs.itertuples()}
    roots = naive_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {d: (f"{fps[d]:016x}", roots[d]) for d in fps}
    assert len(got) == len(docs) and len(set(roots.values())) < len(docs)


def naive_spans(text):
    """The plain patterns as they are stated, with their checks."""
    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return [[(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for p, ok in kinds]


def test_pii(spark, sf, docs):
    got = rows(spark, sf, "op7_pii").set_index("doc_id")
    names = ("email", "ip", "card", "phone")
    some = 0
    for d in docs.itertuples():
        spans = naive_spans(d.text)
        r = got.loc[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans]
        plain = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, s in enumerate(spans) for a, b in s))
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert set(plain.split(",")) <= set(r.spans.split(","))
        some += bool(plain)
    assert some


def test_pipeline(spark, sf, docs):
    """Every stage against a plain version of itself, on what the stage before it kept."""
    import corpus_pipeline

    got, want = corpus_pipeline.run(spark, sf).toPandas(), plain_pipeline(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = [n * (len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for t, n in zip(want["text"], want["copies"])]
    assert got.groupby("doc_id")["length"].sum().to_dict() == dict(zip(want["doc_id"], tokens))
    assert got.groupby("sequence_id")["length"].sum().iloc[:-1].eq(1024).all()
    assert sum(len(x) for x in got["ids"]) == 4 * got["length"].sum()


def plain_pipeline(docs):
    """The first four stages over a pandas table."""
    judged = docs.assign(text=[plain_clean(t) for t in docs["text"]]).dropna(subset=["text"])
    lined = judged.assign(text=plain_line_dedup(dict(zip(judged["doc_id"], judged["text"]))))
    roots = naive_components({d.doc_id: naive_fingerprint(d.text) for d in lined.itertuples()})
    kept = lined[[roots[d] == d for d in lined["doc_id"]]]
    return kept.assign(copies=plain_copies(kept)).query("copies > 0")


def plain_clean(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {i + o for at in places.values() if len(at) > 1 for i in at for o in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    phrases = oracle.BOILERPLATE

    def fails(line):
        n = len(WORD.findall(line))
        return n and (
            not re.search("[.,;:!?…。！？،؟।]", line) or ("!!" in line and line.upper() == line and len(line) >= 10) or len(re.findall(r"[#*$%&|<>]", line)) * 10 > len(line)
            or len(re.findall("[|»›·•→]", line)) * 3 > n or (len(line) < 160 and any(p in line.lower() for p in phrases))
        )

    lines = text.split("\n")
    chars = lambda t: sum(map(len, WORD.findall(t)))
    if sum(chars(x) for x in lines if fails(x)) * 2 > chars(text):
        return None
    return "\n".join(x for x in lines if not fails(x))


def plain_line_dedup(texts):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(d)
    gone = lambda d, line: len(k := key(line)) >= 20 and len(holders[k]) >= 3 and d != max(holders[k])
    return ["\n".join(x for x in t.split("\n") if not gone(d, x)) for d, t in texts.items()]


def plain_copies(kept):
    """Copies of each row in the mix."""
    size = [len(WORD.findall(t)) for t in kept["text"]]
    hashes = [hashlib.md5(f"mix|{d}".encode()).hexdigest() for d in kept["doc_id"]]
    by = defaultdict(list)
    for s, n, h in zip(kept["source"], size, hashes):
        by[s].append((hashlib.md5(f"mix|{s}|{int(h[:3], 16)}".encode()).hexdigest(), h, n))
    names = sorted(by)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(n for _, _, n in by[s]) for s in names}
    target, open_ = {}, set(names)
    while True:
        rest = sum(total.values()) - sum(target.values())
        share = {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        open_ -= over
    target |= share
    extra = set()
    for s in names:
        left = target[s] - int(target[s] / total[s]) * total[s]
        blocks = defaultdict(list)
        for b, h, n in by[s]:
            blocks[b].append((h, n))
        for b in sorted(blocks):
            block = sum(n for _, n in blocks[b])
            if block <= left:
                extra |= {h for h, _ in blocks[b]}
            elif left > 0:
                upto = 0
                for h, n in sorted(blocks[b]):
                    upto += n
                    if upto - n / 2 < left:
                        extra.add(h)
            left -= block
    return [int(target[s] / total[s]) + (h in extra) for s, h in zip(kept["source"], hashes)]
