"""The block tree: what it learns, and markup that is deep, unclosed or without any name."""

import time

from pyspark.ml.feature import VectorAssembler

from paceline.llm import html
from paceline.llm.html import FEATURES, _filler


def text_of(spark, page):
    return html.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()["text"]


def test_link_densities_decide(spark):
    model = html.train(spark)
    weight = dict(zip(FEATURES, model.featureImportances.toArray()))
    assert weight["links"] + weight["prev_links"] + weight["next_links"] > 0.4 and weight["next_links"] + weight["prev_links"] > 0.01
    held = spark.createDataFrame(html.labelled_blocks(html.labelled_pages(seed=99)), ", ".join(f"{f} double" for f in FEATURES) + ", label double")
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(held))
    right, n = judged.selectExpr("count_if(prediction = label)", "count(*)").first()
    assert right > 0.99 * n


def test_labels_come_from_the_marks_alone():
    rows = html.labelled_blocks()
    at = {f: i for i, f in enumerate(FEATURES)}
    bare = [r for r in rows if r[at["place"]] == 0 and not r[at["furniture"]]]
    assert len(bare) > len(rows) / 2 and 0.1 < sum(r[-1] for r in bare) / len(bare) < 0.9
    assert any(r[at["furniture"]] and r[-1] for r in html.labelled_blocks([f"<div class='promo'><p>{_filler(30)}{html.MARK}</p></div>"]))


def test_menus_without_names_go(spark):
    ps = [_filler(40), _filler(30, 3)]
    links = ["Home", "All the latest world news from everywhere today", "Sport results of the whole week in one place"]
    menu = "".join(f"<div><a href='/x'>{t}</a></div>" for t in links)
    assert text_of(spark, menu + "".join(f"<p>{p}</p>" for p in ps)) == "\n".join(ps)
    assert text_of(spark, "".join(f"<p>{p}</p>" for p in ps) + menu) == "\n".join(ps)


def test_an_unclosed_head_hides_nothing(spark):
    ps = [_filler(20), _filler(25, 4)]
    body = "".join(f"<p>{p}" for p in ps)
    for page in (f"<html><head><title>t</title>{body}</html>", f"<head><meta charset=x><style>p{{}}</style>{body}", f"<title>t</title>{body}"):
        assert text_of(spark, page) == "\n".join(ps)


def test_links_count_at_any_depth():
    deep = "<a href='/x'>" + "<div>" * 40 + "read all of this" + "</div>" * 40 + "</a>"
    assert [b["links"] for b in html.flat_blocks(deep)] == [1.0]
    heading = "<h2>" + "<span>" * 40 + "a title" + "</span>" * 40 + "</h2><p>text</p>"
    assert [b["heading"] for b in html.flat_blocks(heading)] == [1.0, 0.0]


def test_end_tags():
    blocks = lambda page: [b["text"] for b in html.flat_blocks(page)]
    assert blocks("<a>one<div>two</a>three</div>four") == ["one", "twothree", "four"]
    assert [b["links"] for b in html.flat_blocks("<a>one</a><div>two</div>")] == [1.0, 0.0]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert blocks("</p></div>text</section>") == ["text"]


def test_long_broken_markup_takes_linear_time():
    for page in ("<font>" * 100_000 + "x", "<div>" * 50_000 + "x" + "</span>" * 50_000, "<div>" + "<font>" * 50_000 + "<p>" * 50_000, "<p>" * 100_000, "</font>" * 100_000):
        start = time.process_time()
        html.flat_blocks(page)
        assert time.process_time() - start < 4  # under a second when nothing else runs
