"""Differencing against plain versions, blocks that only a class marks, and pages that would take long."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from missive.llm import html_text


def longest(a, b):
    """Length of a longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


def is_subsequence(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


@pytest.mark.parametrize("few", [0, 16])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, few):
    monkeypatch.setattr(html_text, "FEW_MATCHES", few)
    rng = random.Random(6)
    for _ in range(600):
        letters = rng.choice([1, 2, 4, 30])
        a, b = ([rng.randrange(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        found = sorted(html_text.common_lines(a, b))
        assert len(found) == longest(a, b) and is_subsequence([a[k] for k in found], b)
    assert html_text.common_lines([], []) == set()


def test_long_pages_take_little_time():
    began = time.time()
    assert len(html_text.common_lines([1, 2] * 3000, [2, 1] * 3000)) == 5999
    assert len(html_text.common_lines([k % 7 for k in range(20_000)], [k % 5 for k in range(20_000)])) > 4000
    assert html_text.lines_of("<div>" * 20_000 + "</p>" * 20_000) == []
    assert len(html_text.lines_of("<p>a" * 20_000 + "</b>" * 20_000)) == 20_000
    assert len(html_text.lines_of("<div>a" * 20_000 + "</div>" * 20_000)) == 20_000
    html_text.lines_of("<a " * 100_000)
    html_text.lines_of("<script>" * 50_000)
    assert time.time() - began < 20


def brute_nearest(rows):
    """For each (page_id, host, path, same): of the nearest ones before and after it with another ``same``, in the order of
    host, path, same and page_id, the one with the longer common beginning."""
    order = sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0]))

    def run_end(k, step):
        host, same = order[k][1], order[k][3]
        while 0 <= k < len(order) and (order[k][1], order[k][3]) == (host, same):
            k += step
        return order[k] if 0 <= k < len(order) and order[k][1] == host else None

    def shared(a, b):
        return sum(1 for _ in itertools.takewhile(lambda xy: xy[0] == xy[1], zip(a, b)))

    want = {}
    for k, row in enumerate(order):
        before, after = run_end(k, -1), run_end(k, 1)
        best = max([x for x in (before, after) if x], key=lambda x: shared(x[2], row[2]), default=None)
        want[row[0]] = best and best[0]
    return want


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_nearest_pages_equal_brute_force(spark, parts, monkeypatch):
    rng = random.Random(parts)
    rows = [(k, rng.choice("ab"), "/" + "/".join(rng.choices(["x", "xy", "y", "news", "2020", "é"], k=rng.randrange(4))), rng.randrange(4)) for k in range(60)]
    rows += [(100 + k, "runs", f"/{k}", 1) for k in range(30)] + [(200, "runs", "/999", 2), (300, "alone", "/", 1), (301, "alone", "/b", 1)]
    rows += [(400, "long", "/" + "p" * 50_000 + "a", 1), (401, "long", "/" + "p" * 50_000 + "b", 2), (402, "long", "/" + "p" * 49_999 + "c", 3)]
    pages = spark.createDataFrame([(k, f"https://{host}{path}?q={k}#f", same) for k, host, path, same in rows], "page_id long, url string, same long")
    real = type(spark.sparkContext).defaultParallelism.fget
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: parts))
    got = {r.page_id: r.nearest_id for r in html_text.nearest_pages(pages).collect()}
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(real))
    assert got == brute_nearest(rows)


def texts(spark, *pages):
    rows = [(k, f"http://h.org/{k}", page) for k, page in enumerate(pages)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("lines", F.lit(1)).withColumn("packed", F.lit(2)))
    return [r.text for r in got.orderBy("page_id").collect()]


def test_an_article_keeps_its_own_blocks(spark):
    page = '<article><header><h1>Title</h1></header><figure><img src=x><figcaption>A picture</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p class="x-search">found</p><svg><text>no</text></svg></article>'
    assert texts(spark, page) == ["Title\nA picture\nSo x=2 holds\nfound"]


def test_differencing_decides_on_doubtful_blocks(spark):
    """What only a word of a class marks inside an article goes where the nearest page has it too, and stays elsewhere."""
    page = '<article><p>{0}</p><div class="{1}">Search our site</div><p>Both pages say this.</p><div class="{1}">body {0}</div></article>'
    rows = []
    for k, mark in enumerate(sorted(html_text.DOUBTFUL)):
        rows += [(3 * k, f"http://{mark}.org/a", page.format("one", mark)), (3 * k + 1, f"http://{mark}.org/b", page.format("two", mark)), (3 * k + 2, f"http://alone-{mark}.org/", page.format("one", mark))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(len(html_text.DOUBTFUL)):
        assert [got[3 * k + j] for j in range(3)] == ["one\nBoth pages say this.\nbody one", "two\nBoth pages say this.\nbody two", "one\nSearch our site\nBoth pages say this.\nbody one"]


@pytest.mark.parametrize("mark", sorted(html_text.MARKS - html_text.DOUBTFUL))
def test_plain_marks_need_no_differencing(spark, mark):
    assert html_text.main_text(html_text.lines_of(f'<article><p>one</p><div class="my-{mark}">Other</div></article>'), None) == "one"
    assert not html_text.in_doubt(html_text.lines_of(f'<article><p>one</p><div class="{mark}">Other</div></article>'))


def test_pages_without_an_article_keep_what_they_do_not_share(spark):
    pages = [f"<div>Site</div><div>{k} own</div><p>shared {k // 2}</p><form>ask</form><div>Imprint</div>" for k in range(4)]
    got = texts(spark, *pages, None, "")
    assert got[0] == "0 own" and got[3] == "3 own" and got[4:] == ["", ""]
    assert all("Site" not in t and "Imprint" not in t and "ask" not in t for t in got)
