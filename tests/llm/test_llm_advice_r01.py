"""What the review of round 1 found missing, on small tables."""

import random

import duckdb
import pytest

from missive.llm import html_text, licenses, mixing


def page(*own):
    return "<div>Site name</div>" + "".join(f"<p>{x}</p>" for x in own) + "<p>All the same here</p>"


def texts(spark, rows):
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return sorted((r.page_id, r.text) for r in got)


def test_repeated_and_copied_pages_keep_their_text(spark):
    rows = [(1, "http://a.b/x", page("one")), (1, "http://a.b/x", page("one")), (2, "http://a.b/y?p=1", page("two")), (3, "http://a.b/y?p=2", page("two")), (4, "http://a.b/y#top", page("two"))]
    rows += [(5, "http://a.b/z/1", page("three")), (6, "http://a.b/z/2", page("three")), (7, "http://c.d/1", page("alone")), (8, "http://c.d/2", page("alone"))]
    alone = "Site name\nalone\nAll the same here"
    assert texts(spark, rows) == [(1, "one"), (1, "one"), (2, "two"), (3, "two"), (4, "two"), (5, "three"), (6, "three"), (7, alone), (8, alone)]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_pages_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"http://h{rng.randrange(3)}/{rng.choice('ab')}/{rng.randrange(9)}", rng.choice([1, 1, 1, 1, 2, 3])) for k in range(80)]
    rows += [(100 + k, f"http://h9/{k:03}", 5 if k in (0, 149) else 4) for k in range(150)]
    got = {r.page_id: r.nearest_id for r in html_text.nearest_pages(spark.createDataFrame(rows, "page_id long, url string, same long")).collect()}
    keys = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], same, k) for k, u, same in rows)

    def common(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {}
    for n, (host, path, same, k) in enumerate(keys):
        sides = [next((r for r in side if r[0] == host and r[2] != same), None) for side in (keys[:n][::-1], keys[n + 1 :])]
        sides = [r for r in sides if r]
        want[k] = max(sides, key=lambda r: common(path, r[1]))[3] if sides else None
    assert got == want


@pytest.mark.parametrize("start", ["<body class='overflow-hidden'>", "<body><article class=\"overflow-x-hidden\">", "<body><div data-x='aria-hidden=true' class=hidden-xs>", "<body><div title='display:none hidden'>", "<body><div aria-hidden=false>", "<body><div hidden=false>", "<body><div style='--display: nonesuch'>"])
def test_what_only_names_hidden_stays(start):
    lines = html_text.lines_of(f"{start}<p>see <a href=\"/hidden-valley\" title=\"Hidden gems\">the valley</a> there</p>")
    assert [(x.text, x.template) for x in lines] == [("see the valley there", False)]


@pytest.mark.parametrize("rest", ["hidden", "class=a hidden", "HIDDEN=''", "hidden=hidden", "style='color:red; Display : none'", "style=display:none", "aria-hidden=true", "aria-hidden = \"true\"", "hidden/", "data-x=\"a'b\" hidden"])
def test_hidden_parts_go(rest):
    assert all(x.template for x in html_text.lines_of(f"<div {rest} ><p>no</p></div>"))


def near(r):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in r)


@pytest.mark.parametrize("rows", [1 << 20, 40])
def test_mixing_takes_the_same_in_more_parts(spark, tmp_path, monkeypatch, rows):
    rng = random.Random(2)
    table = [(k, "w " * rng.choice([0, 5, 100, 101, 102, 103]), rng.choice(["s0", "s1", "s2", "s2", "s2", None])) for k in rng.sample(range(10_000), 400)]
    spark.createDataFrame(table, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(mixing, "BLOCK_ROWS", rows)
    got = mixing.op5_source_mixing(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = connection.execute(mixing.ORACLE_SQL)
    names = [c[0] for c in found.description]
    assert sorted(near(r[n] for n in names) for r in got.collect()) == sorted(map(near, found.fetchall()))


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD4 = BSD2 + """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software
   developed by the University of California, Berkeley and its contributors.
""" + BSD3[len(BSD2) :].replace("3.", "4.").replace("copyright holder", "University")
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_licenses_of_wrapped_notices(spark):
    want = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "BSD-4-Clause": BSD4, "GPL-3.0-or-later": GPL, "LGPL-2.1-or-later": LGPL, "MPL-2.0": MPL, "ISC": ISC, "Apache-2.0": APACHE}
    want |= {"GPL-2.0-or-later": GPL.replace("3 of", "2 of"), "AGPL-3.0-or-later": GPL.replace("GNU", "GNU Affero").replace("This program", "Foo bar"), "LGPL-3.0-or-later": LGPL.replace("2.1", "3")}
    want |= {"CC0-1.0": "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.", "": "We keep the copyright; a licence\nof our own.\n\nRedistribution is forbidden."}
    styles = [lambda t: t, lambda t: t.replace("\n", "\r\n")] + [lambda t, m=m: "\n".join(f"{m} {x}".rstrip() for x in t.split("\n")) for m in ("#", " *", "//", ";;", "rem")] + [lambda t: "before it.\n\n" + t + "\n\nafter it"]
    rows = [(n, k, style(text)) for n, style in enumerate(styles) for k, text in enumerate(want.values())]
    got = licenses.scan_licenses(spark.createDataFrame([(100 * n + k, t) for n, k, t in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {100 * n + k: list(want)[k] for n, k, _ in rows}


def test_pages_without_article_are_differenced(spark):
    """Lines of both pages go, shared body sentences too; an article keeps them, and pages of other hosts share nothing."""
    said = "<p>A sentence that both say</p>"
    rows = [(1, "http://a.b/1", page("one") + said), (2, "http://a.b/2", page("two") + said), (3, "http://c.d/1", page("three") + said)]
    rows += [(4, "http://e.f/1", f"<div>Site name</div><article><p>four</p>{said}</article><p>out</p>"), (5, "http://e.f/2", f"<div>Site name</div>{said}<p>five</p>")]
    assert texts(spark, rows) == [(1, "one"), (2, "two"), (3, "Site name\nthree\nAll the same here\nA sentence that both say"), (4, "four\nA sentence that both say"), (5, "five")]
