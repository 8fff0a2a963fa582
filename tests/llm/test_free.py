"""HTML extraction, licence scans, SimHash, language identification, chat formatting and URL filters."""

import hashlib
import html
import json
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from quarry.llm import chat, decontam, htmltext, langid, licenses, mixing, queries, simhash, urlfilter
from quarry.llm.template import Template, TemplateError
from tests.conftest import SMALL


def plain_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?(?:p|h1)|br)>", " ", inner))).split())


def test_pages_give_their_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = queries.op1_html_text(spark, SMALL).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r["text"] == plain_article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


SITE = """<!doctype html><html><head><title>T{n}</title><script>if (a < b) "</p>"</script><style>p {{}}</style></head>
<body class="no-sidebar"><header><h1>Site</h1><a href="/">home</a></header><div class="cookie-notice">We use cookies</div><ul id="main-menu"><li>a<li>b</ul>
<div class="content-wrap"><main><h1>Title&nbsp;{n} &amp; more</h1>{more}<p>First <b>bold</b>ly <a href="x?a=1>2">link</a>.<p>Second
 line<br>end &#233;&eacute;</p>{items}<div class="ad-box">Buy!</div><form><input><label>Mail</label></form><!-- c > d --></main></div>
<aside>Side</aside><div class="sidebar">more side</div><section id="comments"><p>Reader says</p></section><footer>&copy; x</footer></body></html>"""


def site(n, items=0, more=""):
    return SITE.format(n=n, items="".join(f"<blockquote><p>Item {k}</p></blockquote>" for k in range(items)), more=more)


def site_text(n, items=0, more=""):
    return " ".join([f"Title {n} & more", *more.split(), "First boldly link.", "Second line end éé", *(f"Item {k}" for k in range(items))])


def test_wrappers_of_a_site(spark):
    rows = [(n, f"http://a.example/{n}", site(n, n % 5, "<h2>Odd</h2>" if n == 7 else ""), "clash") for n in range(20)]
    rows += [(100, "http://b.example/", "<div><p>No article</p><nav>menu</nav><p>here", "x"), (101, None, None, "x"), (102, "nourl", "", "x"), (103, "http://c.d", "only text &lt;3", "x"), (104, "http://a.example/x", "<p>another kind</p>", "x"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for how in ({}, {"most_broadcast": 0}):
        found = {r["id"]: r["text"] for r in htmltext.extract(df, **how).collect()}
        for n in range(20):
            assert found[n] == site_text(n, n % 5, "Odd" if n == 7 else "")
        assert found[100] == "No article here" and found[101] == found[102] == "" and found[103] == "only text <3" and found[104] == "another kind"
        assert htmltext.extract(df, **how).count() == len(rows)
    assert htmltext.extract(df.where("false")).count() == 0


def test_wrappers_are_union_free_expressions():
    pages = ["<div class=c><p>a</p></div>", "<div class=c><p>b</p><p>c</p><hr></div><div class=f>same</div>", "<div class=c><p>a</p><ul><li>1<li>2</ul></div><div class=f>same</div>"]
    assert htmltext.Wrapper.infer(pages[:1]).expression() == f"(div c: (p: '{htmltext._hash('a')}'))"
    found = htmltext.Wrapper.infer(pages)
    assert found.expression() == f"(div c: (p: #)+ ((ul: (li: 'Y' 'Z')+))?) ((div f: 'S'))?".translate(str.maketrans({"Y": htmltext._hash("1"), "Z": htmltext._hash("2"), "S": htmltext._hash("same")}))
    found.align(htmltext.Wrapper.infer(["<div class=c><p>a</p></div><div class=f>other, then</div><div class=f>same</div>"]))
    assert "((div f: # 'S')+)?".replace("S", htmltext._hash("same")) in found.expression()  # fixed wherever it stands in its element
    assert htmltext.Wrapper.loads(found.dumps()).decision() == found.decision()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["p", "div", "ul", "li", "div class=x"]), st.sampled_from(["", "a", "b", "c"]), st.booleans()), max_size=7), max_size=6), st.randoms(use_true_random=False))
def test_alignment_does_not_depend_on_the_order(pages, rng):
    pages = ["".join(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if ends else "") for tag, text, ends in page) for page in pages]
    whole = htmltext.Wrapper.infer(pages)
    parts, dealt = [htmltext.Wrapper() for _ in range(3)], pages[:]
    rng.shuffle(dealt)
    for page in dealt:
        rng.choice(parts).align(htmltext.Wrapper.of(htmltext.Page(page)))
    rng.shuffle(parts)
    merged = htmltext.Wrapper()
    for part in parts:
        merged.align(htmltext.Wrapper.loads(part.dumps()))
    assert merged.decision() == whole.decision() and merged.expression() == whole.expression()


ACME = '<html><body><div class="top">Acme portal your daily source</div><div class="txt">Story {n} of <b>day</b> {n}.<p>Its end {n}</div><div class="bottom">All content belongs to Acme Ltd</div></body></html>'
BARE = "<html><body><div>Acme portal</div><table><tr><td><h2>Head {n}</h2><div>Story {n}</div>{more}</td></tr></table><div>Acme Ltd</div></body></html>"


def test_what_all_pages_of_a_host_have_is_not_the_article(spark):
    rows = [(n, f"http://acme.example/{n}", ACME.format(n=n)) for n in range(12)]
    rows += [(100 + n, f"http://bare.example/{n}", BARE.format(n=n, more=f"<div>more {n}</div>" * (n % 3))) for n in range(12)]
    rows += [(200, "http://alone.example/", ACME.format(n=1))] + [(300 + k, "http://copies.example/", ACME.format(n=2)) for k in range(4)]
    rows += [(400, "http://social.example/", '<div class="social-studies article">Lesson</div>'), (401, "http://no.example/", '<div class="has-sidebar"><p>a</p></div><div class="no-comments">b</div><div class="cookie-bar">c</div>')]
    rows += [(402, "http://in.example/", '<div class="sidebar-wrap"><article>kept<div class="share-box">no</div></article>gone</div>')]
    found = {r["id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Acme portal your daily source Story {n} of day {n}. Its end {n} All content belongs to Acme Ltd"
    for n in range(12):
        assert found[n] == f"Story {n} of day {n}. Its end {n}"
        assert found[100 + n] == " ".join([f"Head {n} Story {n}", *[f"more {n}"] * (n % 3)])
        assert htmltext.main_text(ACME.format(n=n), None) == whole.format(n=n)  # what the page alone gives
    assert found[200] == whole.format(n=1) and {found[300 + k] for k in range(4)} == {whole.format(n=2)}
    assert [found[400 + k] for k in range(3)] == ["Lesson", "a b", "kept"]


def sentence(n, k=0):
    return f"In year {n} a river of {n * 7 + k} boats went past the town, and nobody counted the rest."


def texts_of(pages):
    decision = json.loads(json.dumps(htmltext.Wrapper.infer(pages).decision()))
    return [htmltext.main_text(p, decision) for p in pages]


def test_teasers_marked_as_articles_are_not_the_story():
    pages = [f"<body><main><h1>Head {n}</h1><p>{sentence(n)}</p><p>{sentence(n, 1)}</p><section><article>Related one {n}</article><article>Related two {n}</article></section></main></body>" for n in range(10)]
    want = [f"Head {n} {sentence(n)} {sentence(n, 1)}" for n in range(10)]
    assert texts_of(pages) == want and [htmltext.main_text(p, None) for p in pages] == want
    beside = [f"<body><article><p>{sentence(n)}</p></article><article>Next {n}</article></body>" for n in range(10)]
    assert texts_of(beside) == [sentence(n) for n in range(10)]
    equal = f"<body><article>{sentence(1)}</article><article>{sentence(2)}</article></body>"  # neither is the other's teaser
    assert htmltext.main_text(equal, None) == f"{sentence(1)} {sentence(2)}"


def test_an_odd_page_changes_no_other():
    pages = [ACME.format(n=n) for n in range(50)]
    odd = f"<body><div class=top>Acme portal your daily source</div><article>{sentence(3)}</article></body>"
    assert texts_of([*pages, odd]) == [*(f"Story {n} of day {n}. Its end {n}" for n in range(50)), sentence(3)]
    box = [f"<body><div class=txt><p>{sentence(n)}</p><p>{sentence(n, 1)}</p></div><article>Hint {n}</article></body>" for n in range(9)]  # a mark that isn't the article's
    assert texts_of(box) == [f"{sentence(n)} {sentence(n, 1)}" for n in range(9)]


def test_two_layouts_of_a_host():
    first = [f"<body><div class=a><p>Acme portal</p><div class=b><p>{sentence(n)}</p></div></div></body>" for n in range(6)]
    second = [f"<body><table><tr><td>Acme Ltd</td><td><div class=c>{sentence(n, 1)}</div></td></tr></table></body>" for n in range(6)]
    assert texts_of(first + second) == [sentence(n) for n in range(6)] + [sentence(n, 1) for n in range(6)]


def test_fixed_lines_go_wherever_they_stand():
    lines = [f"<p>Line {k} is the same on all pages</p>" for k in range(10)]
    pages = [f"<body><div>{''.join(lines[:5])}<p>{sentence(n)}</p>{'<p>more</p>' * (n % 2)}{''.join(lines[5:])}</div></body>" for n in range(8)]
    assert texts_of(pages) == [sentence(n) + " more" * (n % 2) for n in range(8)]


def test_columns_of_short_texts_are_not_the_article():
    pages = [f"<body><table><tr><td class=x><p>{sentence(n)}</p></td><td class=y><p>Weather {n} degrees</p><p>Stocks {n} up</p></td></tr></table></body>" for n in range(8)]
    assert texts_of(pages) == [sentence(n) for n in range(8)]


def test_marked_articles_lose_what_is_the_sites():
    pages = [f"<body><article><h1>Head {n}</h1><p>{sentence(n)}</p><p>{sentence(n, 1)}</p><p>Subscribe to our letter today</p><div>Notice: this site uses trackers</div></article></body>" for n in range(10)]
    assert texts_of(pages) == [f"Head {n} {sentence(n)} {sentence(n, 1)}" for n in range(10)]
    assert all("Subscribe" in htmltext.main_text(p, None) for p in pages)  # the page alone doesn't tell
    near = [f"<body><article><h1>Head {n}</h1><p>{sentence(0)}</p></article></body>" for n in range(10)]  # near copies aren't emptied
    assert texts_of(near) == [f"Head {n} {sentence(0)}" for n in range(10)]


def test_articles_lose_parts_by_name_and_are_not_lost_by_one():
    for name in ("author-bio", "related-stories", "user-reviews", "reader-replies", "paywall-offer", "recommended"):
        assert htmltext.main_text(f"<article><p>Kept.</p><div class='{name}'>Gone</div></article>", None) == "Kept."
    for name in ("author", "stories", "user-guide", "reader", "biography", "related-work-of-art"):
        assert htmltext.main_text(f"<article><p>Kept.</p><div class='{name}'>too</div></article>", None) == "Kept. too"
    assert htmltext.main_text("<body><div class=notice><p>The bridge is closed.</p></div></body>", None) == "The bridge is closed."
    assert htmltext.main_text("<body><div class='story menu'><p>Soup</p></div><nav>x</nav></body>", None) == "Soup"


def test_long_irregular_pages():
    rng = random.Random(1)
    blocks = [f"<{x} class='{rng.choice('abcdefgh')}'>t{k}</{x}>" for k in range(30_000) for x in [rng.choice(["p", "div", "h2", "blockquote", "section", "pre"])]]
    pages = ["<div class=story>" + "".join(blocks[:n]) + "</div><div class=end>Ltd</div>" for n in (30_000, 20_000, 7)]
    wrapper = htmltext.Wrapper.infer(pages)
    assert len(wrapper.nodes) < 100
    assert htmltext.main_text(pages[0], wrapper.decision()).split() == [f"t{k}" for k in range(30_000)]


@pytest.mark.parametrize("page", ["<" * 5000, "<p" * 3000, "<a href='" * 2000, "<!--" * 2000, "<b>" * 20_000 + "x", "<p>x</p>" * 20_000, "a&" * 10_000, "<article>" * 500 + "deep" + "</article>" * 500, "<div><p>" * 20_000 + "x"])
def test_odd_pages_end(page):
    text = htmltext.main_text(page, None)
    assert isinstance(text, str)
    assert htmltext.main_text(page, htmltext.Wrapper.infer([site(1, 3)]).decision()) == text
    assert htmltext.main_text(page, htmltext.Wrapper.infer([page]).decision()) == text


MIT = """Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Released under the MIT License.", ["MIT"]),
        ("words before\nLicensed under the Apache License, Version 2.0.\nwords after", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Published under the Creative Commons Attribution-ShareAlike 3.0 license", ["CC-BY-SA-3.0"]),
        ("All rights reserved.", ["proprietary"]),
        (MIT, ["MIT"]),
        ("\n".join(f" * {x}" for x in MIT.split("\n")), ["MIT"]),
        ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", ["BSD-3-Clause"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. Neither the name of X nor others may be used to endorse or promote products.", ["BSD-3-Clause"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", ["LGPL"]),
        ("You may obtain a copy of the license at http://x.", ["unknown"]),
        ("Released under the MIT License.\n\nLogo: All rights reserved.", ["MIT", "proprietary"]),
        ("He has a driving licence and permission to park.", []),
        ("", []),
        (None, []),
    ],
)
def test_licences(text, wanted):
    assert [name for name, _ in licenses.scan(text)[1]] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Released under the GPL v3.", ["GPL-3.0"]),
        ("Available under LGPL 2.1", ["LGPL-2.1"]),
        ("Distributed under the BSD-3-Clause.", ["BSD-3-Clause"]),
        ("It may not be copied or reproduced in any form without prior written consent", ["proprietary"]),
        ("All rights\nreserved.", ["proprietary"]),
        ("# This is in the public\n# domain.", ["public domain"]),
    ],
)
def test_licences_in_texts_of_few_words(text, wanted):
    assert [name for name, _ in licenses.scan(text)[1]] == wanted


NOTICE = "Redistributions of source code must retain the above copyright notice."
APACHE = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at"


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", ["MIT", "Apache-2.0"]),
        ("\n".join(f"// SPDX-License-Identifier: {x}" for x in ("MIT", "ISC", "MPL-2.0", "Zlib")), ["MIT", "ISC", "MPL-2.0", "Zlib"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND ( MIT OR ISC ) */", ["GPL-2.0-only WITH linux-syscall-note", "MIT", "ISC"]),
        ("SPDX-License-Identifier: MIT or so.\nOR nothing", ["MIT"]),
        ("Licensed under CC BY-NC 4.0\nLicensed under CC BY 4.0", ["CC-BY-NC-4.0", "CC-BY-4.0"]),
        (f"Released under the MIT License.\n\n{NOTICE}", ["MIT", "unknown"]),
        (f"{NOTICE}\n\n{MIT}", ["unknown", "MIT"]),
        (f"{APACHE}\n\nhttp://x.example", ["Apache-2.0"]),
        (f"{MIT}\n\n{' One sentence.' * 9} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", ["MIT", "unknown"]),
    ],
)
def test_all_licences_of_a_text(text, wanted):
    assert [name for name, _ in licenses.scan(text)[1]] == wanted


GPL_HEADER = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program."""
ZLIB = """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
you wrote the original software. 2. Altered source versions must be plainly marked as such."""


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("This code is released under GPLv3.", ["GPL-3.0"]),
        ("Available under the 2-clause BSD.", ["BSD-2-Clause"]),
        ("Licensed under the GPL, version 2 or later.", ["GPL-2.0-or-later"]),
        (GPL_HEADER, ["GPL-2.0-or-later"]),
        (GPL_HEADER.replace("General Public", "Affero General Public").replace("version 2", "version 3"), ["AGPL-3.0-or-later"]),
        ("\n".join(f"# {x}" for x in GPL_HEADER.replace(", or\n(at your option) any later version", "").split("\n")), ["GPL-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", ["EPL-2.0"]),
        (ZLIB, ["Zlib"]),
        ("Available under the European Union Public Licence v1.2", ["EUPL-1.2"]),
        ("This font is licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]),
        ("License: MIT", ["MIT"]),
        ("It is Apache-2.0 licensed.", ["Apache-2.0"]),
        ("It must not be distributed to children.", []),
    ],
)
def test_known_headers(text, wanted):
    assert [name for name, _ in licenses.scan(text)[1]] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Dual licensed under MIT or Apache-2.0.", ["MIT", "Apache-2.0"]),
        ("Licensed under the MIT License, the BSD 3-Clause License and the GPL version 2 or later.", ["MIT", "BSD-3-Clause", "GPL-2.0-or-later"]),
        ("Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("Released under MIT/Apache-2.0.", ["MIT", "Apache-2.0"]),
        ("Dual licensed under MIT or Apache-2.0. You may not use this file except in compliance with the License.", ["MIT", "Apache-2.0"]),
        ("Apache 2.0 licensed", ["Apache-2.0"]),
        ("MIT and Apache 2.0 licensed code", ["MIT", "Apache-2.0"]),
        ("GPL v3+ licensed", ["GPL-3.0-or-later"]),
        ("MIT licensed", ["MIT"]),
        ("MIT License", ["MIT"]),
        ("Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("# The MIT License (MIT)\n\nSome words.", ["MIT"]),
        (f"BSD 3-Clause License\n\n{NOTICE}", ["BSD-3-Clause"]),
        ("MIT License\n\nReleased under the MIT License.", ["MIT"]),
        ("The MIT License is short.", []),
        ("They study the MIT License and the Apache License at school.", []),
        ("This is provided under the Zope Public License.", ["unknown"]),
        ("Licensed under the Elastic License 2.0.", ["unknown"]),
        ("Business Source License 1.1", ["unknown"]),
        ("Covered by the Sample Public License", ["unknown"]),
        ("He drives a car covered by a valid driving license.", []),
        ("Distributed under the same license.", []),
        ("Distributed under this license. Provided under your own license.", []),
        ("MIT or Apache", []),
        ("licensed MIT licensed or", ["MIT"]),
        ("licensed under", []),
    ],
)
def test_licences_named_together_alone_or_not_known(text, wanted):
    assert [name for name, _ in licenses.scan(text)[1]] == wanted


def test_licences_of_very_long_lists_in_linear_time():
    began = time.monotonic()
    names = [name for name, _ in licenses.scan("MIT or Apache 2.0, " * 30_000 + "licensed")[1]]
    assert len(names) == 60_000 and set(names) == {"MIT", "Apache-2.0"}
    assert licenses.scan("licensed under " + "mit apache " * 30_000 + "end")[1][-1] == ("Apache", "permissive")
    assert licenses.scan("public license mit apache " * 30_000)[1] and time.monotonic() - began < 60


@pytest.mark.parametrize(
    ("expression", "kinds"),
    [("GPL-2.0-only", ["copyleft"]), ("MIT OR LGPL-2.1+", ["permissive", "copyleft"]), ("CC-BY-4.0", ["creative commons"]), ("CC0-1.0", ["public domain"]), ("0BSD", ["permissive"]), ("LicenseRef-Own", ["declared"])],
)
def test_kinds_of_declared_licences(expression, kinds):
    assert [kind for _, kind in licenses.scan(f"SPDX-License-Identifier: {expression}")[1]] == kinds


SEQUENCES = sorted({(name, x) for name, entries in licenses.SENTENCES.items() for e in entries for x in licenses._expanded(e)})


@settings(max_examples=600, deadline=None)
@given(st.sampled_from(SEQUENCES), st.randoms(use_true_random=False))
def test_each_known_sentence_is_found_however_it_is_written(known, rng):
    name, sequence = known
    raw = []
    for k, w in enumerate(sequence):
        short = [x for own in licenses.ONLY_GRANTED.values() for x in own] if k and sequence[k - 1] == "@" else []
        raw += {"@": rng.choice(licenses.GRANTS), "=": rng.choice([x for own in licenses.NAMES.values() for x in own] + short), "#": rng.choice(["version 2.0", "v2", "v. 3.1", "1.1"]), "+": rng.choice(licenses.LATER), "?": rng.choice(["zope public license", "plain common sense public license"])}.get(w, w).split(" ")
    text = "Foo bar "
    for w in raw:
        text += rng.choice(["", "", "", "the ", "a "]) + (w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", " ", " ", ", ", "\n", "\n * ", "  "])
    assert licenses.may_hold(text.lower())
    found = [i for s in licenses.normalised(text) for i, _ in licenses.identify(s)]
    assert name in found or any(x[: len(sequence)] == sequence and n in found for n, x in SEQUENCES), (text, found)


def test_identifiers_equal_a_plain_search():
    rng = random.Random(14)
    table = [(tuple(w for w, _ in licenses._with_symbols([(w, "") for w in x])), name) for name, entries in licenses.SENTENCES.items() for e in entries for x in licenses._expanded(e)]
    further, alone = ([tuple(x) for x in licenses._expanded(licenses.PLACED[name][0])] for name in ("alternative", "heading"))
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice([*table, *((x, "") for x in further)])[0])
            words += x[: rng.randint(1, len(x))] + rng.choice([[], ["foo"]])
        words = [(w, "x" if w in "=#" else "") for w in words]
        wanted, at, named = [], 0, False
        while at < len(words):
            best = max((len(x) for x, _ in table if tuple(w for w, _ in words[at : at + len(x)]) == x), default=0)
            if best:
                wanted.append(next(name for x, name in table if len(x) == best and tuple(w for w, _ in words[at : at + best]) == x))
            for name, forms, here in (("alternative", further, named), ("heading", alone, at == 0 and all(w in ("=", "#", "+", "or", "and") for w, _ in words))):
                if here and not best:
                    best = max((len(x) for x in forms if tuple(w for w, _ in words[at : at + len(x)]) == x), default=0)
                    wanted += [name] * (best > 0)
            named = "=" in [w for w, _ in words[at : at + best]]
            at += best or 1
        assert [name for name, _ in licenses.identify(words)] == wanted


def test_long_and_repeated_licence_texts():
    long = "word " * 200_000
    assert licenses.scan(long + "Released under the MIT License." + long)[1] == [("MIT", "permissive")]
    names, found = licenses.scan("Released under the MIT License.\n" * 5000)
    assert len(names) == 5000 and set(found) == {("MIT", "permissive")}


LINES = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}


def test_licence_query(spark):
    """The tables' texts hold licences as lines of their own."""
    found = {r["doc_id"]: r for r in queries.op2_license_scan(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        wanted = dict.fromkeys(LINES[line] for line in (r["text"] or "").split("\n") if line in LINES)
        assert found[r["doc_id"]]["licences"] == ",".join(wanted)


def test_licences_of_odd_tables(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "Released under the MIT License.", "y"), (2, "Released under the MIT License.", "y"), (None, "All rights reserved.", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    found = licenses.licences(df)
    assert sorted((str(r["id"]), r["licences"]) for r in found.collect()) == [("1", []), ("1", []), ("2", ["MIT"]), ("2", ["MIT"]), ("None", ["proprietary"])]
    assert licenses.licences(df.where("false")).count() == 0


TEXTS = [None, "", " ", "one", "one two three", "a b c d e f"]


def test_fingerprints_and_components(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    texts = TEXTS + ["one", "One\ttwo THREE"]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(base)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choices(base, k=rng.randint(1, 50))) for _ in range(40)] + [" ".join(base * 1000)]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(None, texts[6]), (None, "lonely words here now"), (3000, texts[10]), (3000, texts[10])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int").repartition(3)
    fps, wanted = brute.components(rows)
    by_row = {(r[0], r[1]): (f, c) for r, f, c in zip(rows, fps, wanted, strict=True)}
    for how in ({}, {"cell_cap": 3}, {"cell_cap": 1, "segment_bits": (4,)}, {"cell_cap": 2, "segment_bits": (8, 2)}):
        found = simhash.near_duplicates(df, **how)
        texts_of = df.select(F.col("doc_id").alias("i"), "text", F.xxhash64("text").alias("k")).distinct()
        out = found.join(texts_of, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).collect()
        assert len(out) == len(rows)
        for r in out:
            fp, c = by_row[r["id"], r["text"]]
            assert r["fp"] % 2**64 == fp and r["component_id"] == c, r
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(map(str, [(c, f) if c is None else c for f, c in zip(fps, wanted, strict=True)])))
    empty = simhash.near_duplicates(df.where("false"))
    assert empty.count() == 0 and simhash.keep_one(df.where("false")).count() == 0


def test_dense_groups_link_without_pairs(spark):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 2**63, dtype=np.int64)
    fps = np.unique(np.array([center ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(300)] + list(rng.integers(0, 2**63, 50, dtype=np.int64))))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 4]
    wanted = _closed(near)
    for how in ({}, {"cell_cap": 5}, {"cell_cap": 0}):
        links = [(r["a"], r["b"]) for r in simhash.links(df, **how).collect()]
        assert all(int(a ^ b).bit_count() <= 4 for a, b in links) and _closed(links) == wanted
    assert {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(near, "a long, b long")).collect()} == wanted


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_texts(spark):
    """Near copies around a similarity of 0.8: all pairs at or above it are linked, and none below."""
    rng = random.Random(18)
    rows = [(-1, None), (-2, ""), (-3, "one"), (-4, "ONE\n"), (-5, "a b c"), (-6, "long " * 30_000), (None, "a  b c")]
    for k in range(60):
        base = [f"{rng.choice('abcde')}{rng.randrange(400)}" if rng.random() < 0.6 else rng.choice("the of and to in".split()) for _ in range(rng.randint(60, 500))]
        rows += [(10 * k + c, edited(base, rng, round(len(base) * rng.uniform(0, 0.035)) if c else 0)) for c in range(4)]
    rows += [rows[8], rows[8]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, _node int").repartition(3)
    found = simhash.near_duplicates(df, shingle_words=5, similarity=0.8)
    texts = df.select(F.col("doc_id").alias("i"), "text", F.xxhash64("text").alias("k")).distinct()
    root = {(r["id"], r["text"]): r["root"] for r in found.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).collect()}
    pairs = brute.similar(rows)
    near = [(i, j) for i, j in pairs if rows[i] != rows[j]]
    together = [(i, j) for i, j in near if root[rows[i]] == root[rows[j]]]
    assert len(near) > 150 and len(together) == len(near)
    group = brute.closed(len(rows), pairs)
    assert all(group[i] == group[j] for i in range(len(rows)) for j in range(i) if root[rows[i]] == root[rows[j]])
    kept = simhash.keep_one(df, shingle_words=5, similarity=0.8)
    assert kept.columns == df.columns and kept.count() == len(set(root.values()))
    assert simhash.keep_one(df.where("false"), shingle_words=5, similarity=0.8).count() == 0


@pytest.mark.parametrize("words, pairs", [(60, 1500), (300, 300)])
def test_similar_pairs_within_a_template(spark, words, pairs):
    """Pairs at about 0.9 whose texts share a template with all others: none is lost, however many there are."""
    rng = random.Random(words)
    template = [f"t{k}" for k in range(words // 2)]
    rows = []
    for k in range(pairs):
        own = [f"p{rng.randrange(10**7)}" for _ in range(words - len(template))]
        base = template[: words // 4] + own + template[words // 4 :]
        other = list(base)
        other[words // 4 + rng.randrange(len(own))] = "edited"
        if words > 100:
            other[-3] = "again"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle_words=5, similarity=0.8).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}


def test_a_large_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """Copies of one text with more and fewer edits: what all pairs connect is connected, by links that don't grow with the square of the group."""
    rng, made = random.Random(22), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(k, edited(base, rng, rng.choice((1, 2, 3, 5, 8)))) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("_met", "_alike"):
        real = getattr(simhash, name)
        monkeypatch.setattr(simhash, name, lambda *args, real=real: made.append(real(*args)) or made[-1])
    found = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle_words=5, similarity=0.8).collect()}
    pairs = brute.similar(rows)
    group = brute.closed(len(rows), pairs)
    assert len(set(group)) > 5 and all((found[i] == found[j]) == (group[i] == group[j]) for i in range(len(rows)) for j in range(i))
    assert len(made) == 3 and sum(links.count() for links, _ in made) < len(pairs) / 2
    a, b = (np.unique(rng_.integers(0, 2**63, 300).astype(np.uint64)) for rng_ in (np.random.default_rng(1), np.random.default_rng(2)))
    bits = [np.unpackbits(np.frombuffer(simhash.sketch(np.union1d(a, x)), np.uint8)) for x in (b[:40], b[20:60])]
    assert 0 < int((bits[0] ^ bits[1]).sum()) <= 40 and (40 - int((bits[0] ^ bits[1]).sum())) % 2 == 0


def test_meeting_rule_for_groups_of_all_sizes(spark, monkeypatch):
    """Pairs of different groups that share a token, with how many they share, for any size of a token's group and for tokens that a task can't hold."""
    rng = random.Random(20)
    nodes = {k: (rng.randint(5, 9), rng.choice([k, k - k % 4])) for k in range(400)}
    rows = {(token, k, *nodes[k]) for token, n in enumerate((1, 2, 3, 63, 64, 65, 66, 300)) for k in rng.sample(range(400), n)}
    df = spark.createDataFrame(sorted(rows), "token long, node long, n long, grp long").repartition(3)
    has = {}
    for token, k, *_ in rows:
        has.setdefault(k, set()).add(token)
    wanted = {(a, b, nodes[a][0], nodes[b][0], len(has[a] & has[b])) for a in has for b in has if a < b and has[a] & has[b] and nodes[a][1] != nodes[b][1] and min(nodes[a][0], nodes[b][0]) >= 0.8 * max(nodes[a][0], nodes[b][0])}
    for cap in (1000, 10):
        assert {tuple(r) for r in simhash._meeting(df, 0.8, cap).collect()} == wanted
    assert [int(simhash.prefix_size(np.int64(n), 0.8)) for n in (1, 4, 5, 10, 11)] == [1, 1, 2, 3, 3]


def test_frequent_shingles_are_a_table_of_fixed_size(spark):
    df = spark.createDataFrame([(k, f"a b c d e own{k} x{k} y{k} z{k} w{k}") for k in range(400)], "doc_id long, text string")
    table = simhash.frequent(df, shingle_words=5)
    common, own = simhash.shingles("a b c d e", 5), simhash.shingles("own1 x1 y1 z1 w1", 5)
    assert len(table) == simhash.SLOTS and table[int(common.view(np.uint64)[0]) % simhash.SLOTS] and not table[int(own.view(np.uint64)[0]) % simhash.SLOTS]
    assert not simhash.frequent(df.where("false"), shingle_words=5).any()


def test_rows_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x", "y", 3), (2, "a b c d e f", "x", "y", 3), (3, "other words", "x", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _q_id string, _q_text_key string, id int")
    for kept in (simhash.keep_one(df), simhash.keep_one(df, shingle_words=5, similarity=0.8)):
        assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]] and kept.columns == df.columns
    bench = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert sorted(map(tuple, decontam.clean(df, bench).collect())) == rows[:2]
    clash = df.withColumnsRenamed({"_q_id": "copy", "id": "source"})
    out = mixing.mixed(clash)
    assert out.columns == [*clash.columns, "copy_"] and {r["copy"] for r in out.collect()} <= {"x"}


def _closed(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_a_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_few_links_take_few_tasks(spark, monkeypatch):
    links, held = [(k, k + 1) for k in range(0, 60, 2)] + [(0, 8), (8, 30)], {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    wanted = {k: 0 if k in (0, 1, 8, 9, 30, 31) else k - k % 2 for k in range(60)}
    before = {k: spark.conf.get(k) for k in held}
    tracker, tasks = spark.sparkContext.statusTracker(), []
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for most in (100_000, 5):
            monkeypatch.setattr(simhash, "LINKS", most, raising=False)
            spark.sparkContext.setJobGroup(f"few links {most}", "")
            assert {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()} == wanted
            tasks.append(sum(tracker.getStageInfo(x).numTasks for job in tracker.getJobIdsForGroup(f"few links {most}") for x in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(x)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks[0] < 50 < tasks[1]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op7_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(found) == 1000 and (held.lang == held.lang_pred).mean() >= 0.97
    assert found.rejected.mean() <= 0.02 and found.score.between(0, 1).all()


def test_language_in_odd_cases(spark):
    words = {"aa": "abc bca cab aab", "bb": "xyz zyx yzx xxy"}
    rows = [(k, words[w], w, "clash") for k in range(40) for w in ["aa" if k % 2 else "bb"]] + [(100, None, "aa", "c"), (101, "123 !?", "bb", "c"), (102, "abc cab", None, "c"), (None, "xyz", None, "c"), (103, "abc " * 500_000, None, "c"), (104, "жжж щщщ", None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df, ~queries.held_out("doc_id"))
    out = {r["doc_id"]: r["_langid"] for r in langid.identify(df, model).collect()}
    assert [out[k]["lang"] for k in (100, 101, 102, None, 103)] == ["und", "und", "aa", "bb", "aa"]
    assert out[100]["score"] == 0 and out[101]["rejected"] and out[104]["rejected"] and not out[102]["rejected"]
    assert langid.identify(df, model).columns == [*df.columns, "_langid"]
    clash = langid.identify(df.withColumn("_LangId", F.lit("own")), model)
    assert clash.columns[-2:] == ["_LangId", "_langid_"] and clash.first()["_LangId"] == "own"
    none = langid.fit(df.where("false"), F.lit(True))
    assert none is None and {r["_langid"]["lang"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0


def test_languages_have_several_centroids_and_the_nearest_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~queries.held_out("doc_id"))
    per = {lang: model.langs.count(lang) for lang in set(model.langs)}
    assert len(per) == 4 and set(per.values()) == {langid.Settings().clusters}
    texts = [r["text"] for r in docs.limit(150).collect()]
    langs, scores, _ = langid.predict(texts, model)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        own = np.sqrt(langid.counts(text, len(model.idf))) * model.idf
        near = [float(own @ c) / max(np.linalg.norm(own) * np.linalg.norm(c), 1e-9) for c in model.centroids]
        assert score == pytest.approx(max(near), abs=1e-4) and near[model.langs.index(lang)] >= 0 and max(n for n, x in zip(near, model.langs, strict=True) if x == lang) == pytest.approx(max(near), abs=1e-4)


def test_clusters_are_as_many_as_asked():
    rng = np.random.default_rng(3)
    for n, odd in ((100, 1), (40, 0), (3, 0), (2, 0), (1, 0)):
        x = np.abs(rng.normal(1, 0.05, (n, 8))).astype(np.float32)
        x[:odd] = np.eye(8)[:odd]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c, own = langid._cluster(x, 3, 8)
        assert len(c) == min(3, n) == len(set(own.tolist()))
    same = np.ones((20, 4), np.float32) / 2
    assert len(langid._cluster(same, 3, 8)[0]) == 1


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "".join(random.Random(1).choices("abé ÄЖ1.", k=500))
    whole = langid.counts(text, 512)
    for size in (3, 7, 50, 499):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert (langid.counts(text, 512) == whole).all()


TRICKY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "<\\s>", "<s><s>", "[INST", "a\nb", "\\\\</s>\\", "😀</s", "<<s>>"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(TRICKY), st.lists(st.sampled_from(["<", "s", ">", "/", "\\", "[", "INST", "]", "x", "</s>", "[INST]"]), max_size=12).map("".join)))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


def expected(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_come_back(spark, monkeypatch):
    rng = random.Random(6)
    convs = {k: [(rng.choice(["user", "assistant", "system", None, "odd\nrole", "</s>"]), rng.choice([*TRICKY, None])) for _ in range(rng.randint(1, 9))] for k in range(60)}
    convs[None] = [("user", "x"), ("assistant", "y")]
    convs[99] = [("assistant", "long 😀 " * 20_000), ("user", "z" * 300_000), ("assistant", "end")] * 3
    rows = [(k, i, r, t, "clash") for k, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += [(77, None, "user", "b", "c"), (77, None, "user", "a", "c"), (77, None, "user", "a", "c")]
    convs[77] = [("user", "a"), ("user", "a"), ("user", "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(3)
    formatted = chat.format_conversations(df)
    assert formatted.where("conv_id = 99").count() > 1
    for sort in (True, False):
        found = {r["conv_id"]: r for r in chat.read_back(formatted, sort=sort).collect()}
        assert found.keys() == convs.keys()
        for k, turns in convs.items():
            r = found[k]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns), k
    parts = formatted.where("conv_id = 77").collect()
    assert "".join(p["formatted"] for p in parts) == "<s>[INST] user [/INST]a</s><s>[INST] user [/INST]a</s><s>[INST] user [/INST]b</s>"
    assert chat.format_conversations(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("source", "values", "out"),
    [
        ("a {{ x }} b", {"x": 1}, "a 1 b"),
        ("{% for m in ms %}{{ loop.index }}{{ m.a }}{% if not loop.last %}, {% endif %}{% endfor %}", {"ms": [{"a": "x"}, {"a": "y"}]}, "1x, 2y"),
        ("{% if a == 'x' and b %}1{% elif a in 'yz' %}2{% else %}3{% endif %}", {"a": "y", "b": 0}, "2"),
        ("{{ 'a' ~ 1 + 2 }}{{ ('b' if 1 < 2 else 'c')|upper }}", {}, None),
        ("{{ 'b' if 1 < 2 else 'c' }}{{ 'x'|upper ~ '\\n' }}", {}, "bX\n"),
        ("x  {{- a -}}  y", {"a": "-"}, "x-y"),
        ("{{ '}}' ~ a }}{% if a == '%}' %}1{% else %}2{% endif %}", {"a": "%}"}, "}}%}1"),
        ("{% if a not in 'xy' and not b %}1{% endif %}{{ 'n' if a not in 'z' else 'y' }}", {"a": "z", "b": 0}, "1y"),
        ("{% set t = m['k'] %}{{ t }}{{ t[0] }}{{ none }}{{ u.v }}", {"m": {"k": "hi"}, "u": {}}, "hih"),
    ],
)
def test_templates(source, values, out):
    if out is None:
        with pytest.raises(TemplateError):
            Template(source)
    else:
        assert "".join(t for t, _ in Template(source).render(values)) == out


def test_templates_fold_and_mark():
    t = Template("{% if 1 == 1 %}a{% else %}b{% endif %}{{ 'c'|upper }}d")
    assert t.tree == [("text", "aCd")]
    marked = list(Template("x{% generation %}y{{ z }}{% endgeneration %}w").render({"z": "!"}))
    assert marked == [("x", False), ("y", True), ("!", True), ("w", False)]
    lazy = Template("{% for m in ms %}{{ m }}{% endfor %}").render({"ms": iter(range(10**9))})
    assert [next(lazy)[0] for _ in range(3)] == ["0", "1", "2"]


@pytest.mark.parametrize("source", ["{{ x", "{% for %}", "{% if a %}", "{{ a b }}", "{{ x() }}", "{{ x|nofilter }}", "{% import os %}", "{{ }}", "{% endfor %}"])
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_templates_reach_nothing_else():
    with pytest.raises(TemplateError):
        list(Template("{{ x.__class__ }}").render({"x": 1}))


def judged(url, rules, default="allow"):
    host, path = urlfilter.split_url(url)
    fits = [(len(h.split(".")), len(p), i, v, h + p) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else default


def test_url_rules(spark):
    rng = random.Random(8)
    rules = list(dict.fromkeys((rng.choice(["allow", "block"]), rng.choice(["com", "a.com", "b.a.com", "net", "x.net"]), rng.choice(["", "/", "/en", "/en/", "/en/x", "/e", "/en/x/"])) for _ in range(20)))
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    hosts, paths = ["com", "A.com", "b.a.com", "c.b.a.com", "aa.com", "net", "y.x.net", "", "com."], ["", "/", "/en", "/en/", "/english/x", "/en/x", "/en/x/y", "/en/xy", "/fr/"]
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "x://", "") for h in hosts for p in paths for q in ("", "?a=/en/", "#://z.net/")] + [None, "", "://", "a://b://com/en/"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    for some in (rules, queries.URL_RULES, []):
        found = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, some).collect()}
        for k, u in enumerate(urls):
            assert found[k] == judged(u, some), u
    found = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules, most_entries=3).collect()}  # several tries
    assert all(found[k] == judged(u, rules) for k, u in enumerate(urls))
    assert urlfilter.judge(df.where("false"), rules).count() == 0
