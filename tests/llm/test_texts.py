"""Licences, pages, languages, URLs and media."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest

from posegrid.llm import html_extract, language_id, license_scan, media_avi, url_filter


def test_license_rules(spark):
    grant = dict((i, s) for i, s in license_scan.SENTENCES if i in ("mit-grant", "mit-notice"))
    data = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose"),
        (2, f"MIT License\n\n{grant['mit-grant']}:\n\n{grant['mit-notice']}."),
        (3, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. Licensed under CC BY-NC 4.0."),
        (4, None), (5, ""), (6, "Not released under the MIT License"), (7, "x " * 20000 + "\nReleased under the MIT License."),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'old' AS licenses")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert got[1]["licenses"] == "MIT" and got[1]["rules"] == "mit-reference"
    assert got[2]["rules"] == "mit-full" and got[2]["sentence_ids"] == "mit-title mit-grant mit-notice"
    assert got[3]["licenses"] == "Apache-2.0 CC-BY-NC-4.0"
    assert all(got[k]["licenses"] == "" and got[k]["sentence_ids"] == "" for k in (4, 5, 6)) and got[7]["licenses"] == "MIT"
    assert got[4]["n_sentences"] == 0 and license_scan.scan(df.limit(0)).count() == 0


def test_license_brute_force(spark):
    r = random.Random(5)
    known = license_scan.known()
    pool = [s for _, s in license_scan.SENTENCES] + ["Prose here", "And more of it"]
    texts = ["\n".join(r.choices(pool, k=r.randint(0, 6))) + "." for _ in range(60)]
    got = {x["doc_id"]: x["sentence_ids"] for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        found = [known.get(license_scan.normalise(s)) for s in re.split(license_scan.BOUNDARY, t)]
        assert got[k] == " ".join(x for x in found if x)


MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD = """Copyright (c) 2024, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""


CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_license_signs(spark):
    """Signs, control characters, NUL and all beyond ASCII are blanks, alone or in runs, as in normalise()."""
    texts = ["MIT License", "MIT\u00a0License", "MIT\0License", "MIT \x7f\x01 License", "mit--\u2014 \U0001f600_License", "\u00e9 MIT\tLICENSE \u00e9", "MIT\u00e9eLicense", "MITLicense"]
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: "mit-title" if license_scan.normalise(t) == "mit license" else "" for k, t in enumerate(texts)}
    assert [k for k in got if got[k]] == [0, 1, 2, 3, 4, 5]


def test_more_licences(spark):
    """Whole headers, plain and as comments; a greater licence counts alone."""
    cases = [
        (CLAUSES.replace("1. ", "").replace("2. ", ""), "BSD-2-Clause"), ((CLAUSES + THIRD).replace("1. ", "").replace("2. ", "").replace("3. ", ""), "BSD-3-Clause"), (CLAUSES, "BSD-2-Clause"), (CLAUSES + THIRD, "BSD-3-Clause"),
        (LGPL, "LGPL-2.1"), (MPL, "MPL-2.0"), (ISC, "ISC"), (GPL.replace(": you", "; you").replace("Foundation, either version 3", "Foundation; either version 2"), "GPL-2.0"),
        (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0"), ("SPDX-License-Identifier: GPL-2.0-or-later\ncode", "GPL-2.0"), ("SPDX-License-Identifier: MIT", "MIT"), ("MIT", ""), ("SPDX-License-Identifier: Own", ""),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ]
    texts = [t for c, _ in cases for t in (c, "".join(f"# {line}".rstrip() + "\n" for line in c.splitlines()))]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == [name for _, name in cases for _ in range(2)]


def test_wrapped_licences(spark):
    texts, want = [], []
    for text, ids, rule in ((MIT, "mit-title mit-grant mit-notice", "mit-full"), (GPL, "gpl-free gpl-terms3 gpl-hope", "gpl3-header"), (BSD, "bsd-redistribute", "bsd-clauses")):
        for first, mark, last in (("", "", ""), ("", "# ", ""), ("/*\n", " * ", " */\n"), ("", "// ", ""), ("", ";; ", ""), ("", "! ", ""), ("", "\t", "")):
            texts.append(first + "".join((mark + line).rstrip() + "\n" for line in text.splitlines()) + last)
            want.append((ids, rule))
        texts += [text.replace("\n", "\r\n"), "Prose before.\n" + text.replace(" ", "\n", 1)]
        want += [(ids, rule)] * 2
    for text, ids, rule in (
        ("Released under\nthe MIT License", "mit-ref", "mit-reference"),
        ('Licensed under the Apache License, Version 2.0\n(the "License");', "apache2-ref", "apache2-reference"),
        ("MIT License\nReleased under the MIT License\nMIT License", "mit-title mit-ref mit-title", "mit-reference"),
        ("Released under\n\nthe MIT license", "", ""),
        ("# Released under\n#\n# the MIT license", "", ""),
        ("Released under.\nthe MIT license", "", ""),
        ("It is not released under\nthe MIT License", "", ""),
        ("Released under\nthe MIT License of old", "", ""),
    ):
        texts.append(text)
        want.append((ids, rule))
    got = {r["doc_id"]: (r["sentence_ids"], r["rules"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == want


ARTICLE = "<h1>Title &amp; more</h1><p>First long paragraph of the article with many words in it, and so on.<p>Short.<p>Another <b>long</b>\n one with <a href=y>a link</a> in its text, and then some words."
WANTED = "Title & more\nFirst long paragraph of the article with many words in it, and so on.\nShort.\nAnother long one with a link in its text, and then some words."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><header><p>Site name and slogan</header><article>{ARTICLE}</article><aside>Side text of some length here</aside><footer>(c)</footer></body></html>",
        f"<body class='no-sidebar'><div id=header>Site</div><ul class=menu><li><a href=/>Home</a></ul><div class='cookie-notice'>We use cookies on this site</div><div class=wrap><div class=post>{ARTICLE}</div></div><section id=comments><p>Reader: a comment with quite a few words in it</section><form><label>Name</label><input></form></body>",
        f"<main><div class='ad-slot'>Buy this now</div>{ARTICLE}<script>var a='<p>x</p>';</script><div role=navigation>Next page</div></main><div class=footer>Imprint and contact</div>",
        f"<article>{ARTICLE}<div class='comment-list'><p>Someone wrote this comment</p></div></article>",
    ],
)
def test_main_text(page):
    assert html_extract.extract(page) == WANTED


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><style>p{{}}</style><body><article>{ARTICLE}</article></body></html>",
        f"<html><head><title>T</title><noscript><p>Switch scripts on</p></noscript><script>var a='<body>';</script>\n<body><nav><a href=/>Home</a></nav>{ARTICLE}</body></html>",
        f"<head><link rel=icon href=x><template><p>Not shown</p></template><div>{ARTICLE}</div>",
        f"<head><meta name=a><img src=x><title>T</title><main>{ARTICLE}</main>",
        f"<!DOCTYPE html><title>T</title>{ARTICLE}",
    ],
)
def test_open_head(page):
    assert html_extract.extract(page) == WANTED


def test_text_ends_head():
    assert html_extract.extract("<html><head><title>T</title>\nPlain text of a page without any more tags") == "Plain text of a page without any more tags"


def test_link_rich_lines():
    """Without an article, a line of links that clusters as content stays, and one far from it goes."""
    prose = "A paragraph of the main text with a good many words in it, as articles have them."
    sources = "<a href=/1>A first source with a long title of its own</a>, <a href=/2>a second source, also with a long title</a>"
    menu = "".join(f"<p><a href=/{k}>{k}</a></p>" for k in range(12))
    page = f"<body><div><p>{prose}</p><p>{sources}</p><p>{prose}</p><p>{prose}</p>{menu}</div></body>"
    links = re.sub("<.*?>", "", sources)
    got = html_extract.extract(page).split("\n")
    assert got[:4] == [prose, links, prose, prose] and "11" not in got


def test_page_edges(spark):
    long = "<article><p>" + "word " * 50_000 + "</article>"
    data = [(1, "u", None), (2, None, ""), (3, "u", "plain &lt; text"), (4, "u", "<nav>x</nav>"), (5, "u", "<p>a&amp"), (6, "u", long), (6, "u", long), (7, "u", "</div></p><b>"), (8, "u", "<!-- <p>x</p> -->")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).orderBy("page_id").collect()]
    big = ("word " * 50_000).strip()
    assert got == [(1, "", 0), (2, "", 0), (3, "plain < text", 12), (4, "", 0), (5, "a&", 2), (6, big, len(big)), (6, big, len(big)), (7, "", 0), (8, "", 0)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_language_id(spark):
    words = {"en": "the of and that with this", "de": "der und nicht ein auch für", "fr": "les des une être avec où"}
    r = random.Random(7)
    rows = [(k, " ".join(r.choices(words[lang].split(), k=r.randint(3, 30))), lang) for k in range(400) for lang in [r.choice("en de fr".split())]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out())
    model = language_id.train(df.where("NOT held_out"))
    edge = spark.createDataFrame([(1001, None), (1002, ""), (1003, "123 !?"), (1004, "the that of " * 30_000), (None, "und der")], "doc_id long, text string").selectExpr("*", "'zz' AS lang_pred", "0 AS score")
    got = language_id.identify(df.where("held_out"), model).collect()
    assert len(got) > 60 and sum(x["lang"] == x["lang_pred"] for x in got) >= 0.98 * len(got)
    assert all(0 <= x["score"] <= 1 for x in got)
    said = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(edge, model).collect()}
    assert said[1001] == said[1002] == said[1003] == ("und", 0.0) and said[1004][0] == "en" and said[None][0] == "de"
    none = language_id.train(df.limit(0))
    assert none.labels == [] and none.predict("the") == ("und", 0.0)
    assert language_id.identify(edge.limit(0), model).count() == 0
    assert (model.weights == 0).mean() > 0.5  # the elastic net leaves most weights at zero


def test_no_letter_no_label(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "a b", None), (2, "12 !?", None), (3, "", None), (4, None, None), (5, "1é", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, "").collect()) == [1, 5]


def slow_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
    fit = [r for r in url_filter.RULES for h, _, p in [r[0].partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fit:
        rule, verdict = max(fit, key=lambda r: len(r[0]))
        return host, path, rule, verdict
    glob = lambda g: ".*".join(re.escape(x) for x in g.split("*"))
    hit = any(re.fullmatch(glob(h).replace(".*", "[^/]*"), host, re.S) and re.fullmatch(glob(p), path, re.S) for h, p in url_filter.PATTERNS)
    return host, path, None, "block" if hit else "allow"


def test_urls_against_brute_force(spark):
    r = random.Random(9)
    hosts = ["com", "example.com", "a.Example.COM", "xcom", "net", "b.example.net", "org", "free-bets.example.com", "m.ads-track.x", "evil.com.x", "", "x.com:80", "bigcasino"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/70", "/en/6", "/de/8", "/de/", "/es/1", "/a/adserver/b", "/x/banner/y.gif", "/banner/é.gif?x", "/en/7?q=/de/", "#top", "?a"]
    urls = [f"{r.choice(['http', 'HTTPS', 'x'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "://", "http://com/en/" + "x" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS verdict")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge(df).collect()}
    assert got == {k: slow_judge(u) for k, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_frames_round_trip():
    r = np.random.default_rng(0)
    for frames in (r.integers(0, 256, (50, 24, 24), dtype=np.uint8), np.full((3, 24, 24), 255, np.uint8), (r.integers(0, 2, (40, 24, 24)) * 255).astype(np.uint8)):
        files = media_avi.store(frames.reshape(-1), np.array([0, 2, len(frames)]))
        back, bounds, rates = media_avi.load(files)
        assert (back == frames).all() and bounds.tolist() == [0, 2, len(frames)] and rates == [25.0, 25.0]
    with pytest.raises(ValueError):
        media_avi.load([b"RIFF" + b"\0" * 40])
    damaged = bytearray(files[0])
    damaged[300:340] = b"\xff\xfe" * 20
    with pytest.raises(ValueError):
        media_avi.load([bytes(damaged)])


def test_shots():
    dark, light = np.full((20, 24, 24), 10, np.uint8), np.full((15, 24, 24), 200, np.uint8)
    frames = np.concatenate([dark, light, dark])
    assert np.flatnonzero(media_avi.shots(frames, np.array([0, 55]))).tolist() == [0, 20, 35]
    assert np.flatnonzero(media_avi.shots(frames, np.array([0, 20, 55]))).tolist() == [0, 20, 35]
    assert len(media_avi.shots(frames[:0], np.array([0]))) == 0


def test_media_columns(spark):
    import hashlib
    import zlib

    data = [(1, "abc", 1), (2, None, 2), (3, "", 3), (4, "é" * 100_000, 4), (5, "abc", 5), (6, "x" * 576, 6)]
    stored = media_avi.encode_avi(spark.createDataFrame(data, "doc_id long, text string, n_bytes int"))
    got = {r["doc_id"]: r for r in media_avi.features(stored).collect()}
    for k, t, _ in data:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1]["media_sha256"] == got[5]["media_sha256"] and got[2]["feature"] == got[3]["feature"]
    clips = media_avi.clips(stored).where("doc_id = 4").orderBy("clip").collect()
    assert clips[0]["first_frame"] == 0 and sum(c["n_frames"] for c in clips) == -(-200_000 // 576)
    assert all(a["end_s"] == pytest.approx(b["start_s"]) for a, b in zip(clips, clips[1:]))
    assert media_avi.features(stored.limit(0)).count() == 0


def test_null_and_damaged_media(spark):
    """Rows without a readable file stay, with the reason; the others are not touched."""
    docs = spark.createDataFrame([(1, "a text"), (2, "another text " * 100)], "doc_id long, text string")
    good = {r["doc_id"]: bytes(r["media"]) for r in media_avi.encode_avi(docs).collect()}
    bad = bytearray(good[2])
    bad[300:340] = b"\xff\xfe" * 20
    rows = [(1, good[1]), (2, good[2]), (3, None), (4, b""), (5, bytes(bad)), (6, good[1][:100]), (7, b"RIFF")]
    df = spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1).selectExpr("*", "'x' AS error")
    got = {r["doc_id"]: r for r in media_avi.features(df).collect()}
    clean = {r["doc_id"]: r for r in media_avi.features(media_avi.encode_avi(docs)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    assert all(got[k]["payload_sha256"] == clean[k]["payload_sha256"] and got[k]["feature"] == clean[k]["feature"] and got[k]["error"] is None for k in (1, 2))
    assert all(got[k]["payload_bytes"] is None and got[k]["feature"] is None for k in (3, 4, 5, 6, 7))
    assert got[3]["error"] is None and got[3]["media_bytes"] is None and all(got[k]["error"] for k in (4, 5, 6, 7))
    assert {r["doc_id"] for r in media_avi.clips(df).collect()} == {1, 2}
    assert media_avi.clips(df.where("doc_id > 2")).count() == 0


def test_many_globs(monkeypatch):
    """Thousands of globs, in parts of few states, against fullmatch."""
    r = random.Random(2)
    globs = [(f"*h{k}.*", r.choice(["*", f"/p{k % 7}/*", f"/*x{k % 5}"])) for k in range(3000)]
    texts = [f"a.h{r.randrange(3000)}.com{r.choice(['/', '/p3/q', '/yx2', '/p1/x4'])}" for _ in range(60)] + ["", "/"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    monkeypatch.setattr(url_filter, "STATE_BYTES", 1 << 18)
    got = url_filter.Automaton(globs).run(np.frombuffer(data, dtype=np.uint8), offsets)
    for k in r.sample(range(3000), 300):
        host, path = (".*".join(re.escape(x) for x in g.split("*")) for g in globs[k])
        want = [re.fullmatch(host.replace(".*", "[^/]*") + path, t, re.S) is not None for t in texts]
        assert got[:, k].tolist() == want
    assert got.any()


def test_most_labels(spark):
    """Of a dirty label column the most frequent labels are learned."""
    rows = [(k, "the of and that", "en") for k in range(30)] + [(100 + k, "der und nicht ein", "de") for k in range(30)] + [(200 + k, "noise here", f"x{k}") for k in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_labels=2)
    assert model.labels == ["de", "en"] and model.predict("the and")[0] == "en"
    named = language_id.identify(spark.createDataFrame([("the of", 0.5)], "text string, score double"), model, lang="l", score="s").first()
    assert (named["score"], named["l"]) == (0.5, "en")


def test_sample_stays_small_on_the_driver(spark):
    """The sample costs the driver's Python a few bytes an n-gram, and the fit no copy of it."""
    r = random.Random(5)
    rows = [(k, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)), "ab"[k % 2]) for k in range(800)]
    grams = sum(len(language_id.ngrams(t)[0]) for _, t, _ in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    tracemalloc.start()
    try:
        language_id.train(df)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert grams > 1_000_000 and peak <= 16 * grams + 100 * language_id.SIZE
