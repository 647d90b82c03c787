import json

from streamloom.llm import html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">{0}</a></li></ul></nav>
<!-- c --><div class="ad">{1}</div><article><h1>Head {2}</h1><p><b>First &amp; &eacute;
 {2}<br><p>Sec<i>ond</i> {2}</p><section class="comments"><p>nice</p></section></article><aside>more</aside><footer>&copy; {1}</footer>"""
SOUP = '<div id="top">Site name</div><div class="body"><h2>{0}</h2><p>Text of {0}</p></div><div><a href="x">Link {0}</a></div><p>All rights reserved</p>'


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, template string")


def test_articles_and_soup(spark):
    rows = [(i, "http://a.example/x", PAGE.format(f"n{i}", f"x{i}", i)) for i in range(5)]
    rows += [(10 + i, "https://b.example:80/y", SOUP.format(f"story {i}")) for i in range(5)]
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    for i in range(5):
        assert got[i].text == f"Head {i} First & é {i} Second {i}" and got[i].n_chars == len(got[i].text)
        assert got[10 + i].text == f"story {i} Text of story {i}"


def test_copies_and_shuffled_templates(spark):
    rows = [(i, "http://a.example/x", PAGE.format("n", "x", 1)) for i in range(4)] + [(9, "http://a.example/x", PAGE.format("n", "x", 1))]
    a = sorted((r.page_id, r.text) for r in html_text.extract(pages(spark, rows)).collect())
    b = sorted((r.page_id, r.text) for r in html_text.extract(pages(spark, rows), broadcast_bytes=0).collect())
    assert a == b and all(t == "Head 1 First & é 1 Second 1" for _, t in a)


def test_html_edges(spark):
    rows = [(1, None, None), (2, "not a url", ""), (None, "http://c.example", "<p>plain"), (4, "http://c.example", "no tags at all &lt;b&gt;"), (5, "http://d.example", "<div>" * 3000 + "deep"), (6, "http://e.example", "<article><p>" + "w " * 50_000), (6, "http://e.example", "<article><p>" + "w " * 50_000), (7, "http://f.example", "<script>x"), (8, "http://g.example", "</p></div><a")]
    got = html_text.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[7] == "" and by[None] == "plain" and by[4] == "no tags at all <b>" and by[5] == "deep" and len(by[6]) == 99_999
    assert html_text.extract(pages(spark, [])).count() == 0


def tree(spec):
    """A tree from nested tuples (tag, children...), numbered in order."""
    n = -1

    def make(x):
        nonlocal n
        n += 1
        own = [n]
        return [x[0], 0, [make(c) for c in x[1:]], own]

    return make(spec)


def brute_matching(a, b):
    """Largest matching by trying every set of ordered pairs of children."""
    if a[0] != b[0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), best(xs[1:], ys[1:]) + brute_matching(xs[0], ys[0]))

    return 1 + best(a[2], b[2])


def test_tree_matching_against_brute_force():
    import random

    rng = random.Random(4)

    def grow(depth):
        return (rng.choice("ab"), *(grow(depth - 1) for _ in range(rng.randrange(4) if depth else 0)))

    for _ in range(150):
        a, b = tree(("r", *grow(2)[1:])), tree(("r", *grow(2)[1:]))
        size = html_text.matched(a, b, {})
        assert size == brute_matching(a, b)
        assert html_text.read(html_text.written(a)) == a
        both = html_text.merge(a, b)
        again = html_text.read(html_text.written(both))
        # Each tree's nodes are found in the merged one, in parents that are found too, and matched nodes are one.
        assert html_text.written(both).count("|") + 1 <= html_text.written(a).count("|") + html_text.written(b).count("|") + 2 - size
        for t in (a, b):
            slots = html_text.numbers_to_slots(t, again)
            assert slots[0] == 0 and len(slots) == html_text.matched(t, again, {})


def test_template_of_pages_with_more_blocks():
    a, b = (html_text.page(html_text.parse(x)) for x in ("<ul><li>1<li>2</ul><p>x", "<ul><li>1<li>2<li>3</ul><div>d</div><p>y"))
    assert a[0] == "root 0 0|ul 0 1|li 0 2|p 0 1" and b[0] == "root 0 0|ul 0 1|li 0 2|div 0 1|p 0 1"
    both = html_text.read(html_text.written(html_text.merge(html_text.read(a[0]), html_text.read(b[0]))))
    assert html_text.numbers_to_slots(html_text.read(a[0]), both) == {0: 0, 1: 1, 2: 2, 3: 4}


def test_warc_links(spark):
    rows = [(1, "http://a.example/", PAGE.format("n", "x", 1)), (2, None, None), (3, "http://b.example/\r\nX: y", "<title>T &amp; t</title><a href='u'>l</a>é"), (None, "u", "x"), (3, "http://b.example/\r\nX: y", "d")]
    made = warc.responses(pages(spark, rows))
    got = warc.derivatives(made).collect()
    assert len(got) == 2 * len(rows)
    by = {(r.page_id, r.kind): r for r in got if r.page_id != 3}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    assert meta.refers_to == text.refers_to == warc.record_id("response", 1, "http://a.example/")
    for r in got:
        (headers, block), = warc.records(bytes(r.record))
        h = dict(headers)
        assert h["WARC-Refers-To"] == r.refers_to and h["WARC-Block-Digest"] == r.block_digest == warc.sha1(block)
        assert h["WARC-Source-Payload-Digest"] == r.payload_digest and r.digest_ok and int(h["Content-Length"]) == len(block) == r.content_length
    envelope = json.loads(next(warc.records(bytes(meta.record)))[1])
    assert envelope["html"]["links"] == [{"tag": "a", "url": "/a"}] and envelope["html"]["title"] == "t" and envelope["http-status"] == 200
    assert "First & é" in next(warc.records(bytes(text.record)))[1].decode() and "var t" not in next(warc.records(bytes(text.record)))[1].decode()
    assert warc.derivatives(warc.responses(pages(spark, []))).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    one, two = warc.response(1, "http://a", "<p>x"), warc.response(2, "http://b", "<p>y")
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: s")
    (tmp_path / "a.warc").write_bytes(info + one + two + b"broken")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(two))
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(one[:-30])
    (tmp_path / "e.warc").write_bytes(one.replace(b"<p>x", b"<p>z"))
    got = warc.derivatives(warc.read_warc(spark, str(tmp_path)), keep="path").collect()
    errors = {r.path[-6:]: r.error for r in got if r.kind == "error"}
    assert errors == {"a.warc": "no WARC head", "d.warc": "the block is cut short"}
    got = [r for r in got if r.kind != "error"]
    assert sorted((r.path[-6:], r.kind) for r in got) == sorted([("a.warc", "metadata"), ("a.warc", "conversion")] * 2 + [("arc.gz", "metadata"), ("arc.gz", "conversion"), ("e.warc", "metadata"), ("e.warc", "conversion")])
    assert {r.digest_ok for r in got if r.path.endswith("e.warc")} == {False}


def texts(spark, html, url="http://one.example/x"):
    return [r.text for r in sorted(html_text.extract(pages(spark, [(i, url, h) for i, h in enumerate(html)])).collect(), key=lambda r: r.page_id)]


def test_template_decides_in_and_outside_articles(spark):
    page = '<article><h1>Title {0}</h1><p>Story number {0} is long enough to count.</p><div class="box">Write to our desk</div></article><div>Also {0}</div><div>Site name</div>'
    assert texts(spark, [page.format(i) for i in range(5)]) == [f"Title {i} Story number {i} is long enough to count. Also {i}" for i in range(5)]
    # Four copies of one article, and four with other text around it: nothing of it is the host's.
    one = "<article><h1>Same</h1><p>A long story that is on many pages.</p></article><div>{}</div>"
    assert all("Same A long story that is on many pages." in t for t in texts(spark, [one.format(i) for i in range(4)]))
    mixed = texts(spark, [page.format(i) for i in range(5)] + [page.format(7)] * 3)
    assert mixed[5:] == ["Title 7 Story number 7 is long enough to count. Also 7"] * 3


def test_article_in_a_skipped_region(spark):
    rows = ["<div>Main text of the page</div><aside><article class=teaser>More</article></aside>", "<div>Main</div><section class=comments><article class=comment>nice</article></section>", "<article> </article><div>Outside</div>"]
    for k, (html, want) in enumerate(zip(rows, ["Main text of the page", "Main", "Outside"], strict=True)):
        assert texts(spark, [html], f"http://h{k}.example/") == [want]


def test_deep_pages_with_end_tags(spark):
    deep = "<body><div><article><p>First</p>" + "<div>" * 70 + "Deep<div class=ad>Buy</div><nav>Menu</nav>" + "</div>" * 70 + "<p>Last</p></article></div></body>"
    very = "<article>" + "<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p></article>"
    assert texts(spark, [deep], "http://a.example/") == ["First Deep Last"] and texts(spark, [very], "http://b.example/") == ["x y"]


def test_long_pages_and_many_layouts(spark):
    head = "<div id=top>Site name</div>"
    long = [head + f"<div>Text {i}</div>" + "".join(f"<p>Line {i} {j}</p>" for j in range(2000)) for i in range(3)]
    got = texts(spark, long)
    assert all(t.startswith(f"Text {i} Line {i} 0") for i, t in enumerate(got))
    # Twelve layouts, each of six pages and with a notice of its own.
    tags = "section div center figure fieldset address blockquote pre main2 x-a x-b x-c".split()
    html = [f"<html><body><{t}><h2>Head {t} {i}</h2></{t}><p>Notice of {t}</p></body></html>" for t in tags for i in range(6)]
    assert texts(spark, html, "http://many.example/") == [f"Head {t} {i}" for t in tags for i in range(6)]


def test_template_decides_without_telling_names(spark):
    """Neutral names, no containers, one more block on some pages: the constant blocks go, the slots that vary stay."""
    page = '<div class="q1"><span>Our place</span></div>{1}<table><tr><td>Left</td><td><h2>Story {0}</h2><p>What story {0} tells.</p></td></tr></table><section>Write to us</section>'
    html = [page.format(i, "<ul><li>today only</li></ul>" if i % 2 else "") for i in range(8)]
    assert texts(spark, html, "http://neutral.example/") == [f"Story {i} What story {i} tells." for i in range(8)]
    alone = texts(spark, html[:1], "http://alone.example/")
    assert alone == ["Our place Left Story 0 What story 0 tells. Write to us"]  # one page has no template
    # Many different skeletons, merged in chunks of two and three.
    many = [page.format(i, "".join(f"<{t}>x{i}</{t}>" for t in ("h3", "pre", "blockquote", "center") if i >> "h3 pre blockquote center".split().index(t) & 1)) for i in range(16)]
    rows = [(i, "http://m.example/", h) for i, h in enumerate(many)]
    for merged in (2, 3, 64):
        got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows), merged=merged, broadcast_bytes=0).collect()}
        assert all(f"Story {i} What story {i} tells." in got[i] and "Our place" not in got[i] and "Write to us" not in got[i] for i in range(16))


def test_names_that_say_something_of_the_page(spark):
    cases = {
        '<body class="home has-sidebar"><article><p>Kept</p></article></body>': "Kept", '<div class="page header-fixed"><main><p>Kept</p></main></div>': "Kept",
        "<p>One</p><svg/><p>Two</p>": "One Two", "<p>One</p><iframe src='x'><p>Two</p>": "One Two", "<p>One</p><svg><text>no</text></svg><p>Two</p>": "One Two",
        '<p title="x>One</p><p>Two</p>': "One Two", "<p>One<a href=": "One", '<div class="ad-top">no</div><div class="site_header">no</div><p class="adventure">Yes</p>': "Yes",
    }
    for k, (html, want) in enumerate(cases.items()):
        assert texts(spark, [html], f"http://c{k}.example/") == [want], html


def test_repeated_and_unnamed_pages(spark):
    """Rows alike and rows without id and url: each is put out, one copy counts."""
    page = "<div>Site name</div><p>Text {0} of page {0}</p>"
    rows = [(None, None, page.format(i % 3)) for i in range(60)] + [(5, "http://r.example/", page.format(1))] * 20
    got = html_text.extract(pages(spark, rows), broadcast_bytes=0).collect()
    assert len(got) == 80 and sorted({r.text for r in got if r.page_id is None}) == [f"Text {i} of page {i}" for i in range(3)]


def test_warc_query_returns_the_records(spark, sf):
    from streamloom.llm.queries import QUERIES

    for r in QUERIES["op7_warc_derivatives"](spark, sf).collect():
        (_, block), = warc.records(bytes(r.record))
        assert warc.sha1(block) == r.block_digest and len(block) == r.content_length


def test_warc_codings_ids_digests_and_broken_records(spark):
    import gzip
    import hashlib

    def made(body, head="", ident=True, digest=None):
        headers = [("WARC-Type", "response"), ("WARC-Target-URI", "http://a"), ("WARC-Date", warc.DATE)]
        headers += [("WARC-Record-ID", "<urn:uuid:1>")] * ident + ([("WARC-Payload-Digest", digest)] if digest else [])
        return warc.record(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + head.encode() + b"\r\n" + body)

    page = b"<p>one if a < b and c > d</p>"
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (page[:7], page[7:])) + b"0\r\n\r\n"
    data = [
        made(gzip.compress(page), "Content-Encoding: gzip\r\n"), made(chunked, "Transfer-Encoding: chunked\r\n"), made(page, "Content-Encoding: gzip\r\n"),
        made(page, digest="sha1:" + hashlib.sha1(page).hexdigest()), made(page, digest="sha256:" + "0" * 64), made(page, digest="crc:1"),
        made(page, ident=False) * 2 + b"WARC/1.1\r\nContent-Length: x\r\n\r\nrest\r\n\r\n" + made(page, ident=False), gzip.compress(made(page))[:-20],
    ]
    df = spark.createDataFrame(list(enumerate(data)), "kind int, record binary")
    got = warc.derivatives(df, keep="kind").collect()
    text = {}
    for r in got:
        if r.kind == "conversion":
            text.setdefault(r.source_kind, []).append(next(warc.records(bytes(r.record)))[1].decode())
    assert all(t == "one if a < b and c > d" for ts in text.values() for t in ts) and len(text[6]) == 3
    assert [{r.digest_ok for r in got if r.source_kind == k} for k in (0, 3, 4, 5)] == [{None}, {True}, {False}, {None}]
    ids = [r.record_id for r in got if r.source_kind == 6 and r.kind == "conversion"]
    assert len(set(ids)) == 3 and [r.error for r in got if r.source_kind == 6 and r.kind == "error"] == ["no Content-Length"]
    assert [r.error for r in got if r.source_kind == 7 and r.kind == "error"][-1] == "the gzip stream is broken"
