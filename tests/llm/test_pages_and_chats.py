"""WARC, HTML and chats on awkward tables, against plain versions."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, common, html, warc

PAGES = "page_id long, url string, html string, digest string, nodes string"


def pages(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a.org/1", big, "d", None), (2, "http://a.org/2", big, None, "n"), (3, None, None, None, None), (4, "", "", "d", "n"), (5, "http://b.org/\n5", "small", None, None), (6, "http://b.org/6", "small", None, None), (None, "http://c.org", big, None, None), (7, "http://c.org", "WARC/1.1\r\n\r\nin\r\n\r\nit" + "é" * 700, None, None)]
    return spark.createDataFrame(rows, PAGES)


def test_warc_round_trip(spark, monkeypatch):
    path = common.shared_dir(spark)
    monkeypatch.setattr(warc, "CHUNK", 700)
    monkeypatch.setattr(warc, "ARCHIVE", 900)
    index = warc.write_archives(pages(spark), path)
    assert index.count() == 8
    scanned = [tuple(r)[1:] for r in warc.build_index(spark, path).orderBy("file", "offset").collect()]
    assert [tuple(r)[1:] for r in index.orderBy("file", "offset").collect()] == [x[:4] + (x[4],) + x[5:] for x in scanned]
    got = {r["record_id"]: r for r in warc.payloads(index).collect()}
    assert {k: r["record_type"] for k, r in got.items()} == {f"<urn:page:{k}>": "revisit" if k in (1, "null") else "response" for k in (1, 2, 3, 4, 5, 6, 7, "null")}
    want = {f"<urn:page:{r['page_id'] or 'null'}>": (r["html"] or "").encode() for r in pages(spark).collect()}
    for k, r in got.items():
        assert bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else want[k])
        assert r["refers_to"] == ("<urn:page:2>" if r["record_type"] == "revisit" else None)
    some = warc.payloads(index.filter("record_id = '<urn:page:7>'")).collect()
    assert [bytes(r["payload"]) for r in some] == [want["<urn:page:7>"]]


def test_warc_files_are_gzip_members(spark):
    path = common.shared_dir(spark)
    index = warc.write_archives(pages(spark).limit(2), path)
    assert sorted({r["file"].rpartition("/")[2] for r in index.collect()}) == sorted(p.rpartition("/")[2] for p, in spark.read.format("binaryFile").load(path).select("path").collect())
    data = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect())
    whole = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.endswith(b"\r\n\r\n")


def test_warc_of_an_empty_table(spark):
    assert warc.write_archives(spark.createDataFrame([], PAGES), common.shared_dir(spark)).count() == 0


def test_warc_of_repeated_rows_and_a_long_page(spark):
    """Rows that repeat the largest page_id are all responses; a page longer than what is read at once is whole."""
    long = "<p>" + "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(300_000)) + "</p>"
    rows = [(1, None, long), (1, None, long), (2, None, "y" * 2000), (2, None, "y" * 2000), (0, None, "y" * 2000)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), common.shared_dir(spark))
    assert max(r["length"] for r in index.collect()) > warc.CHUNK
    got = sorted((r["record_id"], r["record_type"], hashlib.sha1(bytes(r["payload"])).hexdigest()) for r in warc.payloads(index).collect())
    of = lambda k, t, kind: (f"<urn:page:{k}>", kind, hashlib.sha1(t.encode()).hexdigest())
    assert got == sorted([of(1, long, "response")] * 2 + [of(2, "y" * 2000, "response")] * 2 + [of(0, "", "revisit")])


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>T</title></head><body><nav><a>m</a></nav><article><h1>H&amp;M</h1><p>a <b>b</b>c<br>d<p>e\n\n f</article><footer>x", "H&M a bc d e f"),
        ("<body><header>h</header><div class='cookie-notice'>c</div><div><p>one&nbsp;two &lt;3</p><script>var a='</p>'</script><p>three</p></div><aside>s</aside><form>f</form>", "one two <3 three"),
        ("<article><header><h1>t</h1></header><p>x</p><div class='ad'>y</div><section id='comments'><p>z</p></section></article>", "t x"),
        ("<p hidden>a</p><ul><li>b<li>c</ul><!-- d --><style>e</style>f", "b c f"),
        ("", ""),
        ("a < b &copy; <unclosed", "a < b ©"),
    ],
)
def test_page_text(page, want):
    assert html.Page(page).text() == want


def test_site_branches_are_removed(spark):
    """A block that repeats on a host goes; what differs from page to page stays, and so do copies of pages."""
    rows = [(k, f"http://a.org/{k}", f"<body><div class='top'>same words here</div><div class='mid'><p>page {k} says {k * k}</p></div>") for k in range(20)]
    rows += [(100 + k, f"http://one.org/{k}", rows[0][2]) for k in range(20)] + [(200, None, None), (201, "http://b.org", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS host", "1 AS nodes")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert len(got) == 42
    for k in range(20):
        assert got[k][0] == f"page {k} says {k * k}"
        assert got[100 + k][0] == "same words here page 0 says 0"
    assert got[200] == ("", 0) and got[201] == ("alone", 5)
    assert html.extract(df.limit(0)).count() == 0


def test_what_is_read_back_is_in_the_archives(spark, tmp_path):
    """A revisit's header is changed in its file: what is read back has the change, not the index's type."""
    import zlib
    from pathlib import Path

    html = "<p>" + "same words " * 200
    pages = spark.createDataFrame([(k, f"http://a.org/{k}", html) for k in range(4)], "page_id long, url string, html string")
    index = common.stored(warc.write_archives(pages, common.shared_dir(spark)))
    row = index.filter("record_type = 'revisit'").orderBy("record_id").first()
    data = Path(row["file"].removeprefix("file://").removeprefix("file:")).read_bytes()
    plain = zlib.decompress(data[row["offset"] : row["offset"] + row["length"]], 31)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    made = packer.compress(plain.replace(b"revisit", b"changed", 1)) + packer.flush()
    (tmp_path / "a.warc.gz").write_bytes(made)
    moved = row.asDict() | {"file": f"file://{tmp_path}/a.warc.gz", "offset": 0, "length": len(made)}
    own = spark.createDataFrame([moved], index.schema)
    found = warc.payloads(index.filter(F.col("record_id") != row["record_id"]).unionByName(own)).collect()
    assert sorted(r["record_type"] for r in found) == ["changed", "response", "revisit", "revisit"]


CHATS = "conv_id long, turn int, role string, text string, valid string"


def test_chats(spark):
    rows = [(1, 1, "assistant", "b\\[INST]", None), (1, 0, "user", "a<|im_end|>", "v"), (2, 0, "assistant", "x", None), (3, None, None, None, None), (3, 1, "odd\nrole<|im_sep|>", "", None), (4, 0, "system", "s", None), (4, 1, "user", "u", None), (4, 2, "assistant", "é\U0001f600", None), (5, 0, "user", "q", None), (5, 0, "user", "q", None), (None, 0, "user", "n", None)]
    made = chat.format_conversations(spark.createDataFrame(rows, CHATS))
    got = {r["conv_id"]: r for r in made.select("*", chat.read_turns(made["formatted"]).alias("back"), chat.read_trained(made["segments"]).alias("trained")).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, None: False}
    assert {k: r["bad_turn"] for k, r in got.items()} == {1: None, 2: 0, 3: 0, 4: None, 5: 1, None: None}
    for k, r in got.items():
        want = sorted(((x[1] if x[1] is not None else -1), x[2] or "", x[3] or "") for x in rows if x[0] == k)
        assert [(t["role"], t["text"]) for t in r["back"]] == [w[1:] for w in want]
        assert r["trained"] == [w[2] for w in want if w[1] == "assistant"]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count("<|im_end|>") == len(want)
    assert chat.format_conversations(spark.createDataFrame([], CHATS)).count() == 0


def test_escapes_are_reversible(spark):

    parts = ["\\", "[", "[INST]", "<|im_end|>", "<", "</s>", "a", "\\\\[", "|>"]
    texts = [a + b + c for a in parts for b in parts for c in parts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.DEFAULT.controls)


def test_global_rank(spark):

    df = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(50)], "a int, b int")
    got = common.global_rank(df, [F.col("a").asc_nulls_last(), F.col("b")], "r", 4).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["r"])] == sorted(((r["a"], r["b"]) for r in got), key=lambda x: (x[0] is None, x))
    assert sorted(r["r"] for r in got) == list(range(50))


def test_digest_is_that_of_the_payload(spark):

    row = spark.createDataFrame([("é",)], "t string").select(warc.payload_digest(F.col("t"))).first()
    assert row[0] == hashlib.sha1("é".encode()).hexdigest()


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body class='right-sidebar'><p>a</p>", "a"),
        ("<article class='no-share'><p>a</p></article>", "a"),
        ("<div class='search-results'><p>a</p></div>", "a"),
        ("<div class='sidebar'><article><p>a</p></article></div>", "a"),
        ("<form><article><p>a</p></article></form>", "a"),
        ("<div class='sidebar-right'>s</div><div class='share social'>t</div><p>a</p>", "a"),
        ("<p>a</p><svg/><p>b</p><svg><path/><text>t</text></svg><p>c</p>", "a b c"),
        ("<article><video src='x'><p>a</p></article>", "a"),
        ("<article><video src='x'>old browser</video><p>a</p></article>", "a"),
        ("<select-box>a</select-box><p>b", "a b"),
        ("<script src='x'/><p>a</p><script>b</script>", "a"),
        ("<p>a</p><style>.x{}</styles>b</style><p>c</p>", "a c"),
    ],
)
def test_no_page_is_lost_by_a_name(page, want):
    assert html.Page(page).text() == want


def extracted(spark, make):
    df = spark.createDataFrame([(k, f"http://a.org/{k}", make(k)) for k in range(20)], "page_id long, url string, html string")
    return [r["text"] for r in html.extract(df).orderBy("page_id").collect()]


def test_a_repeated_text_takes_no_page_with_it(spark):
    got = extracted(spark, lambda k: f"<body>Skip to content<div class='wrap'>Menu<article><p>page {k}</p></article></div></body>")
    assert got == [f"page {k}" for k in range(20)]


def test_importance_decides_inside_and_outside_of_the_article(spark):
    got = extracted(spark, lambda k: f"<div class='lead'>lead {k}</div><div class='top'>same</div><article><p>page {k}</p><div class='more'>Read more here</div></article><nav>n {k}</nav>")
    assert got == [f"lead {k} page {k} Read more here" for k in range(20)]


def test_menus_go_by_the_tree_alone(spark, monkeypatch):
    """With no tag or word that declares noise, lists of links outside the article go by importance."""
    monkeypatch.setattr(html, "DROPPED", frozenset({"head"}))
    links = lambda k: " ".join(f"<li><a href='/{k}{j}'>word {k} {j}</a></li>" for j in range(5))
    pages = [f"<div class='x'><ul>{links(k)}</ul></div><div class='intro'>intro {k}</div><article><p>page {k}</p><p><a href='u'>all linked {k}</a></article>" for k in range(20)]
    got = extracted(spark, pages.__getitem__)
    assert got == [f"intro {k} page {k} all linked {k}" for k in range(20)]


def test_repeated_headings_and_bylines_of_an_article_stay(spark):
    got = extracted(spark, lambda k: f"<article><p class='by'>By Jo Doe</p><p>story {k}</p><h2>Conclusion</h2><p>end {k}</p></article>")
    assert got == [f"By Jo Doe story {k} Conclusion end {k}" for k in range(20)]


STORY = "<article><p>the story as it is told</p></article>"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div style='overflow:hidden'><article><p>a</p></article></div>", "a"),
        ("<p style='overflow:hidden'>a</p><p title='a hidden gem'>b</p><p data-class='ad'>c</p><p data-id=comments>d</p>", "a b c d"),
        ("<div data-url='/x?id=search' data-hidden><p>a</p></div><p hidden>b</p><p hidden=''>c</p>", "a"),
        ("<p title=it's>a</p><p>b's</p><p>c</p>", "a b's c"),
        ("<p title=\"a > b\" class = 'ad'>x</p><p class=ad>y</p><p CLASS=\"x ad\">z</p><p>c", "c"),
        ("<p>a</p><!-- x --!><p>b</p><!--><p>c</p><!---><p>d</p>", "a b c d"),
        ("<p title='open>a</p><p>b", "a b"),
        (STORY + "<div class='comments'><article><p>reader says</p></article></div>", "the story as it is told"),
        (STORY + "<ol class='comment-list'><li><article><p>reader says so much more than the story does</p></article></ol>", "the story as it is told"),
        ("<article><p>story</p><section class='user-comments'><p>reader</p></section></article>", "story"),
        ("<article class='has-comments'><p>story</p></article>", "story"),
        ("<div class='post with-comments'><p>story</p></div>", "story"),
        (STORY + "<footer><article>f</article></footer><div class='sidebar'><article>s</article></div>", "the story as it is told"),
        ("<div id='content'><p>" + "the story " * 13 + "</p></div><div class='comments'><article>" + "no " * 90 + "</article></div>", ("the story " * 13).strip()),
        ("<form id='page'><p>a</p></form>", "a"),
        ("<article><noscript>a</noscript><object>b</object><fieldset>c</fieldset><p aria-hidden='true'>d</p><p class='related'>e</p><div class='social'>f</div><p class='copyright'>g</p></article>", "a b c d e f g"),
        ("<noscript>x</noscript>" + STORY, "the story as it is told"),
        ("<div id='content'><p>" + "the main story " * 9 + "</p></div><article class='card'>a teaser of some fifty nine characters in all, no more</article>", "the main story " * 9 + "a teaser of some fifty nine characters in all, no more"),
    ],
)
def test_attributes_comments_and_main_content(page, want):
    assert html.Page(page).text() == want


def test_few_pages_follow_declared_roles(spark):
    df = spark.createDataFrame([(1, "http://a.org", "<div>out</div><article>in</article>")], "page_id long, url string, html string")
    assert [r["text"] for r in html.extract(df).collect()] == ["in"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>One.</p><svg class='i'/><p>Two must stay.</p>", "One. Two must stay."),
        ("<title-card>Inside</title-card><p>a</p>", "Inside a"),
        ("<article><p class='share-prices'>a</p><p class='search-results-study'>b</p><p class='form-guide'>c</p><p class='social-policy'>d</p></article>", "a b c d"),
        ("<article class='teaser'>t</article><div id='content'>" + "the main story " * 9 + "</div>", "t " + "the main story " * 8 + "the main story"),
        ("<article>a <math><mi>x</mi></math> <label>b</label></article>", "a x b"),
        ("<i>" * 3000 + "<div>" * 3000 + "deep" + "</b>" * 3000 + "</div>" * 3000 + "<p>a", "deep a"),
        ("<p>" + "long words " * 400_000, ("long words " * 400_000).strip()),
    ],
)
def test_nothing_of_a_page_is_lost(page, want):
    assert html.Page(page).text() == want


def test_only_repeated_texts_of_a_branch_go(spark):
    got = extracted(spark, lambda k: f"<div class='c'>Read more: <p>Unique story number {k} of many</p></div>")
    assert got == [f"Unique story number {k} of many" for k in range(20)]


def plain_blocks(element, chain, inside, out, shapes):
    """(chain of tags and classes, in main, text) of well-formed pages, by recursion."""
    held = []

    def flush():
        if words := "".join(held).split():
            out.append((chain, inside, " ".join(words)))
        held.clear()

    def content(e):
        held.append(e.text or "")
        for child in e:
            if child.tag in html.INLINE:
                content(child)
            else:
                flush()
                names = shapes.setdefault(chain, [])
                if names[-1:] != [child.tag]:
                    names.append(child.tag)
                own = (*chain, (child.tag, child.get("class", "")))
                plain_blocks(child, own, inside or child.tag in html.MAIN, out, shapes)
            held.append(child.tail or "")

    content(element)
    flush()


def plain_extract(rows):
    """The texts of rows (page_id, host, html) by the importance of nodes, computed page by page."""
    import math
    import xml.etree.ElementTree as ET
    from collections import Counter

    read = []
    for page_id, host, page in rows:
        out, shapes = [], {}
        plain_blocks(ET.fromstring(f"<x>{page}</x>"), (), False, out, shapes)
        main = any(i for _, i, _ in out)
        read.append((page_id, host, out, shapes, tuple(t for _, i, t in out if i or not main)))
    many = {h for h in {r[1] for r in read} if len({r[4] for r in read if r[1] == h}) >= html.LEAST_PAGES}
    seen = {}
    for _, host, out, shapes, identity in read:
        for chain in {c for c, _, _ in out}:
            for inside in {i for c, i, _ in out if c == chain}:
                mine = tuple(t for c, i, t in out if c == chain and i == inside), tuple(shapes.get(chain, ()))
                seen.setdefault((host if host in many else None, chain, inside), {})[identity] = mine

    def spread(values):
        m, n = len(values), Counter(values)
        return -sum(x / m * math.log(x / m, m) for x in n.values()) if m > 1 else 1.0

    low, high = set(), set()
    for key, by_page in seen.items():
        if len(by_page) >= html.LEAST_PAGES and not key[2]:
            repeats = all(spread([v[k] for v in by_page.values()]) < html.LEAST_IMPORTANCE for k in (0, 1))
            (low if repeats else high).add(key)
    made = {}
    for page_id, host, out, _, _ in read:
        group = host if host in many else None
        gone = {c for h, c, _ in low if h == group}
        stays = {c for h, c, i in high if h == group and not i and group is not None}
        left = [x for x in out if x[1] or x[0] not in gone]
        inner, outer = (sum(len(t) for c, i, t in left if i == side and (i or c not in stays)) for side in (True, False))
        made[page_id] = " ".join(t for c, i, t in left if i or not inner or inner < outer or c in stays)
    return made


def test_extraction_against_a_plain_version(spark):
    import random

    r = random.Random(6)
    word = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(40)) for _ in range(n))
    rows = []
    for host, n in (("a.org", 30), ("b.org", 12), *((f"small{k}.org", 2) for k in range(9))):
        same = word(3)
        for _ in range(n):
            body = "".join(f"<p>{word(r.randrange(1, 9))}<b>{word(1)}</b></p>" for _ in range(r.randrange(1, 4)))
            top = same if r.random() < 0.8 else word(2)
            rows.append((len(rows), host, f"<div class='t'>{top}</div><div class='u'>{word(r.choice([1, 2]))}<ul>Powered by it</ul></div><article>{body}<div class='m'>{r.choice(['Read on', 'More'])}</div></article>"))
    rows += [(1000 + k, "a.org", f"<div class='t'>{word(2)}</div>{rows[0][2][rows[0][2].index('<article>'):]}") for k in range(40)]
    df = spark.createDataFrame([(k, f"http://{h}/{k}", p) for k, h, p in rows], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html.extract(df).collect()}
    assert got == plain_extract(rows)


def test_rows_that_repeat_a_page(spark):
    df = spark.createDataFrame([(1, "http://a.org", "<p>a</p>"), (1, "http://a.org", "<p>a</p>"), (1, None, "<p>b</p>")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html.extract(df).collect()) == ["a", "a", "b"]


def test_a_very_long_turn(spark):
    long = "words [INST] and </s> " * 50_000
    made = chat.format_conversations(spark.createDataFrame([(1, 0, "user", long, None), (1, 1, "assistant", long, None)], CHATS))
    got = made.select(chat.read_turns(made["formatted"]).alias("back"), chat.read_trained(made["segments"]).alias("trained")).first()
    assert [t["text"] for t in got["back"]] == [long, long] and got["trained"] == [long]
