"""Transport streams, archives and extraction: exact round trips and awkward input."""

import hashlib
import re
import struct
import zlib

import pytest
import zstandard

from quire.llm.html_text import extract_articles, main_text
from quire.llm.transport_stream import PACKET, UNIT, media_features, parse_stream, text_to_media, write_stream
from quire.llm.warc import ARCHIVE_BYTES, DICTIONARY_MAGIC, archive_round_trip, pack, parse_record, read_archives, record, unpack, write_archives


@pytest.mark.parametrize("size", [0, 1, 100, 156, 157, 158, 159, 160, 161, 162, 163, 164, 165, 166, 167, 168, 169, 170, 171, 172, 182, 183, 184, 185, 192, UNIT, UNIT + 192, UNIT * 20 + 5])
def test_stream_round_trip(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    stream = write_stream(payload)
    got = parse_stream(stream)
    assert len(stream) % PACKET == 0 and got["payload"] == payload
    assert got["continuity_errors"] == got["bad_sync"] == 0
    if size:
        units = -(-size // UNIT)
        assert got["programs"] == {1: 0x1000} and got["streams"] == {0x100: 6}
        assert got["times"] == [k * 3600 for k in range(units)] and got["random_access"] == [k * 3600 for k in range(0, units, 8)]


def test_stream_faults():
    stream = write_stream(b"x" * 3 * UNIT)
    lost = stream[: 10 * PACKET] + stream[11 * PACKET :]
    assert parse_stream(lost)["continuity_errors"] == 1
    bad = bytearray(stream)
    bad[5 * PACKET] = 0
    assert parse_stream(bytes(bad))["bad_sync"] == 1
    broken = bytearray(stream)
    broken[8] ^= 1  # the association table's checksum fails
    assert parse_stream(bytes(broken))["streams"] == {} and parse_stream(bytes(broken))["payload"] == b""
    assert parse_stream(b"\x00" * 400)["payload"] == b""


def test_media_column(spark):
    rows = [(1, "äb"), (2, None), (3, ""), (4, "y" * 100_000), (None, "n"), (1, "äb")]
    df = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, media string")
    got = media_features(text_to_media(df)).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        own = [r for r in got if r.id == i and r.n_bytes == len(data)]
        assert own and all(r.payload_bytes == len(padded) and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and "continuity_errors=0" in r.feature for r in own)
    assert media_features(text_to_media(df.limit(0))).count() == 0
    assert media_features(spark.createDataFrame([(1, 0, None)], "id long, n_bytes long, media binary")).first().payload_bytes == 0


def walked(stream):
    """Payload, times, access times and packets of the elementary stream, packet by packet as the standard has it."""
    payload, times, access, packets, counter = b"", [], [], 0, {}
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert packet[0] == 0x47 and len(packet) == 188
        pid, control, packets = (packet[1] & 31) * 256 + packet[2], packet[3] >> 4 & 3, packets + 1
        assert control & 1 and packet[3] & 15 == counter.get(pid, 0)
        counter[pid] = (packet[3] + 1) & 15
        if pid != 0x100:
            continue
        body, entry = packet[4:], False
        if control & 2:
            entry, body = bool(body[0] and body[1] & 0x40), body[1 + body[0] :]
        if packet[1] & 0x40:
            assert body[:3] == b"\0\0\1" and body[7] >> 6 == 2
            p = body[9:14]
            times.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
            access += times[-1:] if entry else []
            body = body[9 + body[8] :]
        payload += body
    return payload, times, access, packets


def test_media_query(spark, tmp_path):
    """Every column of op8 against a walk over the stored bytes, and times and access points against their rule."""
    from quire.llm.queries import op8_transport_stream, table

    known = table(spark, "/root/testdata/sf0.001", "documents")
    long_one = known.where("doc_id = 0").selectExpr("cast(-1 as bigint) as doc_id", "repeat(text, cast(200000 / length(text) as int) + 1) as text")  # none of the table's has more than one access point
    known.select("doc_id", "text").union(long_one).write.parquet(str(tmp_path / "documents.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    media = {r.id: bytes(r.media) for r in text_to_media(docs).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    got = op8_transport_stream(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) == len(media) and any(len(r.random_access) > 1 for r in got)
    for r in got:
        data, stored = texts[r.doc_id], media[r.doc_id]
        padded = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        payload, times, access, packets = walked(stored)
        units = -(-len(padded) // UNIT)
        assert payload == padded and times == [k * 3600 for k in range(units)] == r.times and access == times[::8] == r.random_access
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == f"streams=256:6;packets={packets};bad_sync=0;continuity_errors=0;units={units};pts=0-{times[-1]};random_access={len(access)}"


def test_payloads_in_sql(spark):
    import duckdb

    from quire.llm.oracles import ORACLES
    from quire.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    wanted = sorted(con.execute(f"SELECT doc_id, n_bytes, payload_bytes, payload_sha256 FROM ({ORACLES['media_payloads']})").fetchall())
    assert sorted(map(tuple, QUERIES["media_payloads"](spark, "/root/testdata/sf0.001").collect())) == wanted


def test_archive_format():
    records = [record(i, f"http://a.example/{i}\r\nX: y", (f"<p>page {i} " + "common text " * 50).encode(), 0, hashlib.sha1(b"").digest(), None) for i in range(300)]
    packed = pack(records)
    magic, size = struct.unpack_from("<II", packed)
    assert magic == DICTIONARY_MAGIC
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed[8 : 8 + size]))
    assert zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(packed[8 + size :]) == records[0]
    assert list(unpack(packed)) == records and list(unpack(pack(records[:1]))) == records[:1] and list(unpack(pack([]))) == []
    with pytest.raises(ValueError):
        list(unpack(packed[:-3]))
    with pytest.raises(ValueError):
        parse_record(records[0])  # its digest is another payload's


def test_archives(spark, tmp_path):
    big = "b" * 2000
    rows = [(1, "u1", big), (2, None, big), (3, "u 3\n", "small"), (4, "u4", "small"), (5, "u5", None), (None, "u6", big), (7, "u7", "c" * 1000), (7, "u7", "c" * 1000), (8, "ü", "é" * 600)]
    df = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, payload string")
    got = archive_round_trip(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].record_type == "revisit" and by[1].refers_to == 2 and by[2].record_type == "response" and by[None].refers_to == 2
    assert by[3].record_type == by[4].record_type == "response" and by[5].payload_bytes == 0
    assert [r.record_type for r in got if r.page_id == 7] == ["response"] * 2
    for i, _, html in rows:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    listing = write_archives(df, f"file://{tmp_path}/w").cache()
    full = read_archives(listing, payloads=True).collect()
    assert sorted(bytes(r.payload) for r in full if r.record_type == "response") == sorted((h or "").encode() for i, _, h in rows if i not in (1, None))
    assert archive_round_trip(df.limit(0)).count() == 0


def test_payload_above_an_archive(spark):
    """A page that is larger than an archive's size gets one of its own."""
    big = "abcdefghij" * (ARCHIVE_BYTES // 10 + 1)
    df = spark.createDataFrame([(1, "u", "small"), (2, "u", big), (3, "u", "also small")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in archive_round_trip(df.coalesce(1)).collect()}
    assert got == {i: (len(t), hashlib.sha1(t.encode()).hexdigest()) for i, t in ((1, "small"), (2, big), (3, "also small"))}


PAGES = [
    ("<html><body><nav><a>Home</a></nav><article><h1>Title</h1><p>One &amp; two<p>three <b>bold</b>\n  x</p></article><footer>end</footer></body></html>", "Title\nOne & two\nthree bold x"),
    ('<body class="has-sidebar"><div class="sidebar">s</div><main><p>a<br>b</p><div class="ad">buy</div><form><p>name</p></form><ul><li>i1<li>i2</ul><div id="comments"><p>first!</p></div></main>', "a b\ni1\ni2"),
    ("<article><header><h1>H</h1><p>by me</p></header><p>text</p><footer>f</footer><aside>x</aside></article>", "H\ntext"),
    ("<article><p>a &lt;b&gt; &#233; &nbsp;c &unknown; &amp</p><script>var x='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>d</p></article>", "a <b> é c &unknown; &\nd"),
    ("<article><div class=ad><p>unclosed advert</article><p>after", ""),
    ("<article><p>1 < 2 and <3</p><p hidden>no</p><p style='display:none'>no</p><table><tr><td>c1<td>c2</table></article>", "1 < 2 and <3\nc1\nc2"),
    ("", ""),
    ("<article><header><h1>H</h1><p class='article-standfirst'>What it is about.</p><p class='byline'>by me</p></header><p>text</p></article>", "H\nWhat it is about.\ntext"),
    ("<article><p>Let <math><mi>x</mi><annotation encoding='tex'>no</annotation></math> be</p></article>", "Let x be"),
    ("<article><p>one</p><section class='cookie-recipes'><p>two</p></section><div class='ad-hoc-queries'><p>three</p></div><div class='cookie-banner'>no</div><div class='ad-slot-2'>no</div></article>", "one\ntwo\nthree"),
    ("plain words without any markup, but enough of them to be taken for an article here", "plain words without any markup, but enough of them to be taken for an article here"),
    (None, ""),
    ("<p", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_line_blocks_without_article():
    menu = "".join(f'<li><a href="/{i}">Menu entry number {i}</a></li>' for i in range(20))
    body = "".join(f"<p>Paragraph {i} has a good deal of running text in it, as articles do.</p>" for i in range(6))
    text = main_text(f"<body><div><ul>{menu}</ul></div><div>{body}</div><div class='footer'>About us and all our friends, a long line of text here</div>")
    assert text.split("\n") == [f"Paragraph {i} has a good deal of running text in it, as articles do." for i in range(6)]


def _words(n, size=300):
    return f"Paragraph {n} " + "of the article goes on " * (size // 23) + "."


ADVERT = '<div class="ad"><p>Buy this now, a great offer for all of our readers.</p></div>'


@pytest.mark.parametrize("open_, close", [("<body>", "</body>"), ("<body><div>", "</div></body>"), ("<body><div><section>", "</section></div></body>")])
def test_advert_inside_unmarked_article(open_, close):
    parts = [_words(i) for i in range(11)]
    for ending in ([], ["The end."]):
        page = open_ + "".join(f"<p>{x}</p>" for x in parts[:10]) + ADVERT + "".join(f"<p>{x}</p>" for x in parts[10:] + ending) + close
        assert main_text(page).split("\n") == parts + ending
    page = "<body><div><div>" + "".join(f"<p>{x}</p>" for x in parts[:10]) + "</div>" + ADVERT + f"<div><p>{parts[10]}</p></div></div></body>"
    assert main_text(page).split("\n") == parts
    assert main_text("<body>" + "".join(f"<p>{x}</p>" for x in parts[:2]) + ADVERT + f"<p>short</p>{ADVERT}<p>{parts[2]}</p></body>").split("\n") == [*parts[:2], "short", parts[2]]


def test_short_unmarked_article():
    assert main_text("<body><h1>Note</h1><p>Closed today.</p></body>") == "Note\nClosed today."
    lines = [f"A short line {i}" for i in range(12)]
    poem = "".join(f"<p>{x}</p>" for x in lines)
    assert main_text(f"<body><div>{poem}</div></body>").split("\n") == lines
    menu = "".join(f'<li><a href="/{i}">Menu entry number {i}</a></li>' for i in range(20))
    assert main_text(f"<body><div><ul>{menu}</ul></div><div>{poem}</div></body>").split("\n") == lines
    assert main_text(f"<body><div><ul>{menu}</ul></div></body>") == ""


def test_links_inside_unmarked_article():
    page = f'<body><div><p>{_words(1)}</p><p><a href="/x">The whole report</a></p><p>{_words(2)}</p></div></body>'
    assert main_text(page).split("\n") == [_words(1), "The whole report", _words(2)]


TITLED = ['<section id="related-work">{}</section>', '<h2 id="social-history">{}</h2>', '<h2 id="advertising">{}</h2>', '<p id="promotion-and-sponsor-deals">{}</p>', '<section id="notices">{}</section>', '<h2><span class="headline" id="advertising">{}</span></h2>', '<div class="section" id="comments">{}</div>', '<div class="social-history">{}</div>', '<div id="related-work">{}</div>']


@pytest.mark.parametrize("part", TITLED)
@pytest.mark.parametrize("around", ["article", "main"])
def test_parts_named_by_titles(part, around):
    inside = part.format("A part of the article.")
    assert main_text(f"<body><{around}><p>before</p>{inside}<p>after</p></{around}></body>") == "before\nA part of the article.\nafter"


NAMED = ["div class='ad'", "div class='ad-hoc-unit'", "div class='google-ad 300'", "div class='ad-300x250'", "div class='related-posts'", "ul class='share-buttons'", "div id='comments'", "div id='cookie-banner'", "p class='advert'", "section class='newsletter-signup'", "div class='post-comments'", "div class='comment__item'"]


@pytest.mark.parametrize("tag", NAMED)
def test_parts_named_by_layout(tag):
    assert main_text(f"<article><p>before</p><{tag}>not the article</{tag.split()[0]}><p>after</p></article>") == "before\nafter"


MENU = "".join(f'<li><a href="/{i}">Menu entry number {i}</a></li>' for i in range(20))
WHOLE = [
    "<body><h1>Title</h1><p>Short article.</p><p>Only a little.</p></body>",
    "<body><p>One short block.</p></body>",
    "<body><div><p>{long}</p><p>{long}</p><p>a</p><p>b</p><p>c</p><p>d</p><p>e</p></div></body>",  # an ending of short lines
    "<body><div><p>a</p><p>b</p><p>c</p><p>d</p><p>{long}</p><p>{long}</p></div></body>",
    "<body><div>" + "<div><p>{long}</p></div>" * 5 + "<div><p>end</p></div></div></body>",  # a container for each paragraph
    "<body><article><p>{long}</p><p><a href='/x'>a paragraph in a link</a></p><p>x</p><p>y</p><p>z</p></article></body>",
    "<body><article><p>{long}</p><ul><li><a>r1</a></li><li><a>r2</a></li><li><a>r3</a></li><li><a>r4</a></li></ul></article></body>",
    "<body><article><div class='share-price'>The price of a share</div><p>x</p></article></body>",
    "<body><main><article><p>{long}</p></article><article><p>short one</p></article></main></body>",
]


@pytest.mark.parametrize("page", WHOLE)
@pytest.mark.parametrize("menu", ["", f"<div><ul>{MENU}</ul></div>"])
def test_nothing_of_an_article_is_lost(page, menu):
    """Pages with an article and at most a menu: every block of the article is kept, whatever its length."""
    page = page.format(long=_words(7))
    expected = [x for x in re.split(r"<[^>]*>", page) if x]
    assert main_text(page.replace("<body>", f"<body>{menu}")).split("\n") == expected


@pytest.mark.parametrize("n", [1, 2, 3, 10, 60])
def test_unmarked_parts_around_an_article(n):
    """Short lines of other containers stay outside of surge and dive; a page's own sums set the threshold."""
    body = [_words(i, 200) for i in range(n)]
    page = f"<body><div><ul>{MENU}</ul></div><div><p>Log in</p></div><div>{''.join(f'<p>{x}</p>' for x in body)}</div><div><p>All rights reserved</p></div></body>"
    assert main_text(page).split("\n") == body


def test_very_long_page():
    body = [_words(i, 900) for i in range(4000)]
    assert main_text(f"<body><div>{''.join(f'<p>{x}</p>' for x in body)}</div></body>").split("\n") == body


def test_extract(spark):
    df = spark.createDataFrame([(i, None, p, "t") for i, (p, _) in enumerate(PAGES)] + [(None, "u", None, "t")], "page_id long, url string, html string, text string")
    assert extract_articles(df.union(df)).count() == 2 * df.count()
    got = {r.page_id: (r.text, r.n_chars) for r in extract_articles(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} | {None: ("", 0)}
    assert extract_articles(df.limit(0)).count() == 0
