"""HTML extraction on our own page fixtures (FIXTURES §6)."""

from __future__ import annotations

from recensio.config import Config
from recensio.operators import reviews as RV
from recensio.sources import pages as PG

LONG = "Servizio eccellente, spedizione rapidissima e imballo perfetto davvero"  # > 50 chars
LONG2 = "Assistenza lenta, ho atteso tre settimane per una risposta via email"


def art(text, rating="5", extra=""):
    return f'<article data-service-review-rating="{rating}" {extra}><p>{text}</p></article>'


def _pages(spark, rows):
    return spark.createDataFrame(rows, "company string, pagina int, url string, status int, html string")


def _reviews(spark, rows, cfg=Config()):
    raw = PG.raw_from_pages(_pages(spark, rows), cfg)
    return RV.to_reviews(raw, cfg).orderBy("company", "seq")


def test_primary_containers(spark):
    html = "<html><body>" + art(LONG, "5") + art(LONG2, "2") + "</body></html>"
    r = _reviews(spark, [("c", 1, "u1", 200, html)]).collect()
    assert [(x.pos, x.rating) for x in r] == [(0, 5), (1, 2)]


def test_fallback_nested_both_match(spark):
    html = (f'<article class="review-card"><section class="x reviewContentwrapper"><p>{LONG}</p></section></article>')
    r = _reviews(spark, [("c", 1, "u1", 200, html)]).collect()
    assert len(r) == 2 and r[0].testo == LONG and r[1].testo == LONG


def test_bad_rating_rejected_and_short_dropped(spark):
    html = art(LONG, "five") + art("troppo corto", "4") + art(LONG2, "3")
    pages = _pages(spark, [("c", 1, "u1", 200, html)])
    raw = PG.raw_from_pages(pages, Config())
    assert [x.rating for x in RV.to_reviews(raw).collect()] == [3]
    assert [x.reason for x in RV.rejected(raw).collect()] == ["rating attribute is not an integer"]


def test_empty_attribute_uses_nested_div(spark):
    html = f'<article data-service-review-rating=""><div data-service-review-rating="4"></div><p>{LONG}</p></article>'
    r = _reviews(spark, [("c", 1, "u1", 200, html)]).collect()
    assert r[0].rating == 4


def test_rating_from_text_when_no_attribute(spark):
    html = f'<div class="review-content"><p>{LONG} 3 stelle</p></div>'
    r = _reviews(spark, [("c", 1, "u1", 200, html)]).collect()
    assert r[0].rating == 3


def test_empty_first_page_drops_company(spark):
    rows = [("a", 1, "u1", 200, "<html><p>nessuna recensione</p></html>"),
            ("a", 2, "u2", 200, art(LONG)),
            ("b", 1, "u3", 200, art(LONG2))]
    r = _reviews(spark, rows).collect()
    assert [x.company for x in r] == ["b"]


def test_failed_first_page_goes_on(spark):
    rows = [("a", 1, "u1", None, None), ("a", 2, "u2", 200, art(LONG))]
    r = _reviews(spark, rows).collect()
    assert [(x.company, x.pagina) for x in r] == [("a", 2)]


def test_bad_status_stops_crawl(spark):
    rows = [("a", p, f"u{p}", 404 if p == 3 else 200, art(LONG)) for p in range(1, 6)]
    r = _reviews(spark, rows).collect()
    assert sorted({x.pagina for x in r}) == [1, 2]


def test_hidden_text_left_out(spark):
    html = (f'<article data-service-review-rating="4"><script>var x = 1;</script><style>p {{}}</style>'
            f'<!-- nota --><p>{LONG}</p></article>')
    r = _reviews(spark, [("c", 1, "u1", 200, html)]).collect()
    assert r[0].testo == LONG


def test_review_id_and_link(spark):
    cfg = Config()
    html = (art(LONG, "5", 'data-service-review-id="svc1"')
            + f'<article data-service-review-rating="4"><a href="/it/reviews/abc?x=1#y">link</a><p>{LONG2}</p></article>'
            + art(LONG, "3"))
    r = _reviews(spark, [("c", 1, "https://site/page1", 200, html)], cfg).collect()
    assert [x.review_id for x in r] == ["svc1", "abc", None]
    assert [x.link for x in r] == [cfg.link_base + "svc1", cfg.link_base + "abc", "https://site/page1"]


def test_unclosed_tags_parse(spark):
    html = f'<article data-service-review-rating="5"><b>{LONG}<br><p>altro testo</article>'
    r = _reviews(spark, [("c", 1, "u1", 200, html)]).collect()
    assert r[0].testo == LONG + " altro testo"


def test_review_id_methods_from_markup(spark):
    cfg = Config()
    m1 = (f'<article data-service-review-rating="5" data-service-review-id="svc">'
          f'<a data-review-url="/it/reviews/m1id">x</a><p>{LONG}</p></article>')
    m3 = (f'<article data-service-review-rating="4"><a href="/it/reviews/m3id?p=2"><span><time datetime="2024-01-01">1 gen</time>'
          f'</span></a><a href="/it/reviews/other">y</a><p>{LONG2}</p></article>')
    m3_not_review = (f'<article data-service-review-rating="4"><a href="/users/9"><time datetime="2024">t</time></a>'
                     f'<a href="/it/reviews/m4id?q#f">z</a><p>{LONG}</p></article>')
    m5 = f'<article data-service-review-rating="3" data-consumer-review-id="m5id"><p>{LONG2}</p></article>'
    r = _reviews(spark, [("c", 1, "u1", 200, m1 + m3 + m3_not_review + m5)], cfg).collect()
    assert [x.review_id for x in r] == ["m1id", "m3id", "m4id", "m5id"]


def test_last_of_repeated_attributes_counts(spark):
    html = f'<article data-service-review-rating="1" data-service-review-rating="5"><p>{LONG}</p></article>'
    assert [x.rating for x in _reviews(spark, [("c", 1, "u1", 200, html)]).collect()] == [5]


def test_broken_container_drops_itself_only(spark, monkeypatch):
    from recensio.functions import html as H

    good = H.container_record
    monkeypatch.setattr(H, "container_record", lambda c, a: 1 / 0 if c.attrs[a] == "4" else good(c, a))
    rows = H.page_records(art(LONG, "5") + art(LONG2, "4") + art(LONG2, "3"), "data-service-review-rating", ())
    assert [(p, r is not None, bool(e)) for p, r, e in rows] == [(0, True, False), (1, False, True), (2, True, False)]
    raw = spark.createDataFrame([("c", 1, 1, 0, LONG, "5", None, None), ("c", 2, 1, 1, None, None, None, "container: x")],
                                "company string, seq long, pagina int, pos int, testo string, rating_attr string, rating_div string, error string")
    assert [(x.pos, x.reason) for x in RV.rejected(raw).collect()] == [(1, "container: x")]


def test_one_walk_per_page(spark):
    walked = PG.raw_from_pages(_pages(spark, [("c", 1, "u1", 200, art(LONG))]), Config())
    assert "MapInPandas" not in walked._jdf.queryExecution().executedPlan().toString()  # the walk is written, not repeated


def _tree(html, void, hidden):
    """A plain tree of a page, for comparison: [tag, attrs, parent, children]."""
    from html.parser import HTMLParser

    root = ["", {}, None, []]

    class Build(HTMLParser):
        cur = root

        def handle_starttag(self, tag, attrs):
            n = [tag, {k: v or "" for k, v in attrs}, self.cur, []]
            self.cur[3].append(n)
            if tag not in void:
                self.cur = n

        def handle_startendtag(self, tag, attrs):
            self.cur[3].append([tag, {k: v or "" for k, v in attrs}, self.cur, []])

        def handle_endtag(self, tag):
            n = self.cur
            while n is not root and n[0] != tag:
                n = n[2]
            if n is not root:
                self.cur = n[2]

        def handle_data(self, data):
            self.cur[3].append(data)

        def unknown_decl(self, data):
            if data.startswith("CDATA["):
                self.cur[3].append(data[6:])

    b = Build(convert_charrefs=True)
    b.feed(html)
    b.close()
    return root


def _plain_records(html, attr, fallback):
    from recensio.functions import html as H

    root = _tree(html, H.VOID, H.HIDDEN_TEXT)

    def below(n):
        for c in n[3]:
            if isinstance(c, list):
                yield c
                yield from below(c)

    def text(n):
        out = []
        for c in ([] if n[0] in H.HIDDEN_TEXT else n[3]):
            out += [c.strip()] if isinstance(c, str) else text(c)
        return [x for x in out if x]

    every = list(below(root))
    found = [n for n in every if n[0] == "article" and attr in n[1]] or [n for n in every if any(n[0] == t and p in n[1].get(a, "") for t, a, p in fallback)]
    out = []
    for c in found:
        first = lambda tag, ok: next((n for n in below(c) if n[0] == tag and ok(n[1])), None)
        div, url, review = first("div", lambda a: attr in a), first("a", lambda a: "data-review-url" in a), first("a", lambda a: "/reviews/" in a.get("href", ""))
        at = first("time", lambda a: "datetime" in a)
        up = at and at[2]
        while up and not (up[0] == "a" and "href" in up[1]):
            up = up[2]
        out.append({"testo": " ".join(text(c)), "rating_attr": c[1].get(attr), "rating_div": div and div[1][attr], "m1_url": url and url[1]["data-review-url"],
                    "m2_id": c[1].get("data-service-review-id"), "m3_href": up[1]["href"] if up else None, "m4_href": review and review[1]["href"], "m5_id": c[1].get("data-consumer-review-id")})
    return out


def test_one_pass_equals_the_tree():
    """Random markup, mostly broken: the events give what a tree gives."""
    import random

    from recensio.functions import html as H

    attr, fallback = "data-service-review-rating", Config().fallback_selectors
    bits = ["<article>", f'<article {attr}="4">', f'<article {attr}="" data-service-review-id="s1">', "</article>", '<article class="a review">', '<section class="reviewContentwrapper">', "</section>",
            '<div class="review-content">', f'<div {attr}="2">', f'<div {attr}>', "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "<br/>", "<img src=x>", "<spacer>", '<a href="/reviews/r1?x#y">', '<a href="/users/9">',
            '<a data-review-url="/it/reviews/u1">', "<a href>", "</a>", '<time datetime="2024">', "</time>", "<script>", "</script>", "<style>", "</style>", "<template>", "</template>", "<!-- no -->",
            "<![CDATA[cd]]>", "&amp;", "&copy", " uno ", "due", "\n", "<", "tre &lt;", "</span>", f'<article {attr}="5"/>', "<article/>"]
    rng = random.Random(6)
    for i in range(6000):
        some = [b for b in bits if attr not in b] if i % 3 == 0 else bits
        html = "".join(rng.choices(some, k=rng.randint(0, 40)))
        got = [r for _, r, _ in H.page_records(html, attr, fallback) if r]
        assert got == _plain_records(html, attr, fallback), html


def test_deep_markup_needs_no_recursion():
    from recensio.functions import html as H

    html = '<article data-service-review-rating="3">' + "<div>" * 50_000 + "fondo" + "</div>" * 50_000 + "dopo</article>fuori"
    ((_, rec, _),) = H.page_records(html, "data-service-review-rating", ())
    assert rec["testo"] == "fondo dopo"
