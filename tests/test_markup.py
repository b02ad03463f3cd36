"""Elements by selector against a plain parser with a stack, and what pages tell."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from listingspark.functions import markup as K
from listingspark.operators import extract as X


class Plain(HTMLParser):
    """Start and end of the elements of ``names``, by the rule that a close tag closes all inside its element."""

    def __init__(self, html, names, fits):
        super().__init__(convert_charrefs=False)
        self.names, self.fits, self.open, self.found, self.lines = names, fits, [], [], [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)
        self.close()
        self.found += [(s, len(html)) for _, s, ok in self.open if ok]

    def at(self):
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def handle_starttag(self, tag, attrs):
        if tag in self.names:
            self.open.append((tag, self.at(), self.fits(tag, dict(attrs))))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in [t for t, *_ in self.open]:
            while True:
                name, start, ok = self.open.pop()
                self.found += [(start, self.at())] * ok
                if name == tag:
                    break


def random_page(rng, size):
    out = []
    for _ in range(size):
        tag = rng.choice(["div", "div", "section", "p", "td", "b"])
        kind = rng.random()
        if kind < 0.4:
            out.append(rng.choice([f'<{tag} class="x hit">', f"<{tag} class='hitter'>", f'<{tag} data-a="1 > 0" class="hit">', f"<{tag}>", f'<{tag.upper()}\n id="r-hit" >']))
        elif kind < 0.75:
            out.append(f"</{tag}>")
        else:
            out.append(rng.choice(["words ", "1 &lt; 2\n", "é "]))
    return "".join(out)


def test_elements_equal_a_plain_parser(spark):
    rng = random.Random(2)
    pages = [random_page(rng, n) for n in [0, 1, 3] + [rng.randrange(5, 60) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(pages)), "i long, html string")
    for selector, fits in ((".hit", lambda t, a: "hit" in (a.get("class") or "").split()), ('section[id*="hit"]', lambda t, a: t == "section" and "hit" in (a.get("id") or ""))):
        names = K.names_of([selector], ("p", "b"))
        got = {r.i: list(r.e) for r in df.select("i", K.elements(F.col("html"), [selector], more=("p", "b")).alias("e")).collect()}
        for i, html in enumerate(pages):
            assert got[i] == [html[a:b] for a, b in sorted(Plain(html, names, fits).found)], html
    outer = df.select("i", K.elements(F.col("html"), ["div"], outermost=True).alias("e")).collect()
    for r in outer:
        spans = sorted(Plain(pages[r.i], K.names_of(["div"]), lambda t, a: t == "div").found)
        assert list(r.e) == [pages[r.i][a:b] for a, b in spans if not any(c < a and b <= d for c, d in spans)]


def test_selectors(spark):
    tag = '<div id="a" class="b  c" data-rf-test-id="listingRemarks" title=\'x y\'>'
    cases = {"div": True, "div#a.b.c": True, "p": False, ".bc": False, "#b": False, '[data-rf-test-id="listingRemarks"]': True, '[title^="x"]': True, '[title$="y"]': True, '[title*=" "]': True, "[hidden]": False, '[class="b"]': False}
    got = spark.range(1).select(*[K.selects(F.lit(tag), s).alias(str(k)) for k, s in enumerate(cases)]).head()
    assert list(got) == list(cases.values())
    for bad in ("div p", "", "a > b"):
        try:
            K.selects(F.lit(tag), bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_blocks_end_with_their_element_and_hold_nested_markup(spark):
    block = '<div class="a multiLineDisplay"><div><p class="highlight-price">List <b>$1,295,000</b></p></div><div class="highlight-address">Rye Brook, New York 10573{}</div><p class="highlight-specs">4 bd &bull; 3 ba</p><p class="highlight-specs">MLS #964038</p><p class="highlight-title">Single Family</p></div>'
    html = f'<div><div class="x"></div>{block.format("")}<p class="highlight-price">$5 outside</p></div>{block.format("<div>")}</section> tail MLS #1'
    rows = X.extract_html_blocks(spark.createDataFrame([(html,), ("<div class='multiLineDisplayed'>$1</div>",), (None,)], "html string")).orderBy("position").collect()
    assert [(r.position, r.price, r.town, r.zip_code, r.mls_id, r.bedrooms, r.bathrooms) for r in rows] == [(0, 1295000, "Rye Brook", "10573", "964038", 4, 3.0), (1, 1295000, "Rye Brook", "10573", "964038", 4, 3.0)]
    assert "outside" not in rows[0].block
    assert rows[0].property_type is not None


def test_description_by_selector_then_by_blocks(spark):
    told = "A sunny kitchen with a large garage and a finished basement below."
    pages = {
        "chosen": f"<nav><p>{'Search every home and kitchen in town. ' * 9}</p></nav><div class='remarks'><p>{told}<p>And <b>more</b> of it.</div><div>{'kitchen ' * 50}</div>",
        "nested": f"<section id=overview><div><div>{told}</div></div><div>Second part</div></section><div>{'kitchen ' * 80}</div>",
        "blocks": f"<p>{told} {told}</p><div>short kitchen</div><td>{'nothing of use here ' * 20}</td>",
        "none": "<div>too short a kitchen</div>",
    }
    df = spark.createDataFrame(list(pages.items()), "k string, html string")
    got = {r.k: r.d for r in df.select("k", X.extract_page_description(F.col("html")).alias("d")).collect()}
    assert got == {"chosen": f"{told} And more of it.", "nested": f"{told} Second part", "blocks": f"{told} {told}", "none": None}
    own = df.select("k", X.extract_page_description(F.col("html"), 20, selectors=["nav"], furniture=("footer",)).alias("d")).collect()
    assert {r.k: r.d for r in own}["chosen"] == "Search every home an"
    assert spark.createDataFrame([("<div>" + "kitchen " * 3000,)], "html string").select(F.length(X.extract_page_description(F.col("html")))).head()[0] == 5000


def stats(spark, *pages):
    rows = X.extract_page_stats(spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string")).orderBy("k").collect()
    names = ("price", "bedrooms", "bathrooms", "sqft", "year", "list_date", "lot_acres")
    return [{n: r[f"page_{n}"] for n in names if r[f"page_{n}"] is not None} for r in rows]


def test_page_stats_from_text_and_json(spark):
    got = stats(
        spark,
        '<script type="application/ld+json">{"YearBuilt": "1972"}</script><div>$1,499,000 4 beds 3 bath 2,800 sqft</div>',
        '<script>{"OnMarketDate": "2026-02-15T00:00:00"}</script><div>$1,300,000 3 beds 2 bath 2,100 sqft</div>',
        "<div>$1,100,000</div><div>3 bd 2 ba 1,800 sqft</div><div>Listed on: 01/15/2026</div>",
        "<div>$1,250,000</div><div>Built in 1650</div>",
        '<div>$1,275,000 3 beds 2 bath 2,500 sqft</div><script>{"YearBuilt": "2005", "OnMarketDate": "2026-01-20T00:00:00"}</script>',
        "a 5,850 square foot home on a 436 square foot lot with 3 bedrooms",
        '<script>{"a": </script><script>{"lotSize": {"@type": "Q", "value": 0.25}, "yearBuilt": 1950}</script><script>{"lotSize": "3 acres", "yearBuilt": 1960}</script><p>9 acres</p>',
        '<script>{"lotSize": "10,890 sqft"}</script><p>0.9 acres Lot Size</p>',
        '<script>x = {"lotSize": {"value": 7.5}, "yearBuilt": "1931"};</script><p>2 acres</p>',
        "<p>1/4 acre, 2 acres, 0.45 acres Lot Size</p>", "<p>on 1/4 acre or 2.5 acres</p>", "<p>10,890 sq ft lot</p>", '<script>{"lotSize": {"value": 5000}}</script>', "<form>$900,000</form>", None,
    )
    assert got[0] == {"price": 1499000, "bedrooms": 4, "bathrooms": 3.0, "sqft": 2800, "year": 1972}
    assert got[1]["list_date"] == "2026-02-15"
    assert got[2]["list_date"] == "01/15/2026"
    assert got[3] == {"price": 1250000}
    assert got[4] == {"price": 1275000, "bedrooms": 3, "bathrooms": 2.0, "sqft": 2500, "year": 2005, "list_date": "2026-01-20"}
    assert got[5]["sqft"] == 5850
    assert got[6] == {"lot_acres": 0.25, "year": 1950}
    assert [g.get("lot_acres") for g in got[7:13]] == [0.25, 7.5, 0.45, 2.5, 0.25, None]
    assert got[8]["year"] == 1931
    assert got[13:] == [{}, {}]
