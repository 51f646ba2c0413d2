from etalage.functions import markup
from etalage.plans import capture

PAGE = """
<html><body><h2><a href="/menu">Menu</a></h2>
<article class="product-miniature js-product-miniature"><h2 class="t"><a href="/p/1">Riz&nbsp;long &amp; fin
  1kg</a></h2> <span class="u">900 CFA / KG</span><span class="price">1 500 CFA</span></article>
<article class="product-miniature"><h2><a href="/p/2">Sucre</a></h2><span>rupture</span></article>
<ul class="pagination"><li class="active"><a>3</a></li><li class="next"><a href="?page=4">&gt;</a></li></ul>
</body></html>"""
TILES = """
<div class="product-item"><h3>Café</h3><span class="price">2 500 FCFA</span><a href="/p/9">voir</a></div>
<div class="product-item"><a href="/p/8" title="Lait en poudre"></a><p>Promo 1 200 FCFA</p></div>
<div class="product-item"><img alt="Savon" src="x"><b>300 FCFA</b></div>"""


def pages(spark, *rows):
    return spark.createDataFrame(rows, "category string, page_no bigint, magasin string, html string")


def test_cards(spark):
    df = pages(
        spark,
        ("c", 1, "Auchan", PAGE),
        ("c", 2, "Sakanal", PAGE.replace("CFA", "FCFA")),
        ("c", 3, "Auchan", "<h2><a href='/x'>Seul</a></h2>10 CFA"),
        ("c", 4, "Auchan", "<p>vide</p>"),
    )
    got = {(r.page_no, r.pos): (r.name, r.href, r.price_text) for r in capture.extract_cards(df).collect()}
    assert got[(1, 1)] == ("Riz long & fin 1kg", "/p/1", "1 500 CFA")
    assert got[(1, 2)] == ("Sucre", "/p/2", None)
    assert got[(2, 1)][2] == "900 FCFA / KG"
    assert got[(3, 1)] == ("Seul", "/x", "10 CFA")
    assert got[(4, None)] == (None, None, None)
    assert len(got) == 6


def test_a_very_long_page_fits_the_matcher(spark):
    body = "".join(
        f'<article class="product-miniature"><h2><a href="/p/{i}">Produit {i}</a></h2>'
        f"<p>{'texte ' * 200}</p></article>"
        for i in range(400)
    )
    df = pages(spark, ("c", 1, "Auchan", body))
    assert capture.extract_cards(df).count() == 400
    assert capture.extract_tiles(df).count() == 400
    assert capture.pagination_facts(df).first().served_page == 1


def test_tiles(spark):
    rows = capture.extract_tiles(pages(spark, ("c", 1, "Diarle", TILES))).orderBy("pos").collect()
    assert [r.name for r in rows] == ["Café", "Lait en poudre", "Savon"]
    assert [r.href for r in rows] == ["/p/9", "/p/8", ""]
    assert rows[0].price_text == "2 500 FCFA" and "1 200 FCFA" in rows[1].price_text


def test_pagination(spark):
    df = pages(
        spark,
        ("c", 3, "Auchan", PAGE),
        ("c", 4, "Auchan", '<li class="next disabled"><a href="?p=5">x</a></li>'),
        ("c", 5, "Auchan", '<li><a href="?page=6">Suivant</a></li>'),
        ("c", 6, "Auchan", '<a rel="next" href="/n">n</a>'),
    )
    got = {r.page_no: (r.served_page, r.has_next) for r in capture.pagination_facts(df).collect()}
    assert got == {3: (3, True), 4: (1, False), 5: (1, True), 6: (1, True)}


def listing(spark, rows):
    return spark.createDataFrame(
        rows,
        "category string, magasin string, page_no bigint, pos bigint, name string, href string, "
        "price_text string, served_page bigint, has_next boolean",
    )


def page(category, number, items, served=None, following=True, price="500 CFA"):
    served = served or number
    if not items:
        return [(category, "Auchan", number, None, None, None, None, served, following)]
    return [
        (category, "Auchan", number, i + 1, n, f"/{n}", price, served, following)
        for i, n in enumerate(items)
    ]


def test_crawl_stops(spark):
    rows = (
        page("vide", 1, ["a"]) + page("vide", 2, []) + page("vide", 3, ["z"])
        + page("redirige", 1, ["a"]) + page("redirige", 2, ["b"], served=1) + page("redirige", 3, ["c"])
        + page("identique", 1, ["a", "b"]) + page("identique", 2, ["a", "b"])
        + page("vue", 1, ["a", "b", "c", "d"]) + page("vue", 2, ["b", "a", "c", "d", "e"])
        + page("neuf", 1, ["a", "b"]) + page("neuf", 2, ["a", "q", "r"], price="10 CFA")
        + page("fin", 1, ["a"]) + page("fin", 2, ["b"], following=False) + page("fin", 3, ["c"])
        + page("ouvert", 1, ["a"]) + page("ouvert", 2, ["b"])
    )
    table = capture.crawl_cutoff(listing(spark, rows)).collect()
    last = {}
    for r in sorted(table, key=lambda r: r.page_no):
        last[r.category] = (r.page_no, r.motif_arret)
    assert last == {
        "vide": (2, "page_vide"),
        "redirige": (2, "page_redirigee"),
        "identique": (2, "page_identique"),
        "vue": (2, "page_deja_vue"),
        "neuf": (2, "rien_de_nouveau"),
        "fin": (2, "derniere_page"),
        "ouvert": (2, None),
    }
    kept = capture.kept_listing(listing(spark, rows))
    assert kept.filter("category = 'redirige'").count() == 2


def test_first_valid_card_of_a_name_counts(spark):
    rows = [
        ("c", "Auchan", 1, 1, "Riz ", "/1", "20 CFA", 1, True),
        ("c", "Auchan", 1, 2, " Riz", "/2", "500 CFA", 1, True),
        ("c", "Auchan", 1, 3, "Riz", "/3", "600 CFA", 1, True),
        ("c", "Auchan", 1, 4, "  ", "/4", "600 CFA", 1, True),
        ("c", "Diarle", 2, 1, "Riz", "5", "99 CFA", 2, True),
    ]
    got = capture.valid_listing(listing(spark, rows)).collect()
    assert [(r.prix, r.url_produit) for r in got] == [(500.0, "https://www.auchan.sn/2")]


def _card(magasin, page, pos, name, price, has_next=True, snapshot="2024-01-01"):
    return (magasin, snapshot, "Epicerie", page, pos, name, f"/p/{name}", f"{price} FCFA", page, has_next)


_CARDS = "magasin string, snapshot string, category string, page_no bigint, pos bigint, name string, href string, price_text string, served_page bigint, has_next boolean"


def test_shops_and_snapshots_with_the_same_category_stay_apart(spark):
    rows = [
        _card("Auchan", 1, 1, "Riz 5kg", 4000),
        _card("Sakanal", 1, 1, "Riz 5kg", 4100, has_next=False),
        _card("Auchan", 1, 1, "Riz 5kg", 3900, snapshot="2024-01-02"),
        _card("Auchan", 2, 1, "Huile 1L", 1200),
        _card("Sakanal", 2, 1, "Huile 1L", 1300),
    ]
    listing = spark.createDataFrame(rows, _CARDS)
    assert capture.valid_listing(listing).count() == 5
    kept = capture.crawl_cutoff(listing)
    assert {(r.magasin, r.snapshot, r.page_no) for r in kept.collect()} == {
        ("Auchan", "2024-01-01", 1), ("Auchan", "2024-01-01", 2), ("Auchan", "2024-01-02", 1), ("Sakanal", "2024-01-01", 1),
    }


def test_shop_without_a_floor_keeps_its_rows(spark):
    listing = spark.createDataFrame([_card("Nouveau", 1, 1, "Riz 5kg", 5)], _CARDS)
    assert [r.prix for r in capture.valid_listing(listing).collect()] == [5.0]


def test_pager_places_are_asked_in_order(spark):
    slide = '<div class="slide active">5 offres</div><ul class="pagination"><li class="active"><a>3</a></li><li class="next"><span><a href="#">x</a></span></li></ul>'
    home = '<ul><li class="active">Accueil</li></ul><ul class="pagination"><li class="active"><a>4</a></li></ul>'
    plain = '<a href="/x?page=2">nextgen phones</a>'
    fallen = '<ul class="pagination"><li class="current"><a>un</a></li><li class="active">7</li></ul>'
    disabled = '<ul class="pagination"><li class="next disabled"><a href="/x">x</a></li></ul><a rel="nextgen">x</a>'
    item = '<li><a href="?page=9" class="btn-next">&gt;</a></li><script>"<li class=\'current\'>8</li>"</script><!-- <li class="current">6</li> -->'
    cases = [slide, home, plain, fallen, disabled, item, None, ""]
    got = capture.pagination_facts(pages(spark, *[("c", k, "Auchan", h) for k, h in enumerate(cases)])).collect()
    assert [(r.served_page, r.has_next) for r in sorted(got, key=lambda r: r.page_no)] == [
        (3, True), (4, False), (1, False), (7, False), (1, False), (1, True), (1, False), (1, False),
    ]


def test_cards_end_with_their_heading_s_parent(spark):
    outside = '<div class="product-miniature"><h2><a href="/1">A</a></h2></div><p>pied: 500 FCFA</p>'
    two = '<li class="js-product-miniature"><h2><a href="/1">A</a> <a href="/2">B</a></h2><div><b>1&nbsp;500</b> CFA</div></li>'
    nested = '<div class="product-miniature"><h2><a href="/1">A</a></h2><div><div>note</div> <div>700 CFA</div></div></div>'
    stray = '<article class="product-miniature"><h2><a href="/1"><span>A</a></h2></b></i> 800 CFA</article>'
    unclosed = '<div class="product-miniature"><p><h2><a href=/1>A &eacute;&#233;&#xE9;&bogus;</a></h2><br/>900 CFA'
    far = "<h2><a href='/1'>A</a></h2>" + "<br>" * 24 + "100 CFA" + "<h2><a href='/2'>B</a></h2>" + "<br>" * 25 + "200 CFA"
    cases = [outside, two, nested, stray, unclosed, far]
    got = capture.extract_cards(pages(spark, *[("c", k, "Auchan", h) for k, h in enumerate(cases)])).collect()
    found = {k: [(r.name, r.href, r.price_text) for r in sorted(got, key=lambda r: r.pos) if r.page_no == k] for k in range(6)}
    assert found == {
        0: [("A", "/1", None)],
        1: [("A", "/1", "1\xa0500CFA"), ("B", "/2", "1\xa0500CFA")],
        2: [("A", "/1", "note700 CFA")],
        3: [("A", "/1", "800 CFA")],
        4: [("A ééé&bogus;", "/1", "900 CFA")],
        5: [("A", "/1", "100 CFA"), ("B", "/2", None)],
    }


def test_elements_are_intervals(spark):
    html = '<div class="a b"><p>x<br>y</div></p><ul><li>1<li>2</ul><img alt="a>b"/>'
    rows = markup.element_table(pages(spark, ("c", 1, "Auchan", html))).orderBy("at").collect()
    assert [(r.name, r.at, r.end, r.parent, r.depth) for r in rows] == [
        ("div", 1, 4, 0, 0), ("p", 2, 4, 1, 1), ("br", 3, 3, 2, 2), ("ul", 6, 9, 0, 0), ("li", 7, 9, 6, 1), ("li", 8, 9, 7, 2), ("img", 10, 10, 0, 0),
    ]
    assert rows[0].classes == "a b" and [r.n_chars for r in rows] == [2, 2, 0, 2, 2, 1, 0]


def test_malformed_pages_are_read_once(spark):
    bad = ['<b x="1' * 40_000, "<" * 200_000, "<!--" * 50_000, "<script>" + "x" * 200_000, "</p>" * 3_000, "<div>" * 1_500]
    got = capture.pagination_facts(pages(spark, *[("c", k, "Auchan", h) for k, h in enumerate(bad)])).collect()
    assert len(got) == len(bad) and {r.served_page for r in got} == {1}


def test_tags_are_folded_once_whatever_the_page(spark):
    html = (
        "<DIV class='a &amp;  b'><p>x<br/><b CLASS=\"x\" class=\"b disabled\">y</p></b><!-- <p> --><script><p></script>"
        "<p class=b>z<h2 data-class='b'></h2 ></div><i title='1>2'><a/>t"
    )
    df = pages(spark, ("c", 1, "Auchan", html), ("c", 2, "Auchan", ""), ("c", 3, "Auchan", None), ("c", 4, "Auchan", "<p>" * 3000))
    tests = (markup.Test("div", ("&", "b")), markup.Test("", ("b",), ("disabled",), within=0), markup.Test("p"))
    lists = markup.element_lists(df, tests)
    got = {r.page_no: [(e.at, e.end, e.parent, e.depth, e.up, e.name, e.close, e.cls) for e in r._elements] for r in lists.collect()}
    assert got[1] == [
        (1, 12, 0, 0, [0, 0, 0], "div", False, " a & b "),
        (2, 5, 1, 1, [1, 0, 0], "p", False, "  "),
        (3, 3, 2, 2, [1, 0, 2], "br", False, "  "),
        (4, 5, 2, 2, [1, 0, 2], "b", False, " b disabled "),
        (5, 0, 0, 3, [0, 0, 0], "p", True, "  "),
        (6, -1, 0, 1, [0, 0, 0], "b", True, "  "),
        (7, 7, 1, 1, [1, 0, 0], "", False, "  "),
        (8, 8, 1, 1, [1, 0, 0], "", False, "  "),
        (9, 12, 1, 1, [1, 0, 0], "p", False, " b "),
        (10, 11, 9, 2, [1, 9, 9], "h2", False, "  "),
        (11, 0, 0, 3, [0, 0, 0], "h2", True, "  "),
        (12, 0, 0, 2, [0, 0, 0], "div", True, "  "),
        (13, 15, 0, 0, [0, 0, 0], "i", False, "  "),
        (14, 14, 13, 1, [0, 0, 0], "a", False, "  "),
    ]
    assert got[2] == [] == got[3]
    assert got[4][-1][:5] == (3000, 3001, 2999, 2999, [0, 0, 2999])
    # one function makes the elements; no fold of the optimizer's expressions copies its state
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "fold" in plan and "aggregate(" not in plan


def test_a_crawl_is_shuffled_once_and_keeps_rows_as_before(spark):
    schema = "magasin string, category string, page_no bigint, pos bigint, name string, href string, price_text string, served_page bigint, has_next boolean"
    rows = [
        ("X", "c", 1, 1, "riz", "/a", "900 FCFA", 1, True),
        ("X", "c", 1, 2, "riz", "/b", "800 FCFA", 1, True),  # a second card of that name
        ("X", "c", 1, 3, "the", None, "700 FCFA", 1, True),
        ("X", "c", 2, 1, "riz", "/a", "900 FCFA", 2, True),
        ("X", "c", 2, 2, "sel", "/s", "x", 2, True),
        ("X", "c", 3, 1, "riz", "/a", "900 FCFA", 3, True),
        ("X", "c", 4, 1, "eau", "/e", "900 FCFA", 4, True),
        ("X", None, 1, 1, "riz", "/a", "900 FCFA", 1, True),
        ("X", "c", None, 1, "riz", "/a", "900 FCFA", 1, True),
        ("X", "d", 1, None, None, None, None, 1, True),
    ]
    df = spark.createDataFrame(rows, schema)
    found = {(r.category, r.page_no): (r.recouvrement, r.nouveaux, r.motif_arret) for r in capture.crawl_pages(df).collect()}
    assert found == {
        ("c", 1): (0.0, 1, None), ("c", 2): (0.5, 0, "rien_de_nouveau"), ("c", 3): (1.0, 0, "page_deja_vue"),
        ("c", 4): (0.0, 1, None), ("d", 1): (0.0, 0, "page_vide"),
    }
    kept = capture.kept_listing(df)
    assert kept.columns[:3] == ["magasin", "category", "page_no"]
    assert sorted((r.page_no, r.pos) for r in kept.collect()) == [(1, 1), (1, 3), (2, 1)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [f(df)._jdf.queryExecution().executedPlan().toString() for f in (capture.crawl_cutoff, capture.kept_listing)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 2]


def _without_lambdas(df):
    """Is the page read by functions on whole batches, not by expressions on each of its elements?"""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "lambda" not in plan and plan.count("ArrowEvalPython") == 1


def test_tiles_are_read_in_one_pass(spark):
    nested = (
        "<h2><div class='product-item'><a href=' /1?a=1&amp;b=2 '>  Riz <b>&eacute;tuv&#233;</b>\xa0 1kg</a>"
        "<div class='js-product-miniature'><img alt='' title=\"Th&#xE9; 'vert'\"><span class='x product-price'>900 CFA</span></div></div></h2>"
    )
    cases = [
        nested,
        "<article class='product-miniature'><a title='Sel fin' href></a>",  # never closed
        "<article class='product-miniature'/><p class='product-item'></p><!-- <p class='product-item'> -->",
        "<div class='product-item'><a>x</a><a class='product-thumbnail' aria-label=Eau></a></h3><h3></h3 x='>'>&bogus; 5 CFA</div>",
        "<p>vide</p>", None,
    ]
    tiles = capture.extract_tiles(pages(spark, *[("c", k, "Diarle", h) for k, h in enumerate(cases)]))
    found = sorted((r.page_no, r.pos or 0, r.name, r.href, r.price_text) for r in tiles.collect())
    assert found == [
        (0, 1, "Riz étuvé 1kg", " /1?a=1&b=2 ", "900 CFA"),
        (0, 2, "Thé 'vert'", "", "900 CFA"),
        (1, 1, "Sel fin", "", ""),
        (2, 1, "", "", ""), (2, 2, "", "", ""),
        (3, 1, "Eau", "", "x&bogus; 5 CFA"),
        (4, 0, "", None, None), (5, 0, "", None, None),
    ]
    assert _without_lambdas(tiles)


def test_pagers_are_read_in_one_pass(spark):
    cases = [
        "<nav class='pagination'><img class='current'><p class='current'><a>un</a> <a>4</a></p><i class='active'>9</i></nav>",  # only firsts are read
        "<li class='active'>page\xa0<b>12</b></li><li><a href='/?page=13' class='BTN-NEXT'></a></li>",
        "<ul class='pagination'><a href='?page=2'>page <b>sui</b>vant</a><a href='?page=2'>&nbsp;Suivant&nbsp;</a></ul>",
        "<p class='next'><a href='?page=2'>Suivant</a></p><li class='current'>a5 _6 99999999999999999999</li>",
        "<div class='pagination'><p class='next disabled'><a>x</a></p></div><a rel=' next'>x</a></li><a rel=prev REL=next>",
    ]
    facts = capture.pagination_facts(pages(spark, *[("c", k, "Auchan", h) for k, h in enumerate(cases)]))
    assert [(r.served_page, r.has_next) for r in sorted(facts.collect(), key=lambda r: r.page_no)] == [
        (9, False), (12, True), (1, True), (1, False), (1, True),
    ]
    assert facts.columns == ["category", "page_no", "magasin", "served_page", "has_next"] and _without_lambdas(facts)


def test_cards_of_every_kind_are_read_in_one_pass(spark):
    blocks = "<h2><a href='/menu'>Menu</a></h2><div class='product-miniature'><h2><a href=' /1 '>A&nbsp; <i>b</i></a><a/></h2>5 CFA / L<b>6 CFA</b></div>"
    items = "<li class='js-product-miniature'><h2><a>A</a></h2></i></b> 7 cfa<h2>x</h2></li>"
    strays = "<h2><a href='/1'>A</a></h2>" + "</b>" * 38 + "8 CFA<h2><a href='/2'>B</a></h2>" + "</b>" * 39 + "8 CFA"
    francs = "<article class='product-miniature'><h2><a href='/1'>A</a></h2>5 CFA<p>6 <b>FCFA / KG</b></p></article>"
    cases = [("Auchan", blocks), ("Diarle", items), (None, strays), ("Sakanal", francs), ("Auchan", francs), ("Auchan", "<h2>x</h2><a>y</a>")]
    cards = capture.extract_cards(pages(spark, *[("c", k, m, h) for k, (m, h) in enumerate(cases)]))
    found = sorted((r.page_no, r.pos or 0, r.name, r.href, r.price_text) for r in cards.collect())
    assert found == [
        (0, 1, "A b", "/1", "6 CFA"), (0, 2, "", "", "6 CFA"),
        (1, 1, "A", "", "7 cfa"),
        (2, 1, "A", "/1", "8 CFA"), (2, 2, "B", "/2", None),
        (3, 1, "A", "/1", "6FCFA / KG"), (4, 1, "A", "/1", "5 CFA"),
        (5, 0, None, None, None),
    ]
    assert _without_lambdas(cards)
