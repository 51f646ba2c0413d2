import datetime
import random

import pytest
from pyspark.sql import functions as F

from etalage import vocab
from etalage.functions import matching as m
from etalage.functions import text as tx
from etalage.plans import cleaning

RAW = "nom_produit string, categorie string, prix double, magasin string, date_scraping string, url_produit string"

# name, price, cleaned name, exact key, label, packs, unit price, status
GOLDEN = [
    ("red plate 500g", 1000, "red plate 500g", "plate|red__500g", "500g", 1, 2000.0, "comparable_normalise"),
    ("red plate 1,5L", 1500, "red plate 1.5l", "plate|red__1500ml", "1500ml", 1, 1000.0, "comparable_normalise"),
    ("red plate 6x33cl", 990, "red plate 6x 33 cl", "6x|plate|red__1980ml", "1980ml", 6, 500.0, "comparable_normalise"),
    ("red plate 33cl x 6", 990, "red plate 6 x 33 cl", "plate|red__1980ml", "1980ml", 6, 500.0, "comparable_normalise"),
    ("red plate Boîte de 1 kg", 800, "red plate de 1 kg", "plate|red__1000g", "1000g", 1, 800.0, "comparable_normalise"),
    ("red plate 12 pieces", 1200, "red plate 12 pieces", "plate|red__12piece", "12piece", 12, 100.0, "comparable_normalise"),
    ("red plate SACHET 250 gr", 500, "red plate 250 g", "plate|red__250g", "250g", 1, 2000.0, "comparable_normalise"),
    ("red plate ", 700, "red plate", "plate|red", "", 1, None, "a_revoir"),
    ("Lait 1L", 900, "lait 1l", "lait__1000ml", "1000ml", 1, 900.0, "a_revoir"),
    ("Lait", 900, "lait", "lait", "", 1, None, "non_comparable"),
    # a litre figure followed by a count reads as a decimal
    ("1 l 6 bouteilles", 900, "1.6 l bouteilles", "bouteilles__1600ml", "1600ml", 1, 562.5, "a_revoir"),
    # a zero quantity falls back to the pack
    ("0 g x 6 truc bidule", 600, "6 x 0 g truc bidule", "bidule|truc__0g", "0g", 6, 100.0, "a_revoir"),
    ("Café moulu 250 g", 500, "cafe moulu 250 g", "cafe|moulu__250g", "250g", 1, 2000.0, "comparable_normalise"),
    ("Lot de 3 savons d'Alep", 300, "3 savons d alep", "alep|savons", "", 1, None, "a_revoir"),
    ("Riz ﬁn ½ sac", 300, "riz fin 1⁄2 sac", "1⁄2|fin|riz|sac", "", 1, None, "a_revoir"),
]


def listings(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_golden_rows(spark):
    raw = listings(
        spark, [(g[0], "Epicerie", float(g[1]), "Auchan", "2024-05-02", "") for g in GOLDEN]
    )
    for share in (True, False):
        got = {r.nom_produit: r for r in cleaning.analytics(raw, share).collect()}
        assert len(got) == len(GOLDEN)
        for name, _, clean, key, label, packs, unit, status in GOLDEN:
            row = got[name]
            assert (row.nom_nettoye, row.cle_matching_exacte) == (clean, key)
            assert (row.quantite_standardisee, row.pack_count) == (label, packs)
            assert (row.prix_par_kg_ou_l or row.prix_par_piece) == unit
            assert row.statut_comparabilite == status


def test_analytics_schema_and_calendar(spark):
    raw = listings(spark, [("Thé vert 20 pcs", "boissons", 100.0, " auchan ", "2024-05-02", "/x")])
    table = cleaning.analytics(raw)
    assert tuple(table.columns) == vocab.ANALYTICS_COLUMNS
    row = table.first()
    assert (row.magasin_standardise, row.categorie_standardisee) == ("Auchan", "Boissons")
    assert (row.annee, row.mois, row.mois_nom, row.trimestre) == (2024, 5, "2024-05", "2024Q2")
    assert row.jour == datetime.date(2024, 5, 2)


def test_labels(spark):
    given = ["Hygiène & Beauté", "FRUITS & LÉGUMES", "Produits frais ", "Produits Frais", None, "ﬁn  x"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    got = [r.l for r in df.select("i", tx.normalize_category(F.col("g")).alias("l")).orderBy("i").collect()]
    assert got == ["Hygiene & Beaute", "Fruits & Legumes", "Produits frais", "Produits Frais", "nan", "ﬁn x"]


def test_accents_match_the_unicode_rule(spark):
    import unicodedata

    chars = [chr(c) for c in range(0x20, 0x3000)] + ["㎏", "㎖", "ﬁ", "Ⅹ", "𝒜", "é"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    for row in df.select("c", tx.strip_accents(F.col("c")).alias("s")).collect():
        want = "".join(
            x for x in unicodedata.normalize("NFKD", row.c) if not unicodedata.combining(x)
        )
        assert row.s == want, hex(ord(row.c[0]))


@pytest.mark.parametrize(
    "text,price",
    [
        ("1 500 CFA", 1500.0),
        ("1.500 FCFA", 1500.0),
        ("1 234,50 CFA", 123450.0),
        ("Lot 2 : 1 500 fcfa", 1500.0),
        ("2 000 F", None),
        (None, None),
    ],
)
def test_price_text(spark, text, price):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.price_text(F.col("t"))).first()[0] == price


def test_urls(spark):
    rows = [
        ("/a", "Auchan", "https://www.auchan.sn/a"),
        ("a", "Auchan", "a"),
        ("a", "Diarle", "https://diarle.sna"),
        ("http://x/a", "Diarle", "http://x/a"),
        ("", "Diarle", ""),
        ("/a", "Sakanal", "https://sakanal.sn/a"),
    ]
    df = spark.createDataFrame(rows, "h string, s string, w string")
    for r in df.select("w", tx.resolve_url(F.col("h"), F.col("s")).alias("u")).collect():
        assert r.u == r.w


def test_unreachable_comparability_lines(spark):
    df = spark.createDataFrame(
        [
            (3, 0.0, 1, "faible", "raw_price", 3, "non_comparable"),
            (3, 0.0, 1, "elevee", "raw_price", 3, "comparable_brut"),
            (3, 5.0, 1, "elevee", "unit_kg_l", 3, "a_revoir"),
            (3, None, 1, "moyenne", "unit_kg_l", 5, "a_revoir"),
        ],
        "n bigint, t double, p bigint, q string, k string, s bigint, w string",
    )
    for r in df.select("w", m.comparability("n", "t", "p", "q", "k", "s").alias("v")).collect():
        assert r.v.statut == r.w


def test_unreadable_cells_are_dropped(spark):
    df = spark.createDataFrame(
        [
            ("a", "c", "12", "s", "2024-01-01", ""),
            ("a", "c", "douze", "s", "2024-01-01", ""),
            ("a", "c", "12", "s", "hier", ""),
            (None, "c", "12", "s", "2024-01-01", ""),
            ("a", "c", "12", None, "2024-01-01", ""),
        ],
        RAW.replace("prix double", "prix string"),
    )
    assert cleaning.coerce_required(df).count() == 1


def test_row_order_does_not_matter(spark):
    rows = [
        (f"savon {w} {q}", c, float(p), s, "2024-05-02", "/u")
        for w in ("doux", "noir")
        for q in ("100g", "100 g")
        for c in ("Hygiene", "Autre")
        for p in (100, 200)
        for s in ("Auchan", "Diarle")
    ]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        table = cleaning.analytics(listings(spark, rows).repartition(3))
        got = (
            sorted(map(str, table.collect())),
            sorted(map(str, cleaning.product_reference(table).collect())),
            sorted(map(str, cleaning.exact_price_panel(table, ["Auchan", "Diarle"]).collect())),
        )
        want = want or got
        assert got == want
    # one link per shop: the first category and spelling of each key and price stay
    assert len(want[2]) == 2


def test_derived_columns_are_not_shuffled_with_the_rows(spark):
    rows = [("Riz long 1kg", "Epicerie", 900.0, "auchan", "2024-01-02", "/1")] * 3
    raw = spark.createDataFrame(rows, "nom_produit string, categorie string, prix double, magasin string, date_scraping string, url_produit string")
    table = cleaning.analytics(raw)
    (row,) = table.collect()
    assert str(row.jour) == "2024-01-02" and row.mois_nom == "2024-01" and row.prix_par_kg_ou_l == 900.0
    # the ranking comes below the columns that follow from a row alone
    lines = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
    ranked = next(k for k, line in enumerate(lines) if "Window [row_number()" in line)
    below = "\n".join(lines[ranked:])
    assert not any(name in below for name in ("statut_comparabilite", "motif_comparabilite", "mois_nom", "trimestre"))
    assert "statut_comparabilite" in "\n".join(lines[:ranked])


def test_rows_are_shuffled_once_and_narrow_from_listing_to_panel(spark):
    from etalage.plans import kpi
    from etalage.sources.snapshots import with_lineage

    raw = spark.createDataFrame([("Riz long 1kg", "Epicerie", 900.0, "auchan", "2024-01-02", "/1")] * 3, RAW).repartition(2)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = cleaning.analytics(raw)
        panel = kpi.daily_panel(kpi.reliable_prices(kpi.prepare_history(with_lineage(table))))
        plan = panel._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange hashpartitioning") == 1  # dedupe, history, panel and its windows
    below = plan[plan.index("Exchange hashpartitioning") :].split("BroadcastHashJoin")[0]
    assert "nom_nettoye" not in below and "quantite" not in below
    assert [(r.prix_obs, r.nb_magasins_jour) for r in panel.collect()] == [(900.0, 1)]
