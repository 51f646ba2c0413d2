import datetime

import pytest
from pyspark.sql import functions as F

from etalage.plans import cleaning, compare, kpi
from etalage.sources.snapshots import with_lineage

RAW = "nom_produit string, categorie string, prix double, magasin string, date_scraping string, url_produit string"


@pytest.fixture(scope="module")
def analytics(spark):
    rows = [
        ("Riz long 1kg", "Epicerie", 1000.0, "Auchan", "2024-01-10", "/1"),
        ("Riz long 1kg", "Epicerie", 900.0, "Sakanal", "2024-01-10", "/1"),
        ("Riz long 1kg", "Epicerie", 900.0, "Diarle", "2024-01-10", "/1"),
        ("Riz long 1kg", "Epicerie", 1100.0, "Auchan", "2024-02-10", "/1"),
        ("Riz long 1kg", "Epicerie", 1200.0, "Sakanal", "2024-02-10", "/1"),
        ("Jus orange 1L", None, 700.0, "Auchan", "2024-01-10", "/2"),
        ("Jus orange 1L", None, 770.0, "Auchan", "2024-02-10", "/2"),
        ("Savon", "Hygiene", 300.0, "Auchan", "2024-01-10", "/3"),
        ("Gratuit doux 1kg", "Epicerie", 0.0, "Auchan", "2024-01-10", "/4"),
    ]
    return cleaning.analytics(spark.createDataFrame(rows, RAW)).cache()


@pytest.fixture(scope="module")
def history(analytics):
    return kpi.prepare_history(with_lineage(analytics)).cache()


def test_history_nulls(history):
    rows = {(r.nom_produit, str(r.jour)): r for r in history.collect() if r.magasin_standardise == "Auchan"}
    assert rows[("Jus orange 1L", "2024-01-10")].categorie_standardisee is None
    assert rows[("Savon", "2024-01-10")].quantite_standardisee is None
    assert not any(name.startswith("Gratuit") for name, _ in rows)


def test_panel_and_competitiveness(history):
    prices = kpi.reliable_prices(history)
    panel = kpi.daily_panel(prices)
    january = panel.filter("mois = '2024-01' AND nom_reference LIKE 'riz%'").collect()
    assert {r.nb_magasins_jour for r in january} == {3}
    assert all(r.comparabilite_stricte for r in january)
    assert panel.filter("comparabilite_stricte AND NOT comparable_multi_store").count() == 0
    ranks = {
        (r.mois, r.magasin_standardise): (r.indice_competitivite_min, r.rang_competitivite)
        for r in kpi.competitiveness(panel).collect()
    }
    assert ranks[("2024-01", "Auchan")] == (pytest.approx(1000 / 900, abs=1e-6), 2)
    assert ranks[("2024-01", "Sakanal")] == ranks[("2024-01", "Diarle")] == (1.0, 1)
    assert ranks[("2024-02", "Auchan")] == (1.0, 1)


def test_monthly_indices(history):
    prices = kpi.reliable_prices(history)
    rows = {
        (r.mois, r.magasin_standardise, r.categorie_standardisee): r
        for r in kpi.variation_index(prices).collect()
    }
    assert rows[("2024-01", "Auchan", "Epicerie")].indice_base_100 == 100.0
    assert rows[("2024-02", "Auchan", "Epicerie")].variation_vs_mois_precedent_pct == pytest.approx(10)
    # a missing category has figures but neither change nor index
    assert rows[("2024-02", "Auchan", None)].prix_moyen == 770.0
    assert rows[("2024-02", "Auchan", None)].variation_vs_mois_precedent_pct is None
    assert rows[("2024-02", "Auchan", None)].indice_base_100 is None
    total = {r.mois: r for r in kpi.inflation_global(prices).collect()}
    assert total["2024-01"].indice_prix_base_100 == 100.0
    assert total["2024-01"].prix_median == 900.0


def test_score_and_context(history):
    prices = kpi.reliable_prices(history)
    score = kpi.category_store_score(prices)
    rows = score.collect()
    assert len(rows) == 4
    assert all(0 < r.couverture_categorie_pct <= 100 for r in rows)
    null_category = [r for r in rows if r.categorie_standardisee is None]
    assert null_category[0].nb_produits_categorie_total == 1
    levels = kpi.context_table(score)
    assert {r.score_confiance for r in levels.collect()} == {"faible"}


def test_fluctuation_and_summary(history):
    prices = kpi.reliable_prices(history)
    table = kpi.fluctuation(prices).collect()
    assert {(r.magasin_standardise, r.nb_jours) for r in table if r.categorie_standardisee} == {
        ("Auchan", 2),
        ("Sakanal", 2),
    }
    summary = {
        r.kpi: (r.valeur, r.details)
        for r in kpi.kpi_summary(
            prices,
            kpi.variation_index(prices),
            kpi.competitiveness(kpi.daily_panel(prices)),
            kpi.fluctuation(prices),
            kpi.inflation_global(prices),
        ).collect()
    }
    assert summary["date_derniere_observation"] == ("2024-02-10", "3 magasins, 2 cles produits")
    assert summary["magasin_plus_competitif"] == ("Auchan", "indice=1.0000 sur 1 produits")
    assert summary["produit_plus_forte_fluctuation"][1].startswith("Sakanal | cv=20.20%")
    assert summary["indice_variation_prix_dernier_mois"] == ("133.33", "2024-02")


def test_empty_input_keeps_the_schema(history):
    prices = kpi.reliable_prices(history.limit(0))
    panel = kpi.daily_panel(prices)
    competition = kpi.competitiveness(panel)
    assert competition.count() == 0 and "mois" in competition.columns
    summary = kpi.kpi_summary(
        prices, kpi.variation_index(prices), competition, kpi.fluctuation(prices),
        kpi.inflation_global(prices),
    )
    rows = {r.kpi: (r.valeur, r.details) for r in summary.collect()}
    assert rows["magasin_plus_competitif"] == ("", "comparaison multi-magasins insuffisante")
    assert rows["inflation_mensuelle_globale"] == (None, "")
    quality = {r.kpi: r.valeur for r in kpi.quality_report(history.limit(0), panel).collect()}
    assert quality["observations_total"] == 0 and quality["taux_retention_kpi_pct"] is None


def test_comparison(analytics):
    stores = ["Auchan", "Sakanal", "Diarle"]
    serving = compare.serving_prices(analytics)
    table = compare.price_comparison(serving, stores).cache()
    rows = {r.jour: r for r in table.collect()}
    first = rows[datetime.date(2024, 1, 10)]
    assert first.magasin_moins_cher == "Sakanal, Diarle" and first.nb_gagnants == 2
    assert (first.prix_min, first.prix_max, first.ecart_fcfa) == (900.0, 1000.0, 100.0)
    duel = {r.magasin: r for r in compare.head_to_head(table, stores).collect()}
    assert (duel["Sakanal"].victoires, duel["Sakanal"].taux_victoire_pct) == (1, 50.0)
    assert duel["Diarle"].couverture_produits == 1
    assert compare.full_coverage(table, stores).count() == 1
    gap = compare.store_gap(table, "Auchan")
    metrics = compare.store_gap_metrics(gap).first()
    assert (metrics.surcout_moyen, metrics.surcout_median, metrics.nb_plus_chers) == (50.0, 50.0, 1)
    best = compare.best_store_by_category(compare.category_scorecard(table, stores)).first()
    # all three win half of the rows; the lowest mean price decides
    assert best.magasin == "Diarle"
    assert compare.search_products(serving, "RIZ").count() == 5
    none = compare.price_comparison(serving, ["Auchan"])
    assert none.count() == 0 and compare.head_to_head(none, ["Auchan"]).count() == 0


def test_dispersion(spark):
    rows = [("c", "s", float(p), "n") for p in range(1, 201)] + [("c", "t", 50.0, "n")]
    df = spark.createDataFrame(
        rows, "categorie_standardisee string, magasin_standardise string, prix_affiche double, nom string"
    )
    got = {r.magasin_standardise: r for r in compare.dispersion(df, ["s", "t"]).collect()}
    assert (got["s"].prix_min, got["s"].prix_max, got["s"].nb_points) == (3.0, 198.0, 196)
    assert got["s"].mediane == 100.5
    verdict = compare.dispersion_verdict(compare.dispersion(df, ["s", "t"], trim=False)).first()
    assert (verdict.magasin_leader, verdict.niveau_dispersion) == ("t", "elevee")
    two = df.filter(F.col("prix_affiche").isin(1.0, 200.0))
    assert compare.dispersion(two, ["s"]).first().nb_points == 2


def test_the_summary_reads_listings_only_for_its_stored_prices(spark):
    from etalage.catalogue import QUERIES

    summary = QUERIES["kpi_summary"](spark, "/root/testdata/sf0.001")
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "prix_comparable" in plan
    assert summary.count() == 5
