"""Interactive comparison: who is cheapest, by how much, where and with what spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage import vocab
from etalage.functions.numbers import (
    exact_mean,
    fcfa_text,
    half_up,
    percent,
    percent_text,
    ratio,
)
from etalage.functions.text import blank_to_null
from etalage.operators.stats import counted_stats, grouped_stats, value_counts, whole
from etalage.operators.wide import long_rows, wide_prices
from etalage.session import stored

SHELF, UNIT = "prix_affiche", "prix_normalise"


def _number(name: str) -> Column:
    """The column as a number (a whole one for counts and ranks); unreadable and NaN give null."""
    if name.startswith(("nb_", "rang_")):
        return F.coalesce(F.col(name).try_cast("bigint"), F.col(name).try_cast("double").try_cast("bigint"))
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def serving_prices(analytics: DataFrame) -> DataFrame:
    """Typed analytics rows with the shelf price and the unit price used for display."""
    texts = {
        f.name: blank_to_null(f.name)
        for f in analytics.schema
        if isinstance(f.dataType, T.StringType)
    }
    numbers = {c: _number(c) for c in ("prix", "prix_par_kg_ou_l", "prix_par_piece")}
    return (
        analytics.withColumns(texts)
        .withColumns({**numbers, "score_matching": F.col("score_matching").try_cast("bigint")})
        .withColumns(
            {
                "prix_affiche": F.col("prix"),
                "prix_normalise": F.coalesce("prix_par_kg_ou_l", "prix_par_piece"),
            }
        )
    )


def text_flag(column: Column) -> Column:
    """``true`` in any case means true; everything else, null included, is false."""
    return F.coalesce(F.lower(column.cast("string")) == "true", F.lit(False))


def serving_table(table: DataFrame, name: str) -> DataFrame:
    """A mart table that was read as text, with typed numbers, days and flags.

    A panel without flags compares nothing; one without the strict flag takes
    the multi-shop flag for it.  Columns the table lacks otherwise stay absent.
    """
    out = table.withColumns({c: _number(c) for c in vocab.SERVING_NUMBERS[name] if c in table.columns})
    if name != "daily_panel":
        return out
    out = out.withColumns({c: F.col(c).try_cast("date") for c in ("jour", "date_scraping") if c in out.columns})
    multi, strict = "comparable_multi_store", "comparabilite_stricte"
    out = out.withColumn(multi, text_flag(F.col(multi)) if multi in out.columns else F.lit(False))
    return out.withColumn(strict, text_flag(F.col(strict)) if strict in out.columns else F.col(multi))


def filter_selection(
    df: DataFrame, stores: Sequence[str], categories: Sequence[str] = ()
) -> DataFrame:
    """Rows of the chosen shops; no category chosen means all of them."""
    chosen = df.filter(F.col("magasin_standardise").isin(*stores))
    if categories:
        chosen = chosen.filter(F.col("categorie_standardisee").isin(*categories))
    return chosen


def search_products(df: DataFrame, term: str, column: str = "nom_nettoye") -> DataFrame:
    """Rows whose name matches the pattern in any case; a null name never matches."""
    return df.filter(F.coalesce(F.col(column), F.lit("")).rlike(f"(?iu){term}"))


# --- product comparison ------------------------------------------------------


def price_comparison(serving: DataFrame, stores: Sequence[str], mode: str = SHELF) -> DataFrame:
    """One row per day, category, key and product name, one price column per shop.

    Rows first combine to one mean per shop, so a crowded key costs little.
    Which (day, key) qualify is an aggregate of those, joined back: unlike a
    window, that join can be split when one key dominates.
    """
    index = ["jour", "categorie_standardisee", "cle_matching_exacte", "nom_produit"]
    rows = serving.filter(
        F.col("magasin_standardise").isin(*stores)
        & F.col("cle_matching_exacte").isNotNull()
        & (F.col("statut_comparabilite") == "comparable_normalise")
        & F.col(mode).isNotNull()
    )
    if mode == UNIT:
        rows = rows.filter(F.col("type_prix_reference") != "raw_price")
    cells = rows.groupBy(*index, "magasin_standardise", "type_prix_reference").agg(
        exact_mean(F.col(mode)).alias("_prix")
    )
    cells = whole(cells, "_prix")
    qualified = (
        cells.groupBy("jour", "cle_matching_exacte")
        .agg(
            F.size(F.collect_set("magasin_standardise")).alias("_magasins"),
            F.size(F.collect_set("type_prix_reference")).alias("_types"),
        )
        .filter((F.col("_types") == 1) & (F.col("_magasins") >= 2))
        .select("jour", "cle_matching_exacte")
    )
    wide = (
        cells.join(qualified, ["jour", "cle_matching_exacte"], "left_semi")
        .na.drop(subset=index)
        .groupBy(*index)
        .agg(*wide_prices(stores, F.max, "_prix"))
    )
    return row_extremes(wide, stores).withColumn("mode_prix", F.lit(mode))


def row_extremes(wide: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Available shops, cheapest and dearest price, gap and cheapest shops of each row."""
    prices = F.array(*[F.col(f"`{s}`") for s in stores])
    winners = F.array(
        *[F.when(F.col(f"`{s}`") == F.col("prix_min"), F.lit(s)) for s in stores]
    )
    return (
        wide.withColumns(
            {
                "nb_magasins_selectionnes_disponibles": F.size(F.array_compact(prices)).cast(
                    "bigint"
                ),
                "prix_min": F.array_min(prices),
                "prix_max": F.array_max(prices),
            }
        )
        .withColumn("ecart_fcfa", F.col("prix_max") - F.col("prix_min"))
        .withColumns(
            {
                "ecart_pct": percent(F.col("ecart_fcfa"), F.col("prix_min")),
                "magasin_moins_cher": F.array_join(winners, ", "),
                "nb_gagnants": F.size(F.array_compact(winners)).cast("bigint"),
            }
        )
    )


def comparison_rounded(comparison: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Prices to six decimals for publication; comparisons are made before this."""
    names = [*stores, "prix_min", "prix_max", "ecart_fcfa", "ecart_pct"]
    return comparison.withColumns({n: half_up(F.col(f"`{n}`"), 6) for n in names})


def comparison_sorted(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(
        F.col("ecart_fcfa").desc(), "nom_produit", "jour", "categorie_standardisee",
        "cle_matching_exacte",
    )


def full_coverage(comparison: DataFrame, stores: Sequence[str]) -> DataFrame:
    return comparison.filter(F.col("nb_magasins_selectionnes_disponibles") == len(stores))


def _store_totals(comparison: DataFrame, stores: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Wins, presence and mean price of every shop in one aggregate per ``keys``."""
    columns = [
        F.count(F.lit(1)).alias("_lignes"),
        F.count_if(F.col("nb_gagnants") >= 1).alias("_valides"),
    ]
    for i, s in enumerate(stores):
        price = F.col(f"`{s}`")
        columns += [
            F.count_if(price == F.col("prix_min")).alias(f"_v{i}"),
            F.count(price).alias(f"_n{i}"),
            exact_mean(price).alias(f"_m{i}"),
        ]
    return comparison.groupBy(*keys).agg(*columns).filter(F.col("_lignes") > 0)


def head_to_head(comparison: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Wins (ties count for each winner), win rate, mean price and coverage by shop."""
    rows = [
        [
            F.lit(s).alias("magasin"),
            F.col(f"_v{i}").alias("victoires"),
            half_up(percent(F.col(f"_v{i}"), F.col("_valides")), 6).alias("taux_victoire_pct"),
            half_up(F.col(f"_m{i}"), 6).alias("prix_moyen"),
            F.col(f"_n{i}").alias("couverture_produits"),
        ]
        for i, s in enumerate(stores)
    ]
    return long_rows(_store_totals(comparison, stores, []), [], rows).orderBy(
        F.col("taux_victoire_pct").desc_nulls_last(), F.col("prix_moyen").asc_nulls_last()
    )


def category_scorecard(comparison: DataFrame, stores: Sequence[str]) -> DataFrame:
    totals = _store_totals(comparison, stores, ["categorie_standardisee"])
    rows = [
        [
            F.lit(s).alias("magasin"),
            F.lit(i).alias("_choix"),
            F.col(f"_n{i}").alias("produits_comparables"),
            F.col(f"_v{i}").alias("victoires_prix"),
            half_up(percent(F.col(f"_v{i}"), F.col("_lignes")), 6).alias("taux_victoire_pct"),
            half_up(F.col(f"_m{i}"), 6).alias("prix_moyen_obs"),
        ]
        for i, s in enumerate(stores)
    ]
    keyed = totals.withColumnRenamed("categorie_standardisee", "categorie")
    return long_rows(keyed, ["categorie"], rows)


def scorecard_sorted(scorecard: DataFrame) -> DataFrame:
    return scorecard.orderBy(
        F.col("categorie").asc_nulls_last(),
        F.col("taux_victoire_pct").desc_nulls_last(),
        F.col("prix_moyen_obs").asc_nulls_last(),
        "_choix",
    ).drop("_choix")


def best_store_by_category(scorecard: DataFrame) -> DataFrame:
    """Highest win rate, then lowest mean price, then order of selection."""
    window = Window.partitionBy("categorie").orderBy(
        F.col("taux_victoire_pct").desc_nulls_last(),
        F.col("prix_moyen_obs").asc_nulls_last(),
        "_choix",
    )
    return (
        scorecard.withColumn("_rang", F.row_number().over(window))
        .filter(F.col("_rang") == 1)
        .drop("_rang", "_choix")
    )


def store_gap(comparison: DataFrame, store: str) -> DataFrame:
    """What one shop charges above the cheapest price of each row it sells."""
    price = F.col(f"`{store}`")
    return (
        comparison.filter(price.isNotNull())
        .withColumn("surcout_vs_min_fcfa", price - F.col("prix_min"))
        .withColumn(
            "surcout_vs_min_pct", percent(F.col("surcout_vs_min_fcfa"), F.col("prix_min"))
        )
    )


def store_gap_metrics(gap: DataFrame) -> DataFrame:
    """Mean and median overspend, and the rows where the shop is not the cheapest."""
    dearer = gap.agg(F.count_if(F.col("surcout_vs_min_fcfa") > 0).alias("n"))
    stats = grouped_stats(gap, [], "surcout_vs_min_fcfa", {"mediane": 0.5})
    return stats.select(
        half_up(F.col("moyenne"), 6).alias("surcout_moyen"),
        half_up(F.col("mediane"), 6).alias("surcout_median"),
        dearer.scalar().alias("nb_plus_chers"),
    )


def winner_histogram(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("magasin_moins_cher").agg(
        F.count("cle_matching_exacte").alias("nb_produits")
    )


def top_gaps(comparison: DataFrame, rows: int = 100) -> DataFrame:
    """The products with the widest gap: a top-k report."""
    return comparison_sorted(comparison).limit(rows)


def top_store_gaps(gap: DataFrame, rows: int = 50) -> DataFrame:
    return gap.orderBy(
        F.col("surcout_vs_min_fcfa").desc(),
        F.col("surcout_vs_min_pct").desc_nulls_last(),
        F.col("ecart_fcfa").desc(),
        "nom_produit",
        "jour",
        "categorie_standardisee",
        "cle_matching_exacte",
    ).limit(rows)


def product_texts(comparison: DataFrame, stores: Sequence[str]) -> DataFrame:
    """The product table as shown: amounts and shares as text."""
    return comparison.select(
        "jour",
        "cle_matching_exacte",
        "nom_produit",
        "categorie_standardisee",
        "magasin_moins_cher",
        fcfa_text(F.col("prix_min")).alias("prix_min"),
        fcfa_text(F.col("prix_max")).alias("prix_max"),
        fcfa_text(F.col("ecart_fcfa")).alias("ecart_fcfa"),
        percent_text(F.col("ecart_pct")).alias("ecart_pct"),
        *[fcfa_text(F.col(f"`{s}`")).alias(s) for s in stores],
    )


# --- category views ----------------------------------------------------------


def heatmap(score: DataFrame, stores: Sequence[str]) -> DataFrame:
    return (
        score.filter(F.col("magasin_standardise").isin(*stores))
        .groupBy("categorie_standardisee", "magasin_standardise")
        .agg(
            half_up(exact_mean(F.col("indice_categorie_base_100")), 6).alias(
                "indice_categorie_base_100"
            )
        )
    )


def dispersion(
    serving: DataFrame,
    stores: Sequence[str],
    categories: Sequence[str] = (),
    mode: str = SHELF,
    trim: bool = True,
) -> DataFrame:
    """Box-plot figures by category and shop, outliers beyond the 1 % and 99 % quantiles cut.

    When that interval keeps no price, all are kept.  Prices are counted once, and
    the counts, one row per category, shop and price, are stored: the interval, what it keeps and the
    boxes are read from them, without the chain of cleaning below.
    """
    box = ["categorie_standardisee", "magasin_standardise"]
    rows = filter_selection(serving, stores, categories).filter(
        F.col("categorie_standardisee").isNotNull()
    )
    counts = stored(value_counts(rows, box, mode), "prices")
    if trim:
        prices = counts.groupBy("_v").agg(F.sum("_c").alias("_c"))
        bounds = counted_stats(prices, [], {"bas": 0.01, "haut": 0.99})
        interval = bounds.select(F.struct("bas", "haut")).scalar()
        inside = F.col("_v").between(interval.getField("bas"), interval.getField("haut"))
        kept = counts.agg(F.sum(F.when(inside, F.col("_c")))).scalar()
        counts = counts.filter(inside | kept.isNull())
    stats = counted_stats(counts, box, {"q1": 0.25, "mediane": 0.5, "q3": 0.75})
    return stats.select(
        "categorie_standardisee",
        "magasin_standardise",
        F.col("minimum").alias("prix_min"),
        half_up(F.col("q1"), 6).alias("q1"),
        half_up(F.col("mediane"), 6).alias("mediane"),
        half_up(F.col("q3"), 6).alias("q3"),
        F.col("maximum").alias("prix_max"),
        F.col("nb").alias("nb_points"),
    )


def category_order(stats: DataFrame) -> DataFrame:
    """Categories by mean of their shop medians; the window sees one row per category."""
    means = stats.groupBy("categorie_standardisee").agg(
        half_up(exact_mean(F.col("mediane")), 6).alias("mediane_moyenne")
    )
    order = Window.orderBy("mediane_moyenne", "categorie_standardisee")
    return means.withColumn("rang", F.row_number().over(order).cast("bigint"))


def dispersion_verdict(stats: DataFrame) -> DataFrame:
    """Leader, dearest shop, gap of medians and spread level of each category."""
    median = F.struct("mediane", "magasin_standardise")
    gathered = stats.groupBy("categorie_standardisee").agg(
        F.min(median).alias("_bas"),
        F.max(median).alias("_haut"),
        exact_mean(F.col("q3") - F.col("q1")).alias("iqr_moyen"),
    )
    leader = F.col("_bas.mediane")
    spread = ratio(F.col("iqr_moyen"), leader)
    level = (
        F.when(~(leader > 0), F.lit("indeterminee"))
        .when(spread < 0.25, F.lit("faible"))
        .when(spread < 0.5, F.lit("moderee"))
        .otherwise(F.lit("elevee"))
    )
    return gathered.select(
        "categorie_standardisee",
        F.col("_bas.magasin_standardise").alias("magasin_leader"),
        F.col("_haut.magasin_standardise").alias("magasin_haut"),
        half_up(F.when(leader > 0, percent(F.col("_haut.mediane") - leader, leader)), 6).alias(
            "ecart_medianes_pct"
        ),
        half_up(F.col("iqr_moyen"), 6).alias("iqr_moyen"),
        half_up(F.when(leader > 0, spread), 6).alias("ratio_dispersion"),
        level.alias("niveau_dispersion"),
    )


# --- context, overview, quality ----------------------------------------------


def context_metrics(
    context: DataFrame, stores: Sequence[str], categories: Sequence[str] = ()
) -> DataFrame:
    return filter_selection(context, stores, categories).agg(
        F.count(F.lit(1)).alias("nb_lignes"),
        F.count_distinct("categorie_standardisee").alias("nb_categories"),
        F.count_distinct("magasin_standardise").alias("nb_magasins"),
        half_up(exact_mean(F.col("indice_categorie_base_100")), 6).alias("indice_moyen_base_100"),
    )


def confidence_counts(
    context: DataFrame, stores: Sequence[str], categories: Sequence[str] = ()
) -> DataFrame:
    return (
        filter_selection(context, stores, categories)
        .groupBy("score_confiance")
        .agg(F.count(F.lit(1)).alias("nb_lignes"))
    )


def latest_competition(competition: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Rows of the selection's last month; the month is a scalar, not a join."""
    chosen = competition.filter(F.col("magasin_standardise").isin(*stores))
    return chosen.filter(F.col("mois") == chosen.agg(F.max("mois")).scalar())


def latest_ranking(competition: DataFrame, stores: Sequence[str]) -> DataFrame:
    return (
        latest_competition(competition, stores)
        .orderBy("indice_competitivite_min", "indice_competitivite_moyenne", "magasin_standardise")
        .select(
            "magasin_standardise",
            "nb_produits_comparables",
            half_up(F.col("indice_competitivite_min"), 3).alias("indice_competitivite_min"),
            percent_text(F.col("ecart_moyen_vs_min_pct")).alias("ecart_moyen_vs_min_pct"),
            "rang_competitivite",
        )
    )


def overview(
    serving: DataFrame, panel: DataFrame, competition: DataFrame, stores: Sequence[str]
) -> DataFrame:
    """Last day, shops, keys, strictly comparable keys, and the month's leader."""
    strict = filter_selection(panel, stores).filter("comparabilite_stricte").agg(
        F.count_distinct("cle_matching_exacte")
    )
    leaders = latest_competition(competition, stores).agg(
        F.min(
            F.struct(
                "indice_competitivite_min",
                "indice_competitivite_moyenne",
                "magasin_standardise",
                "ecart_moyen_vs_min_pct",
                "nb_produits_comparables",
            )
        ).alias("l")
    )
    covered = filter_selection(serving, stores).agg(
        F.max("jour").alias("derniere_observation"),
        F.count_distinct("magasin_standardise").alias("nb_magasins"),
        F.count_distinct("cle_matching_exacte").alias("nb_produits"),
    )
    return covered.select(
        "*", strict.scalar().alias("nb_produits_comparables"), leaders.scalar().alias("_l")
    ).select(
        "derniere_observation",
        "nb_magasins",
        "nb_produits",
        "nb_produits_comparables",
        F.col("_l.magasin_standardise").alias("magasin_leader"),
        F.col("_l.indice_competitivite_min").alias("indice_leader"),
        F.col("_l.ecart_moyen_vs_min_pct").alias("ecart_leader_pct"),
        F.col("_l.nb_produits_comparables").alias("nb_produits_leader"),
    )


def quality_view(serving: DataFrame, panel: DataFrame, stores: Sequence[str]) -> DataFrame:
    rows = filter_selection(serving, stores)
    kept = F.count_if(F.col("statut_comparabilite") == "comparable_normalise")
    facts = rows.agg(
        kept.alias("observations_retenues"),
        half_up(percent(kept, F.count(F.lit(1))), 6).alias("taux_retention_pct"),
    )
    per_key = (
        filter_selection(panel, stores)
        .groupBy("cle_matching_exacte")
        .agg(
            F.bool_or("comparable_multi_store").alias("multi"),
            F.bool_or("comparabilite_stricte").alias("stricte"),
        )
        .agg(F.struct(F.count_if("multi").alias("m"), F.count_if("stricte").alias("s")).alias("k"))
    )
    return facts.select("*", per_key.scalar().alias("_k")).select(
        "observations_retenues",
        "taux_retention_pct",
        F.col("_k.m").alias("cles_multi_store"),
        F.col("_k.s").alias("cles_strictes"),
    )


def status_counts(serving: DataFrame) -> DataFrame:
    return serving.groupBy(F.col("statut_comparabilite").alias("statut")).agg(
        F.count(F.lit(1)).alias("nb_observations")
    )


def review_reasons(serving: DataFrame) -> DataFrame:
    return (
        serving.filter(F.col("statut_comparabilite") == "a_revoir")
        .groupBy("motif_comparabilite")
        .agg(F.count(F.lit(1)).alias("nb_observations"))
    )


def avg_price(serving: DataFrame) -> DataFrame:
    return serving.groupBy("categorie_standardisee", "magasin_standardise").agg(
        half_up(exact_mean(F.col("prix")), 0).alias("prix")
    )


def inflation_pivot(inflation: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Month by category index, one column per listed category."""
    return inflation.groupBy("mois").agg(
        *wide_prices(categories, F.avg, "indice_prix_base_100", by="categorie_standardisee")
    )


def latest_inflation(inflation: DataFrame) -> DataFrame:
    last = inflation.agg(F.max_by(F.struct("mois", "inflation_mensuelle_pct"), "mois").alias("i"))
    return last.select(
        F.col("i.mois").alias("mois"),
        F.col("i.inflation_mensuelle_pct").alias("inflation_mensuelle_pct"),
        percent_text(F.col("i.inflation_mensuelle_pct")).alias("texte"),
    ).filter(F.col("mois").isNotNull())


def data_warnings(comparison: DataFrame, volatility: DataFrame, variation: DataFrame) -> DataFrame:
    """Which readings the data does not support yet."""
    counts = variation.agg(F.count("variation_vs_mois_precedent_pct").alias("_n"))
    return (
        counts.select(
            (~comparison.exists()).alias("sans_comparaison"),
            (~volatility.exists()).alias("sans_fluctuation"),
            (F.col("_n") == 0).alias("sans_variation_mensuelle"),
        )
        .withColumn(
            "donnees_suffisantes",
            ~(
                F.col("sans_comparaison")
                | F.col("sans_fluctuation")
                | F.col("sans_variation_mensuelle")
            ),
        )
    )


