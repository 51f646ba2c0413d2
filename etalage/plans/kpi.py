"""The price indicators: history, daily panel, indices, scores, summary and quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage import vocab
from etalage.functions.numbers import exact_mean, half_up, percent, ratio
from etalage.functions.text import blank_to_null
from etalage.operators.dedupe import keep_last
from etalage.operators.stats import counted_stats, join_null_safe, value_counts, whole


def _round6(*columns: str) -> dict[str, Column]:
    return {c: half_up(F.col(c), 6) for c in columns}


# --- history -----------------------------------------------------------------


def usable_rows(snapshots: DataFrame) -> DataFrame:
    """Typed rows; one without date, price, shop or key is dropped."""
    typed = snapshots.withColumns(
        {
            "date_scraping": F.col("date_scraping").try_cast("date"),
            "jour": F.col("jour").try_cast("date"),
            "prix": F.col("prix").try_cast("double"),
            "prix_par_kg_ou_l": F.col("prix_par_kg_ou_l").try_cast("double"),
            "prix_par_piece": F.col("prix_par_piece").try_cast("double"),
        }
    )
    return typed.filter(
        F.col("date_scraping").isNotNull()
        & F.col("jour").isNotNull()
        & (F.col("prix") > 0)
        & ~F.isnan("prix")
        & blank_to_null("magasin_standardise").isNotNull()
        & blank_to_null("cle_matching_exacte").isNotNull()
    )


def prepare_history(snapshots: DataFrame) -> DataFrame:
    """Usable rows of the united snapshots, one per shop, day, key, price and source file.

    Texts that a CSV export would read back as missing become null here; shop and key of a usable row are none.
    """
    usable = usable_rows(snapshots)
    kept = keep_last(
        usable,
        ["prix", "jour", "cle_matching_exacte", "magasin_standardise", "source_file"],
        [
            c
            for c in ("date_scraping", "categorie_standardisee", "nom_nettoye", "nom_produit", "url_produit")
            if c in usable.columns
        ],
    )
    texts = {
        f.name: blank_to_null(f.name)
        for f in kept.schema
        if isinstance(f.dataType, T.StringType) and f.name not in ("source_file", "magasin_standardise", "cle_matching_exacte")
    }
    return kept.withColumns(texts).withColumns(
        {
            "mois": F.date_format("jour", "yyyy-MM"),
            "annee": F.year("jour").cast("bigint"),
            "mois_num": F.month("jour").cast("bigint"),
        }
    )


def comparable_price(df: DataFrame) -> DataFrame:
    """Price per kg or litre, else per piece, else as displayed, with its type."""
    return df.withColumns(
        {
            "prix_comparable": F.coalesce("prix_par_kg_ou_l", "prix_par_piece", "prix"),
            "type_prix_comparable": F.when(
                F.col("prix_par_kg_ou_l").isNotNull(), F.lit("unit_kg_l")
            )
            .when(F.col("prix_par_piece").isNotNull(), F.lit("unit_piece"))
            .otherwise(F.lit("raw_price")),
        }
    ).filter(F.col("prix_comparable").isNotNull())


def reliable(history: DataFrame) -> DataFrame:
    return history.filter(F.col("statut_comparabilite").isin(*vocab.RELIABLE_STATUSES))


def reliable_prices(history: DataFrame) -> DataFrame:
    """Input of every indicator: reliable rows with their comparable price."""
    return comparable_price(reliable(history))


#: What the indicators read of a reliable row.
INDICATOR_COLUMNS = (
    "jour", "mois", "date_scraping", "source_file", "magasin_standardise", "categorie_standardisee",
    "cle_matching_exacte", "nom_nettoye", "prix_comparable", "type_prix_comparable", "score_matching",
    "statut_comparabilite",
)


# --- daily panel and competitiveness -----------------------------------------


def _first(column: str) -> Column:
    """First non-null value in file order."""
    order = F.struct("source_file", "date_scraping", F.col("nom_nettoye").isNull(), "nom_nettoye")
    return F.min_by(column, F.when(F.col(column).isNotNull(), order))


def daily_panel(prices: DataFrame) -> DataFrame:
    """Mean price per day, category, key and shop, with how many shops can be compared.

    The aggregate combines map-side, after which a (day, key) holds at most one
    row per shop and category: the coverage counts run over those few rows.
    """
    by_key = Window.partitionBy("jour", "cle_matching_exacte")
    return (
        prices.groupBy(
            "jour", "mois", "categorie_standardisee", "cle_matching_exacte", "magasin_standardise"
        )
        .agg(
            _first("nom_nettoye").alias("nom_reference"),
            exact_mean(F.col("prix_comparable")).alias("prix_obs"),
            _first("type_prix_comparable").alias("type_prix"),
            exact_mean(F.col("score_matching")).alias("score_matching_moyen"),
            _first("statut_comparabilite").alias("statut_comparabilite"),
        )
        .withColumns(
            {
                "nb_magasins_jour": F.size(
                    F.collect_set("magasin_standardise").over(by_key)
                ).cast("bigint"),
                "nb_types_prix_jour": F.size(F.collect_set("type_prix").over(by_key)).cast("bigint"),
            }
        )
        .withColumn("comparable_multi_store", F.col("nb_magasins_jour") >= 2)
        .withColumn(
            "comparabilite_stricte",
            F.col("comparable_multi_store") & (F.col("nb_types_prix_jour") == 1),
        )
    )


def daily_panel_rounded(panel: DataFrame) -> DataFrame:
    return panel.withColumns(_round6("prix_obs", "score_matching_moyen"))


def competitiveness(panel: DataFrame) -> DataFrame:
    """Shops against the day's cheapest and mean price per key, averaged by month and ranked."""
    by_key = Window.partitionBy("jour", "cle_matching_exacte")
    against = (
        panel.filter("comparabilite_stricte")
        .withColumns(
            {
                "_min": F.min("prix_obs").over(by_key),
                "_moyen": F.avg("prix_obs").over(by_key),
            }
        )
        .select(
            "magasin_standardise",
            "mois",
            "cle_matching_exacte",
            ratio(F.col("prix_obs"), F.col("_min")).alias("_vs_min"),
            ratio(F.col("prix_obs"), F.col("_moyen")).alias("_vs_moyen"),
        )
    )
    by_month = Window.partitionBy("mois").orderBy("indice_competitivite_min")
    return (
        against.groupBy("magasin_standardise", "mois")
        .agg(
            F.count_distinct("cle_matching_exacte").alias("nb_produits_comparables"),
            half_up(F.avg("_vs_min"), 6).alias("indice_competitivite_min"),
            half_up(F.avg("_vs_moyen"), 6).alias("indice_competitivite_moyenne"),
            half_up(F.avg((F.col("_vs_min") - 1) * 100), 6).alias("ecart_moyen_vs_min_pct"),
        )
        .withColumn("rang_competitivite", F.dense_rank().over(by_month).cast("bigint"))
    )


# --- monthly indices ---------------------------------------------------------


#: The finest groups of a monthly index; coarser ones are sums of these.
MONTHLY_GROUPS = ("mois", "magasin_standardise", "categorie_standardisee")


def price_counts(prices: DataFrame) -> DataFrame:
    """How often each price occurs per month, shop and category.

    The state of every monthly index: counts of other months, shops and categories add to it, and
    counts, exact sums and medians of any coarser group follow from it.
    """
    return value_counts(prices, MONTHLY_GROUPS, "prix_comparable")


def _monthly(
    prices: DataFrame, by: Sequence[str], change: str, index: str, unless_null: str | None
) -> DataFrame:
    """Monthly count, mean and median per ``by``, change on the previous month present,
    and index 100 on the first month.  Groups with a null ``unless_null`` get neither.

    ``prices`` may be their counts instead (see ``price_counts``).
    """
    groups = ["mois", *by]
    if "_c" in prices.columns:
        counts = prices.groupBy(*groups, "_v").agg(F.sum("_c").alias("_c"))
    else:
        counts = value_counts(prices, groups, "prix_comparable")
    stats = counted_stats(counts, groups, {"prix_median": 0.5})
    series = Window.partitionBy(*by) if by else Window.partitionBy()
    ordered = series.orderBy("mois")
    before = F.lag("moyenne").over(ordered)
    base = F.first("moyenne").over(ordered)
    known = F.col(unless_null).isNotNull() if unless_null else F.lit(True)
    return stats.select(
        "mois",
        *by,
        F.col("nb").alias("nb_observations"),
        half_up(F.col("moyenne"), 6).alias("prix_moyen"),
        half_up(F.col("prix_median"), 6).alias("prix_median"),
        F.when(known, half_up((ratio(F.col("moyenne"), before) - 1) * 100, 6)).alias(change),
        F.when(known, half_up(ratio(F.col("moyenne"), base) * 100, 6)).alias(index),
    )


def variation_index(prices: DataFrame) -> DataFrame:
    return _monthly(
        prices,
        ["magasin_standardise", "categorie_standardisee"],
        "variation_vs_mois_precedent_pct",
        "indice_base_100",
        "categorie_standardisee",
    )


def inflation_category(prices: DataFrame) -> DataFrame:
    return _monthly(
        prices,
        ["categorie_standardisee"],
        "inflation_mensuelle_pct",
        "indice_prix_base_100",
        "categorie_standardisee",
    )


def inflation_global(prices: DataFrame) -> DataFrame:
    """One row per month; the unpartitioned window only ever sees those rows."""
    return _monthly(prices, [], "inflation_mensuelle_pct", "indice_prix_base_100", None)


# --- product volatility ------------------------------------------------------


def fluctuation(prices: DataFrame) -> DataFrame:
    """Spread of each key in each shop and category seen on two days or more."""
    grouped = (
        prices.groupBy("cle_matching_exacte", "magasin_standardise", "categorie_standardisee")
        .agg(
            _first("nom_nettoye").alias("nom_reference"),
            F.count_distinct("jour").alias("nb_jours"),
            F.min("prix_comparable").alias("prix_min"),
            F.max("prix_comparable").alias("prix_max"),
            exact_mean(F.col("prix_comparable")).alias("prix_moyen"),
            F.stddev_samp("prix_comparable").alias("prix_std"),
            F.min("jour").alias("premiere_date"),
            F.max("jour").alias("derniere_date"),
        )
        .filter(F.col("nb_jours") >= 2)
        .withColumn("amplitude_absolue", F.col("prix_max") - F.col("prix_min"))
    )
    return grouped.withColumns(
        {
            "amplitude_pct": half_up(percent(F.col("amplitude_absolue"), F.col("prix_min")), 6),
            "coefficient_variation_pct": half_up(
                percent(F.col("prix_std"), F.col("prix_moyen")), 6
            ),
        }
    ).withColumns(_round6("amplitude_absolue", "prix_moyen", "prix_std"))


def fluctuation_sorted(table: DataFrame) -> DataFrame:
    return table.orderBy(
        F.col("coefficient_variation_pct").desc_nulls_last(),
        F.col("amplitude_pct").desc_nulls_last(),
        F.col("nb_jours").desc(),
        "cle_matching_exacte",
        "magasin_standardise",
        "categorie_standardisee",
    )


# --- category by shop --------------------------------------------------------


def category_store_score(prices: DataFrame) -> DataFrame:
    """Coverage and price level of each shop in each category, 100 = mean of the shops."""
    pair = ["categorie_standardisee", "magasin_standardise"]
    normalised = F.when(F.col("type_prix_comparable") != "raw_price", 1).otherwise(0)
    per_price = prices.groupBy(*pair, "cle_matching_exacte", F.col("prix_comparable").alias("_v")).agg(
        F.sum(normalised).alias("_normalises"), F.sum(F.lit(1)).alias("_c")
    )
    per_price = whole(per_price, "_normalises", "_c")
    per_key = per_price.groupBy(*pair, "cle_matching_exacte").agg(
        F.sum("_normalises").alias("_normalises"), F.sum("_c").alias("_lignes")
    )
    per_key = whole(per_key, "_normalises", "_lignes")
    counts = per_key.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("nb_produits"),
        percent(F.sum("_normalises"), F.sum("_lignes")).alias("part_produits_normalises"),
    )
    totals = per_key.groupBy("categorie_standardisee").agg(
        F.count_distinct("cle_matching_exacte").alias("nb_produits_categorie_total")
    )
    prices_seen = per_price.groupBy(*pair, "_v").agg(F.sum("_c").alias("_c"))
    stats = counted_stats(prices_seen, pair, {"prix_median": 0.5})
    rows = join_null_safe(
        join_null_safe(stats, counts, pair), totals, ["categorie_standardisee"], "left"
    )
    reference = F.avg("moyenne").over(Window.partitionBy("categorie_standardisee"))
    return rows.select(
        *pair,
        "nb_produits",
        F.col("nb").alias("nb_observations"),
        half_up(F.col("moyenne"), 6).alias("prix_moyen"),
        half_up(F.col("prix_median"), 6).alias("prix_median"),
        F.col("minimum").alias("prix_min"),
        F.col("maximum").alias("prix_max"),
        half_up(F.col("part_produits_normalises"), 6).alias("part_produits_normalises"),
        "nb_produits_categorie_total",
        half_up(percent(F.col("nb_produits"), F.col("nb_produits_categorie_total")), 6).alias(
            "couverture_categorie_pct"
        ),
        half_up(ratio(F.col("moyenne"), reference) * 100, 6).alias("indice_categorie_base_100"),
    )


def confidence_level(products: Column, coverage: Column, normalised: Column) -> Column:
    return (
        F.when((products >= 30) & (coverage >= 60) & (normalised >= 50), F.lit("eleve"))
        .when((products >= 15) & (coverage >= 35), F.lit("moyen"))
        .otherwise(F.lit("faible"))
    )


def context_table(score: DataFrame) -> DataFrame:
    """The category score with its confidence level and reading note."""
    notes = F.create_map(*[F.lit(p) for pair in vocab.CONFIDENCE_NOTES.items() for p in pair])
    return (
        score.withColumns(
            {
                "niveau_comparaison": F.lit("categorie"),
                "indicateur_principal": half_up(F.col("indice_categorie_base_100"), 2),
                "score_confiance": confidence_level(
                    F.col("nb_produits"),
                    F.col("couverture_categorie_pct"),
                    F.col("part_produits_normalises"),
                ),
            }
        )
        .withColumn("note_methodologique", F.try_element_at(notes, F.col("score_confiance")))
        .select(*vocab.CONTEXT_COLUMNS)
    )


# --- summary and quality -----------------------------------------------------


def _fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", half_up(value, places))


def kpi_summary(
    prices: DataFrame,
    variation: DataFrame,
    competition: DataFrame,
    volatility: DataFrame,
    inflation: DataFrame,
) -> DataFrame:
    """Five headline rows, each a one-row aggregate, so a missing table still gives its row."""

    def row(df: DataFrame, kpi: str, value: Column, details: Column) -> DataFrame:
        return df.select(
            F.lit(kpi).alias("kpi"),
            value.cast("string").alias("valeur"),
            details.cast("string").alias("details"),
        )

    covered = prices.agg(
        F.max("jour").alias("jour"),
        F.max("mois").alias("mois"),
        F.count_distinct("magasin_standardise").alias("magasins"),
        F.count_distinct("cle_matching_exacte").alias("cles"),
    )
    last_month = prices.agg(F.max("mois").alias("mois"))
    best = (
        competition.join(last_month, "mois", "left_semi")
        .agg(
            F.min(
                F.struct(
                    "indice_competitivite_min",
                    "indice_competitivite_moyenne",
                    "magasin_standardise",
                    "nb_produits_comparables",
                )
            ).alias("b")
        )
        .select("b.*")
    )
    top = volatility.agg(
        F.min(
            F.struct(
                F.col("coefficient_variation_pct").isNull().alias("sans"),
                (-F.col("coefficient_variation_pct")).alias("a"),
                (-F.col("amplitude_pct")).alias("b"),
                (-F.col("nb_jours")).alias("c"),
                "cle_matching_exacte",
                "magasin_standardise",
                F.col("categorie_standardisee").isNull().alias("sans_categorie"),
                "categorie_standardisee",
                "nom_reference",
                "coefficient_variation_pct",
                "amplitude_pct",
            )
        ).alias("t")
    ).select("t.*")
    last_inflation = inflation.agg(
        F.max_by(F.struct("mois", "inflation_mensuelle_pct"), "mois").alias("i")
    ).select("i.*")
    last_variation = variation.agg(
        F.max_by(
            F.struct("indice_base_100"),
            F.struct(
                "mois",
                "magasin_standardise",
                F.col("categorie_standardisee").isNull(),
                "categorie_standardisee",
            ),
        ).alias("v")
    ).select("v.*")
    parts = [
        row(
            covered,
            "date_derniere_observation",
            F.coalesce(F.col("jour").cast("string"), F.lit("")),
            F.format_string("%d magasins, %d cles produits", "magasins", "cles"),
        ),
        row(
            best,
            "magasin_plus_competitif",
            F.coalesce("magasin_standardise", F.lit("")),
            F.when(
                F.col("magasin_standardise").isNotNull(),
                F.concat(
                    F.lit("indice="),
                    _fixed(F.col("indice_competitivite_min"), 4),
                    F.lit(" sur "),
                    F.col("nb_produits_comparables").cast("string"),
                    F.lit(" produits"),
                ),
            ).otherwise(F.lit("comparaison multi-magasins insuffisante")),
        ),
        row(
            top,
            "produit_plus_forte_fluctuation",
            F.coalesce("nom_reference", F.lit("")),
            F.when(
                F.col("magasin_standardise").isNotNull(),
                F.concat(
                    F.col("magasin_standardise"),
                    F.lit(" | cv="),
                    _fixed(F.col("coefficient_variation_pct"), 2),
                    F.lit("% | amplitude="),
                    _fixed(F.col("amplitude_pct"), 2),
                    F.lit("%"),
                ),
            ).otherwise(F.lit("historique insuffisant pour mesurer la fluctuation")),
        ),
        row(
            last_inflation,
            "inflation_mensuelle_globale",
            half_up(F.col("inflation_mensuelle_pct"), 2),
            F.coalesce("mois", F.lit("")),
        ),
        row(
            last_variation.select("*", last_month.scalar().alias("mois")),
            "indice_variation_prix_dernier_mois",
            half_up(F.col("indice_base_100"), 2),
            F.coalesce("mois", F.lit("")),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality_report(history: DataFrame, panel: DataFrame) -> DataFrame:
    """Eight counts: one pass over the history, one over the panel."""
    kept = F.col("statut_comparabilite").isin(*vocab.RELIABLE_STATUSES)
    raw_type = F.col("type_prix_reference") == "raw_price"
    total, held = F.count(F.lit(1)), F.count_if(kept)
    facts = history.agg(
        total.cast("double").alias("observations_total"),
        held.cast("double").alias("observations_retenues_kpi"),
        half_up(percent(held, total), 2).alias("taux_retention_kpi_pct"),
        F.count_distinct("cle_matching_exacte").cast("double").alias("cles_exactes_total"),
        F.count_if(kept & ~raw_type).cast("double").alias("observations_normalisees"),
        F.count_if(kept & raw_type).cast("double").alias("observations_prix_brut"),
    )
    per_key = panel.groupBy("cle_matching_exacte").agg(
        F.bool_or("comparable_multi_store").alias("multi"),
        F.bool_or("comparabilite_stricte").alias("stricte"),
    )
    keys = per_key.agg(
        F.count_if("multi").cast("double").alias("cles_multi_store"),
        F.count_if("stricte").cast("double").alias("cles_comparables_strictes"),
    )
    details = {
        "observations_total": "lignes analytiques chargees",
        "observations_retenues_kpi": "lignes retenues apres filtre de comparabilite",
        "taux_retention_kpi_pct": "part des observations jugees assez fiables pour les KPI",
        "cles_exactes_total": "cles produits dans le dataset analytique",
        "cles_multi_store": "cles presentes dans au moins 2 magasins le meme jour",
        "cles_comparables_strictes": "cles multi-magasins avec type de prix coherent",
        "observations_normalisees": "observations comparees au kg/L ou a la piece",
        "observations_prix_brut": "observations retenues sur prix affiche exact",
    }

    def rows(df: DataFrame) -> DataFrame:
        structs = F.array(
            *[
                F.struct(
                    F.lit(c).alias("kpi"),
                    F.col(c).alias("valeur"),
                    F.lit(details[c]).alias("details"),
                )
                for c in df.columns
            ]
        )
        return df.select(F.explode(structs).alias("r")).select("r.*")

    return rows(facts).unionByName(rows(keys))
