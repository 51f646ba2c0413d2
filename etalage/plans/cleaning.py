"""From raw listings to the analytics table, the product reference and the exact price panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage import vocab
from etalage.functions import matching as m
from etalage.functions import text as tx
from etalage.operators.dedupe import keep_first
from etalage.operators.stats import join_null_safe
from etalage.operators.wide import wide_prices
from etalage.session import stored


#: What the name features and the labels depend on.
ENTRY = ("nom_produit", "categorie", "magasin")


def coerce_required(raw: DataFrame) -> DataFrame:
    """Bad numbers and dates become null; rows without name, price, shop or date go."""
    dates = raw.schema["date_scraping"].dataType
    day = F.col("date_scraping")
    if isinstance(dates, T.StringType):
        day = F.try_to_timestamp(day)
    return raw.select(*vocab.RAW_COLUMNS).withColumns(
        {"prix": F.col("prix").try_cast("double"), "date_scraping": day.cast("date")}
    ).na.drop(subset=["nom_produit", "prix", "magasin", "date_scraping"])


def name_features(names: DataFrame) -> DataFrame:
    """Everything that depends on ``nom_produit`` alone, one step per projection.

    Each step reads the column the step before made, so no pattern runs twice.
    The features leave through a one-row generator: a later filter on a key
    then stays above it, where pushing it down would copy the whole chain of
    patterns into the predicate.
    """
    features = (
        names.withColumn("_epele", tx.quantity_text(F.col("nom_produit")))
        .withColumn("nom_nettoye", tx.clean_spelled(F.col("_epele")))
        .withColumn(
            "_texte",
            tx.strip_accents(
                tx.quantity_text(F.concat_ws(" ", F.col("nom_produit"), F.col("nom_nettoye")))
            ),
        )
        .withColumn("_quantite", m.found_quantity("_texte"))
        .withColumn("_pieces", F.regexp_extract("_texte", vocab.PIECE_COUNT, 1))
        .withColumn("_mots", m.token_text(F.col("nom_nettoye")))
        .withColumns({"quantite": m.quantity("_quantite", "_pieces"), "jetons": m.tokens_of("_mots")})
        .withColumn("cle_matching_large", m.broad_key("jetons"))
        .select(
            *names.columns,
            F.explode(
                F.array(
                    F.struct(
                        "nom_nettoye",
                        "quantite",
                        "jetons",
                        F.expr("bigint(size(jetons))").alias("nb_jetons"),
                        "cle_matching_large",
                        m.exact_key("cle_matching_large", "quantite.quantite_label").alias(
                            "cle_matching_exacte"
                        ),
                        m.brand_guess("jetons").alias("marque_probable"),
                    )
                )
            ).alias("_nom"),
        )
    )
    return features.select(*names.columns, "_nom.*")


def with_labels(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        tx.normalize_store(F.col("magasin")).alias("magasin_standardise"),
        tx.normalize_category(F.col("categorie")).alias("categorie_standardisee"),
    )


def catalogue(listings: DataFrame) -> DataFrame:
    """The distinct entries of the listings, each name parsed and each entry labelled once."""
    entries = listings.select(*ENTRY).distinct()
    return with_labels(entries).join(name_features(entries.select("nom_produit").distinct()), "nom_produit")


def with_name_features(listings: DataFrame, share_names: bool = True) -> DataFrame:
    """Add the name features and the standard labels to every listing.

    A shop lists the same products day after day, so by default the distinct
    (name, category, shop) entries form a catalogue.  Each distinct name is
    parsed once and each entry labelled once, and a listing costs one lookup:
    the pattern work grows with the catalogue, not with the history.  The
    entries combine map-side; the joins are left to Spark's size check
    (broadcast when small, shuffle with skew splitting when not).
    ``share_names=False`` parses row by row, for streams, where there is no
    second pass.
    """
    if not share_names:
        return with_labels(name_features(listings))
    return join_null_safe(listings, catalogue(listings), ENTRY)


def calendar_columns(df: DataFrame, date: str = "date_scraping") -> DataFrame:
    return df.selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"bigint(year({date})) AS annee",
        f"bigint(month({date})) AS mois",
        f"date_format({date}, 'yyyy-MM') AS mois_nom",
        f"concat(year({date}), 'Q', quarter({date})) AS trimestre",
        f"date({date}) AS jour",
    )


def priced(listings: DataFrame) -> DataFrame:
    """Unit prices, score, price type and comparability of rows with name features."""
    total, packs, family = (
        "quantite.quantite_totale", "quantite.pack_count", "quantite.famille_unite"
    )
    return (
        listings.withColumns(
            {
                "prix_par_kg_ou_l": m.price_per_kg_or_l("prix", total, family),
                "prix_par_piece": m.price_per_piece("prix", total, family, packs),
                "qualite_matching": m.match_quality("nb_jetons", total),
                "score_matching": m.match_score("nb_jetons", total, packs, "prix"),
            }
        )
        .withColumn("type_prix_reference", m.price_type("prix_par_kg_ou_l", "prix_par_piece"))
        .withColumn(
            "_verdict",
            m.comparability(
                "nb_jetons", total, packs, "qualite_matching", "type_prix_reference",
                "score_matching",
            ),
        )
        .select(
            "*",
            F.col("_verdict.statut").alias("statut_comparabilite"),
            F.col("_verdict.motif").alias("motif_comparabilite"),
            F.expr("quantite.pack_count AS pack_count"),
            F.expr("quantite.quantite_par_pack AS quantite_par_pack"),
            F.expr("quantite.unite_par_pack AS unite_par_pack"),
            F.expr("quantite.quantite_totale AS quantite_totale_reference"),
            F.expr("quantite.unite_reference AS unite_reference"),
            F.expr("quantite.famille_unite AS famille_unite"),
            F.expr("quantite.quantite_label AS quantite_standardisee"),
        )
    )


def dedup_daily(df: DataFrame, day: str = "jour") -> DataFrame:
    """One row per shop, day, exact key, price and link: the first of the merged order.

    The price leads, as the sort then mostly compares numbers.
    """
    return keep_first(
        df,
        ["prix", day, "cle_matching_exacte", "magasin_standardise", "url_produit"],
        ["magasin", "categorie", "nom_produit"],
    )


def daily_rows(raw: DataFrame, share_names: bool = True) -> DataFrame:
    """Listings with all their columns, one per shop, day, exact key, price and link.

    What follows from a row alone is added after the repeats are gone, so that it is not shuffled with it.
    With shared names the rows are shuffled as they are delivered, with their shop and exact key only, and meet
    the rest of the catalogue, which is stored, afterwards.  They are dealt by day and key: the history's dedupe
    and the daily panel need no other order, and every table of one query that starts here has the same shuffle.
    """
    rows = coerce_required(raw)
    if not share_names:
        return calendar_columns(priced(dedup_daily(with_name_features(rows, False), "date_scraping")))
    entries, keys = stored(catalogue(rows), "catalogue"), ("magasin_standardise", "cle_matching_exacte")
    keyed = join_null_safe(rows, entries.select(*ENTRY, *keys), ENTRY)
    kept = dedup_daily(keyed.repartition("date_scraping", "cle_matching_exacte"), "date_scraping")
    return calendar_columns(priced(join_null_safe(kept, entries.drop(*keys), ENTRY)))


def analytics(raw: DataFrame, share_names: bool = True) -> DataFrame:
    """The 29-column analytics table (unsorted; see ``analytics_sorted``)."""
    return daily_rows(raw, share_names).select(*vocab.ANALYTICS_COLUMNS)


def analytics_sorted(table: DataFrame) -> DataFrame:
    """Export order: date, shop, category, cleaned name."""
    return table.orderBy(
        "date_scraping",
        "magasin_standardise",
        F.col("categorie_standardisee").asc_nulls_last(),
        F.col("nom_nettoye").asc_nulls_last(),
    )


def product_reference(table: DataFrame) -> DataFrame:
    """One row per exact key, broad key and category.

    The table is first brought down to one row per key, shop and status with
    map-side combine.  What is left per key is a handful of rows, so one
    repartition by key serves the status totals and the final aggregate.
    """
    keys = ["cle_matching_exacte", "cle_matching_large", "categorie_standardisee"]
    firsts = ("nom_nettoye", "marque_probable", "quantite_standardisee", "famille_unite")
    order = F.struct("magasin", "categorie", "nom_produit", "jour", "prix", "url")
    parts = (
        table.withColumns(
            {
                "magasin": F.col("magasin_standardise"),
                "categorie": F.col("categorie_standardisee"),
                "url": F.col("url_produit"),
            }
        )
        .groupBy(*keys, "magasin_standardise", "statut_comparabilite")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct(order.alias("o"), *firsts)).alias("_premier"),
            F.min("prix").alias("_min"),
            F.max("prix").alias("_max"),
            F.max("score_matching").alias("_score"),
        )
    )
    status_totals = F.sum("_n").over(Window.partitionBy(*keys, "statut_comparabilite"))
    return (
        parts.repartition(*keys)
        .withColumn("_nstatut", status_totals)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("nb_lignes"),
            F.size(F.collect_set("magasin_standardise")).cast("bigint").alias("nb_magasins"),
            F.array_join(F.sort_array(F.collect_set("magasin_standardise")), " | ").alias(
                "magasins"
            ),
            F.min("_premier").alias("_premier"),
            F.min("_min").alias("prix_min"),
            F.max("_max").alias("prix_max"),
            F.max("_score").alias("score_matching_max"),
            F.min(F.struct((-F.col("_nstatut")).alias("n"), "statut_comparabilite")).alias("_mode"),
        )
        .select(
            *keys,
            "nb_lignes",
            "nb_magasins",
            "magasins",
            F.col("_premier.nom_nettoye").alias("nom_reference"),
            F.col("_premier.marque_probable").alias("marque_probable"),
            F.col("_premier.quantite_standardisee").alias("quantite_standardisee"),
            F.col("_premier.famille_unite").alias("famille_unite"),
            "prix_min",
            "prix_max",
            "score_matching_max",
            F.col("_mode.statut_comparabilite").alias("statut_comparabilite"),
        )
    )


def exact_price_panel(table: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Lowest price per shop for exact keys seen in two shops or more with one price type.

    Differently worded names of a key stay on separate rows.
    """
    order = F.struct("nom_produit", "jour", "prix", "url_produit")
    per_store = (
        table.filter(F.col("statut_comparabilite").isin(*vocab.PANEL_STATUSES))
        .groupBy(
            "cle_matching_exacte",
            "categorie_standardisee",
            "quantite_standardisee",
            "magasin_standardise",
        )
        .agg(
            F.min(F.struct(order.alias("o"), "nom_nettoye", "type_prix_reference")).alias("_p"),
            F.min("prix").alias("prix_min"),
        )
        .select(
            "*",
            F.col("_p.nom_nettoye").alias("nom_reference"),
            F.col("_p.type_prix_reference").alias("type_prix_reference"),
        )
        .drop("_p")
    )
    by_key = Window.partitionBy("cle_matching_exacte")
    index = [
        "cle_matching_exacte",
        "categorie_standardisee",
        "quantite_standardisee",
        "nom_reference",
        "nb_magasins",
        "type_prix_reference",
    ]
    return (
        per_store.withColumns(
            {
                "nb_magasins": F.size(F.collect_set("magasin_standardise").over(by_key)).cast(
                    "bigint"
                ),
                "_types": F.size(F.collect_set("type_prix_reference").over(by_key)),
            }
        )
        .filter((F.col("nb_magasins") >= 2) & (F.col("_types") == 1))
        .na.drop(subset=index)
        .groupBy(*index)
        .agg(*wide_prices(stores, F.min, "prix_min"))
    )


def distributions(table: DataFrame) -> DataFrame:
    """Row counts by shop, by match quality and by status, from one pass."""
    axes = ("magasin_standardise", "qualite_matching", "statut_comparabilite")
    counted = table.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("axe"), F.col(a).alias("valeur")) for a in axes])
    return (
        counted.select(F.explode(pairs).alias("_p"), "_n")
        .groupBy(F.col("_p.axe").alias("axe"), F.col("_p.valeur").alias("valeur"))
        .agg(F.sum("_n").alias("nb_lignes"))
        .orderBy("axe", F.col("nb_lignes").desc(), "valeur")
    )
