"""Every operator as a named query over a folder of driver tables.

A query is ``(spark, sf_dir) -> DataFrame``; nothing runs until the result is used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etalage import vocab
from etalage.functions import matching as m
from etalage.functions import text as tx
from etalage.functions.markup import element_table
from etalage.functions.numbers import half_up
from etalage.operators.stats import grouped_stats
from etalage.plans import capture, cleaning, compare, kpi, messages, search
from etalage.session import shared_folder, stored
from etalage.sources import retail_star as star
from etalage.sources.mart import mart_checked, mart_written, table_path, text_mart_checked, write_mart
from etalage.sources.snapshots import (
    dedup_listing,
    history_union,
    latest_snapshot,
    merge_sources,
    read_source,
    required_columns,
    with_lineage,
)
from etalage.streaming.ingest import incremental_history, incremental_index, incremental_panel, incremental_rows

Query = Callable[[SparkSession, str], DataFrame]
STORES, CATEGORIES = star.STORES, star.CATEGORIES
FOCUS_STORE = "EUROPE"


class Tables:
    """The tables of the pipeline over one folder, each a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return star.raw_listing(self.spark, self.sf_dir)

    @cached_property
    def analytics(self) -> DataFrame:
        return cleaning.analytics(self.raw)

    @cached_property
    def history(self) -> DataFrame:
        return kpi.prepare_history(with_lineage(self.analytics))

    @cached_property
    def prices(self) -> DataFrame:
        return kpi.reliable_prices(self.history)

    @cached_property
    def panel(self) -> DataFrame:
        return kpi.daily_panel(self.prices)

    @cached_property
    def competition(self) -> DataFrame:
        return kpi.competitiveness(self.panel)

    @cached_property
    def context(self) -> DataFrame:
        return kpi.context_table(kpi.category_store_score(self.prices))

    @cached_property
    def serving(self) -> DataFrame:
        return compare.serving_prices(self.analytics)

    @cached_property
    def comparison(self) -> DataFrame:
        return compare.price_comparison(self.serving, STORES)

    @cached_property
    def names(self) -> DataFrame:
        """Distinct product names with their listing counts and name features."""
        counted = self.raw.groupBy("nom_produit").agg(F.count(F.lit(1)).alias("nb_annonces"))
        return cleaning.name_features(counted)


def _of(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


# --- cleaning ----------------------------------------------------------------


def _quantities(t: Tables) -> DataFrame:
    return t.names.select(
        "nom_produit",
        F.col("quantite.pack_count").alias("pack_count"),
        F.col("quantite.quantite_par_pack").alias("quantite_par_pack"),
        F.col("quantite.unite_par_pack").alias("unite_par_pack"),
    )


def _converted(t: Tables) -> DataFrame:
    return t.names.select(
        "nom_produit",
        F.col("quantite.quantite_totale").alias("quantite_totale"),
        F.col("quantite.unite_reference").alias("unite_reference"),
        F.col("quantite.famille_unite").alias("famille_unite"),
        F.col("quantite.quantite_label").alias("quantite_label"),
    )


def _priced(t: Tables) -> DataFrame:
    return cleaning.priced(cleaning.with_name_features(cleaning.coerce_required(t.raw)))


def _unit_prices(t: Tables) -> DataFrame:
    return _priced(t).groupBy("nom_produit", "prix").agg(
        F.max("prix_par_kg_ou_l").alias("prix_par_kg_ou_l"),
        F.max("prix_par_piece").alias("prix_par_piece"),
        F.count(F.lit(1)).alias("nb_annonces"),
    )


def _comparability(t: Tables) -> DataFrame:
    return _priced(t).groupBy(
        "nom_produit",
        "qualite_matching",
        "score_matching",
        "type_prix_reference",
        "statut_comparabilite",
        "motif_comparabilite",
    ).agg(F.count(F.lit(1)).alias("nb_annonces"))


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose price and date went through text, some of it unreadable."""
    raw = star.raw_listing(spark, sf_dir)
    text = raw.withColumns(
        {
            "prix": F.when(F.col("prix") > 90000, F.lit("sur devis")).otherwise(
                F.col("prix").cast("string")
            ),
            "date_scraping": F.when(
                F.dayofmonth("date_scraping") == 13, F.lit("vendredi")
            ).otherwise(F.col("date_scraping").cast("string")),
        }
    )
    return cleaning.coerce_required(text)


def _stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "documents").select(
        "doc_id", tx.strip_accents(F.col("text")).alias("texte")
    )


def _clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "documents").select(
        "doc_id", tx.clean_name(F.col("text")).alias("texte")
    )


# --- sources -----------------------------------------------------------------


def _source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table as a source: only the required columns are read."""
    path = f"{sf_dir.rstrip('/')}/part.parquet"
    return read_source(spark, path, ("p_partkey", "p_name", "p_type", "p_size"))


def _history_union(t: Tables) -> DataFrame:
    """Old snapshots without the optional columns united with complete recent ones."""
    rows = with_lineage(t.analytics)
    recent = rows.filter(F.year("jour") >= 1998)
    old = rows.filter(F.year("jour") < 1998).drop(*vocab.HISTORY_DEFAULTS, "score_matching")
    columns = (
        "source_file", "magasin_standardise", "cle_matching_exacte", "prix", "url_produit",
        "statut_comparabilite", "motif_comparabilite", "type_prix_reference", "score_matching",
    )
    return history_union([old, recent]).select(*columns)


def _merge_sources(t: Tables) -> DataFrame:
    """One source per shop; a source without the required columns is skipped."""
    shops = [
        required_columns(t.raw.filter(F.col("magasin") == s), vocab.RAW_COLUMNS) for s in STORES
    ]
    unusable = required_columns(t.raw.drop("prix"), vocab.RAW_COLUMNS)
    return merge_sources([*shops, unusable])


def _kpi_summary(t: Tables) -> DataFrame:
    """The summary of indicators that all start from the reliable prices, which are stored for them."""
    prices = stored(t.prices.select(*kpi.INDICATOR_COLUMNS), "prices")
    values = stored(kpi.price_counts(prices), "values")
    return kpi.kpi_summary(
        prices,
        kpi.variation_index(values),
        kpi.competitiveness(kpi.daily_panel(prices)),
        kpi.fluctuation(prices),
        kpi.inflation_global(values),
    )


def _serving_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel published as delimited text, read back and typed."""
    panel = kpi.daily_panel_rounded(Tables(spark, sf_dir).panel)
    path = shared_folder(spark, "mart")
    write_mart({"daily_panel": panel}, path, "latest", fmt="csv")
    text = read_source(spark, table_path(spark, path, "daily_panel", "latest"), panel.columns, "csv")
    return compare.serving_table(text, "daily_panel")


#: A tail, two literals around a wildcard, a class, a choice that has no literal of its own, and a short one.
SEARCHES = ("PLATE.*(kg|cl)$", "red.+plate", "^[o-s]ld", "gear|anvil", "1l")


def _product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches over one index of the serving table's names."""
    serving = Tables(spark, sf_dir).serving
    index = search.index_names(serving, "nom_nettoye")
    found = [
        search.search_index(serving, index, term, "nom_nettoye").select(
            F.lit(term).alias("motif"), "nom_nettoye", "magasin_standardise", "jour", "prix", "url_produit"
        )
        for term in SEARCHES
    ]
    return reduce(DataFrame.unionByName, found)


# --- capture -----------------------------------------------------------------


def _listed(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(star.listing(spark, sf_dir))


_LISTED = ("magasin", "category", "page_no", "pos", "nom_produit", "prix", "url_produit")


# --- messages ----------------------------------------------------------------

# Labels that occur in the message table; the shops' own categories do not.
LABELS = ("The", "And", "With", "Une", "Que", "Der")
ALIASES = {"with": ("from", "this"), "der": ("die", "und"), "que": ("les", "leur")}


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "conversations")


def _message_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages against a label dimension of thousands: the longer words of the benchmark, the longest with a short form."""
    words = F.explode(F.split(tx.normalize_message(F.col("text")), " ")).alias("label")
    labels = star.table(spark, sf_dir, "benchmark").select(words).distinct().where(F.length("label") >= 4)
    aliases = labels.where(F.length("label") >= 8).select(F.col("label").alias("canonical"), F.substring("label", 1, 6).alias("alias"))
    return messages.message_labels(_messages(spark, sf_dir), labels, aliases).select(
        "conv_id", "turn", F.array_join("categories", " | ").alias("categories")
    )


# --- registry ----------------------------------------------------------------

QUERIES: dict[str, Query] = {
    # sources
    "source_projection": _source_projection,
    "latest_snapshot": _of(lambda t: latest_snapshot(t.raw, "magasin", "date_scraping")),
    "history_union": _of(_history_union),
    "merge_sources": _of(_merge_sources),
    "dedup_listing": _of(lambda t: dedup_listing(t.raw)),
    "write_mart": lambda spark, sf_dir: mart_written(spark, Tables(spark, sf_dir)),
    "mart_manifest": lambda spark, sf_dir: mart_checked(spark, Tables(spark, sf_dir)),
    "text_mart_manifest": lambda spark, sf_dir: text_mart_checked(spark, Tables(spark, sf_dir)),
    "incremental_history": incremental_history,
    "incremental_rows": incremental_rows,
    "incremental_panel": incremental_panel,
    "incremental_variation": partial(incremental_index, index=kpi.variation_index),
    "incremental_inflation_category": partial(incremental_index, index=kpi.inflation_category),
    "incremental_inflation_global": partial(incremental_index, index=kpi.inflation_global),
    "product_search": _product_search,
    # capture
    "page_links": lambda spark, sf_dir: capture.page_links(
        star.table(spark, sf_dir, "pages"), ["page_id"]
    ),
    "page_cards": lambda spark, sf_dir: capture.extract_cards(star.crawl(spark, sf_dir)),
    "page_tiles": lambda spark, sf_dir: capture.extract_tiles(star.crawl(spark, sf_dir)),
    "mixed_cards": lambda spark, sf_dir: capture.extract_cards(star.mixed_crawl(spark, sf_dir)),
    "mixed_tiles": lambda spark, sf_dir: capture.extract_tiles(star.mixed_crawl(spark, sf_dir)),
    "mixed_pagination": lambda spark, sf_dir: capture.pagination_facts(star.mixed_crawl(spark, sf_dir)),
    "page_elements": lambda spark, sf_dir: element_table(
        star.table(spark, sf_dir, "pages").select("page_id", "html")
    ).groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("nb_elements")),
    "pagination_facts": lambda spark, sf_dir: capture.pagination_facts(star.crawl(spark, sf_dir)),
    "page_pagination": lambda spark, sf_dir: capture.pagination_facts(
        star.table(spark, sf_dir, "pages")
    ),
    "price_text": _listed(
        lambda df: df.groupBy("price_text", tx.price_text(F.col("price_text")).alias("prix")).agg(
            F.count(F.lit(1)).alias("nb_annonces")
        )
    ),
    "resolve_url": _listed(
        lambda df: df.groupBy(
            "magasin", "href", tx.resolve_url(F.col("href"), F.col("magasin")).alias("url_produit")
        ).agg(F.count(F.lit(1)).alias("nb_annonces"))
    ),
    "valid_listing": _listed(lambda df: capture.valid_listing(df).select(*_LISTED)),
    "page_overlap": _listed(
        lambda df: capture.page_overlap(df).withColumn(
            "recouvrement", half_up(F.col("recouvrement"), 6)
        )
    ),
    "crawl_cutoff": _listed(
        lambda df: capture.crawl_cutoff(df).withColumn(
            "recouvrement", half_up(F.col("recouvrement"), 6)
        )
    ),
    "kept_listing": _listed(lambda df: capture.kept_listing(df).select(*_LISTED)),
    # messages
    "normalize_message": lambda spark, sf_dir: _messages(spark, sf_dir).select(
        "conv_id", "turn", tx.normalize_message(F.col("text")).alias("texte")
    ),
    "message_labels": _message_labels,
    "message_categories": lambda spark, sf_dir: messages.message_categories(
        _messages(spark, sf_dir), LABELS, ALIASES
    ).select("conv_id", "turn", F.array_join("categories", " | ").alias("categories")),
    "category_suggestions": lambda spark, sf_dir: messages.category_suggestions(
        _messages(spark, sf_dir), LABELS, ALIASES
    ).select("conv_id", "turn", F.array_join("suggestions", " | ").alias("suggestions")),
    "message_intents": lambda spark, sf_dir: messages.message_intents(
        _messages(spark, sf_dir), ("the", "la", "in"), ("of the", "de la", "in der")
    ).select("conv_id", "turn", "salutation", "conseil_general"),
    "context_payload": _of(
        lambda t: messages.payload_rows(messages.context_payload(t.context, STORES))
    ),
    "recommend_store": _of(lambda t: messages.recommend_store(t.context)),
    "parse_reply": _of(
        lambda t: messages.parse_reply(messages.as_replies(t.context), "reponse")
    ),
    "parse_free_reply": lambda spark, sf_dir: messages.parse_reply(
        _messages(spark, sf_dir).filter("role = 'assistant'").select("conv_id", "turn", "text"),
        "text",
    ).select("conv_id", "turn", "texte_brut", "categorie", "source_magasin"),
    # cleaning
    "strip_accents": _stripped,
    "clean_name": _clean_names,
    "normalize_store": _of(
        lambda t: t.raw.groupBy(
            "magasin", tx.normalize_store(F.col("magasin")).alias("magasin_standardise")
        ).agg(F.count(F.lit(1)).alias("nb_annonces"))
    ),
    "normalize_category": _of(
        lambda t: t.raw.groupBy(
            "categorie", tx.normalize_category(F.col("categorie")).alias("categorie_standardisee")
        ).agg(F.count(F.lit(1)).alias("nb_annonces"))
    ),
    "quantity_text": _of(
        lambda t: t.names.select(
            "nom_produit", "nb_annonces", tx.quantity_text(F.col("nom_produit")).alias("texte")
        )
    ),
    "clean_product_name": _of(lambda t: t.names.select("nom_produit", "nom_nettoye")),
    "extract_quantity": _of(_quantities),
    "convert_quantity": _of(_converted),
    "matching_tokens": _of(
        lambda t: t.names.select(
            "nom_produit", F.array_join("jetons", " ").alias("jetons"), "nb_jetons"
        )
    ),
    "matching_keys": _of(
        lambda t: t.names.select("nom_produit", "cle_matching_large", "cle_matching_exacte")
    ),
    "brand_guess": _of(lambda t: t.names.select("nom_produit", "marque_probable")),
    "unit_prices": _of(_unit_prices),
    "comparability": _of(_comparability),
    "calendar_columns": _of(
        lambda t: cleaning.calendar_columns(t.raw)
        .groupBy("date_scraping", "annee", "mois", "mois_nom", "trimestre", "jour")
        .agg(F.count(F.lit(1)).alias("nb_annonces"))
    ),
    "coerce_required": _coerced,
    "dedup_daily": _of(
        lambda t: t.analytics.select(
            "magasin_standardise", "jour", "cle_matching_exacte", "prix", "url_produit",
            "nom_produit", "categorie_standardisee",
        )
    ),
    "analytics": _of(lambda t: cleaning.analytics_sorted(t.analytics)),
    "product_reference": _of(
        lambda t: cleaning.product_reference(t.analytics).orderBy(
            F.col("nb_magasins").desc(), "categorie_standardisee", "nom_reference"
        )
    ),
    "exact_price_panel": _of(lambda t: cleaning.exact_price_panel(t.analytics, STORES)),
    "distributions": _of(lambda t: cleaning.distributions(t.analytics)),
    # indicators
    "history": _of(lambda t: t.history),
    "comparable_price": _of(
        lambda t: kpi.comparable_price(t.history).select(
            "magasin_standardise", "jour", "cle_matching_exacte", "prix", "url_produit",
            "prix_comparable", "type_prix_comparable",
        )
    ),
    "reliable": _of(
        lambda t: kpi.reliable(t.history).select(
            "magasin_standardise", "jour", "cle_matching_exacte", "prix", "statut_comparabilite"
        )
    ),
    "daily_panel": _of(lambda t: kpi.daily_panel_rounded(t.panel)),
    "variation_index": _of(lambda t: kpi.variation_index(t.prices)),
    "competitiveness": _of(lambda t: t.competition),
    "fluctuation": _of(lambda t: kpi.fluctuation_sorted(kpi.fluctuation(t.prices))),
    "inflation_category": _of(lambda t: kpi.inflation_category(t.prices)),
    "inflation_global": _of(lambda t: kpi.inflation_global(t.prices)),
    "category_store_score": _of(lambda t: kpi.category_store_score(t.prices)),
    "context_table": _of(lambda t: t.context),
    "kpi_summary": _of(_kpi_summary),
    "quality_report": _of(lambda t: kpi.quality_report(t.history, t.panel)),
    # comparison
    "serving_prices": _of(
        lambda t: t.serving.select(
            "magasin_standardise", "jour", "cle_matching_exacte", "url_produit", "prix",
            "nom_produit", "quantite_standardisee", "unite_reference", "prix_affiche",
            "prix_normalise",
        )
    ),
    "serving_panel": _serving_panel,
    "filter_selection": _of(
        lambda t: compare.filter_selection(
            t.serving, ("ASIA", "EUROPE"), ("PROMO", "SMALL")
        ).select("magasin_standardise", "categorie_standardisee", "jour", "nom_produit", "prix", "url_produit")
    ),
    "search_products": _of(
        lambda t: compare.search_products(t.serving, "PLATE.*(kg|cl)$").select(
            "nom_nettoye", "magasin_standardise", "jour", "prix", "url_produit"
        )
    ),
    "price_comparison": _of(lambda t: compare.comparison_rounded(t.comparison, STORES)),
    "full_coverage": _of(
        lambda t: compare.comparison_rounded(
            compare.full_coverage(
                compare.price_comparison(t.serving, ("ASIA", "EUROPE")), ("ASIA", "EUROPE")
            ),
            ("ASIA", "EUROPE"),
        )
    ),
    "head_to_head": _of(lambda t: compare.head_to_head(t.comparison, STORES)),
    "category_scorecard": _of(
        lambda t: compare.scorecard_sorted(compare.category_scorecard(t.comparison, STORES))
    ),
    "best_store_by_category": _of(
        lambda t: compare.best_store_by_category(compare.category_scorecard(t.comparison, STORES))
    ),
    "store_gap": _of(
        lambda t: compare.store_gap(t.comparison, FOCUS_STORE).select(
            "jour", "categorie_standardisee", "cle_matching_exacte", "nom_produit",
            "magasin_moins_cher",
            half_up(F.col("surcout_vs_min_fcfa"), 6).alias("surcout_vs_min_fcfa"),
            half_up(F.col("surcout_vs_min_pct"), 6).alias("surcout_vs_min_pct"),
        )
    ),
    "store_gap_metrics": _of(
        lambda t: compare.store_gap_metrics(compare.store_gap(t.comparison, FOCUS_STORE))
    ),
    "winner_histogram": _of(lambda t: compare.winner_histogram(t.comparison)),
    "top_gaps": _of(
        lambda t: compare.top_gaps(t.comparison).select(
            "jour", "categorie_standardisee", "cle_matching_exacte", "nom_produit",
            half_up(F.col("ecart_fcfa"), 6).alias("ecart_fcfa"),
            half_up(F.col("ecart_pct"), 6).alias("ecart_pct"),
        )
    ),
    "top_store_gaps": _of(
        lambda t: compare.top_store_gaps(compare.store_gap(t.comparison, FOCUS_STORE)).select(
            "jour", "categorie_standardisee", "cle_matching_exacte", "nom_produit",
            half_up(F.col("surcout_vs_min_fcfa"), 6).alias("surcout_vs_min_fcfa"),
        )
    ),
    "display_format": _of(lambda t: compare.product_texts(t.comparison, STORES)),
    "heatmap": _of(lambda t: compare.heatmap(t.context, STORES)),
    "dispersion": _of(lambda t: compare.dispersion(t.serving, STORES)),
    "category_order": _of(
        lambda t: compare.category_order(compare.dispersion(t.serving, STORES))
    ),
    "dispersion_verdict": _of(
        lambda t: compare.dispersion_verdict(compare.dispersion(t.serving, STORES))
    ),
    "context_metrics": _of(lambda t: compare.context_metrics(t.context, STORES)),
    "confidence_counts": _of(lambda t: compare.confidence_counts(t.context, STORES)),
    "overview": _of(lambda t: compare.overview(t.serving, t.panel, t.competition, STORES)),
    "quality_view": _of(lambda t: compare.quality_view(t.serving, t.panel, STORES)),
    "status_counts": _of(lambda t: compare.status_counts(t.serving)),
    "review_reasons": _of(lambda t: compare.review_reasons(t.serving)),
    "latest_ranking": _of(lambda t: compare.latest_ranking(t.competition, STORES)),
    "avg_price": _of(lambda t: compare.avg_price(t.serving)),
    "inflation_pivot": _of(
        lambda t: compare.inflation_pivot(kpi.inflation_category(t.prices), CATEGORIES)
    ),
    "latest_inflation": _of(lambda t: compare.latest_inflation(kpi.inflation_global(t.prices))),
    "data_warnings": _of(
        lambda t: compare.data_warnings(
            t.comparison, kpi.fluctuation(t.prices), kpi.variation_index(t.prices)
        )
    ),
}
