"""Listings read from a sales star schema (line items, parts, suppliers, regions).

A line item becomes one shelf listing: the part is the product, the supplier's
region the shop, the ship week the snapshot.  The joins are plain; Spark
broadcasts a dimension only when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STORES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SIZES = ("500g", "1,5L", "6x33cl", "Boîte de 1 kg", "12 pieces", "", "33cl x 6", "SACHET 250 gr")

# Pages of one crawl of a shop's category, and orders that make up the crawl.
PAGES_PER_CRAWL = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def product_name() -> Column:
    sizes = F.array(*[F.lit(s) for s in SIZES])
    return F.concat(F.col("p_name"), F.lit(" "), F.get(sizes, F.col("p_size") % len(SIZES)))


def as_listings(spark: SparkSession, sf_dir: str, lineitem: DataFrame) -> DataFrame:
    """Raw listings of the given line items, batch or stream."""
    return (
        lineitem.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            product_name().alias("nom_produit"),
            F.col("p_type").alias("categorie"),
            F.col("l_extendedprice").alias("prix"),
            F.col("r_name").alias("magasin"),
            F.date_trunc("week", F.col("l_shipdate")).cast("date").alias("date_scraping"),
            F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url_produit"),
        )
    )


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_listings(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def _thousands(value: Column) -> Column:
    return F.replace(F.format_number(value, 0), F.lit(","), F.lit(" "))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled listing pages: an order is a page, eight consecutive orders a crawl.

    A page holds an order's few lines, and a crawl a few orders.
    Some pages are served under another number, some are the last one, some
    have no card, and some price labels state no price or too low a one.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(
            F.lit("rayon-"), F.floor(F.col("o_orderkey") / (3 * PAGES_PER_CRAWL)).cast("string")
        ).alias("category"),
        (F.col("o_orderkey") % PAGES_PER_CRAWL + 1).cast("bigint").alias("page_no"),
        F.expr("CASE floor(o_orderkey / 8) % 3 WHEN 0 THEN 'Auchan' WHEN 1 THEN 'Sakanal' ELSE 'Diarle' END").alias("magasin"),
        F.expr("bigint(CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE o_orderkey % 8 + 1 END)").alias("served_page"),
        F.expr("o_orderkey % 8 <> 7 AND o_orderkey % 41 <> 0").alias("has_next"),
    )
    price = (
        F.when(F.col("l_orderkey") % 13 == 0, F.lit("2 000 F"))
        .when(F.col("l_quantity") < 8, F.concat((F.col("l_quantity") * 15).cast("bigint").cast("string"), F.lit(" CFA")))
        .otherwise(F.concat(_thousands(F.col("l_extendedprice").cast("bigint")), F.lit(" FCFA")))
    )
    within = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey",
            F.row_number().over(within).cast("bigint").alias("pos"),
            product_name().alias("name"),
            F.concat(F.lit("/c/"), F.lower("p_type")).alias("href"),
            price.alias("price_text"),
        )
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop(
        "o_orderkey", "l_orderkey"
    )


def _pages(spark: SparkSession, sf_dir: str, card: Column, pager: Column) -> DataFrame:
    """Pages of the listing as markup, each put together from its own few cards."""
    paged = listing(spark, sf_dir).groupBy(
        "category", "page_no", "magasin", "served_page", "has_next"
    ).agg(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", card.alias("c"))))),
            lambda x: x.c,
        ).alias("_cartes")
    )
    return paged.select(
        "category",
        "page_no",
        "magasin",
        F.concat(F.lit("<html><body>"), F.array_join("_cartes", "\n"), pager, F.lit("</body></html>")).alias("html"),
    )


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as markup, all cards and pagers of one shape."""
    card = F.concat(
        F.lit('<article class="product-miniature"><h2 class="title"><a href="'),
        F.col("href"),
        F.lit('">'),
        F.replace(F.col("name"), F.lit(" "), F.lit("  ")),
        F.lit("</a></h2>\n<span class=\"unit\">1 000 FCFA / KG</span><span class=\"price\">"),
        F.col("price_text"),
        F.lit("</span></article>"),
    )
    pager = F.concat(
        F.lit('<ul class="pagination"><li class="current"><a href="?page='),
        F.col("served_page").cast("string"),
        F.lit('">'),
        F.col("served_page").cast("string"),
        F.lit("</a></li>"),
        F.when(F.col("has_next"), F.lit('<li class="next"><a href="?page=n">Suivant</a></li>')).otherwise(
            F.lit('<li class="next disabled"><span>Suivant</span></li>')
        ),
        F.lit("</ul>"),
    )
    return _pages(spark, sf_dir, card, pager)


def mixed_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages in four shapes by page number.

    Article cards; block cards with prices of something else behind them; item cards whose heading holds two
    links; headings without cards.  Pagers with a link, with a slide marked active before them, with another active
    item before them, and with the current item outside the pager beside links that only sound like next.
    """
    shape = F.col("page_no") % 4
    heading = F.concat(
        F.lit("<h2 class='t'><a href='"), F.col("href"), F.lit("'>"), F.replace(F.col("name"), F.lit(" "), F.lit("&nbsp; ")), F.lit("</a>")
    )
    prices = F.concat(
        F.lit('</h2>\n<!-- 9 FCFA --><br><span class="unit">1 000 <i>FCFA</i> / KG</span><span class="price"><b>'), F.col("price_text"), F.lit("</b></span>")
    )
    card = F.concat(
        F.when(shape == 0, F.lit('<article class="product-miniature">'))
        .when(shape == 1, F.lit('<div class="x product-miniature" data-note="a > b">'))
        .when(shape == 2, F.lit('<li class="js-product-miniature">'))
        .otherwise(F.lit("")),
        heading,
        F.when(shape == 2, F.lit('<a href="#avis">avis</a>')).otherwise(F.lit("")),
        prices,
        F.when(shape == 0, F.lit("</article>"))
        .when(shape == 1, F.lit("</div><p>pied: 500 FCFA</p>"))
        .when(shape == 2, F.lit("</li><li>500 FCFA</li>"))
        .otherwise(F.lit("")),
    )
    number, more = F.col("served_page").cast("string"), F.col("has_next")

    def if_more(markup: str, else_markup: str = "") -> Column:
        return F.when(more, F.lit(markup)).otherwise(F.lit(else_markup))

    pager = (
        F.when(
            shape == 0,
            F.concat(F.lit('<nav class="pagination"><span class="current"><a href="?page=1">'), number, F.lit("</a></span>"),
                     if_more('<span class="next"><a href="?p=n">&gt;</a></span>', '<span class="next disabled"><a href="?p=n">&gt;</a></span>'), F.lit("</nav>")),
        )
        .when(
            shape == 1,
            F.concat(F.lit('<div class="slide active">5 offres</div><ul class="pagination"><li class="active"><a>'), number, F.lit("</a></li>"),
                     if_more('<li class="next"><span><a href="#">&gt;</a></span></li>'), F.lit("</ul>")),
        )
        .when(
            shape == 2,
            F.concat(F.lit('<ul><li class="active">Accueil</li></ul><div class="pagination"><p class="active"><span> page </span>'), number, F.lit("</p></div>"),
                     if_more('<a rel="next" href="/n">n</a>', '<a rel="nextgen" href="/n">n</a>')),
        )
        .otherwise(
            F.concat(F.lit('<li class="active"><a>promo</a></li><li class="current">'), number, F.lit('</li><a href="/x?page=2">nextgen phones</a>'),
                     if_more('<ul><li><a class="btn" href="?page=n">page suivante</a></li></ul>', '<ul><li><a href="?p=n">suivante</a></li></ul>')),
        )
    )
    return _pages(spark, sf_dir, card, pager)
