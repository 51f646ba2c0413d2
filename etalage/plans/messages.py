"""Message analytics: categories named in a message, intents, and advice from the context table.

A short list of labels is a parameter: tagging is a set of column expressions over each message, no
join, no shuffle.  A label dimension of any size is a table: its names and aliases are filed by a gram.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage import vocab
from etalage.functions.numbers import half_up
from etalage.functions.similarity import matching_ratio, shared_characters_ratio
from etalage.functions.text import normalize_message
from etalage.plans.compare import filter_selection

#: Label lists up to this length are tested in place, longer ones and tables through an index of grams.
IN_PLACE, GRAM = 64, 4
#: An index up to this size goes to the messages, beside a larger one the messages' grams are shuffled.
SENT_BYTES = 16 << 20
# How many labels are suggested, and how similar they are at least.
SUGGESTED, SIMILAR = 6, 0.35
SUGGESTED_BY_WORD, SIMILAR_WORD = 3, 0.6

_PAYLOAD_NUMBERS = {
    "nb_produits": T.LongType(),
    "couverture_categorie_pct": T.DoubleType(),
    "indice_categorie_base_100": T.DoubleType(),
}
PAYLOAD = T.StructType(
    [T.StructField(c, _PAYLOAD_NUMBERS.get(c, T.StringType())) for c in vocab.PAYLOAD_COLUMNS]
)
REPLY = T.StructType(
    [
        T.StructField("categorie", T.StringType()),
        T.StructField("magasins", T.ArrayType(T.StringType())),
        T.StructField(
            "recommandation",
            T.StructType(
                [
                    T.StructField("magasin", T.StringType()),
                    T.StructField("indice_categorie_base_100", T.DoubleType()),
                    T.StructField("nb_produits", T.LongType()),
                    T.StructField("couverture_categorie_pct", T.DoubleType()),
                    T.StructField("score_confiance", T.StringType()),
                    T.StructField("note_methodologique", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "comparaison", T.StructType([T.StructField("ecart_indice_vs_max", T.DoubleType())])
        ),
        T.StructField("reponse_courte", T.StringType()),
        T.StructField(
            "sources",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("magasin", T.StringType()),
                        T.StructField("indice_categorie_base_100", T.DoubleType()),
                        T.StructField("nb_produits", T.LongType()),
                        T.StructField("couverture_categorie_pct", T.DoubleType()),
                        T.StructField("score_confiance", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("_illisible", T.StringType()),
    ]
)


def normalized_label(label: str) -> str:
    """The message normalisation, for a label known when the plan is built."""
    spaced = re.sub(r"[^a-z0-9\s&+-]", " ", label.strip().lower())
    return " ".join(spaced.split())


def _hits(label_tests: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in label_tests]))


def message_categories(
    messages: DataFrame,
    labels: Sequence[str],
    aliases: Mapping[str, Sequence[str]] = vocab.CATEGORY_ALIASES,
) -> DataFrame:
    """Labels a message names, first by the label itself, then by one of its aliases."""
    said = F.col("_message")
    direct, indirect = [], []
    for label in labels:
        if normalized_label(label):
            direct.append((said.contains(normalized_label(label)), label))
    for canonical, words in aliases.items():
        test = F.lit(False)
        for word in words:
            test = test | said.contains(word)
        for label in labels:
            if normalized_label(label) == normalized_label(canonical):
                indirect.append((test, label))
    found = F.concat(_hits(direct), _hits(indirect)) if indirect else _hits(direct)
    return messages.withColumn("_message", normalize_message(F.col("text"))).withColumn(
        "categories", F.array_distinct(found)
    )


def label_table(spark: SparkSession, labels: Sequence[str] | DataFrame) -> DataFrame:
    """(place, label, name): the labels in their order with their normalised names.

    A table has its labels in the column ``label``; their order is that of the texts.
    """
    if isinstance(labels, DataFrame):
        order = F.col("label").alias("place")
        return labels.select("label", order).distinct().select("place", "label", normalize_message(F.col("label")).alias("name"))
    rows = [(f"{k:09d}", label) for k, label in enumerate(labels)]
    return spark.createDataFrame(rows, "place string, label string").withColumn("name", normalize_message(F.col("label")))


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(size))))


def label_phrases(
    spark: SparkSession,
    labels: Sequence[str] | DataFrame,
    aliases: Mapping[str, Sequence[str]] | DataFrame = vocab.CATEGORY_ALIASES,
) -> DataFrame:
    """(phrase, gram, kind, alias_place, place, label): the inverted index of all that names a label.

    A label is named by its own name or by an alias of it.  A phrase is filed under one of its
    grams of four characters, the whole phrase if it is shorter: a message without that gram cannot
    hold the phrase.  Aliases are a mapping or a table (canonical, alias).
    """
    named = label_table(spark, labels).where("name <> ''")
    if not isinstance(aliases, DataFrame):
        rows = [(f"{k:09d}", c, word) for k, (c, words) in enumerate(aliases.items()) for word in words]
        aliases = spark.createDataFrame(rows, "alias_place string, canonical string, alias string")
    else:
        aliases = aliases.select(F.col("canonical").alias("alias_place"), "canonical", "alias")
    own = named.select(F.col("name").alias("phrase"), F.lit(0).alias("kind"), F.lit("").alias("alias_place"), "place", "label")
    other = aliases.where("alias <> ''").join(named, normalize_message(F.col("canonical")) == F.col("name")).select(
        F.col("alias").alias("phrase"), F.lit(1).alias("kind"), "alias_place", "place", "label"
    )
    # of a phrase's grams the one with the least hash: frequent beginnings are not all filed together
    grams = F.transform(_grams(F.col("phrase"), GRAM), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))
    return own.union(other).withColumn("gram", F.array_min(grams)["g"])


def _grams_of_messages(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct grams of normalised texts, whose characters are single bytes, in one pass for each size."""
    cut = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sizes]
    return F.array_distinct(F.concat(*cut)) if cut else F.array().cast("array<string>")


def tagged_messages(messages: DataFrame, phrases: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(_message, categories) of the distinct normalised messages that name a label.

    Grams of the messages meet the phrases filed under them, then the whole phrase is looked for.  An index that is
    small when counted is broadcast, so that no gram is shuffled; beside a larger one a gram carries
    the hash of its message only, and the texts meet the phrases that are left.
    """
    said = messages.select(normalize_message(F.col("text")).alias("_message")).distinct()
    row = reduce(lambda a, b: a + b, [F.octet_length(F.coalesce(c, F.lit(""))) for c in phrases.columns if c != "kind"]) + 64
    size, sizes = phrases.agg(F.coalesce(F.sum(row), F.lit(0)), F.collect_set(F.length("gram"))).first()
    grams = F.explode(_grams_of_messages(F.col("_message"), sorted(sizes))).alias("gram")
    if size <= sent_bytes:
        named = said.select("_message", grams).join(F.broadcast(phrases), "gram")
    else:
        hashed = said.select(F.xxhash64("_message").alias("_hash"), "_message")
        named = hashed.select("_hash", grams).join(phrases, "gram").drop("gram").join(hashed, "_hash")
    met = named.where(F.col("_message").contains(F.col("phrase")))
    found = F.sort_array(F.collect_set(F.struct("kind", "alias_place", "place", "label")))
    return met.groupBy("_message").agg(F.array_distinct(F.transform(found, lambda x: x["label"])).alias("categories"))


def message_labels(
    messages: DataFrame,
    labels: Sequence[str] | DataFrame,
    aliases: Mapping[str, Sequence[str]] | DataFrame = vocab.CATEGORY_ALIASES,
) -> DataFrame:
    """``message_categories`` for a label dimension of any size: the plan does not grow with it."""
    tagged = tagged_messages(messages, label_phrases(messages.sparkSession, labels, aliases))
    return (
        messages.withColumn("_message", normalize_message(F.col("text")))
        .join(tagged, "_message", "left")
        .withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    )


def _tagged(
    messages: DataFrame, labels: Sequence[str] | DataFrame, aliases: Mapping[str, Sequence[str]] | DataFrame
) -> DataFrame:
    """Short lists are tested in place, without a shuffle; tables and long lists are joined."""
    if isinstance(labels, DataFrame) or isinstance(aliases, DataFrame) or len(labels) > IN_PLACE:
        return message_labels(messages, labels, aliases)
    return message_categories(messages, labels, aliases)


def similar_labels(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, whole, suggestions): the labels most similar to each text, best first, ties by later name.

    ``texts`` has distinct (text, whole); a whole message takes six labels of a ratio of 0.35, a word three
    of 0.6.  A ratio needs lengths that are not too different: each label is listed under the lengths it can
    match, and texts meet the labels listed under theirs.  Of those, pairs without enough characters in
    common are left out before blocks are matched.
    """
    floors = {True: (SIMILAR, SUGGESTED), False: (SIMILAR_WORD, SUGGESTED_BY_WORD)}
    size = F.length("name").cast("double")
    listed = None
    for whole, (floor, _) in floors.items():
        least = F.greatest(F.floor(size * floor / (2 - floor)).cast("int"), F.lit(0))
        most = F.ceil(size * (2 - floor) / floor).cast("int")
        part = labels.withColumns({"whole": F.lit(whole), "size": F.explode(F.sequence(least, most))})
        listed = part if listed is None else listed.union(part)
    floor = F.when(F.col("whole"), F.lit(SIMILAR)).otherwise(F.lit(SIMILAR_WORD))
    top = F.when(F.col("whole"), F.lit(SUGGESTED)).otherwise(F.lit(SUGGESTED_BY_WORD))
    best = Window.partitionBy("text", "whole").orderBy(F.col("ratio").desc(), F.col("name").desc())
    return (
        texts.withColumn("size", F.length("text"))
        .join(listed, ["whole", "size"])
        .where(shared_characters_ratio(F.col("name"), F.col("text")) >= floor)
        .withColumn("ratio", matching_ratio(F.col("name"), F.col("text")))
        .where(F.col("ratio") >= floor)
        .withColumn("_rang", F.row_number().over(best))
        .where((F.col("_rang") <= SUGGESTED) & (F.col("_rang") <= top))
        .groupBy("text", "whole")
        .agg(F.sort_array(F.collect_list(F.struct("_rang", "label"))).alias("_l"))
        .select("text", "whole", F.array_distinct(F.transform("_l", lambda x: x["label"])).alias("suggestions"))
    )


def category_suggestions(
    messages: DataFrame,
    labels: Sequence[str] | DataFrame,
    aliases: Mapping[str, Sequence[str]] | DataFrame = vocab.CATEGORY_ALIASES,
) -> DataFrame:
    """Labels close to an untagged message, else close to its first word that has any.

    Similarity is the ratio of matching blocks.  It is computed once per distinct message and word.
    Of labels with one normalised name the last counts.
    """
    spark = messages.sparkSession
    untagged = _tagged(messages, labels, aliases).where(F.size("categories") == 0)
    names = label_table(spark, labels).groupBy("name").agg(F.max_by("label", "place").alias("label"))
    said = F.col("_message")
    words = F.filter(F.split(said, " "), lambda w: w != "")
    places = F.concat(
        F.array(F.struct(said.alias("text"), F.lit(True).alias("whole"))),
        F.transform(words, lambda w: F.struct(w.alias("text"), F.lit(False).alias("whole"))),
    )
    pieces = untagged.select("_message").distinct().select("_message", F.posexplode(places).alias("_place", "_p")).select("_message", "_place", "_p.*")
    similar = similar_labels(pieces.select("text", "whole").distinct(), names)
    first = pieces.join(similar, ["text", "whole"]).groupBy("_message").agg(F.min_by("suggestions", "_place").alias("suggestions"))
    return untagged.join(first, "_message", "left").withColumn(
        "suggestions", F.coalesce("suggestions", F.array().cast("array<string>"))
    )


def message_intents(
    messages: DataFrame,
    greetings: Sequence[str] = vocab.GREETINGS,
    advice: Sequence[str] = vocab.ADVICE_PHRASES,
) -> DataFrame:
    """Is it a greeting of at most three words, and does it ask for general advice?"""
    said = F.col("_message")

    def says(phrases: Sequence[str]) -> Column:
        test = F.lit(False)
        for phrase in phrases:
            test = test | said.contains(phrase)
        return test

    words = F.when(said == "", F.lit(0)).otherwise(F.size(F.split(said, " ")))
    return (
        messages.withColumn("_message", normalize_message(F.col("text")))
        .withColumns(
            {"salutation": says(greetings) & (words <= 3), "conseil_general": says(advice)}
        )
        .drop("_message")
    )


# --- context and advice ------------------------------------------------------


def context_payload(
    context: DataFrame, stores: Sequence[str], categories: Sequence[str] = ()
) -> DataFrame:
    """The selected context rows as one JSON array per category: one entry per shop."""
    rows = F.sort_array(
        F.collect_list(F.struct("magasin_standardise", F.struct(*vocab.PAYLOAD_COLUMNS).alias("p")))
    )
    return (
        filter_selection(context, stores, categories)
        .groupBy("categorie_standardisee")
        .agg(F.to_json(F.transform(rows, lambda r: r.p)).alias("contexte_json"))
    )


def payload_rows(payload: DataFrame) -> DataFrame:
    """The entries of the payloads as typed rows, numbered from 1 within their array."""
    entries = F.from_json("contexte_json", T.ArrayType(PAYLOAD))
    return payload.select(F.posexplode(entries).alias("_pos", "_p")).select(
        "_p.*", (F.col("_pos") + 1).cast("bigint").alias("position")
    )


def recommend_store(context: DataFrame) -> DataFrame:
    """Per category the shop with the lowest index, and how far the highest is from it."""
    index = F.col("indice_categorie_base_100")
    best = F.struct(
        index.alias("indice"),
        "magasin_standardise",
        "nb_produits",
        "couverture_categorie_pct",
        "score_confiance",
        "note_methodologique",
    )
    return (
        context.groupBy("categorie_standardisee")
        .agg(F.min(F.when(index.isNotNull(), best)).alias("_m"), F.max(index).alias("_haut"))
        .select(
            "categorie_standardisee",
            F.col("_m.magasin_standardise").alias("magasin"),
            F.col("_m.indice").alias("indice_categorie_base_100"),
            F.col("_m.nb_produits").alias("nb_produits"),
            F.col("_m.couverture_categorie_pct").alias("couverture_categorie_pct"),
            F.col("_m.score_confiance").alias("score_confiance"),
            F.col("_m.note_methodologique").alias("note_methodologique"),
            half_up(F.col("_haut") - F.col("_m.indice"), 6).alias("ecart_indice_vs_max"),
        )
    )


def as_replies(context: DataFrame) -> DataFrame:
    """A well-formed reply per category, as the assistant is asked to write it."""
    sources = context.groupBy("categorie_standardisee").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("magasin_standardise").alias("magasin"),
                    "indice_categorie_base_100",
                    "nb_produits",
                    "couverture_categorie_pct",
                    "score_confiance",
                )
            )
        ).alias("sources")
    )
    reply = F.struct(
        F.col("categorie_standardisee").alias("categorie"),
        F.transform("sources", lambda s: s.magasin).alias("magasins"),
        F.struct(
            "magasin",
            "indice_categorie_base_100",
            "nb_produits",
            "couverture_categorie_pct",
            "score_confiance",
            "note_methodologique",
        ).alias("recommandation"),
        F.struct("ecart_indice_vs_max").alias("comparaison"),
        F.lit("").alias("reponse_courte"),
        "sources",
    )
    return (
        recommend_store(context)
        .join(sources, "categorie_standardisee")
        .select(F.to_json(reply).alias("reponse"))
    )


def parse_reply(replies: DataFrame, text: str) -> DataFrame:
    """Typed fields of strict JSON replies, one row per source; other text stays as it is."""
    others = [c for c in replies.columns if c != text]
    parsed = F.from_json(
        F.col(text), REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_illisible"}
    )
    return (
        replies.withColumn("_r", parsed)
        .withColumn("_lu", F.col("_r").isNotNull() & F.col("_r._illisible").isNull())
        .select(
            *others,
            F.when(~F.col("_lu"), F.col(text)).alias("texte_brut"),
            F.when(F.col("_lu"), F.col("_r")).alias("_r"),
        )
        .select("*", F.explode_outer("_r.sources").alias("_s"))
        .select(
            *others,
            "texte_brut",
            F.col("_r.categorie").alias("categorie"),
            F.array_join("_r.magasins", ", ").alias("magasins"),
            F.col("_r.recommandation.magasin").alias("magasin_recommande"),
            F.col("_r.recommandation.indice_categorie_base_100").alias("indice_recommande"),
            F.col("_r.recommandation.nb_produits").alias("nb_produits_recommande"),
            F.col("_r.comparaison.ecart_indice_vs_max").alias("ecart_indice_vs_max"),
            F.col("_r.reponse_courte").alias("reponse_courte"),
            F.col("_s.magasin").alias("source_magasin"),
            F.col("_s.indice_categorie_base_100").alias("source_indice"),
            F.col("_s.nb_produits").alias("source_nb_produits"),
            F.col("_s.couverture_categorie_pct").alias("source_couverture_pct"),
            F.col("_s.score_confiance").alias("source_confiance"),
        )
    )
