import difflib
import json
import random

from pyspark.sql import functions as F

from etalage.functions.similarity import matching_ratio, shared_characters_ratio
from etalage.plans import messages

LABELS = ["Boissons", "Epicerie", "Produits Locaux", "Bebe & Puériculture"]


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_categories(spark):
    df = table(
        spark, "Quelles boissons et EPICERIE ?", "un drink local", "des produits pour bébé", None, "bebe"
    )
    got = {r.i: r.categories for r in messages.message_categories(df, LABELS).collect()}
    assert got[0] == ["Boissons", "Epicerie"]
    assert got[1] == ["Boissons", "Produits Locaux"]
    # accented letters vanish in the normalised text, so these never match
    assert got[2] == [] and got[4] == []
    assert got[3] == []


def test_suggestions(spark):
    df = table(spark, "boison", "je veux epiceri", "xyz", "boissons")
    got = {r.i: r.suggestions for r in messages.category_suggestions(df, LABELS).collect()}
    assert got[0][0] == "Boissons" and got[1][0] == "Epicerie" and got[2] == []
    assert 3 not in got


def _suggested(texts, labels):
    names = {messages.normalized_label(label): label for label in labels}
    out = []
    for text in texts:
        said = messages.normalized_label(text)
        want = difflib.get_close_matches(said, list(names), n=6, cutoff=0.35)
        for word in [] if want else said.split():
            want = difflib.get_close_matches(word, list(names), n=3, cutoff=0.6)
            if want:
                break
        out.append([names[w] for w in want])
    return out


def test_suggestions_equal_a_plain_matcher(spark):
    texts = ["boison", "je veux epiceri pas cher", "xyz", "produit", "", "locau produi", "puericulteur bbe", "frai", "???", "abcabc cabcab"]
    texts += ["hygienne et boite " * 14, "zq " * 80 + "locaux"]
    labels = [*LABELS, "abcab", "cabca", "Produits Frais", "produits frais", "Hygiene et boites " * 4 + "de toutes sortes", "b", "boissons"]
    untagged = [t for t in texts if not any(messages.normalized_label(x) in messages.normalized_label(t) for x in labels)]
    for given in (labels, spark.createDataFrame([(x,) for x in labels], "label string")):
        got = {r.text: r.suggestions for r in messages.category_suggestions(table(spark, *texts), given, {}).collect()}
        assert [got[t] for t in untagged] == _suggested(untagged, labels)
        assert set(got) == set(untagged)


def test_matching_size_equals_a_plain_matcher(spark):
    chance = random.Random(11)
    pairs = [("", ""), ("", "a"), ("abcd", "bcde"), ("aXbXc", "abc"), ("xaxa", "axax")]
    pairs += [tuple("".join(chance.choices("abc d", k=chance.randrange(0, 14))) for _ in range(2)) for _ in range(60)]
    pairs += [("ab cd" * 12 + "xyz", "".join(chance.choices("abcd ", k=230)) + "xyz"), ("aaa" * 20, "a" * 300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", matching_ratio(F.col("a"), F.col("b")).alias("r"), shared_characters_ratio(F.col("a"), F.col("b")).alias("q")).collect():
        assert r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio() <= r.q + 1e-12, (r.a, r.b)


def test_an_index_of_labels_tags_like_the_list(spark):
    labels = [*LABELS, "a", "&", "ép", "Produits  locaux", "ici et la"]
    df = table(spark, "Quelles boissons et EPICERIE ?", "un drink local", None, "", "ici et la & co", "xici et lax", "produits locaux locaux")
    short = {r.i: r.categories for r in messages.message_categories(df, labels).collect()}
    index = {r.i: r.categories for r in messages.message_labels(df, labels).collect()}
    assert index == short and index[5][0] == "ici et la" or "ici et la" in index[5]
    aliases = spark.createDataFrame([("boissons", "drink"), ("Epicerie", "grocery")], "canonical string, alias string")
    many = spark.createDataFrame([(f"etiquette {k}",) for k in range(3_000)] + [("Boissons",), ("Boissons",), (None,)], "label string")
    found = messages.message_labels(table(spark, "drink etiquette 17", "etiquette 2999"), many, aliases)
    got = {r.i: r.categories for r in found.collect()}
    assert got == {0: ["etiquette 1", "etiquette 17", "Boissons"], 1: ["etiquette 2", "etiquette 29", "etiquette 299", "etiquette 2999"]}
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_messages_do_not_travel_with_their_grams(spark, tmp_path):
    labels = spark.createDataFrame([(w,) for w in ("lait", "riz", "&", "pain complet", "lait entier", "absent")], "label string")
    df = table(spark, "du LAIT entier et du riz & du pain complet", "lait", "pain", None, "riz au lait " * 400)
    phrases = messages.label_phrases(spark, labels, {"riz": ["au l", "basmati"]}).localCheckpoint()
    sent = messages.tagged_messages(df, phrases)
    shuffled = messages.tagged_messages(df, phrases, sent_bytes=0)
    want = {
        "du lait entier et du riz & du pain complet": ["&", "lait", "lait entier", "pain complet", "riz"],
        "lait": ["lait"],
        ("riz au lait " * 400).strip(): ["lait", "riz"],
    }
    for found in (sent, shuffled):
        assert {r._message: r.categories for r in found.collect()} == want
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    # three sizes of grams occur; a message's grams are cut in one pass each
    assert sorted(r[0] for r in phrases.selectExpr("length(gram)").distinct().collect()) == [1, 3, 4]


def test_intents(spark):
    df = table(spark, "Bonjour !", "bonjour je cherche du riz", "Quel magasin est le moins cher", "")
    got = [(r.salutation, r.conseil_general) for r in messages.message_intents(df).orderBy("i").collect()]
    assert got == [(True, False), (False, False), (False, True), (False, False)]


def test_replies(spark):
    good = json.dumps(
        {
            "categorie": "Epicerie",
            "magasins": ["A", "B"],
            "recommandation": {"magasin": "A", "indice_categorie_base_100": 90.5, "nb_produits": 3},
            "sources": [{"magasin": "A", "nb_produits": 3}, {"magasin": "B", "nb_produits": 4}],
        }
    )
    df = table(spark, good, "Je ne sais pas.", '{"categorie": "x"', json.dumps({"categorie": "y"}))
    rows = messages.parse_reply(df, "text").collect()
    first = sorted((r.source_magasin, r.source_nb_produits) for r in rows if r.i == 0)
    assert first == [("A", 3), ("B", 4)]
    assert {r.indice_recommande for r in rows if r.i == 0} == {90.5}
    assert [r.texte_brut for r in rows if r.i == 1] == ["Je ne sais pas."]
    assert [r.categorie for r in rows if r.i == 2] == [None]
    assert [(r.categorie, r.texte_brut) for r in rows if r.i == 3] == [("y", None)]


def test_advice_and_payload(spark):
    columns = (
        "niveau_comparaison string, categorie_standardisee string, magasin_standardise string, "
        "nb_produits bigint, couverture_categorie_pct double, indice_categorie_base_100 double, "
        "score_confiance string, note_methodologique string"
    )
    rows = [
        ("categorie", "E", "B", 3, 50.0, 110.0, "faible", "n"),
        ("categorie", "E", "A", 4, 60.0, 90.0, "faible", "n"),
    ]
    context = spark.createDataFrame(rows, columns)
    best = messages.recommend_store(context).first()
    assert (best.magasin, best.ecart_indice_vs_max) == ("A", 20.0)
    payload = json.loads(messages.context_payload(context, ["A", "B"]).first().contexte_json)
    assert [p["magasin_standardise"] for p in payload] == ["A", "B"] and len(payload[0]) == 8
    entries = messages.payload_rows(messages.context_payload(context, ["A", "B"])).collect()
    assert [(r.position, r.magasin_standardise, r.nb_produits) for r in entries] == [(1, "A", 4), (2, "B", 3)]
