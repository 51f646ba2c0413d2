"""Fixed values.

Everything in this module is part of the result: word lists, label tables,
patterns, thresholds and output formats.  Changing one changes matching keys,
so they are kept together, as plain text, and nothing else lives here.
Patterns are Java regular expressions; ``(?U)`` makes ``\\s``, ``\\d`` and
``\\b`` cover the whole of Unicode.
"""

# --- columns -----------------------------------------------------------------

RAW_COLUMNS = ("nom_produit", "categorie", "prix", "magasin", "date_scraping", "url_produit")

ANALYTICS_COLUMNS = (
    "nom_produit", "nom_nettoye", "marque_probable", "categorie_standardisee",
    "magasin_standardise", "prix", "prix_par_kg_ou_l", "prix_par_piece", "pack_count",
    "quantite_par_pack", "unite_par_pack", "quantite_totale_reference", "unite_reference",
    "famille_unite", "quantite_standardisee", "cle_matching_large", "cle_matching_exacte",
    "qualite_matching", "score_matching", "type_prix_reference", "statut_comparabilite",
    "motif_comparabilite", "date_scraping", "annee", "mois", "mois_nom", "trimestre", "jour",
    "url_produit",
)

HISTORY_REQUIRED = (
    "nom_nettoye", "categorie_standardisee", "magasin_standardise", "prix", "prix_par_kg_ou_l",
    "prix_par_piece", "cle_matching_exacte", "date_scraping", "jour",
)

CONTEXT_COLUMNS = (
    "niveau_comparaison", "categorie_standardisee", "magasin_standardise", "nb_produits",
    "nb_observations", "prix_moyen", "prix_median", "prix_min", "prix_max",
    "part_produits_normalises", "nb_produits_categorie_total", "couverture_categorie_pct",
    "indice_categorie_base_100", "indicateur_principal", "score_confiance", "note_methodologique",
)

PAYLOAD_COLUMNS = (
    "niveau_comparaison", "categorie_standardisee", "magasin_standardise", "nb_produits",
    "couverture_categorie_pct", "indice_categorie_base_100", "score_confiance",
    "note_methodologique",
)

MART_TABLES = (
    "variation_index", "competitiveness", "fluctuation", "inflation_category", "inflation_global",
    "category_store_score", "ai_context", "summary", "daily_panel", "quality",
)

# Cell texts that a CSV round trip reads back as missing.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- words -------------------------------------------------------------------

PACKAGING_WORDS = (
    "auchan", "sakanal", "diarle", "pet", "brique", "bouteille", "sachet", "sachets", "boite",
    "boites", "carton", "canette", "canettes", "flacon", "pot", "format", "familial", "promo",
    "pack", "barquette", "poche", "etui", "stick", "sticks", "tube",
)

WEAK_WORDS = (
    "de", "du", "des", "la", "le", "les", "au", "aux", "a", "et", "en", "avec", "sans", "pour",
    "sur", "par", "the",
)

NOISE_PHRASES = (
    r"(?U)\blot\s+de\b",
    r"(?U)\bla\s+bouteille\s+de\b",
    r"(?U)\ble\s+flacon\s+de\b",
    r"(?U)\bla\s+boite\s+de\b",
    r"(?U)\ble\s+pot\s+de\b",
    r"(?U)\ble\s+sachet\s+de\b",
    r"(?U)\ble\s+pack\s+de\b",
)

# --- labels ------------------------------------------------------------------

CATEGORY_LABELS = {
    "epicerie": "Epicerie",
    "boissons": "Boissons",
    "hygiene & beaute": "Hygiene & Beaute",
    "produits locaux": "Produits Locaux",
    "fruits & legumes": "Fruits & Legumes",
}

STORE_LABELS = {"auchan": "Auchan", "sakanal": "Sakanal", "diarle": "Diarle"}

STORE_SITES = {
    "Auchan": "https://www.auchan.sn",
    "Sakanal": "https://sakanal.sn",
    "Diarle": "https://diarle.sn",
}

# Lowest shelf price that is still believed, in FCFA.
PRICE_FLOORS = {"Auchan": 50.0, "Sakanal": 100.0, "Diarle": 100.0}

# --- patterns ----------------------------------------------------------------

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE_WHITESPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
PUNCTUATION = r"""[,/\\|()\-+"'`’]"""

UNIT = "(kg|g|mg|l|cl|ml)"
NUMBER = r"(\d+(?:\.\d+)?)"

# Applied in this order to the lower-cased name.
QUANTITY_REWRITES = (
    (r"[\u202f\u00a0]", " "),
    (r"(?U)(?<=\d),(?=\d)", "."),
    (r"(?U)\b(\d+)\s*l\s*(\d+)\b", "$1.$2 l"),
    (rf"(?U)(?<=[a-z]){NUMBER}{UNIT}\b", " $1 $2"),
    (rf"(?U)\b{NUMBER}\s*{UNIT}\s*[xX]\s*(\d+)\b", "$3 x $1 $2"),
    (rf"(?U)\b{NUMBER}\s*litres?\b", "$1 l"),
    (rf"(?U)\b{NUMBER}\s*gr\b", "$1 g"),
    (rf"(?U)\b{NUMBER}\s*grammes?\b", "$1 g"),
    (rf"(?U)\b{NUMBER}\s*kilogrammes?\b", "$1 kg"),
)

PACK_QUANTITY = rf"(?U)\b(\d+)\s*[xX]\s*{NUMBER}\s*{UNIT}\b"
SINGLE_QUANTITY = rf"(?U)\b{NUMBER}\s*{UNIT}\b"
PIECE_COUNT = r"(?U)\b(\d+)\s*(pieces|piece|pcs|pc|unites?)\b"

PRICE_TEXT = r"(?iU)(\d[\d\s.,]*?)\s*(?:CFA|FCFA)"
PRICE_SEPARATORS = r"(?U)[\s.,]"

MESSAGE_NOISE = r"(?U)[^a-z0-9\s&+-]"

# --- units -------------------------------------------------------------------

# unit -> (family, reference unit, base units in one unit)
UNITS = {
    "mg": ("mass", "g", 0.001),
    "g": ("mass", "g", 1.0),
    "kg": ("mass", "g", 1000.0),
    "ml": ("volume", "ml", 1.0),
    "cl": ("volume", "ml", 10.0),
    "l": ("volume", "ml", 1000.0),
}

# --- statuses and notes ------------------------------------------------------

RELIABLE_STATUSES = ("comparable_normalise",)
PANEL_STATUSES = ("comparable_normalise", "comparable_brut")

HISTORY_DEFAULTS = {
    "statut_comparabilite": "a_revoir",
    "motif_comparabilite": "",
    "type_prix_reference": "raw_price",
}

CONFIDENCE_NOTES = {
    "eleve": "comparaison robuste (couverture et normalisation elevees)",
    "moyen": "comparaison exploitable avec prudence moderee",
    "faible": "comparaison a interpreter avec prudence (couverture faible ou echantillon limite)",
}

# --- messages ----------------------------------------------------------------

CATEGORY_ALIASES = {
    "epicerie": ("epicerie", "epiceries", "grocery"),
    "boissons": ("boisson", "boissons", "drink", "drinks"),
    "produits locaux": ("produits locaux", "local", "locaux"),
    "produits frais": ("produits frais", "frais", "fresh"),
    "fruits & legumes": ("fruits legumes", "fruits & legumes", "fruit", "legume", "legumes"),
    "hygiene & beaute": ("hygiene", "beaute", "hygiène", "beauty"),
    "bebe & puericulture": ("bebe", "bébé", "puericulture", "puériculture"),
}

GREETINGS = ("salut", "bonjour", "bonsoir", "hello", "yo", "cv", "ça va", "ca va", "slt")

ADVICE_PHRASES = (
    "quel magasin", "tu me conseilles", "le moins cher", "meilleur magasin", "recommande",
    "conseille", "ou acheter",
)

# The numeric columns of each mart table when it is served from text.
# Counts and ranks (nb_, rang_) are whole numbers, all others doubles.
_LEVELS = (
    "nb_produits", "nb_observations", "prix_moyen", "prix_median", "prix_min", "prix_max",
    "part_produits_normalises", "nb_produits_categorie_total", "couverture_categorie_pct",
    "indice_categorie_base_100",
)
_INFLATION = (
    "nb_observations", "prix_moyen", "prix_median", "inflation_mensuelle_pct", "indice_prix_base_100",
)
SERVING_NUMBERS = {
    "daily_panel": ("prix_obs", "nb_magasins_jour", "nb_types_prix_jour", "score_matching_moyen"),
    "category_store_score": _LEVELS,
    "competitiveness": (
        "nb_produits_comparables", "indice_competitivite_min", "indice_competitivite_moyenne",
        "ecart_moyen_vs_min_pct", "rang_competitivite",
    ),
    "variation_index": (
        "nb_observations", "prix_moyen", "prix_median", "variation_vs_mois_precedent_pct",
        "indice_base_100",
    ),
    "inflation_category": _INFLATION,
    "inflation_global": _INFLATION,
    "fluctuation": (
        "nb_jours", "prix_min", "prix_max", "prix_moyen", "prix_std", "amplitude_absolue",
        "amplitude_pct", "coefficient_variation_pct",
    ),
    "ai_context": (*_LEVELS, "indicateur_principal"),
    "quality": ("valeur",),
}
