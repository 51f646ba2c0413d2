"""The same results in plain SQL, for an engine that shares no code with the Spark plans.

Each query is a chain of common table expressions over the driver tables.  The
chain is cut after the last one a query needs.
"""

from __future__ import annotations

from etalage import vocab

UNIT = "(kg|g|mg|l|cl|ml)"
NUM = r"(\d+(?:\.\d+)?)"
STORES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PACKAGING, WEAK = vocab.PACKAGING_WORDS, vocab.WEAK_WORDS
PHRASES = (
    r"\blot\s+de\b", r"\bla\s+bouteille\s+de\b", r"\ble\s+flacon\s+de\b", r"\bla\s+boite\s+de\b",
    r"\ble\s+pot\s+de\b", r"\ble\s+sachet\s+de\b", r"\ble\s+pack\s+de\b",
)
NA = ", ".join(f"'{text}'" for text in vocab.NA_TEXTS)


def hu(x: str, places: int) -> str:
    f = f"1e{places}"
    return f"(floor(({x}) * {f} + 0.5) / {f})"


def r6(x: str) -> str:
    return hu(x, 6)


def mean(x: str) -> str:
    return f"(sum(cast(floor(({x}) * 1e6 + 0.5) as bigint))::double / count({x}) / 1e6)"


def replace_all(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"


def spelled(x: str) -> str:
    out = f"replace(replace(lower({x}), chr(8239), ' '), chr(160), ' ')"
    for p, r in (
        (r"(\d),(\d)", r"\1.\2"),
        (r"\b(\d+)\s*l\s*(\d+)\b", r"\1.\2 l"),
        (rf"([a-z]){NUM}{UNIT}\b", r"\1 \2 \3"),
        (rf"\b{NUM}\s*{UNIT}\s*[xX]\s*(\d+)\b", r"\3 x \1 \2"),
        (rf"\b{NUM}\s*litres?\b", r"\1 l"),
        (rf"\b{NUM}\s*gr\b", r"\1 g"),
        (rf"\b{NUM}\s*grammes?\b", r"\1 g"),
        (rf"\b{NUM}\s*kilogrammes?\b", r"\1 kg"),
    ):
        out = replace_all(out, p, r)
    return out


def tidy(x: str) -> str:
    return f"trim({replace_all(x, r'\s+', ' ')})"


def in_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def cleaned(x: str) -> str:
    out = f"strip_accents({spelled(x)})"
    for p in PHRASES:
        out = replace_all(out, p, " ")
    out = tidy(replace_all(out, r"""[,/\\|()\-+"''`’]""", " "))
    return (
        f"array_to_string(list_filter(string_split({out}, ' '), "
        f"lambda t: t NOT IN ({in_list(PACKAGING)})), ' ')"
    )


PACK = rf"\b(\d+)\s*[xX]\s*{NUM}\s*{UNIT}\b"
SINGLE = rf"\b{NUM}\s*{UNIT}\b"
COUNT = r"\b(\d+)\s*(pieces|piece|pcs|pc|unites?)\b"
FACTOR = (
    "(CASE unite WHEN 'mg' THEN 0.001::double WHEN 'g' THEN 1.0 WHEN 'kg' THEN 1000.0 "
    "WHEN 'ml' THEN 1.0 WHEN 'cl' THEN 10.0 WHEN 'l' THEN 1000.0 END)"
)
LABEL = (
    "(CASE WHEN total = floor(total) THEN cast(cast(total AS bigint) AS varchar) "
    "ELSE regexp_replace(printf('%.3f', total), '\\.?0+$', '') END)"
)

CTES: list[tuple[str, str]] = [
    (
        "raw",
        """
SELECT p_name || ' ' || CASE p_size % 8 WHEN 0 THEN '500g' WHEN 1 THEN '1,5L' WHEN 2 THEN '6x33cl'
         WHEN 3 THEN 'Boîte de 1 kg' WHEN 4 THEN '12 pieces' WHEN 5 THEN '' WHEN 6 THEN '33cl x 6'
         ELSE 'SACHET 250 gr' END AS nom_produit,
       p_type AS categorie, l_extendedprice AS prix, r_name AS magasin,
       cast(date_trunc('week', l_shipdate) AS date) AS date_scraping,
       '/p/' || cast(p_partkey AS varchar) AS url_produit
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    (
        "noms",
        f"SELECT nom_produit, {spelled('nom_produit')} AS epele, {cleaned('nom_produit')} AS nom_nettoye "
        "FROM (SELECT DISTINCT nom_produit FROM raw)",
    ),
    (
        "textes",
        f"SELECT *, strip_accents({spelled("nom_produit || ' ' || nom_nettoye")}) AS texte FROM noms",
    ),
    (
        "trouve",
        f"""
SELECT *, CASE WHEN regexp_matches(texte, '{PACK}') THEN regexp_extract(texte, '{PACK}', 0)
               ELSE coalesce(list_last(regexp_extract_all(texte, '{SINGLE}', 0)), '') END AS morceau,
       regexp_extract(texte, '{COUNT}', 1) AS pieces,
       list_sort(list_filter(string_split({tidy(replace_all(replace_all('nom_nettoye', SINGLE, ' '), COUNT, ' '))}, ' '),
         lambda t: t NOT IN ({in_list(WEAK)}) AND length(t) > 1)) AS jetons
FROM textes""",
    ),
    (
        "mesure",
        f"""
SELECT *, CASE WHEN morceau <> '' THEN regexp_extract(morceau, '{SINGLE}', 2)
               WHEN pieces <> '' THEN 'piece' ELSE '' END AS unite,
       CASE WHEN morceau <> '' THEN coalesce(try_cast(nullif(regexp_extract(morceau, '{PACK}', 1), '') AS bigint), 1)
            WHEN pieces <> '' THEN cast(pieces AS bigint) ELSE 1 END AS pack_count,
       CASE WHEN morceau <> '' THEN cast(regexp_extract(morceau, '{SINGLE}', 1) AS double)
            WHEN pieces <> '' THEN 1.0::double END AS quantite_par_pack
FROM trouve""",
    ),
    (
        "total",
        f"""
SELECT *, CASE WHEN morceau <> '' THEN pack_count::double * (quantite_par_pack * {FACTOR})
               WHEN pieces <> '' THEN pack_count::double END AS total,
       CASE WHEN unite IN ('mg', 'g', 'kg') THEN 'g' WHEN unite IN ('ml', 'cl', 'l') THEN 'ml'
            ELSE unite END AS unite_reference,
       CASE WHEN unite IN ('mg', 'g', 'kg') THEN 'mass' WHEN unite IN ('ml', 'cl', 'l') THEN 'volume'
            WHEN unite = 'piece' THEN 'count' ELSE '' END AS famille_unite
FROM mesure""",
    ),
    (
        "features",
        f"""
SELECT *, CASE WHEN total IS NULL THEN '' ELSE {LABEL} || unite_reference END AS label,
       len(jetons) AS nb_jetons, array_to_string(jetons, '|') AS cle_large,
       CASE WHEN len(jetons) = 0 THEN '' WHEN length(jetons[1]) <= 2 AND len(jetons) > 1 THEN jetons[2]
            ELSE jetons[1] END AS marque
FROM total""",
    ),
    (
        "rows0",
        f"""
SELECT raw.*, f.* EXCLUDE (nom_produit),
       CASE WHEN label <> '' THEN cle_large || '__' || label ELSE cle_large END AS cle_exacte,
       CASE WHEN famille_unite IN ('mass', 'volume') AND total <> 0
            THEN {hu('prix / (total / 1000.0::double)', 2)} END AS prix_kg,
       CASE WHEN famille_unite = 'count' AND total <> 0 THEN {hu('prix / total', 2)}
            WHEN NOT (famille_unite IN ('mass', 'volume') AND coalesce(total, 0) <> 0) AND pack_count > 1
            THEN {hu('prix / pack_count', 2)} END AS prix_pc,
       coalesce(total, 0) <> 0 AS dit
FROM raw JOIN features f ON raw.nom_produit = f.nom_produit""",
    ),
    (
        "rows1",
        """
SELECT *, CASE WHEN nb_jetons >= 3 AND dit THEN 'elevee' WHEN nb_jetons >= 2 THEN 'moyenne'
               ELSE 'faible' END AS qualite,
       (CASE WHEN nb_jetons >= 4 THEN 3 WHEN nb_jetons >= 3 THEN 2 WHEN nb_jetons >= 2 THEN 1 ELSE 0 END)
       + (CASE WHEN dit THEN 2 WHEN pack_count > 1 THEN 1 ELSE 0 END)
       + (CASE WHEN prix > 0 THEN 1 ELSE 0 END) AS score,
       CASE WHEN prix_kg IS NOT NULL THEN 'unit_kg_l' WHEN prix_pc IS NOT NULL THEN 'unit_piece'
            ELSE 'raw_price' END AS type_prix
FROM rows0""",
    ),
    (
        "rows2",
        """
SELECT *, CASE
  WHEN nb_jetons = 1 AND dit THEN 'a_revoir/produit_monotoken_quantifie'
  WHEN nb_jetons < 2 OR qualite = 'faible' THEN 'non_comparable/matching_trop_faible'
  WHEN type_prix <> 'raw_price' AND (dit OR pack_count > 1) AND score >= 4
    THEN 'comparable_normalise/comparaison_unitaire_fiable'
  WHEN type_prix <> 'raw_price' AND (dit OR pack_count > 1)
    THEN 'a_revoir/comparaison_unitaire_peu_documentee'
  WHEN type_prix = 'raw_price' AND qualite = 'elevee' AND nb_jetons >= 3
    THEN 'comparable_brut/comparaison_par_prix_affiche'
  WHEN type_prix = 'raw_price' THEN 'a_revoir/prix_brut_sans_quantite'
  ELSE 'a_revoir/informations_incompletes' END AS verdict
FROM rows1""",
    ),
    (
        "analytics",
        """
SELECT nom_produit, nom_nettoye, marque AS marque_probable, categorie AS categorie_standardisee,
       magasin AS magasin_standardise, prix, prix_kg AS prix_par_kg_ou_l, prix_pc AS prix_par_piece,
       pack_count, quantite_par_pack, unite AS unite_par_pack, total AS quantite_totale_reference,
       unite_reference, famille_unite, label AS quantite_standardisee, cle_large AS cle_matching_large,
       cle_exacte AS cle_matching_exacte, qualite AS qualite_matching, cast(score AS bigint) AS score_matching,
       type_prix AS type_prix_reference, split_part(verdict, '/', 1) AS statut_comparabilite,
       split_part(verdict, '/', 2) AS motif_comparabilite, date_scraping,
       cast(year(date_scraping) AS bigint) AS annee, cast(month(date_scraping) AS bigint) AS mois,
       strftime(date_scraping, '%Y-%m') AS mois_nom,
       cast(year(date_scraping) AS varchar) || 'Q' || cast(quarter(date_scraping) AS varchar) AS trimestre,
       date_scraping AS jour, url_produit
FROM rows2
QUALIFY row_number() OVER (PARTITION BY magasin, date_scraping, cle_exacte, prix, url_produit
                           ORDER BY magasin, categorie, nom_produit) = 1""",
    ),
    (
        "history",
        f"""
SELECT * EXCLUDE (mois) REPLACE (nullif(quantite_standardisee, '') AS quantite_standardisee,
         nullif(unite_par_pack, '') AS unite_par_pack, nullif(unite_reference, '') AS unite_reference,
         nullif(famille_unite, '') AS famille_unite, nullif(nom_nettoye, '') AS nom_nettoye,
         nullif(marque_probable, '') AS marque_probable, nullif(cle_matching_large, '') AS cle_matching_large),
       strftime(jour, '%Y-%m') AS mois, cast(month(jour) AS bigint) AS mois_num
FROM (SELECT *, 'analytics_' || cast(date_scraping AS varchar) AS source_file FROM analytics
      WHERE prix > 0 AND cle_matching_exacte NOT IN ({NA}))
QUALIFY row_number() OVER (PARTITION BY magasin_standardise, jour, cle_matching_exacte, prix, source_file
  ORDER BY date_scraping DESC, categorie_standardisee DESC, nom_nettoye DESC, nom_produit DESC, url_produit DESC) = 1""",
    ),
    (
        "prices",
        """
SELECT *, coalesce(prix_par_kg_ou_l, prix_par_piece, prix) AS prix_comparable,
       CASE WHEN prix_par_kg_ou_l IS NOT NULL THEN 'unit_kg_l' WHEN prix_par_piece IS NOT NULL THEN 'unit_piece'
            ELSE 'raw_price' END AS type_prix_comparable
FROM history WHERE statut_comparabilite = 'comparable_normalise'""",
    ),
    (
        "panel0",
        f"""
SELECT jour, mois, categorie_standardisee, cle_matching_exacte, magasin_standardise,
       min(nom_nettoye) AS nom_reference, {mean('prix_comparable')} AS prix_obs,
       min(type_prix_comparable) AS type_prix, {mean('score_matching')} AS score_matching_moyen,
       min(statut_comparabilite) AS statut_comparabilite
FROM prices GROUP BY ALL""",
    ),
    (
        "panel",
        """
SELECT panel0.*, nb_magasins_jour, nb_types_prix_jour, nb_magasins_jour >= 2 AS comparable_multi_store,
       nb_magasins_jour >= 2 AND nb_types_prix_jour = 1 AS comparabilite_stricte
FROM panel0 JOIN (SELECT jour, cle_matching_exacte, count(DISTINCT magasin_standardise) AS nb_magasins_jour,
                         count(DISTINCT type_prix) AS nb_types_prix_jour FROM panel0 GROUP BY ALL) USING (jour, cle_matching_exacte)""",
    ),
    (
        "competition0",
        f"""
SELECT magasin_standardise, mois, count(DISTINCT cle_matching_exacte) AS nb_produits_comparables,
       {r6('avg(prix_obs / bas)')} AS indice_competitivite_min, {r6('avg(prix_obs / moyen)')} AS indice_competitivite_moyenne,
       {r6('avg((prix_obs / bas - 1) * 100)')} AS ecart_moyen_vs_min_pct
FROM panel JOIN (SELECT jour, cle_matching_exacte, min(prix_obs) AS bas, avg(prix_obs) AS moyen
                 FROM panel WHERE comparabilite_stricte GROUP BY ALL) USING (jour, cle_matching_exacte)
WHERE comparabilite_stricte GROUP BY magasin_standardise, mois""",
    ),
    (
        "competition",
        "SELECT *, dense_rank() OVER (PARTITION BY mois ORDER BY indice_competitivite_min) AS rang_competitivite "
        "FROM competition0",
    ),
    (
        "variation0",
        f"""
SELECT mois, magasin_standardise, categorie_standardisee, count(*) AS nb_observations,
       {mean('prix_comparable')} AS m, quantile_cont(prix_comparable, 0.5) AS md FROM prices GROUP BY ALL""",
    ),
    (
        "variation",
        f"""
SELECT mois, magasin_standardise, categorie_standardisee, nb_observations, {r6('m')} AS prix_moyen,
       {r6('md')} AS prix_median, {r6('(m / lag(m) OVER w - 1) * 100')} AS variation_vs_mois_precedent_pct,
       {r6('m / first_value(m) OVER w * 100')} AS indice_base_100
FROM variation0 WINDOW w AS (PARTITION BY magasin_standardise, categorie_standardisee ORDER BY mois)""",
    ),
    (
        "inflcat",
        f"""
SELECT mois, categorie_standardisee, nb_observations, {r6('m')} AS prix_moyen, {r6('md')} AS prix_median,
       {r6('(m / lag(m) OVER w - 1) * 100')} AS inflation_mensuelle_pct,
       {r6('m / first_value(m) OVER w * 100')} AS indice_prix_base_100
FROM (SELECT mois, categorie_standardisee, count(*) AS nb_observations, {mean('prix_comparable')} AS m,
             quantile_cont(prix_comparable, 0.5) AS md FROM prices GROUP BY ALL)
WINDOW w AS (PARTITION BY categorie_standardisee ORDER BY mois)""",
    ),
    (
        "inflglob",
        f"""
SELECT mois, nb_observations, {r6('m')} AS prix_moyen, {r6('md')} AS prix_median,
       {r6('(m / lag(m) OVER w - 1) * 100')} AS inflation_mensuelle_pct,
       {r6('m / first_value(m) OVER w * 100')} AS indice_prix_base_100
FROM (SELECT mois, count(*) AS nb_observations, {mean('prix_comparable')} AS m,
             quantile_cont(prix_comparable, 0.5) AS md FROM prices GROUP BY ALL)
WINDOW w AS (ORDER BY mois)""",
    ),
    (
        "fluct",
        f"""
SELECT cle_matching_exacte, magasin_standardise, categorie_standardisee, nom_reference, nb_jours, prix_min, prix_max,
       {r6('m')} AS prix_moyen, {r6('sd')} AS prix_std, premiere_date, derniere_date,
       {r6('prix_max - prix_min')} AS amplitude_absolue, {r6('(prix_max - prix_min) / prix_min * 100')} AS amplitude_pct,
       {r6('sd / m * 100')} AS coefficient_variation_pct
FROM (SELECT cle_matching_exacte, magasin_standardise, categorie_standardisee,
             first(nom_nettoye ORDER BY source_file, date_scraping, nom_nettoye) AS nom_reference,
             count(DISTINCT jour) AS nb_jours, min(prix_comparable) AS prix_min, max(prix_comparable) AS prix_max,
             {mean('prix_comparable')} AS m, stddev_samp(prix_comparable) AS sd, min(jour) AS premiere_date,
             max(jour) AS derniere_date FROM prices GROUP BY ALL)
WHERE nb_jours >= 2""",
    ),
    (
        "score",
        f"""
SELECT categorie_standardisee, magasin_standardise, nb_produits, nb_observations, {r6('m')} AS prix_moyen,
       {r6('md')} AS prix_median, prix_min, prix_max, {r6('part')} AS part_produits_normalises,
       nb_produits_categorie_total, {r6('nb_produits::double / nb_produits_categorie_total * 100')} AS couverture_categorie_pct,
       {r6('m / (avg(m) OVER (PARTITION BY categorie_standardisee)) * 100')} AS indice_categorie_base_100
FROM (SELECT categorie_standardisee, magasin_standardise, count(DISTINCT cle_matching_exacte) AS nb_produits,
             count(*) AS nb_observations, {mean('prix_comparable')} AS m, quantile_cont(prix_comparable, 0.5) AS md,
             min(prix_comparable) AS prix_min, max(prix_comparable) AS prix_max,
             (count(*) FILTER (WHERE type_prix_comparable <> 'raw_price'))::double / count(*) * 100 AS part
      FROM prices GROUP BY ALL)
JOIN (SELECT categorie_standardisee, count(DISTINCT cle_matching_exacte) AS nb_produits_categorie_total
      FROM prices GROUP BY ALL) USING (categorie_standardisee)""",
    ),
    (
        "context",
        f"""
SELECT 'categorie' AS niveau_comparaison, *, {hu('indice_categorie_base_100', 2)} AS indicateur_principal,
       CASE WHEN nb_produits >= 30 AND couverture_categorie_pct >= 60 AND part_produits_normalises >= 50 THEN 'eleve'
            WHEN nb_produits >= 15 AND couverture_categorie_pct >= 35 THEN 'moyen' ELSE 'faible' END AS score_confiance,
       CASE WHEN nb_produits >= 30 AND couverture_categorie_pct >= 60 AND part_produits_normalises >= 50
              THEN 'comparaison robuste (couverture et normalisation elevees)'
            WHEN nb_produits >= 15 AND couverture_categorie_pct >= 35
              THEN 'comparaison exploitable avec prudence moderee'
            ELSE 'comparaison a interpreter avec prudence (couverture faible ou echantillon limite)' END AS note_methodologique
FROM score""",
    ),
    (
        "serving",
        f"""
SELECT * REPLACE ({', '.join(f"CASE WHEN {c} IN ({NA}) THEN NULL ELSE {c} END AS {c}" for c in (
    'nom_produit', 'nom_nettoye', 'marque_probable', 'categorie_standardisee', 'magasin_standardise',
    'unite_par_pack', 'unite_reference', 'famille_unite', 'quantite_standardisee', 'cle_matching_large',
    'cle_matching_exacte', 'qualite_matching', 'type_prix_reference', 'statut_comparabilite',
    'motif_comparabilite', 'mois_nom', 'trimestre', 'url_produit'))}),
       prix AS prix_affiche, coalesce(prix_par_kg_ou_l, prix_par_piece) AS prix_normalise
FROM analytics""",
    ),
    (
        "comparable",
        """
SELECT * FROM serving s SEMI JOIN (
  SELECT jour, cle_matching_exacte FROM serving
  WHERE statut_comparabilite = 'comparable_normalise' AND cle_matching_exacte IS NOT NULL
  GROUP BY ALL HAVING count(DISTINCT magasin_standardise) >= 2 AND count(DISTINCT type_prix_reference) = 1) k
  ON s.jour = k.jour AND s.cle_matching_exacte = k.cle_matching_exacte
WHERE statut_comparabilite = 'comparable_normalise'""",
    ),
    (
        "wide",
        "SELECT jour, categorie_standardisee, cle_matching_exacte, nom_produit, "
        + ", ".join(
            f"sum(cast(floor(prix_affiche * 1e6 + 0.5) AS bigint)) FILTER (WHERE magasin_standardise = '{s}')::double"
            f" / count(prix_affiche) FILTER (WHERE magasin_standardise = '{s}') / 1e6 AS \"{s}\""
            for s in STORES
        )
        + " FROM comparable GROUP BY ALL",
    ),
    (
        "extremes",
        "SELECT *, least(" + ", ".join(f'"{s}"' for s in STORES) + ") AS prix_min, greatest("
        + ", ".join(f'"{s}"' for s in STORES) + ") AS prix_max, "
        + " + ".join(f'(CASE WHEN "{s}" IS NULL THEN 0 ELSE 1 END)' for s in STORES)
        + " AS disponibles FROM wide",
    ),
    (
        "comparison",
        "SELECT * EXCLUDE (disponibles), cast(disponibles AS bigint) AS nb_magasins_selectionnes_disponibles, "
        "prix_max - prix_min AS ecart_fcfa, (prix_max - prix_min) / prix_min * 100 AS ecart_pct, "
        "'prix_affiche' AS mode_prix, concat_ws(', ', "
        + ", ".join(f"CASE WHEN \"{s}\" = prix_min THEN '{s}' END" for s in STORES)
        + ") AS magasin_moins_cher, cast("
        + " + ".join(f'(CASE WHEN "{s}" = prix_min THEN 1 ELSE 0 END)' for s in STORES)
        + " AS bigint) AS nb_gagnants FROM extremes",
    ),
    (
        "longue",
        " UNION ALL ".join(
            f"SELECT categorie_standardisee, '{s}' AS magasin, {i} AS choix, \"{s}\" AS p, prix_min, nb_gagnants FROM comparison"
            for i, s in enumerate(STORES)
        ),
    ),
    (
        "scorecard",
        f"""
SELECT categorie_standardisee AS categorie, magasin, choix, count(p) AS produits_comparables,
       count(*) FILTER (WHERE p = prix_min) AS victoires_prix,
       {r6('(count(*) FILTER (WHERE p = prix_min))::double / count(*) * 100')} AS taux_victoire_pct,
       {r6(mean('p'))} AS prix_moyen_obs
FROM longue GROUP BY ALL""",
    ),
    (
        "gap",
        f"""
SELECT *, "EUROPE" - prix_min AS surcout_vs_min_fcfa, ("EUROPE" - prix_min) / prix_min * 100 AS surcout_vs_min_pct
FROM comparison WHERE "EUROPE" IS NOT NULL""",
    ),
    (
        "bornes",
        "SELECT quantile_cont(prix_affiche, 0.01) AS bas, quantile_cont(prix_affiche, 0.99) AS haut FROM serving",
    ),
    (
        "dispersion",
        f"""
SELECT categorie_standardisee, magasin_standardise, min(prix_affiche) AS prix_min,
       {r6('quantile_cont(prix_affiche, 0.25)')} AS q1, {r6('quantile_cont(prix_affiche, 0.5)')} AS mediane,
       {r6('quantile_cont(prix_affiche, 0.75)')} AS q3, max(prix_affiche) AS prix_max, count(*) AS nb_points
FROM serving, bornes WHERE prix_affiche BETWEEN bas AND haut GROUP BY ALL""",
    ),
]

_NAMES = [name for name, _ in CTES]


def after(last: str, select: str) -> str:
    """The chain up to ``last``, then ``select``, which may go on with ``, name AS (...)``."""
    chain = CTES[: _NAMES.index(last) + 1]
    return "WITH " + ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in chain) + "\n" + select
