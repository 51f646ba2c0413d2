"""SQL text per query name."""

from __future__ import annotations

from checks.oracle import CATEGORIES, STORES, after, cleaned, hu, mean, r6, spelled, tidy

_ROUNDED = ", ".join(f'{r6(chr(34) + s + chr(34))} AS "{s}"' for s in STORES)
_ROUNDED_KPI = ", ".join(f"{r6(c)} AS {c}" for c in ("prix_min", "prix_max", "ecart_fcfa", "ecart_pct"))


def fcfa(x: str) -> str:
    return (
        f"coalesce(replace(format('{{:,}}', cast({hu(x, 0)} AS bigint)), ',', ' ') || ' FCFA', '-')"
    )


def pct(x: str) -> str:
    return f"coalesce(printf('%.1f', {hu(x, 1)}) || '%', '-')"


def counted(column: str, alias: str, value: str) -> str:
    return f"SELECT {column}, {value} AS {alias}, count(*) AS nb_annonces FROM raw GROUP BY ALL"


_PAIR = "jour, categorie_standardisee, cle_matching_exacte, nom_produit"

ORACLE: dict[str, str] = {
    "strip_accents": "SELECT doc_id, strip_accents(text) AS texte FROM documents",
    "clean_name": f"SELECT doc_id, {tidy('text')} AS texte FROM documents",
    "normalize_store": after("raw", counted("magasin", "magasin_standardise", "magasin")),
    "normalize_category": after("raw", counted("categorie", "categorie_standardisee", "categorie")),
    "quantity_text": after(
        "raw",
        f"SELECT nom_produit, count(*) AS nb_annonces, {spelled('nom_produit')} AS texte FROM raw GROUP BY nom_produit",
    ),
    "clean_product_name": after("features", "SELECT nom_produit, nom_nettoye FROM features"),
    "extract_quantity": after(
        "features", "SELECT nom_produit, pack_count, quantite_par_pack, unite AS unite_par_pack FROM features"
    ),
    "convert_quantity": after(
        "features",
        "SELECT nom_produit, total AS quantite_totale, unite_reference, famille_unite, label AS quantite_label FROM features",
    ),
    "matching_tokens": after(
        "features", "SELECT nom_produit, array_to_string(jetons, ' ') AS jetons, nb_jetons FROM features"
    ),
    "matching_keys": after(
        "rows0",
        "SELECT DISTINCT nom_produit, cle_large AS cle_matching_large, cle_exacte AS cle_matching_exacte FROM rows0",
    ),
    "brand_guess": after("features", "SELECT nom_produit, marque AS marque_probable FROM features"),
    "unit_prices": after(
        "rows0",
        "SELECT nom_produit, prix, prix_kg AS prix_par_kg_ou_l, prix_pc AS prix_par_piece, count(*) AS nb_annonces "
        "FROM rows0 GROUP BY ALL",
    ),
    "comparability": after(
        "rows2",
        "SELECT nom_produit, qualite AS qualite_matching, cast(score AS bigint) AS score_matching, "
        "type_prix AS type_prix_reference, split_part(verdict, '/', 1) AS statut_comparabilite, "
        "split_part(verdict, '/', 2) AS motif_comparabilite, count(*) AS nb_annonces FROM rows2 GROUP BY ALL",
    ),
    "calendar_columns": after(
        "raw",
        "SELECT date_scraping, year(date_scraping) AS annee, month(date_scraping) AS mois, "
        "strftime(date_scraping, '%Y-%m') AS mois_nom, cast(year(date_scraping) AS varchar) || 'Q' || "
        "cast(quarter(date_scraping) AS varchar) AS trimestre, date_scraping AS jour, count(*) AS nb_annonces "
        "FROM raw GROUP BY ALL",
    ),
    "coerce_required": after(
        "raw", "SELECT * FROM raw WHERE prix <= 90000 AND dayofmonth(date_scraping) <> 13"
    ),
    "dedup_daily": after(
        "analytics",
        "SELECT magasin_standardise, jour, cle_matching_exacte, prix, url_produit, nom_produit, "
        "categorie_standardisee FROM analytics",
    ),
    "analytics": after("analytics", "SELECT * FROM analytics"),
    "product_reference": after(
        "analytics",
        """
, statuts AS (SELECT cle_matching_exacte, cle_matching_large, categorie_standardisee, statut_comparabilite
  FROM analytics GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY cle_matching_exacte, cle_matching_large,
    categorie_standardisee ORDER BY count(*) DESC, statut_comparabilite) = 1),
premiers AS (SELECT * FROM analytics QUALIFY row_number() OVER (PARTITION BY cle_matching_exacte, cle_matching_large,
    categorie_standardisee ORDER BY magasin_standardise, categorie_standardisee, nom_produit, jour, prix, url_produit) = 1),
comptes AS (SELECT cle_matching_exacte, cle_matching_large, categorie_standardisee, count(*) AS nb_lignes,
    count(DISTINCT magasin_standardise) AS nb_magasins,
    array_to_string(list_sort(list(DISTINCT magasin_standardise)), ' | ') AS magasins,
    min(prix) AS prix_min, max(prix) AS prix_max, max(score_matching) AS score_matching_max FROM analytics GROUP BY ALL)
SELECT cle_matching_exacte, cle_matching_large, categorie_standardisee, nb_lignes, nb_magasins, magasins,
  nom_nettoye AS nom_reference, marque_probable, quantite_standardisee, famille_unite, prix_min, prix_max,
  score_matching_max, statuts.statut_comparabilite
FROM comptes JOIN statuts USING (cle_matching_exacte, cle_matching_large, categorie_standardisee)
     JOIN premiers USING (cle_matching_exacte, cle_matching_large, categorie_standardisee)""",
    ),
    "exact_price_panel": after(
        "analytics",
        """
, g AS (SELECT cle_matching_exacte, categorie_standardisee, quantite_standardisee, magasin_standardise,
    first(nom_nettoye ORDER BY nom_produit, jour, prix, url_produit) AS nom_reference, min(prix) AS prix_min,
    first(type_prix_reference ORDER BY nom_produit, jour, prix, url_produit) AS type_prix_reference
  FROM analytics WHERE statut_comparabilite IN ('comparable_normalise', 'comparable_brut') GROUP BY ALL),
k AS (SELECT cle_matching_exacte, count(DISTINCT magasin_standardise) AS nb_magasins FROM g GROUP BY ALL
  HAVING count(DISTINCT magasin_standardise) >= 2 AND count(DISTINCT type_prix_reference) = 1)
SELECT cle_matching_exacte, categorie_standardisee, quantite_standardisee, nom_reference, nb_magasins, type_prix_reference, """
        + ", ".join(f"min(prix_min) FILTER (WHERE magasin_standardise = '{s}') AS \"{s}\"" for s in STORES)
        + " FROM g JOIN k USING (cle_matching_exacte) GROUP BY ALL",
    ),
    "distributions": after(
        "analytics",
        " UNION ALL ".join(
            f"SELECT '{a}' AS axe, {a} AS valeur, count(*) AS nb_lignes FROM analytics GROUP BY ALL"
            for a in ("magasin_standardise", "qualite_matching", "statut_comparabilite")
        ),
    ),
    "history": after("history", "SELECT * FROM history"),
    "comparable_price": after(
        "history",
        "SELECT magasin_standardise, jour, cle_matching_exacte, prix, url_produit, "
        "coalesce(prix_par_kg_ou_l, prix_par_piece, prix) AS prix_comparable, CASE WHEN prix_par_kg_ou_l IS NOT NULL "
        "THEN 'unit_kg_l' WHEN prix_par_piece IS NOT NULL THEN 'unit_piece' ELSE 'raw_price' END AS type_prix_comparable "
        "FROM history",
    ),
    "reliable": after(
        "history",
        "SELECT magasin_standardise, jour, cle_matching_exacte, prix, statut_comparabilite FROM history "
        "WHERE statut_comparabilite = 'comparable_normalise'",
    ),
    "daily_panel": after(
        "panel",
        f"SELECT * REPLACE ({r6('prix_obs')} AS prix_obs, {r6('score_matching_moyen')} AS score_matching_moyen) FROM panel",
    ),
    "variation_index": after("variation", "SELECT * FROM variation"),
    "competitiveness": after("competition", "SELECT * FROM competition"),
    "fluctuation": after("fluct", "SELECT * FROM fluct"),
    "inflation_category": after("inflcat", "SELECT * FROM inflcat"),
    "inflation_global": after("inflglob", "SELECT * FROM inflglob"),
    "category_store_score": after("score", "SELECT * FROM score"),
    "context_table": after("context", "SELECT * FROM context"),
    "kpi_summary": after(
        "fluct",
        f"""
SELECT 'date_derniere_observation' AS kpi, cast(max(jour) AS varchar) AS valeur,
  cast(count(DISTINCT magasin_standardise) AS varchar) || ' magasins, ' || cast(count(DISTINCT cle_matching_exacte) AS varchar)
  || ' cles produits' AS details FROM prices
UNION ALL (SELECT 'magasin_plus_competitif', magasin_standardise, 'indice=' || printf('%.4f', {hu('indice_competitivite_min', 4)})
  || ' sur ' || cast(nb_produits_comparables AS varchar) || ' produits' FROM competition
  WHERE mois = (SELECT max(mois) FROM prices) ORDER BY indice_competitivite_min, indice_competitivite_moyenne, magasin_standardise LIMIT 1)
UNION ALL (SELECT 'produit_plus_forte_fluctuation', nom_reference, magasin_standardise || ' | cv=' ||
  printf('%.2f', {hu('coefficient_variation_pct', 2)}) || '% | amplitude=' || printf('%.2f', {hu('amplitude_pct', 2)}) || '%'
  FROM fluct ORDER BY coefficient_variation_pct DESC, amplitude_pct DESC, nb_jours DESC, cle_matching_exacte, magasin_standardise,
  categorie_standardisee LIMIT 1)
UNION ALL (SELECT 'inflation_mensuelle_globale', cast({hu('inflation_mensuelle_pct', 2)} AS varchar), mois FROM inflglob
  ORDER BY mois DESC LIMIT 1)
UNION ALL (SELECT 'indice_variation_prix_dernier_mois', cast({hu('indice_base_100', 2)} AS varchar), mois FROM variation
  ORDER BY mois DESC, magasin_standardise DESC, categorie_standardisee DESC LIMIT 1)""",
    ),
    "quality_report": after(
        "panel",
        f"""
, h AS (SELECT count(*)::double AS n, (count(*) FILTER (WHERE statut_comparabilite = 'comparable_normalise'))::double AS r,
    count(DISTINCT cle_matching_exacte)::double AS k,
    (count(*) FILTER (WHERE statut_comparabilite = 'comparable_normalise' AND type_prix_reference <> 'raw_price'))::double AS u,
    (count(*) FILTER (WHERE statut_comparabilite = 'comparable_normalise' AND type_prix_reference = 'raw_price'))::double AS b
  FROM history)
SELECT 'observations_total' AS kpi, n AS valeur, 'lignes analytiques chargees' AS details FROM h
UNION ALL SELECT 'observations_retenues_kpi', r, 'lignes retenues apres filtre de comparabilite' FROM h
UNION ALL SELECT 'taux_retention_kpi_pct', {hu('r / n * 100', 2)}, 'part des observations jugees assez fiables pour les KPI' FROM h
UNION ALL SELECT 'cles_exactes_total', k, 'cles produits dans le dataset analytique' FROM h
UNION ALL SELECT 'cles_multi_store', count(DISTINCT cle_matching_exacte) FILTER (WHERE comparable_multi_store),
  'cles presentes dans au moins 2 magasins le meme jour' FROM panel
UNION ALL SELECT 'cles_comparables_strictes', count(DISTINCT cle_matching_exacte) FILTER (WHERE comparabilite_stricte),
  'cles multi-magasins avec type de prix coherent' FROM panel
UNION ALL SELECT 'observations_normalisees', u, 'observations comparees au kg/L ou a la piece' FROM h
UNION ALL SELECT 'observations_prix_brut', b, 'observations retenues sur prix affiche exact' FROM h""",
    ),
    "serving_prices": after(
        "serving",
        "SELECT magasin_standardise, jour, cle_matching_exacte, url_produit, prix, nom_produit, quantite_standardisee, "
        "unite_reference, prix_affiche, prix_normalise FROM serving",
    ),
    "filter_selection": after(
        "serving",
        "SELECT magasin_standardise, categorie_standardisee, jour, nom_produit, prix, url_produit FROM serving "
        "WHERE magasin_standardise IN ('ASIA', 'EUROPE') AND categorie_standardisee IN ('PROMO', 'SMALL')",
    ),
    "search_products": after(
        "serving",
        "SELECT nom_nettoye, magasin_standardise, jour, prix, url_produit FROM serving "
        "WHERE regexp_matches(nom_nettoye, 'PLATE.*(kg|cl)$', 'i')",
    ),
    "price_comparison": after(
        "comparison",
        f"SELECT {_PAIR}, {_ROUNDED}, {_ROUNDED_KPI}, nb_magasins_selectionnes_disponibles, mode_prix, magasin_moins_cher, "
        "nb_gagnants FROM comparison",
    ),
    "full_coverage": after(
        "serving",
        f"""
, c AS (SELECT * FROM serving WHERE statut_comparabilite = 'comparable_normalise' AND magasin_standardise IN ('ASIA', 'EUROPE')),
k AS (SELECT jour, cle_matching_exacte FROM c GROUP BY ALL
  HAVING count(DISTINCT magasin_standardise) >= 2 AND count(DISTINCT type_prix_reference) = 1),
w AS (SELECT {_PAIR}, """
        + ", ".join(
            f"sum(cast(floor(prix_affiche * 1e6 + 0.5) AS bigint)) FILTER (WHERE magasin_standardise = '{s}')::double"
            f" / count(*) FILTER (WHERE magasin_standardise = '{s}') / 1e6 AS {s}"
            for s in ("ASIA", "EUROPE")
        )
        + f""" FROM c JOIN k USING (jour, cle_matching_exacte) GROUP BY ALL)
SELECT {_PAIR}, {r6('ASIA')} AS ASIA, {r6('EUROPE')} AS EUROPE, {r6('least(ASIA, EUROPE)')} AS prix_min,
  {r6('greatest(ASIA, EUROPE)')} AS prix_max, {r6('greatest(ASIA, EUROPE) - least(ASIA, EUROPE)')} AS ecart_fcfa,
  {r6('(greatest(ASIA, EUROPE) - least(ASIA, EUROPE)) / least(ASIA, EUROPE) * 100')} AS ecart_pct,
  2::bigint AS nb_magasins_selectionnes_disponibles, 'prix_affiche' AS mode_prix,
  CASE WHEN ASIA = EUROPE THEN 'ASIA, EUROPE' WHEN ASIA < EUROPE THEN 'ASIA' ELSE 'EUROPE' END AS magasin_moins_cher,
  CASE WHEN ASIA = EUROPE THEN 2 ELSE 1 END::bigint AS nb_gagnants
FROM w WHERE ASIA IS NOT NULL AND EUROPE IS NOT NULL""",
    ),
    "head_to_head": after(
        "longue",
        f"""
SELECT magasin, count(*) FILTER (WHERE p = prix_min) AS victoires,
  {r6('(count(*) FILTER (WHERE p = prix_min))::double / (count(*) FILTER (WHERE nb_gagnants >= 1)) * 100')} AS taux_victoire_pct,
  {r6(mean('p'))} AS prix_moyen, count(p) AS couverture_produits FROM longue GROUP BY magasin""",
    ),
    "category_scorecard": after("scorecard", "SELECT * EXCLUDE (choix) FROM scorecard"),
    "best_store_by_category": after(
        "scorecard",
        "SELECT * EXCLUDE (choix) FROM scorecard QUALIFY row_number() OVER (PARTITION BY categorie "
        "ORDER BY taux_victoire_pct DESC NULLS LAST, prix_moyen_obs NULLS LAST, choix) = 1",
    ),
    "store_gap": after(
        "gap",
        f"SELECT {_PAIR}, magasin_moins_cher, {r6('surcout_vs_min_fcfa')} AS surcout_vs_min_fcfa, "
        f"{r6('surcout_vs_min_pct')} AS surcout_vs_min_pct FROM gap",
    ),
    "store_gap_metrics": after(
        "gap",
        f"SELECT {r6(mean('surcout_vs_min_fcfa'))} AS surcout_moyen, "
        f"{r6('quantile_cont(surcout_vs_min_fcfa, 0.5)')} AS surcout_median, "
        "count(*) FILTER (WHERE surcout_vs_min_fcfa > 0) AS nb_plus_chers FROM gap",
    ),
    "winner_histogram": after(
        "comparison", "SELECT magasin_moins_cher, count(*) AS nb_produits FROM comparison GROUP BY ALL"
    ),
    "top_gaps": after(
        "comparison",
        f"SELECT {_PAIR}, {r6('ecart_fcfa')} AS ecart_fcfa, {r6('ecart_pct')} AS ecart_pct FROM (SELECT * FROM comparison "
        "ORDER BY ecart_fcfa DESC, nom_produit, jour, categorie_standardisee, cle_matching_exacte LIMIT 100)",
    ),
    "top_store_gaps": after(
        "gap",
        f"SELECT {_PAIR}, {r6('surcout_vs_min_fcfa')} AS surcout_vs_min_fcfa FROM (SELECT * FROM gap "
        "ORDER BY surcout_vs_min_fcfa DESC, surcout_vs_min_pct DESC NULLS LAST, ecart_fcfa DESC, nom_produit, jour, "
        "categorie_standardisee, cle_matching_exacte LIMIT 50)",
    ),
    "display_format": after(
        "comparison",
        "SELECT jour, cle_matching_exacte, nom_produit, categorie_standardisee, magasin_moins_cher, "
        + ", ".join(f"{fcfa(c)} AS {c}" for c in ("prix_min", "prix_max", "ecart_fcfa"))
        + f", {pct('ecart_pct')} AS ecart_pct, "
        + ", ".join(f'{fcfa(chr(34) + s + chr(34))} AS "{s}"' for s in STORES)
        + " FROM comparison",
    ),
    "heatmap": after(
        "score", "SELECT categorie_standardisee, magasin_standardise, indice_categorie_base_100 FROM score"
    ),
    "dispersion": after("dispersion", "SELECT * FROM dispersion"),
    "category_order": after(
        "dispersion",
        f"SELECT *, row_number() OVER (ORDER BY mediane_moyenne, categorie_standardisee) AS rang FROM "
        f"(SELECT categorie_standardisee, {r6(mean('mediane'))} AS mediane_moyenne FROM dispersion GROUP BY ALL)",
    ),
    "dispersion_verdict": after(
        "dispersion",
        f"""
, v AS (SELECT categorie_standardisee, first(magasin_standardise ORDER BY mediane, magasin_standardise) AS magasin_leader,
    last(magasin_standardise ORDER BY mediane, magasin_standardise) AS magasin_haut, min(mediane) AS bas, max(mediane) AS haut,
    {mean('q3 - q1')} AS iqr FROM dispersion GROUP BY ALL)
SELECT categorie_standardisee, magasin_leader, magasin_haut, {r6('(haut - bas) / bas * 100')} AS ecart_medianes_pct,
  {r6('iqr')} AS iqr_moyen, {r6('iqr / bas')} AS ratio_dispersion, CASE WHEN iqr / bas < 0.25 THEN 'faible'
  WHEN iqr / bas < 0.5 THEN 'moderee' ELSE 'elevee' END AS niveau_dispersion FROM v""",
    ),
    "context_payload": after(
        "context",
        "SELECT niveau_comparaison, categorie_standardisee, magasin_standardise, nb_produits, "
        "couverture_categorie_pct, indice_categorie_base_100, score_confiance, note_methodologique, "
        "row_number() OVER (PARTITION BY categorie_standardisee ORDER BY magasin_standardise) AS position "
        "FROM context",
    ),
    "context_metrics": after(
        "context",
        "SELECT count(*) AS nb_lignes, count(DISTINCT categorie_standardisee) AS nb_categories, "
        f"count(DISTINCT magasin_standardise) AS nb_magasins, {r6(mean('indice_categorie_base_100'))} AS indice_moyen_base_100 "
        "FROM context",
    ),
    "confidence_counts": after(
        "context", "SELECT score_confiance, count(*) AS nb_lignes FROM context GROUP BY ALL"
    ),
    "overview": after(
        "serving",
        """
, l AS (SELECT * FROM competition WHERE mois = (SELECT max(mois) FROM competition)
  ORDER BY indice_competitivite_min, indice_competitivite_moyenne, magasin_standardise LIMIT 1)
SELECT (SELECT max(jour) FROM serving) AS derniere_observation,
  (SELECT count(DISTINCT magasin_standardise) FROM serving) AS nb_magasins,
  (SELECT count(DISTINCT cle_matching_exacte) FROM serving) AS nb_produits,
  (SELECT count(DISTINCT cle_matching_exacte) FROM panel WHERE comparabilite_stricte) AS nb_produits_comparables,
  magasin_standardise AS magasin_leader, indice_competitivite_min AS indice_leader, ecart_moyen_vs_min_pct AS ecart_leader_pct,
  nb_produits_comparables AS nb_produits_leader FROM l""",
    ),
    "quality_view": after(
        "serving",
        f"""
SELECT count(*) FILTER (WHERE statut_comparabilite = 'comparable_normalise') AS observations_retenues,
  {r6("(count(*) FILTER (WHERE statut_comparabilite = 'comparable_normalise'))::double / count(*) * 100")} AS taux_retention_pct,
  (SELECT count(DISTINCT cle_matching_exacte) FROM panel WHERE comparable_multi_store) AS cles_multi_store,
  (SELECT count(DISTINCT cle_matching_exacte) FROM panel WHERE comparabilite_stricte) AS cles_strictes FROM serving""",
    ),
    "status_counts": after(
        "serving", "SELECT statut_comparabilite AS statut, count(*) AS nb_observations FROM serving GROUP BY ALL"
    ),
    "review_reasons": after(
        "serving",
        "SELECT motif_comparabilite, count(*) AS nb_observations FROM serving WHERE statut_comparabilite = 'a_revoir' GROUP BY ALL",
    ),
    "latest_ranking": after(
        "competition",
        f"SELECT magasin_standardise, nb_produits_comparables, {hu('indice_competitivite_min', 3)} AS indice_competitivite_min, "
        f"{pct('ecart_moyen_vs_min_pct')} AS ecart_moyen_vs_min_pct, rang_competitivite FROM competition "
        "WHERE mois = (SELECT max(mois) FROM competition)",
    ),
    "avg_price": after(
        "serving",
        f"SELECT categorie_standardisee, magasin_standardise, {hu(mean('prix'), 0)} AS prix FROM serving GROUP BY ALL",
    ),
    "inflation_pivot": after(
        "inflcat",
        "SELECT mois, "
        + ", ".join(
            f"max(indice_prix_base_100) FILTER (WHERE categorie_standardisee = '{c}') AS \"{c}\"" for c in CATEGORIES
        )
        + " FROM inflcat GROUP BY mois",
    ),
    "latest_inflation": after(
        "inflglob",
        f"SELECT mois, inflation_mensuelle_pct, {pct('inflation_mensuelle_pct')} AS texte FROM inflglob "
        "WHERE mois = (SELECT max(mois) FROM inflglob)",
    ),
    "data_warnings": after(
        "comparison",
        "SELECT (SELECT count(*) FROM comparison) = 0 AS sans_comparaison, (SELECT count(*) FROM fluct) = 0 AS sans_fluctuation, "
        "(SELECT count(variation_vs_mois_precedent_pct) FROM variation) = 0 AS sans_variation_mensuelle, "
        "(SELECT count(*) FROM comparison) > 0 AND (SELECT count(*) FROM fluct) > 0 AND "
        "(SELECT count(variation_vs_mois_precedent_pct) FROM variation) > 0 AS donnees_suffisantes",
    ),
}

# --- sources -----------------------------------------------------------------

ORACLE |= {
    "source_projection": "SELECT p_partkey, p_name, p_type, p_size FROM part",
    "latest_snapshot": after(
        "raw",
        "SELECT raw.* FROM raw JOIN (SELECT magasin, max(date_scraping) AS d FROM raw GROUP BY magasin) n "
        "ON raw.magasin = n.magasin AND raw.date_scraping = n.d",
    ),
    "history_union": after(
        "analytics",
        "SELECT 'analytics_' || cast(date_scraping AS varchar) AS source_file, magasin_standardise, cle_matching_exacte, prix, "
        "url_produit, CASE WHEN year(jour) >= 1998 THEN statut_comparabilite ELSE 'a_revoir' END AS statut_comparabilite, "
        "CASE WHEN year(jour) >= 1998 THEN motif_comparabilite ELSE '' END AS motif_comparabilite, "
        "CASE WHEN year(jour) >= 1998 THEN type_prix_reference ELSE 'raw_price' END AS type_prix_reference, "
        "CASE WHEN year(jour) >= 1998 THEN score_matching END AS score_matching FROM analytics",
    ),
    "merge_sources": after(
        "raw",
        "SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY nom_produit, prix, magasin "
        "ORDER BY date_scraping, categorie, url_produit) = 1",
    ),
    "write_mart": after("competition", "SELECT * FROM competition"),
    "mart_manifest": after(
        "context",
        " UNION ALL ".join(
            f"SELECT '{name}' AS jeu, {count} AS nb_lignes"
            for name, count in (
                ("variation_index", "(SELECT count(*) FROM variation)"),
                ("competitiveness", "(SELECT count(*) FROM competition)"),
                ("fluctuation", "(SELECT count(*) FROM fluct)"),
                ("inflation_category", "(SELECT count(*) FROM inflcat)"),
                ("inflation_global", "(SELECT count(*) FROM inflglob)"),
                ("category_store_score", "(SELECT count(*) FROM score)"),
                ("ai_context", "(SELECT count(*) FROM context)"),
                ("summary", "5"),
                ("daily_panel", "(SELECT count(*) FROM panel)"),
                ("quality", "8"),
                ("ai_context_json", "(SELECT count(*) FROM context)"),
            )
        ),
    ),
    "incremental_history": after(
        "history", "SELECT magasin_standardise, jour, cle_matching_exacte, prix, source_file FROM history"
    ),
}
ORACLE["dedup_listing"] = ORACLE["merge_sources"]
ORACLE["text_mart_manifest"] = ORACLE["mart_manifest"]
ORACLE["incremental_rows"] = ORACLE["history"]

# --- capture -----------------------------------------------------------------

_ANCHOR = """(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""


def text_of(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
        ("&apos;", "''"), ("&amp;", "&"),
    ):
        out = f"replace({out}, '{entity}', '{char}')"
    return tidy(out)


_LISTING = """
WITH pages_vues AS (
  SELECT o_orderkey, 'rayon-' || cast(o_orderkey // 24 AS varchar) AS category, o_orderkey % 8 + 1 AS page_no,
    CASE (o_orderkey // 8) % 3 WHEN 0 THEN 'Auchan' WHEN 1 THEN 'Sakanal' ELSE 'Diarle' END AS magasin,
    CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE o_orderkey % 8 + 1 END AS served_page,
    o_orderkey % 8 <> 7 AND o_orderkey % 41 <> 0 AS has_next FROM orders),
lignes AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, nom AS name, '/c/' || lower(p_type) AS href,
    CASE WHEN l_orderkey % 13 = 0 THEN '2 000 F'
         WHEN l_quantity < 8 THEN cast(cast(l_quantity * 15 AS bigint) AS varchar) || ' CFA'
         ELSE replace(format('{:,}', cast(trunc(l_extendedprice) AS bigint)), ',', ' ') || ' FCFA' END AS price_text
  FROM lineitem JOIN (SELECT *, p_name || ' ' || CASE p_size % 8 WHEN 0 THEN '500g' WHEN 1 THEN '1,5L' WHEN 2 THEN '6x33cl'
         WHEN 3 THEN 'Boîte de 1 kg' WHEN 4 THEN '12 pieces' WHEN 5 THEN '' WHEN 6 THEN '33cl x 6'
         ELSE 'SACHET 250 gr' END AS nom FROM part) ON l_partkey = p_partkey),
listing AS (SELECT pages_vues.* EXCLUDE (o_orderkey), lignes.* EXCLUDE (l_orderkey)
            FROM pages_vues LEFT JOIN lignes ON o_orderkey = l_orderkey),
chiffre AS (
  SELECT *, trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g')) AS nom,
    try_cast(regexp_replace(regexp_extract(price_text, '(?i)(\\d[\\d\\s.,]*?)\\s*(?:CFA|FCFA)', 1), '[\\s.,]', '', 'g') AS double) AS prix,
    CASE WHEN starts_with(href, '/') THEN CASE magasin WHEN 'Auchan' THEN 'https://www.auchan.sn'
      WHEN 'Sakanal' THEN 'https://sakanal.sn' ELSE 'https://diarle.sn' END || href ELSE href END AS url_produit
  FROM listing),
valide AS (SELECT * FROM chiffre WHERE nom <> '' AND prix >= CASE magasin WHEN 'Auchan' THEN 50 ELSE 100 END
           QUALIFY row_number() OVER (PARTITION BY magasin, category, page_no, nom ORDER BY pos) = 1),
articles AS (SELECT magasin, category, page_no, nom, href AS lien, pos, min(page_no) OVER (PARTITION BY magasin, category, nom, href) AS premiere
             FROM chiffre WHERE nom <> '' OR href <> ''),
parts AS (SELECT magasin, category, page_no, (count(*) FILTER (WHERE premiere < page_no))::double / count(*) AS part,
                 string_agg(nom || '>' || lien, '|' ORDER BY pos) AS signature FROM articles GROUP BY ALL),
neufs AS (SELECT v.magasin, v.category, v.page_no, count(*) FILTER (WHERE premiere = v.page_no) AS nouveaux
          FROM valide v JOIN (SELECT DISTINCT magasin, category, page_no, nom, lien, premiere FROM articles) a
            ON v.magasin = a.magasin AND v.category = a.category AND v.page_no = a.page_no AND v.nom = a.nom AND v.href = a.lien GROUP BY ALL),
feuilles AS (
  SELECT p.magasin, p.category, p.page_no, p.served_page, p.has_next, coalesce(part, 0) AS recouvrement, coalesce(nouveaux, 0) AS nouveaux,
    coalesce(signature, '') AS signature, part IS NULL AS vide
  FROM pages_vues p LEFT JOIN parts ON p.magasin = parts.magasin AND p.category = parts.category AND p.page_no = parts.page_no
       LEFT JOIN neufs ON p.magasin = neufs.magasin AND p.category = neufs.category AND p.page_no = neufs.page_no),
arrets AS (
  SELECT *, CASE WHEN vide THEN 'page_vide' WHEN served_page <> page_no THEN 'page_redirigee'
    WHEN signature = lag(signature) OVER (PARTITION BY magasin, category ORDER BY page_no) THEN 'page_identique'
    WHEN recouvrement >= 0.8 THEN 'page_deja_vue' WHEN nouveaux = 0 AND page_no > 1 THEN 'rien_de_nouveau'
    WHEN NOT has_next THEN 'derniere_page' END AS motif_arret FROM feuilles),
gardees AS (
  SELECT * FROM (SELECT *, min(page_no) FILTER (WHERE motif_arret IS NOT NULL) OVER (PARTITION BY magasin, category) AS arret FROM arrets)
  WHERE arret IS NULL OR page_no <= arret)
"""
_CARD = "nom AS nom_produit, prix, url_produit"

ORACLE |= {
    "page_links": f"""
SELECT page_id, pos, {text_of(f"regexp_extract(a, '{_ANCHOR}', 2)")} AS name, trim(regexp_extract(a, '{_ANCHOR}', 1)) AS href
FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}', 0)) AS a,
             generate_subscripts(regexp_extract_all(html, '{_ANCHOR}', 0), 1) AS pos FROM pages)""",
    "page_cards": _LISTING
    + """SELECT category, page_no, magasin, CASE WHEN pos IS NOT NULL THEN row_number() OVER (PARTITION BY magasin, category, page_no ORDER BY pos) END AS pos,
  CASE WHEN pos IS NOT NULL THEN nom END AS name, href, CASE WHEN pos IS NULL THEN NULL WHEN magasin = 'Sakanal' THEN '1 000 FCFA / KG'
  WHEN price_text LIKE '%CFA%' THEN price_text END AS price_text FROM chiffre""",
    "page_tiles": _LISTING
    + """SELECT category, page_no, magasin, CASE WHEN pos IS NOT NULL THEN row_number() OVER (PARTITION BY magasin, category, page_no ORDER BY pos) END AS pos,
  nom AS name, href, price_text FROM chiffre""",
    "mixed_cards": _LISTING
    + """, lies AS (SELECT category, page_no, magasin, pos, nom, href, price_text FROM chiffre
  UNION ALL SELECT category, page_no, magasin, pos + 0.5, 'avis', '#avis', price_text FROM chiffre WHERE page_no % 4 = 2 AND pos IS NOT NULL)
  SELECT category, page_no, magasin, CASE WHEN pos IS NOT NULL THEN row_number() OVER (PARTITION BY magasin, category, page_no ORDER BY pos) END AS pos,
  CASE WHEN pos IS NOT NULL THEN nom END AS name, href, CASE WHEN pos IS NULL THEN NULL WHEN magasin = 'Sakanal' THEN '1 000FCFA/ KG'
  WHEN price_text LIKE '%CFA%' THEN price_text END AS price_text FROM lies""",
    "mixed_tiles": _LISTING
    + """, vues AS (SELECT category, page_no, magasin, pos, nom, href, price_text FROM chiffre WHERE page_no % 4 IN (0, 2)
  UNION ALL SELECT category, page_no, magasin, NULL, '', NULL, NULL FROM pages_vues WHERE page_no % 4 IN (1, 3))
  SELECT category, page_no, magasin, CASE WHEN pos IS NOT NULL THEN row_number() OVER (PARTITION BY magasin, category, page_no ORDER BY pos) END AS pos,
  nom AS name, href, price_text FROM vues""",
    "mixed_pagination": _LISTING
    + "SELECT category, page_no, magasin, served_page, has_next FROM pages_vues",
    "page_elements": """
SELECT page_id, name, count(*) AS nb_elements FROM (SELECT page_id, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)>', '', 'g'),
  '<[A-Za-z][^>]*>')) AS tag FROM pages)) GROUP BY ALL""",
    "pagination_facts": _LISTING
    + "SELECT category, page_no, magasin, served_page, has_next FROM pages_vues",
    "page_pagination": """
SELECT page_id, url, coalesce(try_cast(regexp_extract(regexp_replace(regexp_extract(html,
  '(?is)<(?:li|a|span|div)\\b[^>]*class\\s*=\\s*["''][^"'']*\\b(?:current|active)\\b[^"'']*["''][^>]*>(.*?)</(?:li|a|span|div)>', 1),
  '<[^>]*>', ' ', 'g'), '\\b(\\d+)\\b', 1) AS bigint), 1) AS served_page,
  regexp_matches(html, '(?is)<a\\b[^>]*\\brel\\s*=\\s*["''][^"'']*\\bnext\\b')
  OR regexp_matches(html, '(?is)<(li|div|span)\\b[^>]*class\\s*=\\s*["''][^"'']*\\b(next|pagination_next)\\b[^"'']*["''][^>]*>\\s*<a\\b')
  OR regexp_matches(html, '(?is)<a\\b[^>]*href="[^"]*page=[^>]*>[^<]*(next|suivant)') AS has_next FROM pages""",
    "price_text": _LISTING + "SELECT price_text, prix, count(*) AS nb_annonces FROM chiffre GROUP BY ALL",
    "resolve_url": _LISTING + "SELECT magasin, href, url_produit, count(*) AS nb_annonces FROM chiffre GROUP BY ALL",
    "valid_listing": _LISTING + f"SELECT magasin, category, page_no, pos, {_CARD} FROM valide",
    "page_overlap": _LISTING + f"SELECT magasin, category, page_no, {r6('recouvrement')} AS recouvrement FROM feuilles",
    "crawl_cutoff": _LISTING
    + f"SELECT magasin, category, page_no, {r6('recouvrement')} AS recouvrement, nouveaux, motif_arret FROM gardees",
    "kept_listing": _LISTING
    + f"SELECT magasin, category, page_no, pos, {_CARD} FROM valide SEMI JOIN gardees USING (magasin, category, page_no)",
}

# --- messages ----------------------------------------------------------------

_NORMAL = tidy("regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s&+-]', ' ', 'g')")
_MESSAGES = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, text, role, {_NORMAL} AS t FROM conversations),
h AS (SELECT *, contains(t, 'the') AS a, contains(t, 'and') AS b, contains(t, 'with') AS c, contains(t, 'une') AS d,
        contains(t, 'que') AS e, contains(t, 'der') AS f, contains(t, 'from') OR contains(t, 'this') AS c2,
        contains(t, 'die') OR contains(t, 'und') AS f2, contains(t, 'les') OR contains(t, 'leur') AS e2 FROM m),
g AS (SELECT *, concat_ws(' | ', CASE WHEN a THEN 'The' END, CASE WHEN b THEN 'And' END, CASE WHEN c THEN 'With' END,
        CASE WHEN d THEN 'Une' END, CASE WHEN e THEN 'Que' END, CASE WHEN f THEN 'Der' END,
        CASE WHEN c2 AND NOT c THEN 'With' END, CASE WHEN f2 AND NOT f THEN 'Der' END,
        CASE WHEN e2 AND NOT e THEN 'Que' END) AS categories FROM h),
etiquettes(r, l, n) AS (VALUES (0, 'The', 'the'), (1, 'And', 'and'), (2, 'With', 'with'), (3, 'Une', 'une'), (4, 'Que', 'que'), (5, 'Der', 'der')),
u AS (SELECT * FROM g WHERE categories = ''),
mots AS (SELECT conv_id, turn, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM u),
paires AS (SELECT DISTINCT x, n FROM (SELECT t AS x FROM u UNION SELECT w FROM mots WHERE w <> ''), etiquettes
  WHERE 2.0 * least(length(x), length(n)) / (length(x) + length(n)) >= 0.35),
blocs(x, n, a, b, k) AS (
  SELECT x, n, n, x, 0::bigint FROM paires UNION ALL
  SELECT x, n, c.a, c.b, c.k FROM (SELECT x, n, unnest([
      {{'a': substring(a, 1, m.i - 1), 'b': substring(b, 1, j - 1), 'k': -m.k}},
      {{'a': substring(a, m.i - m.k), 'b': substring(b, j - m.k), 'k': 0}}]) AS c
    FROM (SELECT *, strpos(b, substring(a, m.i, -m.k)) AS j FROM (
      SELECT x, n, a, b, list_sort(flatten([[{{'k': -k, 'i': i}} FOR k IN range(1, length(a) - i + 2) IF contains(b, substring(a, i, k))]
        FOR i IN range(1, length(a) + 1)]))[1] AS m FROM blocs WHERE a <> '' AND b <> '') WHERE m IS NOT NULL))),
ratios AS (SELECT x, n, 2.0 * sum(k) / (length(x) + length(n)) AS s FROM blocs GROUP BY x, n),
entier AS (
  SELECT conv_id, turn, array_to_string(list(l ORDER BY s DESC, n DESC)[1:6], ' | ') AS p
  FROM u JOIN ratios ON x = t JOIN etiquettes USING (n) WHERE s >= 0.35 GROUP BY ALL),
parmot AS (
  SELECT conv_id, turn, i, array_to_string(list(l ORDER BY s DESC, n DESC)[1:3], ' | ') AS p
  FROM mots JOIN ratios ON x = w JOIN etiquettes USING (n) WHERE s >= 0.6 GROUP BY ALL),
premier AS (SELECT conv_id, turn, arg_min(p, i) AS p FROM parmot GROUP BY ALL)
"""

ORACLE |= {
    "normalize_message": _MESSAGES + "SELECT conv_id, turn, t AS texte FROM m",
    "message_categories": _MESSAGES + "SELECT conv_id, turn, categories FROM g",
    "message_labels": _MESSAGES
    + """, mots_vus AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s&+-]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS label FROM benchmark),
  dim AS (SELECT label FROM mots_vus WHERE length(label) >= 4),
  phrases AS (SELECT label AS phrase, 0 AS kind, '' AS ap, label FROM dim
    UNION ALL SELECT left(label, 6), 1, label, label FROM dim WHERE length(label) >= 8),
  vus AS (SELECT t, label, min({'k': kind, 'a': ap, 'l': label}) AS o FROM (SELECT DISTINCT t FROM m) JOIN phrases ON contains(t, phrase) GROUP BY ALL),
  listes AS (SELECT t, string_agg(label, ' | ' ORDER BY o) AS categories FROM vus GROUP BY ALL)
  SELECT conv_id, turn, coalesce(categories, '') AS categories FROM m LEFT JOIN listes USING (t)""",
    "category_suggestions": _MESSAGES
    + "SELECT u.conv_id, u.turn, coalesce(entier.p, premier.p, '') AS suggestions FROM u "
    "LEFT JOIN entier ON u.conv_id = entier.conv_id AND u.turn = entier.turn "
    "LEFT JOIN premier ON u.conv_id = premier.conv_id AND u.turn = premier.turn",
    "message_intents": _MESSAGES
    + "SELECT conv_id, turn, (contains(t, 'the') OR contains(t, 'la') OR contains(t, 'in')) AND "
    "(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END) <= 3 AS salutation, "
    "contains(t, 'of the') OR contains(t, 'de la') OR contains(t, 'in der') AS conseil_general FROM m",
    "recommend_store": after(
        "context",
        f"""
, b AS (SELECT * FROM context QUALIFY row_number() OVER (PARTITION BY categorie_standardisee
  ORDER BY indice_categorie_base_100, magasin_standardise) = 1)
SELECT b.categorie_standardisee, magasin_standardise AS magasin, indice_categorie_base_100, nb_produits, couverture_categorie_pct,
  score_confiance, note_methodologique, {r6('haut - indice_categorie_base_100')} AS ecart_indice_vs_max
FROM b JOIN (SELECT categorie_standardisee, max(indice_categorie_base_100) AS haut FROM context GROUP BY ALL) USING (categorie_standardisee)""",
    ),
    "parse_reply": after(
        "context",
        f"""
, b AS (SELECT *, row_number() OVER (PARTITION BY categorie_standardisee ORDER BY indice_categorie_base_100, magasin_standardise) AS rang,
  max(indice_categorie_base_100) OVER (PARTITION BY categorie_standardisee) AS haut FROM context),
n AS (SELECT categorie_standardisee, string_agg(magasin_standardise, ', ' ORDER BY magasin_standardise) AS magasins FROM context GROUP BY ALL)
SELECT NULL::varchar AS texte_brut, s.categorie_standardisee AS categorie, magasins, b.magasin_standardise AS magasin_recommande,
  b.indice_categorie_base_100 AS indice_recommande, b.nb_produits AS nb_produits_recommande,
  {r6('haut - b.indice_categorie_base_100')} AS ecart_indice_vs_max, '' AS reponse_courte, s.magasin_standardise AS source_magasin,
  s.indice_categorie_base_100 AS source_indice, s.nb_produits AS source_nb_produits, s.couverture_categorie_pct AS source_couverture_pct,
  s.score_confiance AS source_confiance
FROM context s JOIN b ON s.categorie_standardisee = b.categorie_standardisee AND rang = 1
     JOIN n ON n.categorie_standardisee = s.categorie_standardisee""",
    ),
    "parse_free_reply": "SELECT conv_id, turn, text AS texte_brut, NULL::varchar AS categorie, NULL::varchar AS source_magasin "
    "FROM conversations WHERE role = 'assistant'",
}
ORACLE["serving_panel"] = ORACLE["daily_panel"]
ORACLE["incremental_panel"] = ORACLE["daily_panel"]
ORACLE["incremental_variation"] = ORACLE["variation_index"]
ORACLE["incremental_inflation_category"] = ORACLE["inflation_category"]
ORACLE["incremental_inflation_global"] = ORACLE["inflation_global"]
ORACLE["product_search"] = after(
    "serving",
    "SELECT motif, nom_nettoye, magasin_standardise, jour, prix, url_produit FROM serving, "
    "(VALUES ('PLATE.*(kg|cl)$'), ('red.+plate'), ('^[o-s]ld'), ('gear|anvil'), ('1l')) v(motif) WHERE regexp_matches(nom_nettoye, '(?i)' || motif)",
)
