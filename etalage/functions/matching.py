"""Matching tokens and keys, unit prices, scores and the comparability class.

The rules are CASE tables, written as SQL text over column names (or any SQL
expression): ``quantity("_texte", "_pieces")``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from etalage import vocab
from etalage.functions.text import drop_words


def _half_up2(value: str) -> str:
    return f"floor(({value}) * 100D + 0.5D) / 100D"


def _stated(total: str) -> str:
    """A quantity is stated: present and not zero."""
    return f"coalesce({total} <> 0, false)"


def _unit_case(unit: str, position: int) -> str:
    def sql(value: str | float) -> str:
        return f"'{value}'" if isinstance(value, str) else f"{value}D"

    lines = " ".join(f"WHEN '{u}' THEN {sql(spec[position])}" for u, spec in vocab.UNITS.items())
    return f"CASE {unit} {lines} END"


def found_quantity(text: str) -> Column:
    """The text piece that states the quantity: a pack, else the last plain quantity.

    ``text`` is the spelled, unaccented raw and cleaned name.  '' when there is none.
    """
    pack = f"regexp_extract({text}, r'{vocab.PACK_QUANTITY}', 0)"
    plain = f"regexp_extract_all({text}, r'{vocab.SINGLE_QUANTITY}', 0)"
    return F.expr(f"coalesce(nullif({pack}, ''), try_element_at({plain}, -1), '')")


def quantity(found: str, pieces: str) -> Column:
    """Quantity record from ``found_quantity`` and the first stated number of pieces."""
    count = (
        f"coalesce(try_cast(nullif(regexp_extract({found}, r'{vocab.PACK_QUANTITY}', 1), '')"
        " AS BIGINT), 1L)"
    )
    amount = f"try_cast(regexp_extract({found}, r'{vocab.SINGLE_QUANTITY}', 1) AS DOUBLE)"
    unit = f"regexp_extract({found}, r'{vocab.SINGLE_QUANTITY}', 2)"
    total = f"({count} * ({amount} * {_unit_case(unit, 2)}))"
    number = f"try_cast({pieces} AS BIGINT)"
    label = (
        f"concat(CASE WHEN {total} = floor({total}) THEN string(bigint({total})) "
        f"ELSE regexp_replace(format_string('%.3f', {total}), r'\\.?0+$', '') END, "
        f"{_unit_case(unit, 1)})"
    )

    def record(*values: str) -> str:
        names = (
            "pack_count", "quantite_par_pack", "unite_par_pack", "quantite_totale",
            "unite_reference", "famille_unite", "quantite_label",
        )
        return f"named_struct({', '.join(f"'{n}', {v}" for n, v in zip(names, values))})"

    measured = record(
        count, amount, unit, total, _unit_case(unit, 1), _unit_case(unit, 0), label
    )
    counted = record(
        number, "1D", "'piece'", f"double({number})", "'piece'", "'count'",
        f"concat(string({number}), 'piece')",
    )
    absent = record("1L", "double(NULL)", "''", "double(NULL)", "''", "''", "''")
    return F.expr(
        f"CASE WHEN {found} <> '' THEN {measured} WHEN {number} IS NOT NULL THEN {counted} "
        f"ELSE {absent} END"
    )


def token_text(cleaned: Column) -> Column:
    """Cleaned name without quantities, counts, weak words and one-letter words."""
    out = F.regexp_replace(cleaned, vocab.SINGLE_QUANTITY, " ")
    out = F.regexp_replace(out, vocab.PIECE_COUNT, " ")
    return drop_words(out, vocab.WEAK_WORDS, single_chars=True)


def tokens_of(text: str) -> Column:
    """Sorted tokens, repeats kept, of a text made by ``token_text``."""
    return F.expr(
        f"CASE WHEN {text} = '' THEN cast(array() AS array<string>) "
        f"ELSE sort_array(split({text}, ' ')) END"
    )


def broad_key(tokens: str) -> Column:
    return F.array_join(tokens, "|")


def exact_key(broad: str, label: str) -> Column:
    return F.expr(f"CASE WHEN {label} <> '' THEN concat({broad}, '__', {label}) ELSE {broad} END")


def brand_guess(tokens: str) -> Column:
    """First token, or the second when the first has one or two characters."""
    first, second = f"try_element_at({tokens}, 1)", f"try_element_at({tokens}, 2)"
    return F.expr(
        f"coalesce(CASE WHEN length({first}) <= 2 THEN coalesce({second}, {first}) "
        f"ELSE {first} END, '')"
    )


def price_per_kg_or_l(price: str, total: str, family: str) -> Column:
    return F.expr(
        f"CASE WHEN {family} IN ('mass', 'volume') AND {_stated(total)} "
        f"THEN {_half_up2(f'try_divide({price}, {total} / 1000D)')} END"
    )


def price_per_piece(price: str, total: str, family: str, packs: str) -> Column:
    return F.expr(
        f"CASE WHEN {family} = 'count' AND {_stated(total)} "
        f"THEN {_half_up2(f'try_divide({price}, {total})')} "
        f"WHEN NOT ({family} IN ('mass', 'volume') AND {_stated(total)}) AND {packs} > 1 "
        f"THEN {_half_up2(f'try_divide({price}, double({packs}))')} END"
    )


def match_quality(nb_tokens: str, total: str) -> Column:
    return F.expr(
        f"CASE WHEN {nb_tokens} >= 3 AND {_stated(total)} THEN 'elevee' "
        f"WHEN {nb_tokens} >= 2 THEN 'moyenne' ELSE 'faible' END"
    )


def match_score(nb_tokens: str, total: str, packs: str, price: str) -> Column:
    """Up to 3 for the words, 2 for a quantity or else 1 for a pack, 1 for a price."""
    return F.expr(
        f"bigint((CASE WHEN {nb_tokens} >= 4 THEN 3 WHEN {nb_tokens} >= 3 THEN 2 "
        f"WHEN {nb_tokens} >= 2 THEN 1 ELSE 0 END) "
        f"+ (CASE WHEN {_stated(total)} THEN 2 WHEN {packs} > 1 THEN 1 ELSE 0 END) "
        f"+ (CASE WHEN {price} > 0 THEN 1 ELSE 0 END))"
    )


def price_type(per_kg_or_l: str, per_piece: str) -> Column:
    return F.expr(
        f"CASE WHEN {per_kg_or_l} IS NOT NULL THEN 'unit_kg_l' "
        f"WHEN {per_piece} IS NOT NULL THEN 'unit_piece' ELSE 'raw_price' END"
    )


def comparability(
    nb_tokens: str, total: str, packs: str, quality: str, kind: str, score: str
) -> Column:
    """Status and reason; the first matching line decides."""
    unit_price = (
        f"{kind} IN ('unit_kg_l', 'unit_piece') AND ({_stated(total)} OR coalesce({packs} > 1, false))"
    )
    table = (
        (f"{nb_tokens} = 1 AND {_stated(total)}", "a_revoir", "produit_monotoken_quantifie"),
        (f"{nb_tokens} < 2 OR {quality} = 'faible'", "non_comparable", "matching_trop_faible"),
        (f"{unit_price} AND {score} >= 4", "comparable_normalise", "comparaison_unitaire_fiable"),
        (unit_price, "a_revoir", "comparaison_unitaire_peu_documentee"),
        (
            f"{kind} = 'raw_price' AND {quality} = 'elevee' AND {nb_tokens} >= 3",
            "comparable_brut",
            "comparaison_par_prix_affiche",
        ),
        (f"{kind} = 'raw_price'", "a_revoir", "prix_brut_sans_quantite"),
        ("true", "a_revoir", "informations_incompletes"),
    )
    lines = " ".join(
        f"WHEN {test} THEN named_struct('statut', '{status}', 'motif', '{reason}')"
        for test, status, reason in table
    )
    return F.expr(f"CASE {lines} END")
