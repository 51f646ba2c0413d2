"""Product search by an index of trigrams.

Distinct names are filed under their grams of three characters.  A pattern's literal parts say which
grams every match must hold: names filed under all of them are candidates, and the pattern
itself decides.  A pattern without such parts is matched against all distinct names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etalage.session import shared_folder

GRAM = 3
#: Names with other than ASCII characters are filed here: their letters may match in more than two cases.
OTHER = ""


def required_literals(pattern: str) -> list[str]:
    """Texts that every match of the pattern holds, in lower case; none where that is not certain.

    Only what stands at the outermost level counts: groups, classes and escapes end a text, a
    quantifier takes back the character before it, a choice at that level leaves nothing.
    """
    if "\\Q" in pattern or "(?" in pattern:
        return []
    found, run, at = [], "", 0

    def closing(start: int, stop: str) -> int:
        """The place after a class or group that starts here."""
        place = start + 1
        if stop == "]":
            place += pattern[place : place + 1] == "^"
            place += pattern[place : place + 1] == "]"
        while place < len(pattern) and pattern[place] != stop:
            if pattern[place] == "\\":
                place += 1
            elif pattern[place] == "[":
                place = closing(place, "]") - 1
            elif pattern[place] == "(" and stop == ")":
                place = closing(place, ")") - 1
            place += 1
        return place + 1

    while at < len(pattern):
        char = pattern[at]
        if char == "|":
            return []
        if char == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            run, at = run + pattern[at + 1], at + 2
            continue
        if char in "*?{":
            run = run[:-1]
        if char in "\\.^$[(*?+{":
            found, run = [*found, run], ""
            at = at + 2 if char == "\\" else closing(at, {"[": "]", "(": ")", "{": "}"}[char]) if char in "[({" else at + 1
            continue
        run, at = run + char, at + 1
    return [text.lower() for text in [*found, run] if text.isascii() and text]


def required_grams(pattern: str) -> list[str]:
    """The grams every match of the pattern holds."""
    return sorted({text[k : k + GRAM] for text in required_literals(pattern) for k in range(len(text) - GRAM + 1)})


def index_names(df: DataFrame, column: str) -> DataFrame:
    """(gram, nom): the postings of the distinct names, written in the order of the grams.

    Sorted files let a search read only the row groups of its grams.
    """
    names = df.select(F.coalesce(F.col(column), F.lit("")).alias("nom")).distinct()
    starts = F.sequence(F.lit(1), F.length("nom") - GRAM + 1)
    grams = F.array_distinct(F.transform(starts, lambda k: F.substring(F.lower("nom"), k, F.lit(GRAM))))
    filed = F.when(F.col("nom").rlike(r"[^\x00-\x7f]"), F.array(F.lit(OTHER))).when(F.length("nom") >= GRAM, grams)
    path = shared_folder(df.sparkSession, "postings")
    postings = names.select(F.explode(filed).alias("gram"), "nom")
    postings.repartitionByRange("gram", "nom").sortWithinPartitions("gram", "nom").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def matching_names(df: DataFrame, index: DataFrame, term: str, column: str) -> DataFrame:
    """(nom): the distinct names that match the pattern in any case."""
    grams = required_grams(term)
    if grams:
        filed = index.where(F.col("gram").isin(*grams)).groupBy("nom").agg(F.count(F.lit(1)).alias("_n"))
        names = filed.where(F.col("_n") == len(grams)).select("nom").union(index.where(F.col("gram") == OTHER).select("nom"))
    else:
        names = df.select(F.coalesce(F.col(column), F.lit("")).alias("nom")).distinct()
    return names.where(F.col("nom").rlike(f"(?iu){term}"))


def search_index(df: DataFrame, index: DataFrame, term: str, column: str = "nom_nettoye") -> DataFrame:
    """Rows whose name matches the pattern in any case, as by a scan; a null name is an empty one."""
    found = matching_names(df, index, term, column)
    return df.join(found, F.coalesce(F.col(column), F.lit("")) == F.col("nom"), "left_semi")
