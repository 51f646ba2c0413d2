import re

import pytest
from pyspark.sql import functions as F

from etalage.plans import compare, search

NAMES = [
    "red plate 500g", "Red Plate 1,5l", "old gear", "OLD GEAR x6", "", None, "ab", "abc", "pâté plate", "straſse plate",
    "\u212aelvin plate", "a+b (c) plate", "red\nplate", "plaate", "plte", "1l",
]
PATTERNS = [
    "plate", "PLATE", "pla+te", "pla?te", "pla*te", "pla{0,2}te", "red.*plate", "^red", "plate$", "gear|anvil", "(gear|plate)", "x[0-9]",
    r"a\\+b \\(c\\)", "", ".", "str.sse", "strasse", "kelvin", "(?s)red.plate", r"\\bplate", "[]a]bc", "[^]]bc", "(a(b)c|[)]x)", "1l", "ab", r"\\Qa+b\\E", "pâté",
]


@pytest.mark.parametrize("chunk", [PATTERNS[0::2], PATTERNS[1::2]])
def test_the_index_finds_what_a_scan_finds(spark, chunk):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(NAMES)] + [(99, NAMES[0])], "i int, nom_nettoye string")
    df = df.withColumn("nom", F.lit("x"))
    index = search.index_names(df, "nom_nettoye").cache()
    for pattern in [p.replace("\\\\", "\\") for p in chunk]:
        scan = sorted(r.i for r in compare.search_products(df, pattern).collect())
        assert sorted(r.i for r in search.search_index(df.drop("nom"), index, pattern).collect()) == scan, pattern


def test_required_literals():
    want = {
        "plate": ["plate"], "red.*Plate": ["red", "plate"], "pla+te": ["pla", "te"], "pla?te": ["pl", "te"], "a|bcd": [], "(abc)def": ["def"],
        r"ab\.cd": ["ab.cd"], r"ab\dcd": ["ab", "cd"], "[abc]def{2}gh": ["de", "gh"], "(?i)abc": [], "é": [], "[]]abc": ["abc"], r"[\]x]abc": ["abc"],
    }
    assert {p: search.required_literals(p) for p in want} == want
    for pattern, parts in want.items():
        assert re.compile(pattern) and all(len(g) == 3 for g in search.required_grams(pattern)) and parts is not None
