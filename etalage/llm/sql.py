"""SQL counterparts of operators 11 to 13."""

from __future__ import annotations

from etalage.llm.conversation_trie import BLOCK, HEADS
from etalage.llm.lexical import TOP
from etalage.llm.secrets import BASE, COPIED_OWNERS, KINDS, LIVE_CHARACTERS, PLACEHOLDER

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def secrets() -> str:
    names = list(KINDS)
    parts = []
    for kind, (pattern, group, least) in KINDS.items():
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT r, owner, repo, {names.index(kind)} AS k, '{kind}' AS kind, {least} AS least,
            unnest(range(1, len(w) + 1)) AS i, unnest(g[1:len(w)]) AS gap, unnest(w) AS whole, unnest(v) AS value
            FROM (SELECT r, owner, repo, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS w,
            regexp_extract_all(t, {p}, {group}) AS v FROM d)"""
        )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repo FROM documents),
    c AS ({" UNION ALL ".join(parts)}),
    p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM c),
    s AS (SELECT r, owner, repo, k, kind, value, CAST(e - length(whole) AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
        len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND (kind <> 'token' OR (regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')))
        AND NOT regexp_matches(lower(value), '{PLACEHOLDER}') AS alive FROM p WHERE length(value) >= least),
    o AS (SELECT value, count(DISTINCT owner) AS owners FROM s GROUP BY 1),
    j AS (SELECT s.*, CASE WHEN owners >= {COPIED_OWNERS} THEN 'example' WHEN alive THEN 'live' ELSE 'unsure' END AS verdict FROM s JOIN o USING (value)),
    f AS (SELECT * FROM j WHERE k < {len(BASE)} OR (verdict = 'live' AND NOT EXISTS
        (SELECT 1 FROM j b WHERE b.r = j.r AND b.k < {len(BASE)} AND b.s < j.e AND b.e > j.s))),
    a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
        count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM f GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN a USING (r)"""


#: The checksum of zlib over the decimal digits: a table of one entry per byte, by its rule, then a fold over the digits.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"""

CONVERSATIONS = f"""
    WITH RECURSIVE tab AS (SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) FOR i IN range(256)] AS crc),
    own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS t
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
    h AS (SELECT conv_id, t, {_CRC} % {HEADS} AS h FROM own, tab),
    r AS (SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % {BLOCK}),
    p AS (SELECT conv_id, len(t) AS size, unnest(range(len(t) + 1)) AS depth, t FROM r),
    q AS (SELECT conv_id, size, depth, md5(t[1:depth]::VARCHAR || depth) AS node, CASE WHEN depth > 0 THEN md5(t[1:depth - 1]::VARCHAR || (depth - 1)) END AS parent,
        CASE WHEN depth > 0 THEN len(regexp_extract_all(t[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM p),
    n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM q GROUP BY 1),
    k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
    up(node, leaf, saved, parent) AS (SELECT node, (n_children = 0)::BIGINT, saved, parent FROM m
        UNION ALL SELECT m.node, up.leaf, up.saved, m.parent FROM up JOIN m ON up.parent = m.node),
    u AS (SELECT node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1)
    SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN u USING (node) LEFT JOIN m a ON m.parent = a.node"""

LEXICAL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
    s AS (SELECT count(*) AS N, sum(len(t))::BIGINT AS L FROM d WHERE len(t) > 0),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    m AS (SELECT r, doc_id, 25 + (75 * len(t)::BIGINT * N) // L AS m FROM d, s WHERE len(t) > 0),
    x AS (SELECT item_id, doc_id, r, CAST(sum(c * floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM i JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r), s WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3),
    k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
    SELECT * FROM k WHERE rank <= {TOP}"""
