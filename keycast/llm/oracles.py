"""DuckDB SQL that must give the rows of the queries which SQL can express."""

from __future__ import annotations

from itertools import permutations

from keycast.llm.licences import BASE, BETWEEN, LOWER, UPPER, Settings


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licence_sql(settings: Settings = Settings()) -> str:
    """Words, document frequencies, votes and verification as relations."""
    places = ", ".join(f"({t}, {q}, {_quoted(w)})" for t, x in enumerate(settings.templates) for q, w in enumerate(x.words.split()))
    names = ", ".join(f"({t}, {_quoted(x.label)}, {len(x.words.split())}, [{', '.join(_quoted(f' {p} ') for p in x.phrases)}])" for t, x in enumerate(settings.templates))
    base = " ".join(
        f"WHEN w = {_quoted(p.split()[0])} " + " ".join(f"AND lead(w, {k}) OVER (PARTITION BY rid ORDER BY p) = {_quoted(x)}" for k, x in enumerate(p.split()) if k) + f" THEN {_quoted(label)}"
        for p, label in BASE.items()
    )
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BETWEEN}'), lambda x: x <> '') AS words FROM documents
), spread AS (
    SELECT rid, unnest(range(len(words))) AS p, translate(unnest(words), '{UPPER}', '{LOWER}') AS w FROM docs
), tw(t, q, w) AS (VALUES {places}), details(t, label, long, phrases) AS (VALUES {names}),
total AS (SELECT count(*) AS n FROM docs),
held AS (SELECT w, count(DISTINCT rid) AS n FROM spread WHERE w IN (SELECT w FROM tw) GROUP BY w),
ranked AS (
    SELECT t, w, coalesce(held.n, 0) AS n, row_number() OVER (PARTITION BY t ORDER BY coalesce(held.n, 0), w) AS r, count(*) OVER (PARTITION BY t) AS many
    FROM (SELECT DISTINCT t, w FROM tw) LEFT JOIN held USING (w)
), chosen AS (
    SELECT t, w, ln((1 + total.n)::DOUBLE / (1 + ranked.n)) + 1 AS weight FROM ranked, total WHERE r <= least({settings.most}, ceil({settings.share!r}::DOUBLE * many))
), bars AS (SELECT t, ceil({settings.agree}::DOUBLE * count(*)) AS bar, sum(weight) AS weight FROM chosen GROUP BY t),
votes AS (
    SELECT DISTINCT rid, t, w, weight, cell - k AS cell
    FROM (SELECT rid, t, w, weight, floor((p - q)::DOUBLE / {settings.grid})::INT AS cell FROM spread JOIN tw USING (w) JOIN chosen USING (t, w)), (VALUES (0), (1)) AS s(k)
), cells AS (
    SELECT rid, t, cell, sum(votes.weight) / any_value(bars.weight) AS share FROM votes JOIN bars USING (t) GROUP BY rid, t, cell HAVING count(*) >= any_value(bar)
), parts AS (
    SELECT rid, label, least(1, round(share, 6)) AS share, phrases,
        ' ' || translate(array_to_string(list_slice(words, greatest(0, cell * {settings.grid}) + 1, cell * {settings.grid} + {2 * settings.grid} + long), ' '), '{UPPER}', '{LOWER}') || ' ' AS part
    FROM cells JOIN details USING (t) JOIN docs USING (rid)
), found AS (SELECT rid, label, share FROM parts WHERE list_bool_and(list_transform(phrases, lambda x: contains(part, x)))),
base AS (SELECT rid, p, CASE {base} END AS label FROM spread),
bases AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base WHERE label IS NOT NULL GROUP BY rid),
labelled AS (
    SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
    FROM (SELECT rid, label, share FROM found UNION ALL SELECT rid, label, 1 FROM base WHERE label IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0)::DOUBLE AS score
FROM docs LEFT JOIN bases USING (rid) LEFT JOIN labelled USING (rid)
"""


# crc32 of a string, bit by bit; 3988292384 is the reversed polynomial of the standard.
_CRC32 = """xor(4294967295, list_reduce(string_to_array({text}, ''), lambda crc, c:
    list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, ascii(c)::BIGINT)), 4294967295::BIGINT))"""

TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns, {_CRC32.format(text="conv_id::VARCHAR")} % 6 AS share FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, o.share), []), list_slice(o.turns, o.share + 1, len(o.turns))) AS turns
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), starts AS (
    SELECT conv_id, list_slice(turns, 1, depth) AS prefix, depth, depth = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends FROM starts GROUP BY prefix, depth
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
), children AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), valued AS (
    SELECT linked.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(prefix[depth].text) ELSE 0 END AS saved FROM linked LEFT JOIN children USING (conv_id, depth)
), above AS (
    SELECT list_slice(prefix, 1, k) AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(depth + 1)) AS k FROM valued) GROUP BY 1
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM valued JOIN above USING (prefix)
"""


def audit_sql(filters: str = "ABCDE") -> str:
    """Flags per document, counts per order and step."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(filters))
    fails = " ".join(f"WHEN '{c}' THEN {c.lower()}" for c in filters)
    return f"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), least AS (SELECT text, min(doc_id) AS least FROM words GROUP BY text),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
    FROM words JOIN least USING (text) LEFT JOIN known USING (doc_id)
), orders(filter_order) AS (VALUES {orders}),
states AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
steps AS (
    SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS letter, a::INT + b::INT + c::INT + d::INT + e::INT AS failed,
        CASE substr(filter_order, step, 1) {fails} END AS fails,
        list_bool_or(list_transform(range(1, step), lambda k: CASE substr(filter_order, k, 1) {fails} END)) AS earlier
    FROM states, orders, (SELECT unnest(range(1, {len(filters) + 1})) AS step)
), report AS (
    SELECT part, filter_order, step, letter, sum(n) FILTER (WHERE NOT coalesce(earlier, false) AND NOT fails) AS kept, sum(n) FILTER (WHERE NOT coalesce(earlier, false) AND fails) AS removed,
        sum(n) FILTER (WHERE earlier AND fails) AS redundant, sum(n) FILTER (WHERE fails AND failed = 1) AS unique_fails,
        sum(good) FILTER (WHERE NOT coalesce(earlier, false) AND fails) AS good_lost, sum(toxic) FILTER (WHERE NOT coalesce(earlier, false) AND fails) AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM report
"""
