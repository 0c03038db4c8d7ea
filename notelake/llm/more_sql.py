"""DuckDB equivalents of the license, repair and ranked-search queries."""

from __future__ import annotations

from math import ceil

from .license_scan import PHRASES, STRIDE, TEMPLATES, THRESHOLD

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def license_sql(threshold: float = THRESHOLD) -> str:
    """Every block against every template, and every place of every phrase."""
    phrases = ", ".join(f"({_list(p.split())}, {_text(label)})" for p, label in PHRASES)
    sets = [(label, sorted(set(t.split()))) for label, t in TEMPLATES]
    templates = ", ".join(f"({_list(s)}, {_text(label)}, {ceil(threshold * len(s) - 1e-9)})" for label, s in sets)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
             p(p, label) AS (VALUES {phrases}),
             t(t, label, need) AS (VALUES {templates}),
             s AS (SELECT r, p, label, w, unnest(range(0, len(w) - len(p) + 1)) AS pl FROM d, p WHERE len(list_intersect(w, p)) = len(p)),
             h AS (SELECT r, label, pl FROM s WHERE list_slice(w, pl + 1, pl + len(p)) = p),
             b AS (SELECT r, unnest(range(0, CAST(ceil(len(w) / {STRIDE}.0) AS BIGINT))) AS b, w FROM d),
             v AS (SELECT list_distinct(flatten(list(t))) AS v FROM t),
             e AS (SELECT r, list_intersect(list_slice(w, b * {STRIDE} + 1, b * {STRIDE} + {2 * STRIDE}), v) AS e FROM b, v),
             m AS (SELECT r, label, len(list_intersect(e, t)) / len(t) AS c FROM e, t WHERE len(e) >= need AND len(list_intersect(e, t)) >= need),
             x AS (SELECT r, count(*) AS n, min(pl) AS lo, max(pl) AS hi, list_distinct(list(label)) AS l FROM h GROUP BY r),
             y AS (SELECT r, max(c) AS c, list_distinct(list(label)) AS l FROM m GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
          coalesce(array_to_string(list_sort(x.l), ','), '') AS base_labels,
          array_to_string(list_sort(list_distinct(list_concat(coalesce(x.l, []), coalesce(y.l, [])))), ',') AS labels,
          CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
        FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
    """


def _repair_sql() -> str:
    """A fold over each conversation's rows: of every state the least text of padded cost and audit.

    States are 1 nothing written, 2 a system row, 3 ending in a user's, 4 ending in an assistant's.
    """
    add = lambda x, cost, edit: f"printf('%09d', CAST(substr({x}, 1, 9) AS INTEGER) + {cost}) || substr({x}, 10) || '{edit}'"

    def inserted(s: str) -> str:
        once = f"[{s}[1], {s}[2], least({s}[3], {add(f'{s}[1]', 3, 'I')}, {add(f'{s}[2]', 3, 'I')}, {add(f'{s}[4]', 3, 'I')}), least({s}[4], {add(f'{s}[3]', 3, 'I')})]"
        return f"list_transform([{once}], lambda z: [z[1], z[2], least(z[3], {add('z[1]', 3, 'I')}, {add('z[2]', 3, 'I')}, {add('z[4]', 3, 'I')}), least(z[4], {add('z[3]', 3, 'I')})])[1]"

    def step(s: str, r: str) -> str:
        dead, cut = f"{r}[1] IN ('b', 'd')", f"(CASE WHEN {r}[1] = 't' THEN 3 ELSE 0 END)"
        keep = lambda role, x: f"CASE WHEN NOT {dead} AND {r}[2] = '{role}' THEN {add(x, cut, 'K')} END"
        role = lambda x: f"CASE WHEN NOT {dead} THEN {add(x, f'3 + {cut}', 'R')} END"
        to_user = ", ".join(f"{keep('u', f'{s}[{i}]')}, {role(f'{s}[{i}]')}" for i in (1, 2, 4))
        gone = [add(f"{s}[{i}]", 4, "D") for i in (1, 2, 3, 4)]
        return f"[{gone[0]}, least({gone[1]}, {keep('s', f'{s}[1]')}), least({gone[2]}, {to_user}), least({gone[3]}, {keep('a', f'{s}[3]')}, {role(f'{s}[3]')})]"

    white = r"[^\x20\x09-\x0D]"
    return rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
             t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8),
                     lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t),
             k AS (SELECT c.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                     lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295), 4294967295) % 20 AS k FROM c, t),
             g AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                     CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0),
             o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM g),
             f AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '{white}') THEN 'b'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'k' ELSE 't' END AS f,
                     lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM o),
             l AS (SELECT conv_id, list([f, r] ORDER BY i) AS l, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
                     count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                     coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
             s AS (SELECT l.*, list_reduce(l, lambda s, r: list_transform([{step("s", "r")}], lambda y: {inserted("y")})[1],
                     {inserted("['000000000', NULL, NULL, NULL]")}) AS s FROM l),
             a AS (SELECT * EXCLUDE (s, l), CAST(substr(least(s[1], s[4]), 1, 9) AS BIGINT) AS cost, substr(least(s[1], s[4]), 10) AS audit FROM s),
             u AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, len(audit) + 1)) AS p FROM a WHERE audit <> ''),
             n AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
                     count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS q FROM u),
             w AS (SELECT n.conv_id, e, p, q, role, text, max(CASE WHEN q = 1 AND e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS lead
                   FROM n LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i AND e <> 'I'),
             z AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (q - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
                     chr(10) ORDER BY p)) AS h FROM w WHERE e <> 'D' GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
          coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id
    """


LICENSE_SQL = license_sql()
REPAIR_SQL = _repair_sql()
RANKED_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
         b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
         x AS (SELECT q, unnest(w) AS t FROM b),
         i AS (SELECT q, t, count(*) AS times FROM x GROUP BY ALL),
         y AS (SELECT r, unnest(w) AS t FROM d),
         p AS (SELECT r, t, count(*) AS tf FROM y SEMI JOIN i USING (t) GROUP BY ALL),
         c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
         g AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t, n),
         m AS (SELECT r, doc_id, 75 + (25 * len(w) * n) // l AS m FROM d, c WHERE len(w) > 0),
         s AS (SELECT q, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
               FROM i JOIN p USING (t) JOIN g USING (t) JOIN m USING (r) GROUP BY q, r, doc_id),
         k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 20
"""
