"""SQL for another engine that computes what a query returns; values are written out here."""

from __future__ import annotations

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# kind, order, regex, group that decides, least characters of it.
SECRETS = (
    ("assign", 0, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 2, r"[0-9a-f]+", 0, 24),
    ("github", 3, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("google", 4, r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("pemkey", 5, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("slack", 6, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def matches_sql(kind: str, order: int, regex: str, group: int, condition: str) -> str:
    """Rows doc_id, kind, place, start, finish of one regex over the table ``texts``.

    ``condition`` may use m, the match, and g, its deciding group.
    """
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS place, start, start + length(m) AS finish FROM (
      SELECT doc_id, m, g,
        list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT
        + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
      FROM (
        SELECT *, unnest(found) AS m, unnest(groups) AS g, unnest(range(1, len(found) + 1)) AS i
        FROM (
          SELECT doc_id, regexp_extract_all(body, '{regex}', 0) AS found,
            regexp_extract_all(body, '{regex}', {group}) AS groups,
            string_split_regex(body, '{regex}') AS pieces
          FROM texts)))
    WHERE {condition}"""


def secrets_sql() -> str:
    spans = "\n    UNION ALL".join(
        matches_sql(kind, order, regex, group, f"length(g) >= {least}")
        for kind, order, regex, group, least in SECRETS
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce("text", '') AS body FROM documents),
spans AS ({spans}),
folded AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) AS spans,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) FILTER (place < 3) AS base
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN folded USING (doc_id)"""


URL_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {A_Z}) AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (
  SELECT u.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS place
  FROM urls u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN (FROM fits WHERE place = 1) f USING (page_id)"""

LINES_SQL = """
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(coalesce("text", ''), chr(10))) AS piece,
    generate_subscripts(string_split(coalesce("text", ''), chr(10)), 1) AS line FROM documents),
lines AS (SELECT *, trim(piece, ' ' || chr(9) || chr(13)) AS content FROM pieces),
spread AS (
  SELECT content, min((doc_id, line)) AS first FROM lines WHERE content <> ''
  GROUP BY content HAVING count(DISTINCT coalesce(source, chr(0))) >= 5),
marked AS (
  SELECT l.*, s.first IS NOT NULL AND s.first <> (l.doc_id, l.line) AS removed
  FROM lines l LEFT JOIN spread s USING (content))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
  sha256(coalesce(string_agg(piece, chr(10) ORDER BY line) FILTER (NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

REPEATS_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS start,
    unnest(list_transform(range(1, len(words) - 11), lambda i: words[i:i + 12])) AS win
  FROM texts WHERE len(words) >= 13),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
hits AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS place
  FROM windows JOIN firsts USING (win) WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
counted AS (
  SELECT p.doc_id, count(*) AS n_words, count(h.place) AS n_removed,
    string_agg(p.word, ' ' ORDER BY p.place) FILTER (h.place IS NULL) AS kept
  FROM placed p LEFT JOIN hits h ON p.doc_id = h.doc_id AND p.place = h.place GROUP BY p.doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN counted USING (doc_id)"""

BENCHMARK_SQL = rf"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce("text", ''), {A_Z}),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce("text", ''), {A_Z}),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
sought AS (
  SELECT DISTINCT item_id, win, len(win) AS size FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(words) - 8, 2)), lambda i: words[i:i + 9])) AS win
    FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM sought),
starts AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM texts, sizes
  WHERE len(words) >= size),
found AS (
  SELECT doc_id, start, size, item_id
  FROM (SELECT doc_id, start, size, words[start:start + size - 1] AS win FROM starts) JOIN sought USING (win, size)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
    SELECT doc_id, unnest(range(start, start + size)) AS place FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT t.doc_id, len(t.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, role AS given, coalesce("text", '') AS body FROM conversations
  UNION ALL SELECT -1, 0, 'user', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]'),
control AS (SELECT *,
  length(regexp_replace(body, '([<\[])(\\*)((?:/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|/TURN\]))', '\1\\\2\3', 'g')) AS body_size,
  length(regexp_replace(role, '([<\[])(\\*)((?:/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|/TURN\]))', '\1\\\2\3', 'g')) AS role_size
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, given NULLS FIRST, body)) AS turns_sha256,
  coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(body_size + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11 ELSE 7 + role_size + 9 + 8 END))::BIGINT
    AS formatted_chars
FROM control GROUP BY conv_id"""

PHRASES_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce("text", ''), {A_Z}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, phrase, k AS size, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_phrases AS (
  SELECT DISTINCT lang, a, unnest(flatten(list_transform(range(2, size), lambda m:
    list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase
  FROM candidates WHERE size > 2),
cuts AS (
  SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS cut FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = c.lang AND i.phrase = c.phrase AND i.a >= c.a)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.c AS l, r.c AS r, t.n,
    ((1000::HUGEINT * c.a * t.n) // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:c.size], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM best)
SELECT lang, place AS "rank", phrase, a, l, r, n, score FROM placed WHERE place <= 2000"""

ORACLES: dict[str, str] = {
    "op2_secret_scan": secrets_sql(),
    "op6_url_filter": URL_SQL,
    "op8_line_dedup": LINES_SQL,
    "op9_substring_dedup": REPEATS_SQL,
    "op10_benchmark_decontamination": BENCHMARK_SQL,
    "op11_collocations": PHRASES_SQL,
    "op13_chat_formatting": CHAT_SQL,
}
