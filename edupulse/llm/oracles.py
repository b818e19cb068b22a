"""SQL that gives the rows of the queries where SQL can express them."""

from __future__ import annotations

from edupulse.llm import decontamination, hard_negatives, prefix_trie, quality_rules, sharding, substrings, url_filters

_BLANK = r"\x20\x09-\x0D"


def _substrings() -> str:
    size = substrings.WINDOW
    return rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS words FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + {size - 1}], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {size - 2})) AS p FROM split)),
earliest AS (SELECT k, min(doc_id) AS source FROM windows GROUP BY k),
hit AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {size})) AS spot
  FROM windows JOIN earliest USING (k) WHERE doc_id > source),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM split),
kept AS (
  SELECT placed.doc_id, count(hit.spot) AS n_removed, string_agg(word, ' ' ORDER BY placed.spot) FILTER (hit.spot IS NULL) AS text
  FROM placed LEFT JOIN hit ON placed.doc_id = hit.doc_id AND placed.spot = hit.spot GROUP BY placed.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""


def _decontamination() -> str:
    size = decontamination.WINDOW
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH split AS (SELECT doc_id, {words} AS words FROM documents),
items AS (SELECT item_id, words, least({size}, len(words)) AS size FROM (SELECT item_id, {words} AS words FROM benchmark) WHERE len(words) > 0),
wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(words[p:p + size - 1], ' ') AS k
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM items)),
windows AS (
  SELECT doc_id, size, p, array_to_string(words[p:p + size - 1], ' ') AS k
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
        FROM split, (SELECT DISTINCT size FROM wanted) WHERE len(words) >= size)),
found AS (SELECT doc_id, item_id, p, windows.size FROM windows JOIN wanted USING (size, k)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS spot FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _quality_rules() -> str:
    q = quality_rules
    rates = {"symbols": ("n_symbols", "n_words"), "capitals": ("n_capitals", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    value = {r: f"(CASE WHEN {b} > 0 THEN {a} * 1000 // {b} ELSE 0 END)" for r, (a, b) in rates.items()}
    values = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {v} AS value FROM judged WHERE NOT base_failed" for r, v in value.items())
    grid = ", ".join(f"({i}, {c})" for i, c in enumerate(q.GRID))
    share = q.RISK / len(q.RULES)
    over = " OR ".join(f"coalesce({v} >= max(cutoff) FILTER (rule = '{r}'), false)" for r, v in value.items())
    base = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_capitals, n_lines"
    return rf"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 2], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM split)),
again AS (
  SELECT doc_id, count(DISTINCT spot) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 3)) AS spot
    FROM windows JOIN (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1) USING (doc_id, k)) GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(again.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS n_capitals, len(lines) AS n_lines
  FROM split LEFT JOIN again USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
good AS (
  SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL
  GROUP BY doc_id HAVING min(quality) = max(quality)),
rated AS (SELECT coalesce(lang, '') AS stratum, rule, value, good FROM ({values}) JOIN good USING (doc_id)),
grid(step, cutoff) AS (VALUES {grid}),
counted AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (good = 1) AS n,
    count(*) FILTER (good = 1 AND value >= cutoff) AS lost, count(*) FILTER (good = 0 AND value >= cutoff) AS won
  FROM rated, grid GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN lost <= floor(n * {share!r}) AND lost < n THEN list_sum(list_transform(range(0, lost + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r}))))
      <= {q.LEVEL!r} / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM rated)) ELSE false END AS fine
  FROM counted),
valid AS (SELECT *, bool_and(fine) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM tested),
chosen AS (
  SELECT stratum, rule, cutoff FROM valid WHERE ok AND won > {q.PENALTY} * lost
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY won - {q.PENALTY} * lost DESC, step) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over}) AS kept
FROM judged LEFT JOIN chosen ON stratum = coalesce(lang, '') GROUP BY {base}, lang"""


def _sharding() -> str:
    s = sharding
    prime, by = s._PRIME, s._MULTIPLIER

    def network(source: str) -> str:
        """``source``: rows (id, x, n, w); the same with x sent through the network once."""
        out = f"(SELECT id, n, w, x >> w AS l, x & ((1 << w) - 1) AS r FROM {source})"
        for key in s.round_keys():
            mixed = f"((r * {by} + {key}) % {prime})"
            out = f"(SELECT id, n, w, r AS l, xor(l, ({mixed} * {mixed} % {prime}) & ((1 << w) - 1)) AS r FROM {out})"
        return f"(SELECT id, (l << w) | r AS x, n, w FROM {out})"

    return f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
{_CRC_ENTRY},
summed AS (
  SELECT doc_id, n_bytes + 1 AS size,
    {_CRC} AS text_crc32
  FROM bytes, entry),
numbered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id, count(*) OVER () AS n FROM summed),
walk AS (
  SELECT id, x, n, w FROM {network("(SELECT id, id AS x, n, greatest(2, (length(bin(greatest(n - 1, 1))) + 1) // 2)::BIGINT AS w FROM numbered)")}
  UNION ALL SELECT id, x, n, w FROM {network("(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {s.SHARDS})::INT AS shard, (x // {s.SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN walk USING (id) WHERE x < walk.n"""


# CRC32 of each row's hexadecimal ``h`` of ``n_bytes`` bytes, by the table of the reflected polynomial in CTE ``entry``.
_CRC_ENTRY = """entry AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(n_bytes), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _prefix_trie() -> str:
    t = prefix_trie
    return f"""
WITH {_CRC_ENTRY},
turns AS (
  SELECT conv_id, turn, md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, ''))) AS k, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(size ORDER BY turn NULLS FIRST, k) AS sizes FROM turns GROUP BY conv_id),
taken AS (
  SELECT conv_id, ({_CRC} % {t.HEAD_TURNS})::INT AS h
  FROM (SELECT conv_id, length(conv_id::VARCHAR) AS n_bytes, hex(encode(conv_id::VARCHAR)) AS h FROM own), entry),
rebuilt AS (
  SELECT own.conv_id, list_concat(coalesce(base.ks, [])[:h], own.ks[h + 1:]) AS ks, list_concat(coalesce(base.sizes, [])[:h], own.sizes[h + 1:]) AS sizes
  FROM own JOIN taken USING (conv_id) LEFT JOIN own AS base ON base.conv_id = own.conv_id - own.conv_id % {t.SHARED}),
prefixes AS (
  SELECT conv_id, d, array_to_string(ks[:d], '') AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, len(ks) = d AS ended
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends
  FROM prefixes GROUP BY path, d),
children AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT left(path, 32 * a) AS path, sum((n - 1) * size) AS saved, sum((kids = 0)::INT) AS leaves
  FROM (SELECT nodes.*, coalesce(children.n, 0) AS kids, unnest(range(0, d + 1)) AS a FROM nodes LEFT JOIN children USING (path)) GROUP BY ALL)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, nodes.n::BIGINT AS n_convs, coalesce(children.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN below USING (path) LEFT JOIN children USING (path)
LEFT JOIN nodes AS parent ON nodes.d > 0 AND parent.path = left(nodes.path, 32 * (nodes.d - 1))"""


def _hard_negatives() -> str:
    h = hard_negatives
    return f"""
WITH packed AS (
  SELECT vec_id, CASE WHEN vec_id % {h.RELABEL_EVERY} = 0 THEN (label + 1) % {h.LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({h.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM packed a, packed c WHERE a.vec_id % {h.ANCHOR_EVERY} = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {h.POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND {h.LOWEST} * positive_score <= 100 * score AND 100 * score <= {h.HIGHEST} * positive_score
QUALIFY rank <= {h.NEGATIVES}"""


def _url_filters() -> str:
    u = url_filters
    upper, lower = u._UPPER, u._LOWER

    def part(group: int) -> str:
        return rf"regexp_extract(coalesce(url, ''), '(?s)^(.*?)://([^/?#]*)([^?#]*)(.*)$', {group})"

    marked = ", ".join(
        rf"list_transform(list_filter(string_split_regex(translate({part(g)}, '{upper}', '{lower}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: '{m}:' || w)"
        for m, g in (("s", 1), ("h", 2), ("p", 3), ("q", 4)))
    rules = sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in rules]
    name = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " END"
    said = "CASE " + " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, rules, strict=True)) + " END"
    return rf"""
WITH told AS (
  SELECT *, {name} AS rule, {said} AS said FROM (
    SELECT page_id, url, translate({part(2)}, '{upper}', '{lower}') AS host, {part(3)} AS path, list_distinct(flatten([{marked}])) AS words FROM pages)),
bad AS (
  SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS blocked FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
labelled AS (SELECT words, blocked FROM told JOIN bad ON doc_id = try_cast(regexp_extract(path, '([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1) AS BIGINT)),
least AS (SELECT greatest({u.LEAST}, ceil({round(u.SHARE * 10_000)} * count(*) / 10000)) AS t FROM labelled),
frequent AS (SELECT list(word) AS f FROM (SELECT word FROM (SELECT unnest(words) AS word FROM labelled) GROUP BY word HAVING count(*) >= (SELECT t FROM least))),
held AS (SELECT list_sort(list_filter(words, lambda w: list_contains(f, w))) AS tokens, blocked FROM labelled, frequent),
subsets AS (
  SELECT list_filter(tokens, lambda w, i: (m >> (i - 1)) & 1 = 1) AS wanted, blocked
  FROM (SELECT tokens, blocked, unnest(range(1, 1 << len(tokens))) AS m FROM held)),
counted AS (SELECT wanted, count(*) AS n, count(*) FILTER (blocked) AS hits FROM subsets GROUP BY wanted),
sides AS (SELECT wanted, n, '{u.BLOCK}' AS label, hits FROM counted UNION ALL SELECT wanted, n, '{u.ALLOW}', n - hits FROM counted),
mined AS (SELECT *, hits / n AS confidence FROM sides WHERE hits >= (SELECT t FROM least) AND hits / n >= {u.CONFIDENCE}),
sets AS (SELECT DISTINCT words FROM told WHERE said IS NULL),
best AS (
  SELECT words, label, array_to_string(wanted, ' ') AS learned FROM sets JOIN mined ON list_has_all(words, wanted)
  QUALIFY row_number() OVER (PARTITION BY words ORDER BY confidence DESC, n DESC, len(wanted), array_to_string(wanted, ' '), label) = 1)
SELECT page_id, host, path, rule, coalesce(said, label, '{u.ALLOW}') AS verdict, CASE WHEN said IS NULL THEN learned END AS learned
FROM told LEFT JOIN best USING (words)"""


ORACLES = {
    "op5_substring_dedup": _substrings(),
    "op8_quality_rules": _quality_rules(),
    "op9_sharding": _sharding(),
    "op10_decontamination": _decontamination(),
    "op11_prefix_trie": _prefix_trie(),
    "op12_url_filters": _url_filters(),
    "op13_hard_negatives": _hard_negatives(),
}
