"""SQL of the queries that SQL can express. BPE, hashing with XXH64 and trained models it cannot."""

from __future__ import annotations

from ledgerline.llm import chat, filteraudit, licenses, linededup, sharding
from ledgerline.llm.common import LOWER, UPPER

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


DECONTAMINATION = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower('text')}, '{_WORDS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, len(part) AS n, array_to_string(part, ' ') AS body
  FROM (SELECT item, unnest([w[i : i + 9] FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS part FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
stretches AS (
  SELECT r, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS body
  FROM starts CROSS JOIN (SELECT DISTINCT n FROM windows) AS s WHERE i + s.n - 1 <= len(w)),
hits AS (SELECT r, i, n, item FROM stretches JOIN windows USING (n, body)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

_QUOTED = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(licenses.TEMPLATES))
_PAIRS = "[w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]"

LICENSE_SCAN = f"""
WITH templates AS (
  SELECT license, {_PAIRS} AS pairs FROM (
    SELECT license, regexp_extract_all({_lower('body')}, '{_WORDS}') AS w FROM (VALUES {_QUOTED}) AS t(i, license, body))),
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
stretches AS (
  SELECT doc_id, place, {_PAIRS} AS own
  FROM (SELECT doc_id, place, regexp_extract_all({_lower('line')}, '{_WORDS}') AS w FROM lines) WHERE len(w) > 1),
able AS (
  SELECT doc_id, place, license, own, pairs FROM stretches JOIN templates
  ON len(own) BETWEEN len(pairs) * {licenses.THRESHOLD / (2 - licenses.THRESHOLD)} - 1e-9 AND len(pairs) * {(2 - licenses.THRESHOLD) / licenses.THRESHOLD} + 1e-9
  AND list_has_any(own, pairs)),
scored AS (
  SELECT doc_id, place, license, 2.0::DOUBLE * list_sum([
    least(len([x FOR x IN own IF x = b]), len([y FOR y IN pairs IF y = b])) FOR b IN list_distinct(pairs)]) / (len(own) + len(pairs)) AS dice
  FROM able),
best AS (
  SELECT doc_id, place, max(dice) AS dice, arg_max(license, (dice, license)) AS license
  FROM scored WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id, place),
per_doc AS (
  SELECT doc_id, count(*) AS n_matches, max(dice) AS best_dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM best GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(best_dice, 0.0::DOUBLE) AS best_dice, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN per_doc ON documents.doc_id IS NOT DISTINCT FROM per_doc.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


SHARDING = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%04d', i) AS name FROM range({sharding.SHARDS}) AS t(i)),
starts AS (
  SELECT list({_number("name || '|offset'")} % {sharding.SLOTS} ORDER BY i) AS first,
         list({_number("name || '|step'")} % {sharding.SLOTS - 1} + 1 ORDER BY i) AS step FROM shards),
turns AS (
  SELECT 0 AS turn, [-1 FOR x IN range({sharding.SLOTS})] AS taken, first AS pos, step, -1::BIGINT AS slot, -1::BIGINT AS shard FROM starts
  UNION ALL
  SELECT turn + 1, taken[:slot_now] || [s] || taken[slot_now + 2:], pos[:s] || [slot_now] || pos[s + 2:], step, slot_now, s
  FROM (
    SELECT turn, taken, pos, step, s,
           (pos[s + 1] + [j FOR j IN range({sharding.SLOTS}) IF taken[(pos[s + 1] + j * step[s + 1]) % {sharding.SLOTS} + 1] = -1][1] * step[s + 1])
             % {sharding.SLOTS} AS slot_now
    FROM (SELECT *, turn % {sharding.SHARDS} AS s FROM turns WHERE turn < {sharding.SLOTS}))),
slots AS (SELECT slot, shard FROM turns WHERE turn > 0)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, printf('shard-%04d', shard) AS shard
FROM (SELECT doc_id, {_number("coalesce(CAST(doc_id AS VARCHAR), '')")} % {sharding.SLOTS} AS slot FROM documents) JOIN slots USING (slot)
"""

_BODY = "'{}' || role || chr(10) || text || '{}'".format(chat.TURN_START, chat.TURN_END.replace("\n", "' || chr(10) || '"))
_LEAD, _TAIL = len(chat.TURN_START) + 1, len(chat.TURN_END)
_BEFORE = "coalesce(sum(length(body)) OVER (PARTITION BY conv_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"

PREFERENCES = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER w - 1 AS pos, lag(coalesce(text, '')) OVER w AS before
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
ends AS (SELECT conv_id, max(pos) FILTER (WHERE role = 'assistant' AND pos > 0) AS last, count(*) AS n FROM turns GROUP BY conv_id),
sides AS (
  SELECT conv_id, 'chosen' AS side, pos, role, text, last, n, before FROM turns JOIN ends USING (conv_id)
  UNION ALL
  SELECT conv_id, 'rejected', pos, role, CASE WHEN pos = last THEN before ELSE text END, last, n, before FROM turns JOIN ends USING (conv_id)),
shared AS (
  SELECT conv_id, any_value(CASE WHEN last IS NULL OR same THEN n ELSE last END) AS shared FROM (
    SELECT conv_id, last, n, bool_or(pos = last AND text = before) OVER (PARTITION BY conv_id) AS same FROM sides WHERE side = 'chosen')
  GROUP BY conv_id),
parts AS (
  SELECT conv_id, shared, pos, role, text, {_BODY} AS body,
         CASE WHEN pos >= shared THEN side WHEN side = 'chosen' THEN 'prompt' END AS part
  FROM sides JOIN shared USING (conv_id)),
placed AS (SELECT *, {_BEFORE} + {_LEAD} + length(role) AS start FROM parts WHERE part IS NOT NULL),
joined AS (
  SELECT conv_id, shared,
    coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE part = 'prompt'), '') AS prompt,
    coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE part = 'chosen'), '') AS chosen,
    coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE part = 'rejected'), '') AS rejected,
    coalesce(string_agg(CAST(start AS VARCHAR) || '-' || CAST(start + length(text) AS VARCHAR), ',' ORDER BY pos)
      FILTER (WHERE part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
    coalesce(string_agg(CAST(start AS VARCHAR) || '-' || CAST(start + length(text) AS VARCHAR), ',' ORDER BY pos)
      FILTER (WHERE part = 'rejected' AND role = 'assistant'), '') AS rejected_spans
  FROM placed GROUP BY conv_id, shared)
SELECT conv_id, CAST(shared AS INTEGER) AS n_prompt_turns, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256,
       sha256(rejected) AS rejected_sha256, chosen_spans, rejected_spans
FROM joined
"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(range(len(l))) AS place, unnest(l) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
wide AS (
  SELECT line, min((doc_id, place)) AS first FROM lines WHERE trim(line) <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {linededup.SITES}),
marked AS (
  SELECT doc_id, place, lines.line, wide.line IS NOT NULL AND first <> (doc_id, place) AS gone
  FROM lines LEFT JOIN wide ON lines.line = wide.line),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

_LETTERS = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(filteraudit.LETTERS))

FILTER_AUDIT = f"""
WITH RECURSIVE letters(letter, bit) AS (VALUES {_LETTERS}),
marks AS (
  SELECT doc_id AS id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < {filteraudit.MIN_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < {filteraudit.MIN_DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filteraudit.MAX_UPPER_PERCENT} * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '{filteraudit.SYMBOLS}') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM docs LEFT JOIN marks ON doc_id = id),
orders(filter_order, applied) AS (
  SELECT '', 0 UNION ALL
  SELECT filter_order || letter, applied | bit FROM orders JOIN letters ON applied & bit = 0),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bit,
         list_sum([1 << instr('{filteraudit.LETTERS}', substr(filter_order, k, 1)) - 1 FOR k IN range(1, step)]) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5)
  JOIN letters ON letter = substr(filter_order, CAST(step AS INTEGER), 1)),
figures AS (
  SELECT part, filter_order, step, bit,
         count(*) FILTER (WHERE mask & (coalesce(before, 0) | bit) = 0) AS kept,
         count(*) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit <> 0) AS removed,
         count(*) FILTER (WHERE mask & coalesce(before, 0) <> 0 AND mask & bit <> 0) AS redundant,
         count(*) FILTER (WHERE mask = bit) AS unique_fails,
         count(*) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit <> 0 AND good) AS good_lost,
         count(*) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit <> 0 AND toxic) AS toxic_lost
  FROM masks CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step, {', '.join(filteraudit.FIGURES)},
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM figures
"""

# Bytes of the decimal id go through a table of 256 remainders, each made by eight divisions.
MERKLE_MANIFEST = """
WITH RECURSIVE divided(i, turn, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i) UNION ALL
  SELECT i, turn + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM divided WHERE turn < 8),
remainders AS (SELECT list(c ORDER BY i) AS r FROM divided WHERE turn = 8),
hashed AS (
  SELECT *, xor(list_reduce([ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
                            lambda c, b: xor(r[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 7 = 0 AS odd
  FROM documents CROSS JOIN remainders),
parts AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM hashed),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN odd THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS other
  FROM parts),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS part,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total
  FROM leaves),
nodes(depth, part, pos, total, node) AS (
  SELECT 0, part, pos, total, leaf FROM placed UNION ALL
  SELECT depth + 1, part, pos // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM nodes WHERE total > 1 GROUP BY depth, part, pos // 2, total),
subroots AS (SELECT part, node AS subroot FROM nodes WHERE total = 1),
upper(depth, pos, total, node) AS (
  SELECT 0, part, (SELECT count(*) FROM subroots), subroot FROM subroots UNION ALL
  SELECT depth + 1, pos // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE total > 1 GROUP BY depth, pos // 2, total),
steps AS (
  SELECT p.part, p.pos, n.depth, n.pos > p.pos >> n.depth AS after, n.node
  FROM placed AS p JOIN nodes AS n ON n.part = p.part AND n.pos = xor(p.pos >> n.depth, 1)
  UNION ALL
  SELECT p.part, p.pos, 100 + u.depth, u.pos > p.part >> u.depth, u.node
  FROM placed AS p JOIN upper AS u ON u.pos = xor(p.part >> u.depth, 1)),
proofs AS (SELECT part, pos, string_agg(node, '' ORDER BY depth) AS proof FROM steps GROUP BY part, pos),
heights AS (SELECT part, max(depth) AS h FROM nodes GROUP BY part),
ways AS (
  SELECT w.part, w.pos, list(coalesce(CASE WHEN after THEN '>' ELSE '<' END || node, '=') ORDER BY d) AS way
  FROM (SELECT part, pos, unnest(range(h) || [100 + x FOR x IN range((SELECT max(depth) FROM upper))]) AS d FROM placed JOIN heights USING (part)) AS w
  LEFT JOIN steps AS s ON s.part = w.part AND s.pos = w.pos AND s.depth = d GROUP BY ALL),
folded AS (
  SELECT part, pos, list_reduce(way, lambda c, s: sha256(CASE s[1] WHEN '>' THEN c || s[2:] WHEN '<' THEN s[2:] || c ELSE c END), coalesce(other, leaf)) AS folded_root
  FROM placed LEFT JOIN ways USING (part, pos))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (part) JOIN folded USING (part, pos) LEFT JOIN proofs USING (part, pos)
CROSS JOIN (SELECT node AS root FROM upper WHERE total = 1)
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op2_license_scan": LICENSE_SCAN,
    "op4_top_k": TOP_K,
    "op7_sharding": SHARDING,
    "op8_preferences": PREFERENCES,
    "op10_line_dedup": LINE_DEDUP,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_merkle_manifest": MERKLE_MANIFEST,
}
