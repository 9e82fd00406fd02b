"""DuckDB SQL for the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def decontamination_sql(documents: str = "documents") -> str:
    """One row per row of ``documents``; rid tells rows with equal ids apart."""
    return f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM {documents}),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, ws[p:p + n - 1] AS w
        FROM (SELECT item, ws, least(len(ws), 10) AS n FROM iw WHERE len(ws) > 0) t,
             unnest(range(1, len(ws) - n + 2)) AS u(p)),
dp AS (SELECT rid, n, p, ws[p:p + n - 1] AS w
       FROM dw, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(ws) - n + 2)) AS u(p)),
hit AS (SELECT rid, p, dp.n, item FROM dp JOIN win ON dp.n = win.n AND dp.w = win.w),
cov AS (SELECT rid, count(DISTINCT p + o) AS n_hit FROM hit, unnest(range(0, n)) AS u(o) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items,
               array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""


def mixing_sql(documents: str = "documents", columns: str = "doc_id, source") -> str:
    """Simulates the schedule slot by slot (recursive) and numbers every block of the corpus."""
    return f"""
WITH RECURSIVE cnt AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source),
src AS (SELECT source, n, CAST(ceil(100.0::DOUBLE * sqrt(n::DOUBLE / (sum(n) OVER ())::DOUBLE)) AS INT) AS q,
               row_number() OVER (ORDER BY source NULLS FIRST) AS j FROM cnt),
arr AS (SELECT list(q ORDER BY j) AS qs, sum(q)::INT AS total, count(*)::INT AS m FROM src),
sim(t, ks, pick) AS (
  SELECT -1, list_transform(range(0, m), lambda x: 0), NULL::BIGINT FROM arr
  UNION ALL
  SELECT t + 1, list_transform(range(1, m + 1), lambda i: ks[i] + CASE WHEN i = c THEN 1 ELSE 0 END), c
  FROM (SELECT t, ks, qs, m, total,
               list_min(list_transform(
                 list_filter(range(1, m + 1), lambda i: ks[i] < qs[i] AND (ks[i] * total) // qs[i] <= t + 1),
                 lambda i: {{'d': ((ks[i] + 1) * total + qs[i] - 1) // qs[i], 'i': i}})).i AS c
        FROM sim, arr WHERE t + 1 < total) s),
per AS (SELECT t AS slot, pick AS j, ks[pick] - 1 AS k FROM sim WHERE t >= 0),
ranked AS (SELECT d.*, s.j, s.q, row_number() OVER (
             PARTITION BY s.j ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r
           FROM {documents} d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
placed AS (SELECT ranked.*, r // 16 AS blk, ((r // 16) // ranked.q) * total + slot AS mix_slot
           FROM ranked JOIN per ON per.j = ranked.j AND per.k = (r // 16) % ranked.q, arr)
SELECT {columns}, CAST(blk AS BIGINT) AS mix_block, CAST(mix_slot AS BIGINT) AS mix_slot,
       CAST(row_number() OVER (ORDER BY mix_slot, r) - 1 AS BIGINT) AS mix_position
FROM placed"""


# CRC-32 of an ASCII string: the table from its polynomial, one step per character.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({0}, '.'), lambda c: ascii(c)::BIGINT)),
  lambda r, b: xor(r >> 8, crc_list[CAST((xor(r, b) & 255) + 1 AS BIGINT)]))"""

_CRC_TABLE = """crc_steps(i, k, t) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) u(i) UNION ALL
  SELECT i, k + 1, CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::BIGINT) ELSE t >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(t ORDER BY i) AS crc_list FROM crc_steps WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, beside the one-row table ``crc_table``."""
    return f"xor({_CRC.format(text)}, 4294967295::BIGINT)"


def merkle_sql(documents: str = "documents") -> str:
    """Grows every tree by recursion over its levels; a leaf's path is the list of its siblings
    ('before|after' at every level), folded over it."""
    def field(c):
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    rest = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    beside = """coalesce(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY {0}lvl, idx // 3 ORDER BY idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(h, '' ORDER BY idx) OVER (
  PARTITION BY {0}lvl, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"""
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({rest} || {field('text')}) AS leaf,
             CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0
                  THEN sha256({rest} || {field("replace(text, chr(10), '')")}) END AS changed FROM {documents}, crc_table),
leaves AS (SELECT row_number() OVER () AS rid, *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                  count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes(tree, lvl, idx, n, h) AS (SELECT tree, 0, place, n, leaf FROM leaves UNION ALL
  SELECT tree, lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 3),
subs AS (SELECT tree, lvl AS top, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(lvl, idx, n, h) AS (SELECT 0, place, n, h FROM subs UNION ALL
  SELECT lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY lvl, idx // 3),
apex AS (SELECT lvl AS top, h FROM upper WHERE n = 1),
low AS (SELECT tree, lvl, idx, {beside.format('tree, ')} AS b FROM nodes WHERE n > 1),
high AS (SELECT lvl, idx, {beside.format('')} AS b FROM upper WHERE n > 1),
way AS (SELECT rid, 0 AS part, low.lvl, b FROM leaves l JOIN low ON l.tree = low.tree AND l.place // CAST(pow(3, low.lvl) AS BIGINT) = low.idx
  UNION ALL SELECT rid, 1, high.lvl, b FROM leaves l JOIN subs s ON l.tree = s.tree
  JOIN high ON s.place // CAST(pow(3, high.lvl) AS BIGINT) = high.idx),
path AS (SELECT rid, list(b ORDER BY part, lvl) AS p FROM way GROUP BY rid)
SELECT doc_id, leaf, s.h AS subroot, apex.h AS root, sha256(coalesce(replace(array_to_string(p, ''), '|', ''), '')) AS proof_sha256,
       list_reduce(list_prepend(coalesce(changed, leaf), coalesce(p, [])),
                   lambda h, b: sha256(split_part(b, '|', 1) || h || split_part(b, '|', 2))) AS folded_root,
       folded_root = apex.h AS verified
FROM leaves l JOIN subs s ON l.tree = s.tree JOIN apex ON true LEFT JOIN path USING (rid)"""


def conversations_sql(conversations: str = "conversations") -> str:
    """The dynamic programme as a recursion over rows; states carry (cost, audit, repaired text)."""
    def plus(state, cost, letter, text=None):
        t = f"{state}.t || chr(10) || {text}" if text else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {t}}}"

    def least(*options):
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"

    def stay(initial, state):
        return f"CASE WHEN stays AND k = '{initial}' THEN {plus(state, 'extra', 'K', 'kept')} END"

    def change(state, role):
        return f"CASE WHEN stays THEN {plus(state, '1 + extra', 'R', repr(role + ':') + ' || text')} END"

    none = "{'c': 1000000000, 'a': '', 't': ''}"
    user = least("s2", *[plus(s, 5, "I", "'user:'") for s in ("s0", "s1", "s3")])
    reply = least("s3", plus("i2", 5, "I", "'assistant:'"))
    code = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return f"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role,
               coalesce(text, ' ') AS text, {code} % 20 AS code FROM {conversations}, crc_table),
dam AS (SELECT cid, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
               CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM raw, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
num AS (SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) AS nth FROM (
          SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i FROM dam)),
judged AS (SELECT cid, turn, role, text, i, left(role, 1) AS k, role || ':' || text AS kept,
                  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                       WHEN regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
                  lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) AS prev FROM num),
dp(cid, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT cid, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}, {none}, {none}, {none} FROM raw
  UNION ALL
  SELECT cid, i, {least(plus('s0', 2, 'D'))}, {least(plus('s1', 2, 'D'), stay('s', 's0'))},
         {least(plus('i2', 2, 'D'), *[stay('u', s) for s in ('s0', 's1', 'i3')], *[change(s, 'user') for s in ('s0', 's1', 'i3')])},
         {least(plus('i3', 2, 'D'), stay('a', 'i2'), change('i2', 'assistant'))}
  FROM (SELECT *, {reply} AS i3 FROM (SELECT dp.cid, j.i, s0, s1, s3, {user} AS i2, k, kept, text, fault NOT IN ('blank', 'duplicate') AS stays,
               CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM dp JOIN judged j ON j.cid = dp.cid AND j.i = dp.i + 1))),
last AS (SELECT cid, {least("s0", reply)} AS best FROM (SELECT *, {user} AS i2 FROM (
           SELECT *, row_number() OVER (PARTITION BY cid ORDER BY i DESC) AS r FROM dp) WHERE r = 1)),
per AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (prev IS NOT NULL AND prev || k NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY cid)
SELECT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(best.t[2:]) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM raw) r JOIN last USING (cid) LEFT JOIN per USING (cid)"""


TOPK = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pairs) WHERE rank <= 20"""


ORACLE = {"op2_mixing": mixing_sql(), "op4_decontamination": decontamination_sql(), "op11_merkle_manifest": merkle_sql(),
          "op12_conversation_repair": conversations_sql(), "op13_exact_topk": TOPK}
