"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

_OP1 = f"""
WITH marks AS (
  SELECT doc_id, CASE WHEN min(quality) > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), rows AS (
  SELECT d.doc_id, d.source, {_WORDS.replace('text', 'd.text')}::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|mix|' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / coalesce(m.weight, 1.0::DOUBLE) AS k
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
), sizes AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM rows GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(place % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS most FROM sizes
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), own AS (
  SELECT *, first_value(CASE WHEN level * w <= most THEN level END IGNORE NULLS)
      OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own
  FROM levels
), targets AS (
  SELECT source, source_size::BIGINT AS source_size, coalesce(own * w, most) AS target FROM own
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
), placed AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.epochs,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for mark in ("<</SYS>>", "<<SYS>>", "[/INST]", "[/ROLE]", "[/TURN]", "[INST]", "[ROLE]", "</s>", "<s>"):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_OP3 = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
    lag(coalesce(role, ''), 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS prev
  FROM rows
), marked AS (
  SELECT *, {_escaped('t')} AS e,
    NOT CASE WHEN pos = 0 THEN r IN ('system', 'user') WHEN prev = '' THEN r IN ('system', 'user') WHEN prev = 'system' THEN r = 'user'
      WHEN prev = 'user' THEN r = 'assistant' WHEN prev = 'assistant' THEN r = 'user' ELSE false END AS bad
  FROM turns
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY pos) FILTER (r = 'assistant'), '')) AS loss_sha256,
    sum(length(e) + CASE r WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length({_escaped('r')}) END)::BIGINT AS formatted_chars,
    coalesce(min(pos) FILTER (bad), -1) AS first_bad, max_by(r, pos) AS final
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  first_bad < 0 AND final = 'assistant' AS is_valid,
  (CASE WHEN first_bad >= 0 THEN first_bad WHEN final <> 'assistant' THEN n_turns ELSE -1 END)::BIGINT AS bad_turn
FROM chats
"""

#: Windows of 400 bytes as hexadecimal digits; blocks of a text keep substr() from walking through all of it.
_OP2 = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT r, doc_id, h, length(h) // 2 AS n FROM texts
), blocks AS (
  SELECT r, b * 512 AS first, substr(h, b * 1024 + 1, 1024 + 798) AS part, least(512, n - 399 - b * 512) AS windows
  FROM (SELECT r, h, n, unnest(range(0, (n - 400) // 512 + 1)) AS b FROM sized WHERE n >= 400)
), windows AS (
  SELECT r, first + k AS pos, hash(substr(part, 2 * k + 1, 800)) AS code
  FROM (SELECT r, first, part, unnest(range(0, windows)) AS k FROM blocks)
), again AS (
  SELECT code FROM windows GROUP BY code HAVING count(*) > 1
), starts AS (
  SELECT r, pos FROM windows WHERE code IN (SELECT code FROM again)
), marked AS (
  SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS span
  FROM (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 400 THEN 0 ELSE 1 END AS new FROM starts)
), spans AS (
  SELECT r, span, min(pos) AS low, max(pos) + 400 AS high FROM marked GROUP BY r, span
), gaps AS (
  SELECT r, span, low, high, lag(high, 1, 0::BIGINT) OVER (PARTITION BY r ORDER BY low) AS before,
    row_number() OVER (PARTITION BY r ORDER BY low DESC) = 1 AS final FROM spans
), kept AS (
  SELECT g.r, count(*) AS n_spans, sum(high - low) AS n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (low - before)) || CASE WHEN final THEN substr(h, 2 * high + 1) ELSE '' END, '' ORDER BY low) AS left_over
  FROM gaps g JOIN sized s ON s.r = g.r GROUP BY g.r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM sized LEFT JOIN kept ON kept.r = sized.r
"""

_OP9 = """
WITH RECURSIVE classes AS (
  SELECT row_number() OVER (ORDER BY min(doc_id), text) AS c, text, count(*) AS copies, min(doc_id) AS first_id
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text
), words AS (
  SELECT c, copies, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM classes
), grams AS (
  SELECT DISTINCT c, md5_number(array_to_string(w[k : k + 4], ' ')) AS g
  FROM (SELECT c, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT c, count(*) AS n FROM grams GROUP BY c
), shared AS (
  SELECT a.c AS a, b.c AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c
), near AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.c = a JOIN sizes y ON y.c = b WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)
), links AS (
  SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
  SELECT c AS node, c AS root FROM sizes
  UNION
  SELECT l.b AS node, r.root FROM reach r JOIN links l ON l.a = r.node
), groups AS (
  SELECT r.node, min(c.first_id) AS class_id FROM reach r JOIN classes c ON c.c = r.root GROUP BY r.node
), counts AS (
  SELECT l.a AS node, sum(c.copies) AS n FROM links l JOIN classes c ON c.c = l.b GROUP BY l.a
)
SELECT d.doc_id, CASE WHEN g.node IS NULL THEN d.doc_id ELSE g.class_id END AS class_id,
  CASE WHEN g.node IS NULL THEN 0 ELSE c.copies - 1 + coalesce(n.n, 0) END::BIGINT AS n_links
FROM documents d JOIN classes c ON c.text = coalesce(d.text, '')
LEFT JOIN groups g ON g.node = c.c LEFT JOIN counts n ON n.node = c.c
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters, bit by bit; the constants are fixed values."""
    bits = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, {})"
    bytes_ = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda crc, b: {bits.format('xor(crc, b)')}, 4294967295::BIGINT), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Trees of documents have t = their language's number, the tree of subroots has t = -1.
_SIBLINGS = """SELECT t, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {} WHERE n > 1 WINDOW w AS (PARTITION BY t, level, i // 8 ORDER BY i)"""
_UP = "SELECT t, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM {} WHERE n > 1 GROUP BY t, level, i // 8"
_OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, {_leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc32("coalesce(doc_id, 0)::VARCHAR")} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY t) AS total FROM leaves
), nodes AS (
  SELECT t, 0 AS level, place AS i, leaf AS h, total AS n FROM placed UNION ALL {_UP.format('nodes')}
), subroots AS (
  SELECT t, level AS top, h FROM nodes WHERE n = 1
), upper AS (
  SELECT -1 AS t, 0 AS level, t AS i, h, (SELECT count(*) FROM subroots) AS n FROM subroots UNION ALL {_UP.format('upper')}
), siblings AS (
  {_SIBLINGS.format('nodes')} UNION ALL {_SIBLINGS.format('upper')}
), steps AS (
  SELECT p.row, s.level AS k, s.l, s.r FROM placed p JOIN siblings s ON s.t = p.t AND s.i = p.place // power(8, s.level)::BIGINT
  UNION ALL
  SELECT p.row, b.top + s.level, s.l, s.r FROM placed p JOIN subroots b ON b.t = p.t JOIN siblings s ON s.t = -1 AND s.i = p.t // power(8, s.level)::BIGINT
), paths AS (
  SELECT row, list(l ORDER BY k) AS ls, list(r ORDER BY k) AS rs, string_agg(l || r, '' ORDER BY k) AS proof FROM steps GROUP BY row
), folded AS (
  SELECT row, 0 AS k, coalesce(other, leaf) AS h FROM placed
  UNION ALL
  SELECT f.row, k + 1, sha256(p.ls[k + 1] || h || p.rs[k + 1]) FROM folded f JOIN paths p ON p.row = f.row WHERE k < len(p.ls)
), ends AS (
  SELECT row, max_by(h, k) AS h FROM folded GROUP BY row
)
SELECT p.doc_id, p.leaf, b.h AS subroot, u.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = u.h AS verified
FROM placed p JOIN subroots b ON b.t = p.t JOIN ends e ON e.row = p.row LEFT JOIN paths q ON q.row = p.row, (SELECT h FROM upper WHERE n = 1) u
"""

_OP13 = f"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS place, digest, words
  FROM (SELECT *, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS digest, {_WORDS} AS words FROM own)
), counted AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM turns GROUP BY conv_id
), convs AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS b FROM counted c LEFT JOIN counted b ON b.conv_id = c.base
), rebuilt AS (
  SELECT c.conv_id, t.place + 1 AS depth, digest, words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.b
  UNION ALL
  SELECT c.conv_id, t.place - c.h + c.b + 1, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h
), named AS (
  SELECT conv_id, depth, words, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM rebuilt
), members AS (
  SELECT conv_id, depth, words, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM named
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs
), nodes AS (
  SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM members GROUP BY key, depth
), children AS (
  SELECT parent, count(*) AS n FROM nodes GROUP BY parent
), marked AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent = n.key
), below AS (
  SELECT m.key, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved
  FROM marked n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.key
), ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
  FROM (SELECT conv_id, arg_max(key, depth) AS key FROM members GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM marked n JOIN below b ON b.key = n.key LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN ends e ON e.key = n.key
"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": _OP1, "op2_suffix_dedup": _OP2, "op3_chat_formatting": _OP3, "op9_ngram_join": _OP9, "op12_merkle_manifest": _OP12, "op13_prefix_trie": _OP13}
