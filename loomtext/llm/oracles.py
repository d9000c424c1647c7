"""DuckDB SQL of the queries that SQL expresses at whole length."""

from . import secret_scan

ORACLES: dict[str, str] = {}

ORACLES["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

ORACLES["op8_decontamination"] = r"""
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') AS win
  FROM items, unnest(generate_series(1, greatest(1, len(words) - 12))) AS t(i) WHERE len(words) > 0
), docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM docs, sizes, unnest(generate_series(1, greatest(0, len(words) - size + 1))) AS t(i) WHERE len(words) >= size
), hits AS (
  SELECT DISTINCT g.doc_id, g.i, g.size, w.item_id FROM grams g JOIN windows w ON g.win = w.win AND g.size = w.size
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + size - 1)) AS t(p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES["op1_quotations"] = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lines AS (
  SELECT conv_id, turn, i, line, len(regexp_replace(regexp_extract(line, '^([ \t]*>[> \t]*)', 1), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*>[> \t]*', '')), '\s+', ' ', 'g')) AS norm
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m)
),
per AS (SELECT conv_id, turn, count(*) AS n_quoted, max(level) AS max_level FROM lines WHERE level > 0 GROUP BY ALL),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM lines WHERE regexp_matches(norm, '[\p{L}\p{N}]')),
runs AS (SELECT conv_id, turn, level, list(norm ORDER BY i) AS ns FROM told GROUP BY conv_id, turn, level, run),
asked AS (SELECT DISTINCT conv_id, turn, level, ns FROM runs WHERE level > 0),
lengths AS (SELECT DISTINCT conv_id, len(ns) AS n FROM asked UNION SELECT DISTINCT conv_id, 1 FROM asked),
first AS (
  SELECT r.conv_id, array_to_string(ns[i : i + n - 1], chr(10)) AS passage, min(turn) AS source
  FROM runs r JOIN lengths l ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.level = 0 AND l.n <= len(r.ns), unnest(generate_series(1, len(ns) - n + 1)) AS t(i) GROUP BY ALL),
whole AS (SELECT a.*, CASE WHEN f.source < a.turn THEN f.source END AS source FROM asked a LEFT JOIN first f ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND array_to_string(a.ns, chr(10)) = f.passage),
single AS (SELECT DISTINCT conv_id, turn, level, unnest(ns) AS norm FROM whole WHERE source IS NULL),
found AS (
  SELECT conv_id, turn, level, source, sum(n) AS n FROM (
    SELECT conv_id, turn, level, source, len(ns) AS n FROM whole WHERE source IS NOT NULL
    UNION ALL
    SELECT s.conv_id, s.turn, s.level, f.source, 1 FROM single s JOIN first f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.norm = f.passage AND f.source < s.turn
  ) GROUP BY ALL
),
parents AS (
  SELECT conv_id, turn, source AS reply_to, CAST(total AS BIGINT) AS n_linked
  FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS total, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) AS r FROM found) WHERE r = 1
),
walk AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM parents
  UNION ALL
  SELECT w.conv_id, w.turn, p.reply_to, w.depth + 1 FROM walk w JOIN parents p ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.root = p.turn
),
chain AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM walk GROUP BY ALL),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m))
SELECT m.conv_id, m.turn, m.role,
       regexp_replace(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>[> \t]*')), chr(10)), '^\s+|\s+$', '', 'g') AS content,
       coalesce(per.n_quoted, 0) AS n_quoted, coalesce(per.max_level, 0) AS max_level, coalesce(p.n_linked, 0) AS n_linked,
       coalesce(p.reply_to, t.before, -1) AS reply_to, coalesce(c.root, m.turn) AS thread, CAST(coalesce(c.depth, 0) AS BIGINT) AS depth
FROM m
LEFT JOIN per ON m.conv_id IS NOT DISTINCT FROM per.conv_id AND m.turn = per.turn
LEFT JOIN parents p ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.turn = p.turn
LEFT JOIN chain c ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.turn = c.turn
LEFT JOIN turns t ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.turn = t.turn
"""

ORACLES["op2_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM n UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(r) AS c FROM reach GROUP BY v) c USING (doc_id)
"""


def _matches(kind: str, no: int, pattern: str, value: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {no} AS no, v[i] AS value,
         CAST(list_sum(list_transform(g[1 : i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1 : i - 1], lambda x: len(x))), 0) AS BIGINT) AS start,
         CAST(list_sum(list_transform(g[1 : i], lambda x: len(x))) + list_sum(list_transform(f[1 : i], lambda x: len(x))) AS BIGINT) AS stop
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS f, regexp_extract_all(text, '{p}', {value}) AS v, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}')),
       unnest(generate_series(1, len(f))) AS t(i) WHERE {keep}"""


ORACLES["op10_secret_scan"] = (
    "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), base AS ("
    + " UNION ALL ".join([_matches("assign", 1, secret_scan.ASSIGN, 2, "len(v[i]) >= 6"), _matches("access", 2, secret_scan.ACCESS, 0, "true"), _matches("hex", 3, secret_scan.HEX, 0, "true")])
    + "), bare AS ("
    + _matches("bare", 4, secret_scan.BARE, 0, "regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]')")
    + """), every AS (
  SELECT * FROM base UNION ALL SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = b.doc_id AND s.start < b.stop AND b.start < s.stop)
), freq AS (SELECT value, count(DISTINCT source) AS owners FROM every JOIN d USING (doc_id) GROUP BY value),
rated AS (SELECT e.*, owners <= 1 AS live FROM every e JOIN freq USING (value)),
per AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (live OR kind <> 'bare') AS spans, count(*) FILTER (live) AS n_live,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (kind <> 'bare') AS base,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
  FROM rated GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (doc_id)
"""
)

# A document's passages are hashed, each lane counts the hashes that have its bit, four lanes make a word.
_FINGERPRINT = """
  SELECT *, list_transform(range(0, 64), lambda k: list_reduce(list_prepend(0::UHUGEINT, list_transform(h, lambda x: ((('0x' || substr(x, 1 + 16 * (k // 16), 16))::UBIGINT >> CAST(k % 16 AS UBIGINT)) & 281479271743489::UBIGINT)::UHUGEINT)), lambda s, y: s + y)) AS words
  FROM (SELECT {keep}, list_transform(list_filter(string_split_regex({text}, '\\n+|[.,;:!?] +'), lambda p: p <> ''), lambda p: sha256(p)) AS h FROM {source})"""
_DIFFERENCES = "list_transform(range(0, 256), lambda i: CAST(2 * ((words[1 + i // 4] >> CAST(16 * (i % 4) AS UHUGEINT)) & 65535::UHUGEINT) AS BIGINT) - len(h))"
_COSINE = "CASE WHEN {x}x = 0 OR {y}x = 0 THEN CAST({x}x = 0 AND {y}x = 0 AS DOUBLE) ELSE greatest(0.0, least(1.0, round({dot} / sqrt({x}x * {y}x), 6))) END"
ORACLES["op12_fingerprints"] = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\n"
    "e AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS after FROM d),\n"
    "f AS (SELECT doc_id, text, n, after, left(text, n - n // 2) || left(after, n // 2) AS edited FROM e),\n"
    + f"own AS ({_FINGERPRINT.format(keep='doc_id, n, edited', text='text', source='f')}),\n"
    + f"alt AS ({_FINGERPRINT.format(keep='doc_id', text='edited', source='f')}),\n"
    + f"v AS (SELECT doc_id, n, edited, h, words, {_DIFFERENCES} AS d FROM own),\n"
    + f"w AS (SELECT doc_id, h, words, {_DIFFERENCES} AS d FROM alt),\n"
    + """x AS (
  SELECT doc_id, v.n, sha256(v.edited) AS edited_sha256, CAST(len(v.h) AS VARCHAR) || ':' || array_to_string(list_transform(v.words, lambda y: lpad(lower(hex(y::UBIGINT)), 16, '0')), '') AS fingerprint,
         CAST(len(w.h) AS VARCHAR) || ':' || array_to_string(list_transform(w.words, lambda y: lpad(lower(hex(y::UBIGINT)), 16, '0')), '') AS edited_fingerprint,
         v.d AS p, w.d AS q, coalesce(lead(v.d) OVER (ORDER BY doc_id), first(v.d) OVER (ORDER BY doc_id)) AS r FROM v JOIN w USING (doc_id)
), y AS (SELECT *, list_sum(list_transform(p, lambda a: a * a)) AS px, list_sum(list_transform(q, lambda a: a * a)) AS qx, list_sum(list_transform(r, lambda a: a * a)) AS rx,
         list_dot_product(p::DOUBLE[], q::DOUBLE[]) AS pq, list_dot_product(p::DOUBLE[], r::DOUBLE[]) AS pr FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint, """
    + _COSINE.format(x="p", y="q", dot="pq") + " AS near_edited, " + _COSINE.format(x="p", y="r", dot="pr") + " AS near_next FROM y\n"
)

# Whole levels as lists, one tree after the other; then each leaf walks up with the level's list beside it.
_FIELD = "coalesce(CAST(octet_length(encode({0}::VARCHAR)) AS VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
ORACLES["op13_manifest"] = (
    "WITH RECURSIVE d AS (SELECT doc_id, lang, " + _LEAF.format(n_chars="n_chars") + " AS leaf, " + _LEAF.format(n_chars="(n_chars + 1)") + """ AS other FROM documents),
crc AS (
  WITH RECURSIVE c AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, 0 AS bit, xor(4294967295::BIGINT, ascii(CAST(doc_id AS VARCHAR)[1])::BIGINT) AS r FROM d
    UNION ALL
    SELECT doc_id, s, CASE WHEN bit = 7 THEN i + 1 ELSE i END, CASE WHEN bit = 7 THEN 0 ELSE bit + 1 END,
           xor(CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END, CASE WHEN bit = 7 AND i < len(s) THEN ascii(s[i + 1])::BIGINT ELSE 0 END)
    FROM c WHERE i <= len(s)
  ) SELECT doc_id, xor(r, 4294967295::BIGINT) AS crc FROM c WHERE i > len(s)
),
o AS (SELECT d.*, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS shown, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS BIGINT) AS spot FROM d LEFT JOIN crc USING (doc_id)),
up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY spot) AS nodes FROM o GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM up WHERE len(nodes) > 1
),
sub AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM up WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY spot) AS nodes FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM top WHERE len(nodes) > 1
),
walk AS (
  SELECT doc_id, lang, 0 AS level, spot, leaf, shown AS now, '' AS proof FROM o
  UNION ALL
  SELECT w.doc_id, w.lang, w.level + 1, w.spot // 2, w.leaf, sha256(CASE WHEN w.spot % 2 = 1 THEN u.nodes[w.spot] || w.now ELSE w.now || coalesce(u.nodes[w.spot + 2], '') END),
         w.proof || CASE WHEN w.spot % 2 = 1 THEN u.nodes[w.spot] ELSE coalesce(u.nodes[w.spot + 2], '') END
  FROM walk w JOIN up u ON w.lang IS NOT DISTINCT FROM u.lang AND w.level = u.level AND len(u.nodes) > 1
),
half AS (SELECT w.* FROM walk w JOIN up u ON w.lang IS NOT DISTINCT FROM u.lang AND w.level = u.level AND len(u.nodes) = 1),
rest AS (
  SELECT h.doc_id, 0 AS level, s.spot, h.leaf, s.subroot, h.now, h.proof FROM half h JOIN sub s ON h.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.level + 1, w.spot // 2, w.leaf, w.subroot, sha256(CASE WHEN w.spot % 2 = 1 THEN u.nodes[w.spot] || w.now ELSE w.now || coalesce(u.nodes[w.spot + 2], '') END),
         w.proof || CASE WHEN w.spot % 2 = 1 THEN u.nodes[w.spot] ELSE coalesce(u.nodes[w.spot + 2], '') END
  FROM rest w JOIN top u ON w.level = u.level AND len(u.nodes) > 1
)
SELECT doc_id, leaf, subroot, u.nodes[1] AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = u.nodes[1] AS verified
FROM rest w JOIN top u ON w.level = u.level AND len(u.nodes) = 1
"""
)
