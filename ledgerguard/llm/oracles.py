"""DuckDB SQL for the queries of this subpackage that SQL can express."""

HOST_QUALITY = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS v
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])
            - len(list_distinct([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM b WHERE source IS NOT NULL GROUP BY source),
tot AS (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*)::DOUBLE AS hosts, sum(k * k / n::DOUBLE) AS kk FROM h),
m AS (SELECT *, least(greatest(k / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1)) AS mean, least(hosts / n, 0.999999) AS noise FROM tot),
p AS (SELECT *, least(greatest(((kk / n - (k / n) * (k / n)) / (mean * (1 - mean)) - noise) / (1 - noise), 0.001), 0.999) AS r FROM m),
rate AS (SELECT h.source, (h.k + p.mean * (1 / p.r - 1)) / (h.n + (1 / p.r - 1)) AS host_rate FROM h, p)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rate.host_rate,
       (NOT base_failed AND coalesce(rate.host_rate, 0) <= 0.5) AS kept
FROM b LEFT JOIN rate ON rate.source = b.source
"""

def jaccard_sql(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


REVISITS = r"""
WITH p AS (
  SELECT page_id, page_id * 3600 AS t, sha256(coalesce(html, '')) AS digest,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
u AS (
  SELECT page_id, t, digest, substr(digest, 1, 16) AS tag,
         regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') ||
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1),
             '([?&])((utm_[a-z]+|ref)=[^&]*&?)+', '\1', 'g'), '[?&]+$', ''), '/+$', ''), '^$', '') AS url_key FROM p),
v AS (
  SELECT page_id * 4 + 1 AS record_id, url_key, t + 172800 AS ts, CASE WHEN page_id % 5 = 0 THEN NULL ELSE tag END AS tag, t - 86400 AS modified FROM u
  UNION ALL SELECT page_id * 4 + 2, url_key, t - 3599, 'old-' || tag, t - 86400 FROM u WHERE page_id % 7 = 0),
j AS (
  SELECT v.record_id, v.url_key, v.ts, v.tag, v.modified, arg_max(u, [u.t, u.page_id]) AS r
  FROM v LEFT JOIN u ON u.url_key = v.url_key AND u.t < v.ts GROUP BY ALL),
s AS (
  SELECT *, CASE WHEN r.page_id IS NULL THEN 'no_response' WHEN coalesce(tag = r.tag, modified = r.t - 86400, FALSE) THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT record_id, url_key, status, r.page_id * 4 AS response_id, r.t AS response_ts,
       CASE WHEN status = 'resolved' THEN r.digest END AS digest,
       CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=' || ts || ';etag=' || r.tag || ';expires=' || (ts + 60) || ';last-modified=' || (r.t - 86400) END AS headers
FROM s
"""

NEAREST = """
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id,
       LATERAL (SELECT list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score))
WHERE rank <= 20
"""

CONVERSATIONS = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(i)),
e AS (
  SELECT *, length('### ') + length(replace(replace(role, '\', '\s'), chr(10), '\n')) + 1
       + length(regexp_replace(text, '(^|[\n\\])(### |</turn>)', '\1\\\2', 'g')) + length('</turn>') + 2 AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def _manifest() -> str:
    def row(n_chars: str) -> str:
        texts = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in texts) + ")"

    def tree(name: str, of: str, group: str, leaf: str) -> str:
        return f"""
{name} AS (
  SELECT {group} AS g, 0 AS level, pos, {leaf} AS h, count(*) OVER (PARTITION BY {group}) AS n FROM {of}
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, pos // 2, n)"""

    def fold(name: str, start: str, nodes: str) -> str:
        return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT f.id, f.g, f.level + 1, f.pos // 2, CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN f.pos % 2 = 0 THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END,
         f.proof || coalesce(s.h, '')
  FROM {name} f JOIN {nodes} own ON own.g IS NOT DISTINCT FROM f.g AND own.level = f.level AND own.pos = f.pos AND own.n > 1
  LEFT JOIN {nodes} s ON s.g IS NOT DISTINCT FROM f.g AND s.level = f.level AND s.pos = xor(f.pos, 1))"""

    return f"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                        lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)),
                        4294967295) AS crc
  FROM documents),
l AS (SELECT doc_id, lang, {row("n_chars")} AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN {row("(n_chars + 1)")} END AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM l),
{tree("lv", "p", "lang", "leaf")},
sub AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM lv WHERE n = 1),
{tree("top", "sub", "1", "subroot")},
{fold("a", "SELECT id, lang AS g, 0 AS level, pos, coalesce(changed, leaf) AS h, '' AS proof FROM p", "lv")},
done AS (SELECT a.* FROM a JOIN lv ON lv.g IS NOT DISTINCT FROM a.g AND lv.level = a.level AND lv.n = 1),
{fold("b", "SELECT done.id, 1 AS g, 0 AS level, sub.pos, done.h, done.proof FROM done JOIN sub ON sub.lang IS NOT DISTINCT FROM done.g", "top")},
r AS (SELECT h AS root, level FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, sub.subroot, r.root, sha256(b.proof) AS proof_sha256, b.h AS folded_root, b.h = r.root AS verified
FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN b ON b.id = p.id JOIN r ON r.level = b.level"""


ORACLES = {"op2_revisit_resolution": REVISITS, "op7_int8_tile_neighbours": NEAREST, "op5_ngram_jaccard_join": jaccard_sql(4, 85), "op4_host_quality_rules": HOST_QUALITY,
           "op11_grammar_round_trip": CONVERSATIONS, "op12_path_copying_manifest": _manifest()}
