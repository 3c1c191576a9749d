"""SQL for another engine, for those of the queries that SQL can express.

Texts are cut into words, shingles and windows of bytes in plain sight and compared pair by pair, so this is for small tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"
# CTE reach over links (a, b), both ways; nodes (id): the smallest id that each one reaches
REACH = "reach(id, reached) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.reached = l.a), found AS (SELECT id, min(reached) AS root FROM reach GROUP BY id)"

EMBEDDINGS = f"""WITH RECURSIVE vectors AS (SELECT vec_id AS id, label, embedding::double[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), {REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM found LEFT JOIN counts ON id = a"""

REPEATS = """WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
windows AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM texts)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
marked AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM marked GROUP BY doc_id, span),
pieces AS (SELECT s.doc_id, s.a, substr(h, 2 * before + 1, 2 * (s.a - before)) AS piece FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans) s JOIN texts t ON s.doc_id = t.doc_id
  UNION ALL SELECT t.doc_id, length(h), substr(h, 2 * coalesce(b, 0) + 1) FROM texts t LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id) s ON s.doc_id = t.doc_id),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS left_over FROM pieces GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::bigint AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM texts t JOIN kept k ON t.doc_id = k.doc_id LEFT JOIN sums s ON t.doc_id = s.doc_id"""

SIMILAR = f"""WITH RECURSIVE worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
nodes AS (SELECT doc_id AS id FROM documents),
links AS (SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * m >= 85 * (p.n + q.n - m)), {REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, id = root AS kept FROM found LEFT JOIN sizes ON id = doc_id"""

SEARCH = f"""WITH words AS (SELECT doc_id, unnest({WORDS}) AS t FROM documents), counts AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id), whole AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents) AS mean),
weights AS (SELECT t, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) AS idf FROM (SELECT t, count(*) AS df FROM counts GROUP BY t), whole),
scored AS (SELECT q.doc_id AS query_id, c.doc_id, sum(idf * c.tf * 2.2::double / (c.tf + 1.2::double * (0.25::double + 0.75::double * l.n / mean))) AS score
  FROM counts q JOIN counts c ON q.t = c.t JOIN weights w ON w.t = c.t JOIN lengths l ON l.doc_id = c.doc_id, whole WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, c.doc_id)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10"""


def urls(rules: list[tuple[str, str]]) -> str:
    """Without links between hosts, as in the tables here, ranks are seeds: the shares of a host's pages that rules allow or block."""
    values = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '{rule[rule.find('/'):]}')" for verdict, rule in rules)
    return f"""WITH rules(given, rule, rule_host, rule_path) AS (VALUES {values}), behind AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM behind),
fitting AS (SELECT page_id, rule, given, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS nth FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
judged AS (SELECT u.*, f.rule, f.given FROM urls u LEFT JOIN fitting f ON u.page_id = f.page_id AND f.nth = 1),
hosts AS (SELECT host, avg((given IS NOT DISTINCT FROM 'block')::int) - avg((given IS NOT DISTINCT FROM 'allow')::int) AS distrust FROM judged WHERE host <> '' GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(given, CASE WHEN distrust > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN hosts h ON j.host = h.host"""


def phrases(least: int, longest: int, most: int) -> str:
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{capitals}', '{small}') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM cut GROUP BY lang),
sizes AS (SELECT unnest(range(1, {longest + 1})) AS m),
grams AS (SELECT lang, m, list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1]) AS gs FROM cut, sizes WHERE len(ws) >= m),
f AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(gs) AS w FROM grams) GROUP BY lang, w HAVING count(*) >= {least}),
several AS (SELECT lang, w, f AS a FROM f WHERE len(w) > 1),
inside AS (SELECT s.lang, s.w, max(o.f) AS outer_f FROM (SELECT lang, f, unnest([w[1:len(w) - 1], w[2:len(w)]]) AS w FROM f WHERE len(w) > 2) o JOIN several s ON s.lang = o.lang AND s.w = o.w GROUP BY s.lang, s.w),
cuts AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM several),
scored AS (
  SELECT c.lang, c.w, c.a, c.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.w = c.w[1:c.k] JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k + 1:len(c.w)] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.w = b.w WHERE i.outer_f IS NULL OR 100 * i.outer_f < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM kept)
WHERE rank <= {most}"""


def spelling(every: int, least: int, twice: int, times: int) -> str:
    """CRC-32 is made from its polynomial: a table of 256 steps, and one reduction over the bytes of a text."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE steps AS (SELECT list(step ORDER BY i) AS steps FROM (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS step FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(run, '{capitals}', '{small}') AS w, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT w, times, hex(encode(concat(doc_id, ':', w))) AS h FROM runs),
drawn AS (SELECT w, times, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS crc FROM coded, steps),
counted AS (SELECT CASE WHEN crc % {every} = 0 THEN left(w, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS word, sum(times)::BIGINT AS n FROM drawn GROUP BY 1),
words AS MATERIALIZED (SELECT word, n FROM counted WHERE length(word) >= {least} AND n >= {twice}),
without AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS other, b.n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a.word, w.word, w.n FROM without a JOIN words w ON a.rest = w.word
  UNION ALL SELECT w.word, a.word, a.n FROM without a JOIN words w ON a.rest = w.word)),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {times} * w.n THEN b.other END AS form, CASE WHEN b.other_n >= {times} * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
led AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN formed f ON f.word = l.next)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN led l ON l.word = f.word AND l.next IS NULL"""
