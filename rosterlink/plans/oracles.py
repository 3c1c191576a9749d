"""The same queries as SQL for another engine, built from text of its own."""

from __future__ import annotations

from ..functions.names import AND_RULE, COMMA_RULE, JOINERS, LIGHT_WRAPPERS, NOISE_RULES, SUFFIX_RULES, SUFFIXES, WRAPPERS
from ..operators.prompts import NO_CANDIDATES, SYSTEM_PLAIN, SYSTEM_SCORED, SYSTEM_SHORT


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def u(salt: str, *key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)}, {text(salt)})), 1, 8))::bigint / 4294967296.0)"


def pick(draw: str, values: list[str]) -> str:
    return f"({listed(values)})[floor({draw} * {len(values)})::int + 1]"


WHITE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"


def wide(rule: str) -> str:
    return rule.replace(r"\s", WHITE)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def rules(x: str, pairs: list[tuple[str, str]]) -> str:
    for rule, to in pairs:
        x = f"regexp_replace({x}, {text(wide(rule))}, {text(to)}, 'gi')"
    return x


def basic(x: str) -> str:
    return rf"regexp_replace(replace(replace(replace({strip(f'lower({x})')}, ',', ''), '.', ''), ' & ', ' and '), '{WHITE}+', ' ', 'g')"


def noiseless(x: str) -> str:
    return strip(rules(x, [(r, "") for r in NOISE_RULES]))


def suffix_form(x: str) -> str:
    return strip(rules(strip(f"lower({x})"), SUFFIX_RULES))


def comma(x: str) -> str:
    return f"regexp_replace({x}, {text(wide(COMMA_RULE))}, ' \\1', 'gi')"


def title(x: str) -> str:
    return f"list_reduce(list_concat([''], string_split({x}, '')), lambda o, ch: o || CASE WHEN regexp_matches(right(o, 1), '[A-Za-z]') THEN lower(ch) ELSE upper(ch) END)"


def swapped(x: str, choice: str, gap: str) -> str:
    arms = " ".join(f"WHEN lower({x}) LIKE {text('%' + key)} THEN rtrim(substr({x}, 1, length({x}) - {len(key)}), ', ') || {pick(gap, [' ', ', '])} || {pick(choice, forms)}" for key, forms in SUFFIXES.items())
    return f"(CASE {arms} ELSE {x} END)"


def recased(x: str, draw: str) -> str:
    return f"(CASE WHEN {draw} < 0.25 THEN upper({x}) WHEN {draw} < 0.45 THEN lower({x}) WHEN {draw} < 0.55 THEN {title(x)} ELSE {x} END)"


def wrapped(x: str, draw: str, wrappers: list[str] = WRAPPERS) -> str:
    return strip(f"replace({pick(draw, wrappers)}, '{{name}}', {x})")


ENTITIES = """entities AS (SELECT *, p_partkey AS ord FROM (SELECT p_partkey, p_partkey AS cik,
  concat(p_name, ' ', lower(p_type), ' ', replace(p_brand, '#', ' '), ' ', p_size, ([', Inc.', ' INC', ' Corp.', ' & Co.', ', LLC', ' Ltd.', ' Holdings', ' plc'])[(p_partkey % 8)::int + 1]) AS name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(p_type) END AS entity_type, p_name, p_brand FROM part)),
registry AS (SELECT cik, ord, name, entity_type, CASE cik % 3 WHEN 0 THEN cast([] AS varchar[]) WHEN 1 THEN [concat(p_name, ' ', lower(p_brand))]
  ELSE [concat(p_name, ' co'), CASE WHEN cik % 7 = 0 THEN upper(name) ELSE '' END] END AS former_names FROM entities)"""
MESSY = f"messy AS (SELECT * REPLACE (CASE WHEN cik % 11 = 0 THEN replace(messy, ' ', chr(160)) WHEN cik % 17 = 0 THEN replace(messy, ' ', chr(12288)) ELSE messy END AS messy) FROM (SELECT *, replace(({listed(WRAPPERS)})[(cik % 13)::int + 1], '{{name}}', name) AS messy FROM registry))"
FORMER = f"former AS (SELECT cik, name, entity_type, nth - 1 AS nth, former_names[nth] AS former FROM (SELECT *, unnest(range(1, len(former_names) + 1)) AS nth FROM registry) WHERE former_names[nth] <> '' AND {strip('lower(former_names[nth])')} <> {strip('lower(name)')})"


def noise(source: str, key: tuple[str, ...], p: str) -> str:
    """CTEs up to {p}6, each kind of noise as its own column: k1 to k3, and the noisy name c before it is wrapped."""
    v = lambda s: u(s, *key)
    joined = f"regexp_replace(a, {text(wide(AND_RULE))}, {pick(v('joiner'), JOINERS)}, 'g')"
    return f"""{p}1 AS (SELECT *, {v('swap?')} < 0.85 AS k1, {v('points?')} < 0.5 AS k2, {v('case?')} < 0.4 AS k3 FROM {source}),
{p}2 AS (SELECT *, CASE WHEN k1 THEN {swapped('name', v('swap'), v('gap'))} ELSE name END AS a FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN k2 THEN {joined} ELSE a END AS b0 FROM {p}2),
{p}4 AS (SELECT *, CASE WHEN k2 AND {v('commas')} < 0.3 THEN replace(b0, ',', '') ELSE b0 END AS b1 FROM {p}3),
{p}5 AS (SELECT *, CASE WHEN k2 AND {v('spaces')} < 0.2 THEN regexp_replace(b1, '{WHITE}+', '  ', 'g') ELSE b1 END AS b FROM {p}4),
{p}6 AS (SELECT *, CASE WHEN k3 THEN {recased('b', v('case'))} ELSE b END AS c FROM {p}5)"""


def noisy_steps() -> str:
    """First data set."""
    key = ("cik", "'noisy'", "variant")
    s = lambda salt: u(salt, "cik", "'suffix'", "variant")
    return f"""n0 AS (SELECT *, unnest(range(0, 5)) AS variant FROM registry), {noise('n0', key, 'n')},
s1 AS (SELECT *, CASE WHEN {s('swap?')} < 0.9 THEN {swapped('name', s('swap'), s('gap'))} ELSE name END AS a FROM (SELECT *, unnest(range(0, 2)) AS variant FROM registry)),
examples AS (
  SELECT cik, 'former' AS branch, nth::bigint AS variant, former AS input, name, entity_type, true AS is_former, 'hard' AS difficulty FROM former
  UNION ALL SELECT cik, 'noisy', variant, {wrapped('c', u('wrapper', *key))}, name, entity_type, false, CASE WHEN k1::int + k2::int + k3::int >= 2 THEN 'hard' ELSE 'easy' END FROM n6
  UNION ALL SELECT cik, 'suffix', variant, {wrapped('a', s('wrapper'))}, name, entity_type, false, 'hard' FROM s1
  UNION ALL SELECT cik, 'identity', 0, name, name, entity_type, false, 'easy' FROM registry)"""


ASKED_KEY = ("cik", "'query'")
ASKED = f"""q0 AS (SELECT * FROM registry WHERE cik % 50 = 0), {noise('q0', ASKED_KEY, 'q')},
asked AS MATERIALIZED (SELECT cik AS qid, cik, name, {wrapped('c', u('wrapper', *ASKED_KEY))} AS query FROM q6)"""
HARD = "(contains(lower(query), 'former') OR contains(query, '/DE/'))"


def tokens(x: str) -> str:
    return rf"array_to_string(list_sort(list_filter(string_split_regex({x}, '{WHITE}+'), lambda t: t <> '')), ' ')"


def ratios(pairs: str, out: str) -> str:
    """A CTE that adds score, 200 * the longest common subsequence / both lengths, to a table of pairs (a, b); a has up to 120 characters.

    One bit of a number for each character of a; the characters of b are run through it."""
    chars = f"SELECT a, map_from_entries(list(row(ch, m))) AS masks FROM (SELECT a, ch, sum(pow(2, i - 1)::hugeint)::hugeint AS m FROM (SELECT a, unnest(string_split(a, '')) AS ch, generate_subscripts(string_split(a, ''), 1) AS i FROM (SELECT DISTINCT a FROM {pairs} WHERE a <> '')) GROUP BY a, ch) GROUP BY a"
    step = "lambda v, m: ((v + (v & m)) | (v - (v & m))) & full"
    masks = "list_transform(CASE WHEN b = '' THEN [] ELSE string_split(b, '') END, lambda ch: coalesce(masks[ch], 0::hugeint))"
    bits = f"list_reduce({masks}, {step}, full)".replace("full", "(pow(2, length(a))::hugeint - 1)")
    return f"""{out}_m AS MATERIALIZED ({chars}),
{out} AS MATERIALIZED (SELECT * EXCLUDE (common), CASE WHEN length(a) + length(b) = 0 THEN 100::double ELSE (200::double * common) / (length(a) + length(b)) END AS score
  FROM (SELECT p.*, CASE WHEN p.a = '' THEN 0 ELSE length(p.a) - bit_count({bits.replace('length(a)', 'length(p.a)').replace("b = ''", "p.b = ''").replace("string_split(b", "string_split(p.b")}) END AS common FROM {pairs} p LEFT JOIN {out}_m k ON p.a = k.a))"""


LAST = "list_filter(former_names, lambda f: f <> '')[-1]"
CHOICES = f"""choices AS (SELECT ord, {tokens(basic('name'))} AS b FROM registry WHERE name IS NOT NULL UNION ALL SELECT ord, {tokens(f'lower({LAST})')} FROM registry WHERE {LAST} IS NOT NULL),
pairs AS (SELECT qid, ord, {tokens(basic('query'))} AS a, b FROM asked, choices), {ratios('pairs', 'rated')}"""


def best_rows(k: int) -> str:
    return f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM (SELECT qid, ord, max(score) AS score FROM rated GROUP BY qid, ord)) WHERE rank <= {k})"


FOUND = f"{CHOICES}, {best_rows(3)}, cand AS MATERIALIZED (SELECT b.qid, b.rank, b.score, r.cik AS c_cik, r.name AS c_name, r.entity_type AS c_type, a.query, a.cik, a.name FROM best b JOIN registry r ON b.ord = r.ord JOIN asked a ON a.qid = b.qid)"


def second_steps() -> str:
    f = lambda salt: u(salt, "cik", "'former'", "nth")
    li = lambda salt: u(salt, "cik", "'light'", "variant")
    fu = lambda salt: u(salt, "cik", "'full'", "variant")
    co = lambda salt: u(salt, "cik", "'comma'", "variant")
    return f"""l0 AS (SELECT *, unnest(range(0, 3)) AS variant FROM registry), c0 AS (SELECT *, unnest(range(0, 2)) AS variant FROM registry),
l1 AS (SELECT *, {swapped('name', li('swap'), li('gap'))} AS a FROM l0),
f1 AS (SELECT *, CASE WHEN {fu('swap?')} < 0.7 THEN {swapped('name', fu('swap'), fu('gap'))} ELSE name END AS a FROM l0),
f2 AS (SELECT *, CASE WHEN {fu('case?')} < 0.4 THEN {recased('a', fu('case'))} ELSE a END AS b FROM f1),
c1 AS (SELECT *, {comma('name')} AS a FROM c0 WHERE contains(name, ',')),
second AS (
  SELECT 'former' AS branch, former AS input, true AS changed, true AS is_former, 'hard' AS difficulty FROM former
  UNION ALL SELECT 'former_suffix', {swapped('former', f('swap'), f('gap'))}, {swapped('former', f('swap'), f('gap'))} <> former, true, 'hard' FROM former
  UNION ALL SELECT 'former_wrapped', {wrapped('former', f('wrapper'))}, {wrapped('former', f('wrapper'))} <> former, true, 'hard' FROM former
  UNION ALL SELECT 'light', {wrapped('a', li('wrapper'), LIGHT_WRAPPERS)}, true, false, 'hard' FROM l1
  UNION ALL SELECT 'full', {wrapped('b', fu('wrapper'))}, true, false, 'hard' FROM f2
  UNION ALL SELECT 'comma', {wrapped('a', co('wrapper'), LIGHT_WRAPPERS)}, true, false, 'hard' FROM c1 WHERE a <> name
  UNION ALL SELECT 'identity', name, true, false, 'easy' FROM registry)"""


def with_rows(steps: str) -> str:
    """second with the columns that tell its rows apart."""
    for branch, at in (("former", "nth"), ("former_suffix", "nth"), ("former_wrapped", "nth"), ("light", "variant"), ("full", "variant"), ("comma", "variant"), ("identity", "0")):
        steps = steps.replace(f"SELECT '{branch}'", f"SELECT cik, name AS canonical_name, entity_type, {at}::bigint AS variant, '{branch}'", 1)
    return steps


LOOKUP_TABLE = f"""named AS (SELECT ord, 0 AS kind, 0 AS nth, name AS t FROM registry UNION ALL SELECT ord, 1, nth, former_names[nth] FROM (SELECT *, unnest(range(1, len(former_names) + 1)) AS nth FROM registry) WHERE former_names[nth] <> ''),
normed AS (SELECT *, {suffix_form('t')} AS norm FROM named),
lookup AS (SELECT norm, ord FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY kind, CASE WHEN kind = 0 THEN -ord ELSE ord END, nth) AS r FROM normed) WHERE r = 1)"""
LOOKUP = f"""{LOOKUP_TABLE}, tried AS (SELECT m.cik AS qid, m.name, {suffix_form(noiseless('m.messy'))} AS norm FROM messy m)"""
CASCADE = f"""{LOOKUP_TABLE}, looked AS MATERIALIZED (SELECT t.qid, t.query, l.ord FROM (SELECT qid, query, {suffix_form(noiseless('query'))} AS norm FROM asked) t LEFT JOIN lookup l ON t.norm = l.norm),
fallback AS (SELECT ord, 0 AS kind, {tokens('name')} AS b FROM registry WHERE name IS NOT NULL UNION ALL SELECT ord, 1, {tokens(LAST)} FROM registry WHERE {LAST} IS NOT NULL),
left_over AS (SELECT qid, f.ord, kind, {tokens('query')} AS a, b FROM looked, fallback f WHERE looked.ord IS NULL), {ratios('left_over', 'likened')},
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, ord) AS place FROM likened) WHERE place = 1 AND score >= 80),
cascade AS (SELECT qid, ord, 'exact' AS how, 100::double AS score FROM looked WHERE ord IS NOT NULL
  UNION ALL SELECT w.qid, n.ord, CASE WHEN n.ord IS NOT NULL THEN 'similar' END, n.score FROM looked w LEFT JOIN nearest n ON w.qid = n.qid WHERE w.ord IS NULL)"""


# windows of the longer text, as long as the shorter one and shorter at both ends; equal lengths both ways
PARTIAL = f"""bare AS (SELECT qid, {noiseless('query')} AS q FROM asked), held AS (SELECT ord, 0 AS kind, name AS t FROM registry WHERE name IS NOT NULL UNION ALL SELECT ord, 1, {LAST} FROM registry WHERE {LAST} IS NOT NULL),
both_ways AS (SELECT qid, ord, kind, q AS s, t AS l FROM bare, held WHERE length(q) <= length(t) UNION ALL SELECT qid, ord, kind, t, q FROM bare, held WHERE length(t) <= length(q)),
sought AS (SELECT DISTINCT s, l FROM both_ways WHERE s <> '' AND l <> ''),
slid AS (SELECT DISTINCT s AS a, l, substr(l, greatest(i, 0)::int + 1, length(s) + least(i, 0)::int) AS b FROM (SELECT s, l, unnest(range(1 - length(s), length(l))) AS i FROM sought)), {ratios('slid', 'slid_scores')},
tops AS (SELECT a AS s, l, max(score) AS score FROM slid_scores GROUP BY a, l),
parts AS (SELECT w.qid, w.ord, w.kind, max(coalesce(t.score, CASE WHEN w.s = w.l THEN 100 ELSE 0 END)) AS score FROM both_ways w LEFT JOIN tops t ON w.s = t.s AND w.l = t.l GROUP BY w.qid, w.ord, w.kind),
likest_part AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, ord) AS place FROM parts) WHERE place = 1)"""


# the cascade with both scorers: of equal scores the sorted tokens' wins
BOTH = CASCADE.replace(",\nnearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, ord) AS place FROM likened)", f""",
{PARTIAL},
both_scores AS (SELECT qid, ord, kind, score, 0 AS scorer FROM likened UNION ALL SELECT p.qid, p.ord, p.kind, p.score, 1 FROM parts p JOIN looked w ON w.qid = p.qid WHERE w.ord IS NULL),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, scorer, kind, ord) AS place FROM both_scores)""")
MISSPELT = f"""{ASKED.replace('asked AS MATERIALIZED (SELECT cik AS qid,', 'spelt AS (SELECT k1::int + k2::int + k3::int AS kinds, cik AS qid,')},
asked AS MATERIALIZED (SELECT * REPLACE (CASE WHEN qid % 100 = 0 THEN substr(query, 1, (length(query) // 2)::int) || substr(query, (length(query) // 2)::int + 2) ELSE query END AS query) FROM spelt)"""


def plain(x: str) -> str:
    return strip(f"replace(replace(lower({x}), ',', ''), '.', '')")


# a prediction: the second candidate's name without commas, and its id where the query's id isn't divisible by 100
RESOLVED = f"""told AS (SELECT qid, upper(replace(coalesce(max(c_name) FILTER (WHERE rank = 2), max(c_name) FILTER (WHERE rank = 1)), ',', '')) AS predicted,
  CASE WHEN qid % 100 <> 0 THEN coalesce(max(c_cik) FILTER (WHERE rank = 2), max(c_cik) FILTER (WHERE rank = 1)) END AS predicted_cik FROM cand GROUP BY qid)"""


def likest(said: str, name: str) -> str:
    return f"said AS (SELECT c.qid, c.rank, c.c_cik, c.c_name, {tokens(said)} AS a, {tokens(f'lower({name})')} AS b FROM cand c JOIN told t ON c.qid = t.qid), {ratios('said', 'compared')}"


LABELLED = """labelled AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'hard' WHEN quality = 1 THEN 'easy' ELSE 'other' END AS difficulty,
  coalesce(trim(lower(source)) = trim(lower(CASE WHEN n_chars > 1000 THEN ' ' || upper(source) WHEN n_chars > 200 THEN lang END)), false) AS name_match,
  coalesce(ltrim(d.doc_id::varchar, '0') = ltrim(CASE WHEN n_chars % 3 = 0 THEN '00' || d.doc_id::varchar WHEN n_chars % 3 = 1 THEN n_chars::varchar END, '0'), false) AS cik_match
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def share(flag: str, where: str = "") -> str:
    return f"round(coalesce(avg({flag}::int){f' FILTER (WHERE {where})' if where else ''}, 0.0), 9)"


def split_sql(table: str, key: str, salt: str, arms: str) -> str:
    return f"SELECT {key}, CASE {arms} ELSE 'train' END AS split FROM (SELECT {key}, row_number() OVER (ORDER BY {u(salt, key)}, {key}) AS place, count(*) OVER () AS total FROM {table})"


def placed_sql(salt: str) -> str:
    return f"placed AS (SELECT cik, ord, name, entity_type, row_number() OVER (ORDER BY {u(f'{salt}|place', 'cik')}, cik) AS place, count(*) OVER () AS total FROM registry)"


def drawn_sql(examples: str, key: list[str], salt: str, k: int = 5) -> str:
    """CTEs up to picked (key, slot, candidate_cik, candidate_name, candidate_type): each example's own row and k-1 others on the circle."""
    keys = ", ".join(key)
    steps = [f"a0 AS (SELECT {', '.join('e.' + x for x in key)}, p.place, p.total, least({k - 1}, p.total - 1) AS most, [0]::bigint[] AS away FROM {examples} e JOIN placed p ON e.cik = p.cik)"]
    for i in range(1, k):
        one = f"(floor({u(f'{salt}|{i}', *key)} * (total - 1 - most + {i}))::bigint + 1)"
        steps.append(f"a{i} AS (SELECT * REPLACE (CASE WHEN {i} > most THEN away WHEN list_contains(away, {one}) THEN list_append(away, total - 1 - most + {i}) ELSE list_append(away, {one}) END AS away) FROM a{i - 1})")
    steps.append(f"met AS (SELECT a.* EXCLUDE (place), p.place AS spot, p.cik AS candidate_cik, p.name AS candidate_name, p.entity_type AS candidate_type FROM (SELECT {keys}, place, total, unnest(away) AS away FROM a{k - 1}) a JOIN placed p ON (a.place - 1 + a.away) % a.total + 1 = p.place)")
    steps.append(f"picked AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {u(f'{salt}|slot', *key, 'spot')}, spot) AS slot, candidate_cik, candidate_name, candidate_type FROM met)")
    return ", ".join(steps)


def answer_sql(name: str, kind: str, former: str) -> str:
    return f"""'{{"canonical_name":"' || {name} || '","cik":' || cik || ',"entity_type":"' || coalesce(nullif({kind}, ''), 'unknown') || '","is_former_name_input":' || CASE WHEN {former} THEN 'true' ELSE 'false' END || '}}'"""


def turn(role: str, content: str) -> str:
    return f"('<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10))"


USER = """'Company name: "' || query || '"' || chr(10) || chr(10) || 'Candidates:' || chr(10) """
START = "'<|im_start|>assistant' || chr(10)"
ONE = "WITH " + ENTITIES
ONE_KEY = ("cik", "'one'")
SQL: dict[str, str] = {
    "registry_projection": f"{ONE} SELECT cik, name, coalesce(nullif(entity_type, ''), 'unknown') AS entity_type, {basic('name')} AS name_norm, len(former_names) AS n_former, array_to_string(former_names, '|') AS former FROM registry WHERE name <> ''",
    "former_name_unnest": f"{ONE}, {FORMER} SELECT cik, nth, former FROM former",
    "former_name_last": f"{ONE} SELECT cik, list_filter(former_names, lambda f: f <> '')[-1] AS former FROM registry WHERE len(list_filter(former_names, lambda f: f <> '')) > 0",
    "registry_union": "SELECT 'supplier' AS source, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer",
    "page_titles": f"WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages) SELECT page_id, title, {noiseless('title')} AS cleaned, {suffix_form(noiseless('title'))} AS norm FROM t",
    "strip_noise": f"{ONE}, {MESSY} SELECT cik, messy, {noiseless('messy')} AS cleaned FROM messy",
    "normalize_suffix": f"{ONE}, {MESSY} SELECT cik, {suffix_form('name')} AS norm, {suffix_form(noiseless('messy'))} AS messy_norm FROM messy",
    "normalize_basic": f"{ONE}, {MESSY} SELECT cik, {basic('messy')} AS norm FROM messy",
    "comma_before_suffix": f"{ONE} SELECT cik, {comma('name')} AS bare, {comma('name')} <> name AS changed FROM registry WHERE contains(name, ',')",
    "title_case": f"{ONE}, t AS (SELECT name AS text FROM registry UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) SELECT text, {title('text')} AS titled FROM t",
    "suffix_swap": f"{ONE} SELECT cik, {swapped('name', u('swap', *ONE_KEY), u('gap', *ONE_KEY))} AS swapped FROM registry",
    "casing_noise": f"{ONE} SELECT cik, {recased('name', u('case', *ONE_KEY))} AS recased FROM registry",
    "punctuation_noise": rf"""{ONE}, a AS (SELECT *, regexp_replace(name, {text(wide(AND_RULE))}, {pick(u('joiner', *ONE_KEY), JOINERS)}, 'g') AS x FROM registry),
b AS (SELECT *, CASE WHEN {u('commas', *ONE_KEY)} < 0.3 THEN replace(x, ',', '') ELSE x END AS y FROM a)
SELECT cik, CASE WHEN {u('spaces', *ONE_KEY)} < 0.2 THEN regexp_replace(y, '{WHITE}+', '  ', 'g') ELSE y END AS noisy FROM b""",
    "noisy_variants": f"{ONE}, {FORMER}, {noisy_steps()} SELECT cik, branch, variant, input, name AS canonical_name, coalesce(nullif(entity_type, ''), 'unknown') AS entity_type, is_former, difficulty FROM examples",
    "variants_v3_counts": f"""{ONE}, {FORMER}, {noisy_steps()}, held AS (SELECT DISTINCT input FROM examples WHERE cik % 7 = 0), {second_steps()},
flagged AS (SELECT s.*, h.input IS NOT NULL AS in_test FROM second s LEFT JOIN held h ON s.input = h.input)
SELECT branch, count(*) AS tried, count(*) FILTER (WHERE changed AND NOT in_test) AS kept, count(*) FILTER (WHERE changed AND NOT in_test AND difficulty = 'hard') AS hard,
count(*) FILTER (WHERE changed AND NOT in_test AND is_former) AS former, count(*) FILTER (WHERE in_test) AS skipped, count(DISTINCT input) AS inputs FROM flagged GROUP BY branch""",
    "decontaminate_exact": f"{ONE}, {FORMER}, {noisy_steps()} SELECT cik, branch, variant, input FROM examples e WHERE NOT EXISTS (SELECT 1 FROM examples h WHERE h.cik % 7 = 0 AND h.input = e.input)",
    "decontaminate_contains": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''",
    "holdout_antijoin": f"{ONE} SELECT cik, name FROM registry WHERE cik NOT IN (SELECT s_suppkey FROM supplier)",
    "random_distractors": f"{ONE}, {placed_sql('distractor')}, {drawn_sql('placed', ['cik'], 'distractor')} SELECT cik, slot, candidate_cik FROM picked",
    "token_sort": rf"{ONE}, {MESSY} SELECT cik, array_to_string(list_sort(list_filter(string_split_regex(messy, '{WHITE}+'), lambda t: t <> '')), ' ') AS sorted FROM messy",
    "exact_lookup": f"{ONE}, {MESSY}, {LOOKUP} SELECT t.qid, t.norm, l.ord FROM tried t LEFT JOIN lookup l ON t.norm = l.norm",
    "fuzzy_topk": f"{ONE}, {ASKED}, {CHOICES}, {best_rows(3)} SELECT qid, rank, ord, round(score, 6) AS score FROM best",
    "fuzzy_topk_all_former": f"""{ONE}, {ASKED}, choices AS (SELECT ord, 0 AS nth, {tokens('name')} AS b FROM registry UNION ALL SELECT ord, nth, {tokens('f')} FROM (SELECT ord, unnest(list_filter(former_names, lambda f: f <> '')) AS f, generate_subscripts(list_filter(former_names, lambda f: f <> ''), 1) AS nth FROM registry)),
pairs AS (SELECT qid, ord, nth, {tokens('query')} AS a, b FROM asked, choices), {ratios('pairs', 'rated')},
placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord, nth) AS place FROM rated) WHERE place <= 6),
firsts AS (SELECT qid, ord, min(place) AS place, max(score) AS score FROM placed GROUP BY qid, ord)
SELECT qid, rank, ord, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM firsts) WHERE rank <= 3""",
    "match_cascade_two_scorers": f"{ONE}, {ASKED}, {BOTH} SELECT qid, ord, how, round(score, 6) AS score FROM cascade",
    "hybrid_report_two_scorers": f"""{ONE}, {MISSPELT}, {FOUND}, {BOTH}, flags AS (SELECT CASE WHEN a.kinds >= 2 THEN 'hard' ELSE 'easy' END AS difficulty, coalesce(r.name = a.name, false) AS hit, r.cik IS NULL AS call,
  r.cik IS NULL AND coalesce({strip('lower(a.name)')} = {strip('lower(c.c_name)')}, false) AS call_hit FROM asked a JOIN cascade k ON k.qid = a.qid LEFT JOIN registry r ON r.ord = k.ord LEFT JOIN cand c ON c.qid = a.qid AND c.rank = 1)
SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE call) AS calls, count(*) FILTER (WHERE call_hit) AS call_hits, count(*) FILTER (WHERE difficulty = 'hard') AS hard, count(*) FILTER (WHERE hit AND difficulty = 'hard') AS hard_hits,
count(*) FILTER (WHERE difficulty = 'easy') AS easy, count(*) FILTER (WHERE hit AND difficulty = 'easy') AS easy_hits, {share('hit')} AS accuracy, {share('hit', "difficulty = 'hard'")} AS accuracy_hard, {share('hit', "difficulty = 'easy'")} AS accuracy_easy,
{share('(hit OR call_hit)')} AS total_accuracy, {share('call')} AS call_rate FROM flags""",
    "fuzzy_threshold_high": f"{ONE}, {ASKED}, {CHOICES} SELECT qid, ord, round(max(score), 6) AS score FROM rated WHERE score >= 90 GROUP BY qid, ord",
    "partial_ratio_top1": f"""{ONE}, {ASKED}, {PARTIAL} SELECT qid, ord, round(score, 6) AS score FROM likest_part""",
    "fuzzy_threshold": f"{ONE}, {ASKED}, {CHOICES} SELECT qid, ord, round(max(score), 6) AS score FROM rated WHERE score >= 80 GROUP BY qid, ord",
    "match_cascade": f"{ONE}, {ASKED}, {CASCADE} SELECT qid, ord, how, round(score, 6) AS score FROM cascade",
    "flagship": f"{ONE}, {ASKED}, {FOUND} SELECT qid, query, c_cik AS found_cik, c_name AS found_name, round(score, 6) AS score, name = c_name AS name_match, cik = c_cik AS cik_match FROM cand WHERE rank = 1",
    "candidate_prompt": f"""{ONE}, {ASKED}, {FOUND} SELECT qid, 'Company name: "' || any_value(query) || '"' || chr(10) || chr(10) || 'Candidates:' || chr(10) || string_agg(rank || '. canonical_name: "' || c_name || '"  cik: ' || c_cik, chr(10) ORDER BY rank) AS prompt,
string_agg('[' || rank || '] ' || c_name || ' | CIK: ' || c_cik || ' | Type: ' || coalesce(nullif(c_type, ''), 'unknown'), chr(10) ORDER BY rank) AS bracketed FROM cand GROUP BY qid""",
    "model_prompts": f"""{ONE}, {ASKED}, {FOUND}, said AS (SELECT qid, any_value(query) AS query, string_agg(rank || '. canonical_name: "' || c_name || '"  cik: ' || c_cik || ' (score: ' || round_even(score, 0)::int || ')', chr(10) ORDER BY rank) AS listed FROM cand GROUP BY qid)
SELECT qid, {turn('system', text(SYSTEM_SCORED))} || {turn('user', USER + "|| listed")} || {START} AS scored, {turn('system', text(SYSTEM_SHORT))} || {turn('user', USER + "|| " + text(NO_CANDIDATES))} || {START} AS without FROM said""",
    "formatted": """SELECT page_id, lpad(page_id::varchar, 10, '0') AS padded, printf('%.1f%%', (page_id % 7) / 7 * 100) AS share, array_to_string(string_split(replace(html, '>', '>' || chr(10)), chr(10))[1:3], chr(10)) AS head FROM pages""",
    "input_order": f"{ONE} SELECT cik, name, row_number() OVER (ORDER BY cik) AS place FROM registry",
    "file_digests": f"{ONE} SELECT cik // 1000 AS range, sha256(string_agg(name || chr(10), '' ORDER BY cik)) AS sha256 FROM registry GROUP BY cik // 1000",
    "resolve_by_id": f"""{ONE}, {ASKED}, {FOUND}, {RESOLVED}, {likest('lower(t.predicted)', 'c.c_name')},
hit AS (SELECT c.qid, first(c.c_cik ORDER BY c.rank) AS cik, first(c.c_name ORDER BY c.rank) AS name FROM cand c JOIN told t ON c.qid = t.qid AND c.c_cik = t.predicted_cik GROUP BY c.qid),
near AS (SELECT qid, first(c_cik ORDER BY score DESC, rank) AS cik, first(c_name ORDER BY score DESC, rank) AS name FROM compared WHERE score >= 70 GROUP BY qid)
SELECT t.qid, coalesce(hit.name, near.name, t.predicted) AS name, coalesce(hit.cik, near.cik) AS resolved_cik FROM told t LEFT JOIN hit ON t.qid = hit.qid LEFT JOIN near ON t.qid = near.qid""",
    "resolve_by_name": f"""{ONE}, {ASKED}, {FOUND}, {RESOLVED}, {likest(plain('t.predicted'), 'c.c_name')},
same AS (SELECT c.qid, first(c.c_cik ORDER BY c.rank) AS cik FROM cand c JOIN told t ON c.qid = t.qid AND {plain('c.c_name')} = {plain('t.predicted')} GROUP BY c.qid),
near AS (SELECT qid, first(c_cik ORDER BY score DESC, rank) AS cik FROM compared WHERE score > 75 GROUP BY qid)
SELECT t.qid, coalesce(same.cik, near.cik) AS resolved_cik, same.cik IS NOT NULL AS same FROM told t LEFT JOIN same ON t.qid = same.qid LEFT JOIN near ON t.qid = near.qid""",
    "eval_report": f"""{ONE}, {ASKED}, {FOUND}, {CASCADE}, answers AS (SELECT 'first candidate' AS model, query, name, cik, c_name AS a_name, c_cik AS a_cik FROM cand WHERE rank = 1
  UNION ALL SELECT 'rule matcher', a.query, a.name, a.cik, r.name, r.cik FROM asked a JOIN cascade c ON a.qid = c.qid LEFT JOIN registry r ON c.ord = r.ord),
flags AS (SELECT model, coalesce(name = a_name, false) AS name_match, coalesce(cik = a_cik, false) AS cik_match, {HARD} AS hard FROM answers)
SELECT model, count(*) AS n, count(*) FILTER (WHERE name_match) AS name_hits, count(*) FILTER (WHERE cik_match) AS cik_hits, count(*) FILTER (WHERE hard) AS hard, count(*) FILTER (WHERE hard AND name_match) AS hard_hits, {share('name_match')} AS hit_rate FROM flags GROUP BY model""",
    "distractor_examples": f"""{ONE}, {FORMER}, {noisy_steps()}, {placed_sql('distractor')}, {drawn_sql('examples', ['cik', 'branch', 'variant'], 'distractor')},
lists AS (SELECT cik, branch, variant, string_agg('[' || slot || '] ' || candidate_name || ' | CIK: ' || candidate_cik || ' | Type: ' || coalesce(nullif(candidate_type, ''), 'unknown'), chr(10) ORDER BY slot) AS listed FROM picked GROUP BY cik, branch, variant)
SELECT cik, branch, variant, 'Company name: ' || input || chr(10) || chr(10) || 'One of these is meant:' || chr(10) || listed AS prompt, {answer_sql('name', 'entity_type', 'is_former')} AS answer, difficulty FROM examples JOIN lists USING (cik, branch, variant)""",
    "distractor_examples_repeated": f"""{ONE.replace('registry AS (', 'single AS (', 1)}, registry AS (SELECT * FROM single UNION ALL SELECT * REPLACE (ord + 1000000000 AS ord) FROM single WHERE cik % 40 = 0),
{FORMER.replace('SELECT cik, name,', 'SELECT cik, ord, name,', 1)}, {noisy_steps().replace('SELECT cik, ', 'SELECT ord, cik, ')} SELECT ord, cik, branch, variant, input, 5::bigint AS n, true AS has_own FROM examples""",
    "variants_v3": f"""{ONE}, {FORMER}, {noisy_steps()}, held AS (SELECT DISTINCT input FROM examples WHERE cik % 7 = 0), {with_rows(second_steps())}
SELECT cik, branch, variant, input, canonical_name, coalesce(nullif(entity_type, ''), 'unknown') AS entity_type, is_former, difficulty FROM second s WHERE changed AND NOT EXISTS (SELECT 1 FROM held h WHERE h.input = s.input)""",
    "captured_registry": f"{ONE} SELECT cik, name, entity_type, array_to_string(former_names, '|') AS former FROM registry WHERE name <> ''",
    "progress_by_date": """WITH r AS (SELECT o_orderkey, count(*) OVER w AS place, cast(sum((o_orderstatus = 'F')::int) OVER w AS bigint) AS hits FROM orders WINDOW w AS (ORDER BY o_orderdate::varchar, o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, place, hits, round(hits / place, 6) AS share FROM r WHERE place % 50 = 0""",
    "split_entities": f"""WITH e AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), c AS (SELECT o_custkey, n, sum(n) OVER (ORDER BY {u('entity', 'o_custkey')}, o_custkey ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM e),
one AS (SELECT max(upto) AS cut FROM c WHERE upto - n < greatest(100, floor(total * 0.12)))
SELECT o_orderkey, o_custkey, CASE WHEN upto <= cut THEN 'test' WHEN upto - n < cut + greatest(100, floor(total * 0.10)) THEN 'valid' ELSE 'train' END AS split FROM orders JOIN c USING (o_custkey), one""",
    "chat_splits": f"""{ONE}, {FORMER}, {noisy_steps()}, keyed AS (SELECT *, concat_ws('|', cik, branch, variant) AS key FROM examples), ordered AS (SELECT *, row_number() OVER (ORDER BY {u('split', 'key')}, key) AS place, count(*) OVER () AS total FROM keyed)
SELECT {text(SYSTEM_PLAIN)} AS "system", input AS "user", {answer_sql('name', 'entity_type', 'is_former')} AS assistant, difficulty, CASE WHEN place <= greatest(50, floor(total * 0.1)) THEN 'test' WHEN place <= 2 * greatest(50, floor(total * 0.1)) THEN 'valid' ELSE 'train' END AS split FROM ordered""",
    "chat_assembly": r"SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat, list(text ORDER BY turn)[2] AS second, list(role ORDER BY turn)[-1] AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id",
    "answer_json": f"{ONE} SELECT cik, {answer_sql('name', 'entity_type', '(cik % 2 = 0)')} AS answer FROM registry",
    "model_output_parse": r"""WITH r AS (SELECT event_id, '```json' || chr(10) || CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END || chr(10) || '```' AS t FROM events),
p AS (SELECT event_id, try_cast(nullif(regexp_extract(t, '(?s)\{.*\}', 0), '') AS json) AS j FROM r) SELECT event_id, j IS NOT NULL AS parsed, try_cast(json_extract_string(j, '$.k') AS bigint) AS k FROM p""",
    "score_rows": f"WITH {LABELLED} SELECT doc_id, difficulty, name_match, cik_match, name_match AND cik_match AS full_match FROM labelled",
    "accuracy_by_bucket": f"WITH {LABELLED}, f AS (SELECT *, name_match AND cik_match AS full_match FROM labelled) SELECT count(*) AS n, " + ", ".join(
        f"{share(flag, where)} AS {flag}_{name}" for flag in ("name_match", "cik_match", "full_match") for name, where in (("overall", ""), ("hard", "difficulty = 'hard'"), ("easy", "difficulty = 'easy'"))) + " FROM f",
    "hybrid_report": f"""{ONE}, {MESSY}, {LOOKUP}, j AS (SELECT t.*, l.ord, r.name AS found_name FROM tried t LEFT JOIN lookup l ON t.norm = l.norm LEFT JOIN registry r ON l.ord = r.ord)
SELECT count(*) AS n, count(*) FILTER (WHERE name = found_name) AS hits, count(*) FILTER (WHERE ord IS NULL) AS calls, round(count(*) FILTER (WHERE ord IS NULL) / count(*), 9) AS call_rate, {share('coalesce(name = found_name, false)')} AS accuracy FROM j""",
    "progress_running": """WITH r AS (SELECT event_id, count(*) OVER w AS place, cast(sum((value > 50)::int) OVER w AS bigint) AS hits, count(*) OVER () AS n FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, place, hits, round(hits / place, 6) AS share FROM r WHERE place % 50 = 0 OR place = n""",
    "split_rows": split_sql("orders", "o_orderkey", "split", "WHEN place <= greatest(50, floor(total * 0.1)) THEN 'test' WHEN place <= 2 * greatest(50, floor(total * 0.1)) THEN 'valid'"),
    "split_rows_one_share": ONE + " " + split_sql("registry", "cik", "split", "WHEN place <= greatest(100, floor(total * 0.15)) THEN 'valid'"),
    "split_by_entity": f"{ONE}, {FORMER}, {noisy_steps()} SELECT cik, branch, variant, CASE WHEN {u('entity', 'cik')} < 0.1 THEN 'test' WHEN {u('entity', 'cik')} < 0.2 THEN 'valid' ELSE 'train' END AS split FROM examples",
    "limit_then_filter": "SELECT doc_id, toxic::bigint AS toxic FROM (SELECT * FROM labels ORDER BY doc_id LIMIT 200) WHERE quality = 1",
    "file_checksum": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}
