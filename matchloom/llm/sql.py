"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .lm_corpus import DISCOUNT
from .lm_score import DIGITS
from .mixing import MAX_REPEATS, SEED
from .rules import LEAST_KEPT, MIN_DOCS, SHARE
from .secrets import ACCESS, ASSIGN, CANDIDATE, ENCODINGS, FDR, HEX, SHORTEST_VALUE, UNIFORM_LEVEL

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LINE = r"lower(trim(regexp_replace(regexp_replace(line, '\p{Nd}+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')))"

RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
windows AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
normal AS (SELECT doc_id, source, text, {_LINE} AS line, length(trim(line)) AS chars FROM lines WHERE length(trim(line)) > 0),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM normal GROUP BY source),
common AS (SELECT c.source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM normal GROUP BY source, line) c JOIN hosts ON c.source IS NOT DISTINCT FROM hosts.source WHERE n > {MIN_DOCS} AND n > CAST({SHARE} AS DOUBLE) * texts),
share AS (SELECT doc_id, CAST(sum(chars) FILTER (hit) AS DOUBLE) / sum(chars) AS gone FROM (SELECT doc_id, chars, EXISTS (SELECT 1 FROM common WHERE common.line = normal.line AND common.source IS NOT DISTINCT FROM normal.source) AS hit FROM normal) GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone, 0.0) AS boilerplate_share
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN share USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND boilerplate_share <= 1 - CAST({LEAST_KEPT} AS DOUBLE) AS kept FROM base
"""


def mixing(rounds: int = 8) -> str:
    """Targets settle in as many rounds as sources stop at their limit one after another; here `rounds` at most."""
    steps = ["t0 AS (SELECT source, own, weight, CAST(NULL AS DOUBLE) AS fixed FROM sources)"]
    for i in range(rounds):
        free = f"(total - (SELECT coalesce(sum(fixed), 0) FROM t{i})) * weight / (SELECT sum(weight) FROM t{i} WHERE fixed IS NULL)"
        steps.append(f"t{i + 1} AS (SELECT source, own, weight, CASE WHEN fixed IS NULL AND {free} > {MAX_REPEATS} * own THEN CAST({MAX_REPEATS} * own AS DOUBLE) ELSE fixed END AS fixed FROM t{i}, whole)")
    last = f"(total - (SELECT coalesce(sum(fixed), 0) FROM t{rounds})) * weight / (SELECT sum(weight) FROM t{rounds} WHERE fixed IS NULL)"
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, CAST('0x' || substr(md5('{SEED}|' || doc_id), 1, 15) AS BIGINT) AS spot FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS own, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
whole AS (SELECT CAST(sum(own) AS DOUBLE) AS total FROM sources),
{", ".join(steps)},
wanted AS (SELECT source, own, coalesce(fixed, {last}) AS target FROM t{rounds}, whole),
split AS (SELECT *, CASE WHEN own > 0 THEN least({MAX_REPEATS}, CAST(floor(target / own) AS BIGINT)) ELSE 0 END AS times FROM wanted),
shares AS (SELECT *, CASE WHEN times < {MAX_REPEATS} THEN CAST(floor(target - times * own + 0.5) AS BIGINT) ELSE 0 END AS more FROM split)
SELECT doc_id, size, own AS source_size, target, CAST(size * (times + CASE WHEN more > 0 AND 2 * upto - size <= 2 * more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY spot) AS upto FROM d) x JOIN shares ON x.source IS NOT DISTINCT FROM shares.source
"""


def _matches(name: str, rank: int, pattern: str, group: int = 0) -> str:
    """Spans of all matches: what a split leaves between them gives their places."""
    p = pattern.replace("'", "''")
    lengths = lambda x, end: f"coalesce(list_sum(list_transform({x}[1:{end}], lambda g: length(g))), 0)"
    start = f"{lengths('gaps', 'i')} + {lengths('whole', 'i - 1')}"
    found = f"SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {group}) AS bodies FROM d WHERE regexp_matches(text, '{p}')"
    return f"{name} AS (SELECT doc_id, CAST({start} AS BIGINT) AS s, {rank} AS k, CAST({start} + length(whole[i]) AS BIGINT) AS e, bodies[i] AS body FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM ({found})))"


def _chosen(column: int) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    cases = " ".join(f"WHEN regexp_matches(body, '{e[1]}') THEN {quoted(e[column])}" for e in ENCODINGS[:-1])
    return f"CASE {cases} ELSE {quoted(ENCODINGS[-1][column])} END"


def _tail(z: str) -> str:
    z = f"least(greatest({z}, -8.0), 8.0)"
    return f"(1 / (1 + exp(1.5976 * {z} + 0.070565992 * {z} * {z} * {z})))"


def secrets() -> str:
    kinds = "['assign', 'access', 'hex', 'random']"
    text = lambda of: f"coalesce(string_agg({kinds}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k){of}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_matches("m0", 0, ASSIGN, 2)},
{_matches("m1", 1, ACCESS)},
{_matches("m2", 2, HEX)},
{_matches("m3", 3, CANDIDATE)},
base AS (SELECT * FROM m0 WHERE length(body) >= {SHORTEST_VALUE} UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2),
free AS (SELECT * FROM m3 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m3.doc_id AND b.s < m3.e AND m3.s < b.e)),
coded AS (SELECT doc_id, s, k, e, {_chosen(2)} AS alphabet, {_chosen(3)} AS ic, CASE WHEN regexp_matches(body, '{ENCODINGS[1][1]}') THEN lower(body) ELSE body END AS body FROM free),
chars AS (SELECT doc_id, s, i, CAST(instr(alphabet, substr(body, i, 1)) - 1 AS DOUBLE) AS v, length(alphabet) AS size FROM (SELECT *, unnest(range(1, length(body) + 1)) AS i FROM coded)),
pairs AS (SELECT *, (size - 1) / 2.0 AS middle, lead(v) OVER (PARTITION BY doc_id, s ORDER BY i) AS w FROM chars),
tested AS (SELECT doc_id, s, CAST(max(size) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ((v > middle) <> (w > middle)) AS DOUBLE) AS changes, CAST(coalesce(sum((v - middle) * (w - middle)), 0) AS DOUBLE) AS lagged FROM pairs GROUP BY doc_id, s),
squares AS (SELECT doc_id, s, CAST(sum(c * c) AS DOUBLE) AS squares FROM (SELECT doc_id, s, v, count(*) AS c FROM chars GROUP BY doc_id, s, v) GROUP BY doc_id, s),
stats AS (SELECT doc_id, s, t.k, n, ic, k - 1 AS df, t.k / n * squares - n AS chi, (changes - (n - 1) / 2) / sqrt((n - 1) / 4) AS z_runs, lagged / ((t.k * t.k - 1) / 12 * sqrt(n - 1)) AS z_serial, n * greatest(t.k * ic - 1, 0.0) AS excess
  FROM tested t JOIN squares USING (doc_id, s) JOIN (SELECT doc_id, s, ic FROM coded) USING (doc_id, s)),
judged AS (SELECT doc_id, s, least(1.0, 3 * least({_tail("(pow(greatest(chi, 0.0) / df, CAST(1 AS DOUBLE) / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))")}, 2 * {_tail("abs(z_runs)")}, 2 * {_tail("abs(z_serial)")})) AS uniform, {_tail("(df + excess - chi) / sqrt(2 * (df + 2 * excess))")} AS p FROM stats),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, uniform, s) AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM judged),
found AS (SELECT doc_id, s FROM (SELECT *, max(CASE WHEN p <= i * CAST({FDR} AS DOUBLE) / m THEN i ELSE 0 END) OVER (PARTITION BY doc_id) AS last FROM placed) WHERE i <= last AND uniform >= CAST({UNIFORM_LEVEL} AS DOUBLE)),
spans AS (SELECT doc_id, s, k, e FROM base UNION ALL SELECT doc_id, s, k, e FROM coded SEMI JOIN found USING (doc_id, s))
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256({text(" FILTER (k < 3)")}) AS base_sha256, {text("")} AS spans, count(*) FILTER (k = 3) AS n_random
FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""


def lm_scores() -> str:
    """Bigram models of all words and bigrams, of all documents and of the target's, and each document's mean losses, also without its own counts."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

    def loss(target: str, mine: str) -> str:
        """Of a token; `mine` is 1 where the counts of its document are left out."""
        own = f"(w.n{target} - {mine} * dw.c + 1.0) / (tokens{target} - {mine} * size + words)"
        total = f"greatest(v.n{target} - {mine} * dv.c, 1)"
        rest = f"1 - (v.before{target} - {mine} * dv.before - {DISCOUNT} * (v.types{target} - {mine} * dv.alone{target})) / {total}"
        return f"-ln(CASE WHEN t.v IS NULL THEN {own} ELSE {own} * ({rest}) + greatest(p.n{target} - {mine} * dp.c - {DISCOUNT}, 0) / {total} END)"

    mine = "CASE WHEN t.good THEN 1 ELSE 0 END"
    sums = {"background_loss": loss("", "0"), "target_loss": loss("_t", "0"), "held_out_background_loss": loss("", "1"), "held_out_target_loss": loss("_t", mine)}
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0), false) AS good, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tokens AS (SELECT r, good, size, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT r, good, ws, len(ws) AS size, unnest(range(1, len(ws) + 1)) AS i FROM d)),
own_pairs AS (SELECT r, good, v, w, count(*) AS c FROM tokens WHERE v IS NOT NULL GROUP BY r, good, v, w),
pairs AS (SELECT v, w, sum(c) AS n, coalesce(sum(c) FILTER (good), 0) AS n_t FROM own_pairs GROUP BY v, w),
follow AS (SELECT v, sum(n) AS before, sum(n_t) AS before_t, count(*) AS types, count(*) FILTER (n_t > 0) AS types_t FROM pairs GROUP BY v),
own_follow AS (SELECT r, v, sum(c) AS before, count(*) FILTER (c = n) AS alone, count(*) FILTER (c = n_t AND good) AS alone_t FROM own_pairs JOIN pairs USING (v, w) GROUP BY r, v),
own_words AS (SELECT t.r, t.w, c, coalesce(before, 0) AS before, coalesce(alone, 0) AS alone, coalesce(alone_t, 0) AS alone_t FROM (SELECT r, w, count(*) AS c FROM tokens GROUP BY r, w) t LEFT JOIN own_follow f ON f.r = t.r AND f.v = t.w),
vocabulary AS (SELECT c.w, n, n_t, coalesce(before, 0) AS before, coalesce(before_t, 0) AS before_t, coalesce(types, 0) AS types, coalesce(types_t, 0) AS types_t
  FROM (SELECT w, count(*) AS n, count(*) FILTER (good) AS n_t FROM tokens GROUP BY w) c LEFT JOIN follow ON follow.v = c.w),
sums AS (SELECT count(*) AS words, sum(n) AS tokens, sum(n_t) AS tokens_t FROM vocabulary),
losses AS (SELECT t.r, count(*) AS n_tokens, {", ".join(f"sum({x}) / count(*) AS {name}" for name, x in sums.items())}
  FROM tokens t JOIN vocabulary w ON w.w = t.w JOIN own_words dw ON dw.r = t.r AND dw.w = t.w LEFT JOIN vocabulary v ON v.w = t.v LEFT JOIN own_words dv ON dv.r = t.r AND dv.w = t.v
  LEFT JOIN pairs p ON p.v = t.v AND p.w = t.w LEFT JOIN own_pairs dp ON dp.r = t.r AND dp.v = t.v AND dp.w = t.w CROSS JOIN sums GROUP BY t.r)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, {", ".join(f"round({name}, {DIGITS}) AS {name}" for name in sums)}, round(held_out_target_loss - held_out_background_loss, {DIGITS}) AS score FROM d LEFT JOIN losses USING (r)
"""


SQL = {"op8_secret_scans": secrets(), "op9_quality_rules": RULES, "op10_mixing": mixing()}
