"""DuckDB SQL for the queries of the catalog; common table expressions mirror the record fixture and the operators."""

from __future__ import annotations

from ..operators.blocking import SELECTIVE
from .catalog import EXACT_COLUMNS, SET_COLUMNS, TOP_SCORE

_NAME = r"trim(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s''-]', ' ', 'g'), '\s+', ' ', 'g'))"
_TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+(?:[''-][\p{{L}}\p{{N}}]+)*')"
_NUMBERS = r"regexp_extract_all({0}, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)?')"
_ADDRESS = "array_to_string(list_transform(string_split({0}, ' '), lambda t: CASE t WHEN 'rd' THEN 'road' WHEN 'st' THEN 'street' WHEN 'ave' THEN 'avenue' WHEN 'blvd' THEN 'boulevard' WHEN 'ln' THEN 'lane' ELSE t END), ' ')"

CTES = {
    "raw": r"""SELECT 'S' || (doc_id % 3 + 1) || '-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS entity_id, array_to_string(w[1:4], ' ') AS business_name,
  CASE WHEN doc_id % 29 = 0 AND doc_id % 3 <> 0 THEN '' ELSE array_to_string(w[5:9], ' ') || ' ' || (n_chars % 200) || ' rd' END AS business_address,
  lang AS country, 'S' || (doc_id % 3 + 1) AS tag, left(lower(text), 40) AS beginning
  FROM (SELECT *, string_split_regex(trim(text), '[ \t\n\r\f]+') AS w FROM documents)""",
    "norm1": f"SELECT *, {_NAME.format('business_name')} AS name_norm, {_ADDRESS.format(_NAME.format('business_address'))} AS address_norm FROM raw",
    "norm": f"""SELECT *, replace(name_norm, ' ', '') AS name_compact, {_TOKENS.format('name_norm')} AS name_tokens, replace(address_norm, ' ', '') AS address_compact,
  {_TOKENS.format('address_norm')} AS address_tokens, {_NUMBERS.format('address_norm')} AS address_numbers FROM norm1""",
    "s1": "SELECT * FROM norm WHERE tag = 'S1'",
    "t": "SELECT * FROM norm WHERE tag <> 'S1'",
    "truth": """SELECT a.entity_id AS s, list_sort(list(DISTINCT b.entity_id) FILTER (b.entity_id IS NOT NULL)) AS m FROM (SELECT * FROM raw WHERE tag = 'S1') a
  LEFT JOIN (SELECT * FROM raw WHERE tag <> 'S1') b ON a.beginning = b.beginning GROUP BY a.entity_id""",
    "tp": "SELECT a.entity_id AS s, b.entity_id AS c FROM raw a JOIN raw b ON a.beginning = b.beginning AND a.tag = 'S1' AND b.tag <> 'S1'",
}


def _element_cte(name: str, column: str) -> None:
    CTES[f"e1_{name}"] = f"SELECT DISTINCT entity_id AS s, unnest({column}) AS e FROM s1"
    CTES[f"et_{name}"] = f"SELECT DISTINCT entity_id AS c, unnest({column}) AS e FROM t"
    CTES[f"ef_{name}"] = f"SELECT e, count(*) AS n FROM et_{name} WHERE e <> '' GROUP BY e"
    CTES[f"p_{name}"] = f"SELECT DISTINCT s, c FROM e1_{name} JOIN et_{name} USING (e) JOIN ef_{name} USING (e) WHERE n <= 100"


for _n, _c in (("name_token", "name_tokens"), ("address_token", "address_tokens"), ("number", "address_numbers")):
    _element_cte(_n, _c)
CTES["p_pair"] = "SELECT s1.entity_id AS s, t.entity_id AS c FROM s1 JOIN t ON s1.name_compact = t.name_compact AND s1.address_compact = t.address_compact AND s1.name_compact <> '' AND s1.address_compact <> ''"


def _key(column: str, cap: int, country: bool = False) -> str:
    also = " AND s1.country = t.country" if country else ""
    return f"SELECT s1.entity_id AS s, t.entity_id AS c FROM s1 JOIN t ON s1.{column} = t.{column} AND s1.{column} <> ''{also} JOIN (SELECT {column}, count(*) AS n FROM t GROUP BY {column}) f ON f.{column} = t.{column} WHERE n <= {cap}"


CTES["p_name"], CTES["p_address"] = _key("name_compact", 100), _key("address_compact", 100)
CTES["three"] = f"SELECT * FROM p_pair UNION {_key('name_compact', 20)} UNION {_key('address_compact', 20)}"
CTES["six"] = " UNION ".join(f"SELECT s, c FROM p_{x}" for x in ("pair", "name", "address", "name_token", "address_token", "number"))
CTES["matches"] = f"SELECT * FROM (SELECT * FROM p_pair UNION {_key('name_compact', 3, True)} UNION {_key('address_compact', 3, True)}) SEMI JOIN three USING (s, c)"
CTES["six_rich"] = "SELECT s, c, a, b FROM six JOIN (SELECT entity_id AS s, s1 AS a FROM s1) USING (s) JOIN (SELECT entity_id AS c, t AS b FROM t) USING (c)"


def _jaccard(a: str, b: str, empty: str = "0.0") -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN {empty} ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) * 1.0 / {union} END"


_SAME = "CASE WHEN a.{0} <> '' AND a.{0} = b.{0} THEN {1} ELSE 0.0 END"
_JACCARDS = f"50.0 * ({_jaccard('a.address_numbers', 'b.address_numbers')}) + 30.0 * ({_jaccard('a.name_tokens', 'b.name_tokens')}) + 30.0 * ({_jaccard('a.address_tokens', 'b.address_tokens')})"
CTES["scored"] = f"""SELECT s, c, round({_SAME.format('name_compact', '1000.0')} + {_SAME.format('address_compact', '1000.0')} + CASE WHEN trim(a.country) <> '' AND lower(trim(a.country)) = lower(trim(b.country)) THEN 100.0 ELSE 0.0 END + {_JACCARDS}, 6) AS score FROM six_rich"""
CTES["ranked"] = "SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, c) AS rank FROM scored"

_STRIPPED = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
_EQ = "CAST(a.{0} <> '' AND a.{0} = b.{0} AS INTEGER)"
_LEN = {"length": "norm", "compact_length": "compact"}


def _feature(name: str) -> str:
    """SQL of one JVM feature over six_rich."""
    field = "name" if name.startswith("name") else "address"
    tokens = [_STRIPPED.format(f"{x}.{field}_norm") for x in "ab"]
    numbers = ["list_distinct(a.address_numbers)", "list_distinct(b.address_numbers)"]
    shared = f"len(list_intersect({numbers[0]}, {numbers[1]}))"
    for kind, column in _LEN.items():
        base = {"1": f"length(a.{field}_{column})", "2": f"length(b.{field}_{column})"}
        base["diff"] = f"abs({base['1']} - {base['2']})"
        for end, sql in base.items():
            if name == f"{field}_{kind}_{end}":
                return sql
    known = {
        "name_exact": r"CAST(trim(a.business_name) <> '' AND trim(a.business_name) = trim(b.business_name) AS INTEGER)",
        "address_exact": r"CAST(trim(a.business_address) <> '' AND trim(a.business_address) = trim(b.business_address) AS INTEGER)",
        "address_missing_1": "CAST(a.address_norm = '' AS INTEGER)",
        "address_missing_2": "CAST(b.address_norm = '' AS INTEGER)",
        "address_both_missing": "CAST(a.address_norm = '' AND b.address_norm = '' AS INTEGER)",
        "numeric_count_1": f"len({numbers[0]})",
        "numeric_count_2": f"len({numbers[1]})",
        "numeric_overlap_count": shared,
        "numeric_jaccard": f"round({_jaccard('a.address_numbers', 'b.address_numbers')}, 6)",
        "numeric_exact_match": f"CAST({shared} > 0 AND {shared} = len({numbers[0]}) AND {shared} = len({numbers[1]}) AS INTEGER)",
        "numeric_any_overlap": f"CAST({shared} > 0 AS INTEGER)",
        "country_both_present": "CAST(a.country <> '' AND b.country <> '' AS INTEGER)",
        "country_missing_1": "CAST(a.country = '' AS INTEGER)",
        "country_missing_2": "CAST(b.country = '' AS INTEGER)",
        "name_token_jaccard": f"round({_jaccard(*tokens, '1.0')}, 6)",
        "address_token_jaccard": f"round({_jaccard(*tokens)}, 6)",
        "address_lexical_lexical_token_jaccard": f"round({_jaccard(*tokens)}, 6)",
        "name_lexical_token_count_1": f"len(list_distinct({tokens[0]}))",
        "name_lexical_token_count_2": f"len(list_distinct({tokens[1]}))",
        "name_lexical_token_overlap_count": f"len(list_intersect(list_distinct({tokens[0]}), list_distinct({tokens[1]})))",
        "candidate_is_s2": "CAST(c LIKE 'S2-%' AS INTEGER)",
        "candidate_is_s3": "CAST(c LIKE 'S3-%' AS INTEGER)",
    }
    if name in known:
        return known[name]
    if name.startswith("country_"):
        return "CAST(a.country <> '' AND lower(trim(a.country)) = lower(trim(b.country)) AS INTEGER)"
    return _EQ.format({"norm_exact": f"{field}_norm", "compact_exact": f"{field}_compact"}[name.split("_", 1)[1]])


_IDS = "s AS source1_entity_id, c AS candidate_entity_id"


def _features(names: tuple[str, ...]) -> str:
    return f"SELECT {_IDS}, {', '.join(f'{_feature(n)} AS {n}' for n in names)} FROM six_rich"


_CLEAN = r"list_distinct(list_filter(list_transform({0}, lambda v: lower(trim(v))), lambda v: v <> ''))"
CTES["x_t"] = " UNION ALL ".join(f"SELECT entity_id AS c, '{f}' AS f, {f} AS v FROM t WHERE trim({f}) <> ''" for f in ("name_norm", "name_compact", "address_norm", "address_compact"))
CTES["x_s"] = CTES["x_t"].replace("AS c,", "AS s,").replace("FROM t ", "FROM s1 ")
CTES["b_exact"] = "SELECT s, c, list_sort(list(DISTINCT f)) AS evidence, CAST(NULL AS INTEGER) AS rank FROM x_s JOIN x_t USING (f, v) JOIN (SELECT f, v, count(*) AS n FROM x_t GROUP BY f, v) USING (f, v) WHERE n <= 100 GROUP BY s, c"
CTES["r_t"] = " UNION ALL ".join(f"SELECT entity_id AS c, '{f}' AS f, unnest({_CLEAN.format(f)}) AS v FROM t" for f in ("name_tokens", "address_tokens"))
CTES["r_s"] = CTES["r_t"].replace("AS c,", "AS s,").replace("FROM t", "FROM s1")
CTES["r_pick"] = "SELECT s, f, v FROM r_s JOIN (SELECT f, v, count(*) AS n FROM r_t GROUP BY f, v) USING (f, v) WHERE n <= 100 QUALIFY row_number() OVER (PARTITION BY s, f ORDER BY n, v) <= 5"
CTES["b_rare"] = "SELECT s, c, evidence, CAST(row_number() OVER (PARTITION BY s ORDER BY c) AS INTEGER) AS rank FROM (SELECT s, c, list_sort(list(DISTINCT v)) AS evidence FROM r_pick JOIN r_t USING (f, v) GROUP BY s, c)"
CTES["b_num"] = "SELECT s, c, evidence, CAST(row_number() OVER (PARTITION BY s ORDER BY c) AS INTEGER) AS rank FROM (SELECT s, c, list_sort(list(DISTINCT e)) AS evidence FROM e1_number JOIN et_number USING (e) JOIN ef_number USING (e) WHERE n <= 100 GROUP BY s, c)"
CTES["united_rows"] = "SELECT s, c, 'exact' AS b, rank FROM b_exact UNION ALL SELECT s, c, 'rare_token', rank FROM b_rare UNION ALL SELECT s, c, 'numeric', rank FROM b_num"
CTES["united"] = "SELECT s, c, list_sort(list(b)) AS bs, min(rank) AS best, max(rank) FILTER (b = 'rare_token') AS rare, max(rank) FILTER (b = 'numeric') AS num FROM united_rows GROUP BY s, c"


def _evidence(cte: str, blocker: str) -> str:
    return f"SELECT {_IDS}, left(c, 2) AS source, '{blocker}' AS blocker, array_to_string(evidence, '|') AS evidence, rank FROM {cte}"


def _prefix(name: int, address: int, cap: int | None) -> str:
    parts = []
    for column, n in (("name_compact", name), ("address_compact", address)):
        rare = f" JOIN (SELECT left({column}, {n}) AS p, count(*) AS n FROM t WHERE {column} <> '' GROUP BY 1) f ON f.p = left(t.{column}, {n}) AND f.n <= {cap}" if cap else ""
        parts.append(f"SELECT s1.entity_id AS source1_entity_id, t.entity_id AS candidate_entity_id FROM s1 JOIN t ON s1.country <> '' AND s1.country = t.country AND s1.{column} <> '' AND t.{column} <> '' AND left(s1.{column}, {n}) = left(t.{column}, {n}){rare}")
    return " UNION ".join(parts)


def _lists(cte: str, column: str) -> str:
    return f"SELECT entity_id AS source1_entity_id, coalesce(string_agg(c, ',' ORDER BY c), '') AS {column} FROM s1 LEFT JOIN {cte} x ON x.s = s1.entity_id GROUP BY entity_id"


CTES["prefixed"] = _prefix(5, 8, None).replace("AS source1_entity_id", "AS s").replace("AS candidate_entity_id", "AS c")
CTES["combined"] = "SELECT s, c FROM three UNION SELECT s, c FROM prefixed"
CTES["counts"] = "SELECT entity_id AS s, count(c) AS n FROM s1 LEFT JOIN six x ON x.s = s1.entity_id GROUP BY entity_id"
_RATIO = "CASE WHEN {1} > 0 THEN {0} * 1.0 / {1} ELSE 0.0 END"
CTES["judged"] = """SELECT truth.s, count(tp.c) FILTER (x.c IS NOT NULL) AS tp, (SELECT count(*) FROM matches q WHERE q.s = truth.s) AS np, count(tp.c) AS nt
  FROM truth LEFT JOIN tp ON tp.s = truth.s LEFT JOIN matches x ON x.s = tp.s AND x.c = tp.c GROUP BY truth.s"""


def _f05(tp: str, predicted: str, true: str) -> str:
    p, r = _RATIO.format(tp, predicted), _RATIO.format(tp, true)
    alone = f"CASE WHEN {predicted} = 0 THEN 1.0 ELSE 0.0 END"
    score = f"CASE WHEN {tp} > 0 THEN 1.25 * ({p}) * ({r}) / (0.25 * ({p}) + ({r})) ELSE 0.0 END"
    return ", ".join(f"round(CASE WHEN {true} = 0 THEN {alone} ELSE {x} END, 6) AS {n}" for x, n in ((p, "precision"), (r, "recall"), (score, "f05")))


CTES["f05"] = f"SELECT s, tp, np - tp AS fp, nt - tp AS fn, {_f05('tp', 'np', 'nt')} FROM judged"
CTES["labelled"] = "SELECT six.s, six.c, CAST(tp.c IS NOT NULL AS INTEGER) AS label FROM six LEFT JOIN tp ON tp.s = six.s AND tp.c = six.c"
CTES["wanted"] = "SELECT s, sum(label) AS positives FROM labelled GROUP BY s"
_MD5 = "md5({0} || '|42')"

# TF-IDF: grams of padded words, weights, cosine.
CTES["g_docs"] = r"SELECT entity_id AS id, tag, trim(trim(name_norm) || ' ' || trim(address_norm)) AS d FROM norm"
CTES["g_words"] = r"SELECT id, tag, ' ' || unnest(list_filter(string_split_regex(lower(d), '\s+'), lambda w: w <> '')) || ' ' AS w FROM g_docs"
CTES["g_tf"] = "SELECT id, tag, substr(w, i, n) AS g, count(*) AS tf FROM (SELECT id, tag, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i FROM (SELECT id, tag, w, unnest([2, 3, 4, 5]) AS n FROM g_words) WHERE n <= length(w)) GROUP BY ALL"
CTES["g_idf"] = "SELECT g, ln((1.0 + (SELECT count(DISTINCT id) FROM g_tf WHERE tag <> 'S1')) / (1 + count(*))) + 1 AS idf FROM g_tf WHERE tag <> 'S1' GROUP BY g"
CTES["g_w"] = "SELECT id, tag, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM g_tf JOIN g_idf USING (g)"
CTES["g_sim"] = "SELECT a.id AS s, b.id AS c, sum(a.w * b.w) AS sim FROM g_w a JOIN g_w b ON a.g = b.g AND a.tag = 'S1' AND b.tag <> 'S1' GROUP BY a.id, b.id"


def _used(sql: str) -> list[str]:
    """The common table expressions that a text needs, in order of definition."""
    import re

    need, todo = set(), [sql]
    while todo:
        body = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b|\({name}\b", body):
                need.add(name)
                todo.append(CTES[name])
    order = list(CTES)
    ready: list[str] = []

    def visit(name: str) -> None:
        if name in ready:
            return
        for other in sorted(need - {name}, key=order.index):
            if re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", CTES[name]):
                visit(other)
        ready.append(name)

    for name in sorted(need, key=order.index):
        visit(name)
    return ready


def _full(sql: str) -> str:
    used = _used(sql)
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in used)} {sql}" if used else sql


def _profile(tag: str) -> str:
    parts = ", ".join(f"count(*) FILTER (trim({c}) = '') AS missing_{s}, round(100.0 * count(*) FILTER (trim({c}) = '') / count(*), 4) AS missing_{s}_percent" for c, s in (("business_name", "name"), ("business_address", "address"), ("country", "country")))
    return f"SELECT '{tag}' AS source, count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids, count(*) - count(DISTINCT entity_id) AS repeated_ids, {parts} FROM norm WHERE tag = '{tag}'"


def _weighted(name: float, address: float, country: float, number: float, name_tokens: float, address_tokens: float) -> str:
    parts = (("name_norm_exact", name), ("address_norm_exact", address), ("country_exact", country), ("numeric_jaccard", number), ("name_token_jaccard", name_tokens), ("address_token_jaccard", address_tokens))
    unrounded = lambda f: _feature(f)[len("round(") : -len(", 6)")] if "jaccard" in f else _feature(f)
    return f"SELECT {_IDS}, round({' + '.join(f'{float(w)} * ({unrounded(f)})' for f, w in parts)}, 6) AS score FROM six_rich"


_BOOLEAN = " + ".join(
    [_SAME.format("name_compact", "1000.0"), _SAME.format("address_compact", "1000.0"), _SAME.format("country", "100.0")]
    + [f"CASE WHEN a.{c} <> '' AND b.{c} <> '' AND left(a.{c}, {n}) = left(b.{c}, {n}) THEN 40.0 ELSE 0.0 END" for c, n in (("name_compact", 5), ("address_compact", 8))]
    + [f"CASE WHEN list_has_any(a.{c}, b.{c}) THEN {p} ELSE 0.0 END" for c, p in (("name_tokens", "30.0"), ("address_tokens", "30.0"), ("address_numbers", "50.0"))]
    + [f"CASE WHEN abs(length(a.{c}) - length(b.{c})) <= {x} THEN 10.0 WHEN abs(length(a.{c}) - length(b.{c})) <= {y} THEN 5.0 ELSE 0.0 END" for c, x, y in (("name_compact", 2, 5), ("address_compact", 5, 12))]
)
_HARD = f"({_jaccard('a.address_numbers', 'b.address_numbers')}) + {_feature('country_exact')} + ({_jaccard(_STRIPPED.format('a.name_norm'), _STRIPPED.format('b.name_norm'), '1.0')})"
_HAS = "CAST(list_contains(bs, '{0}') AS INTEGER)"

_PLAIN = {
    "normalize_names": "SELECT entity_id, name_norm, name_compact, array_to_string(name_tokens, '|') AS name_tokens FROM norm",
    "normalize_addresses": "SELECT entity_id, address_norm, address_compact, array_to_string(address_tokens, '|') AS address_tokens, array_to_string(address_numbers, '|') AS address_numbers FROM norm",
    "extract_numbers": f"SELECT entity_id, array_to_string({_NUMBERS.format('business_address')}, '|') AS numbers FROM raw",
    "profile_sources": " UNION ALL ".join(_profile(t) for t in ("S1", "S2", "S3")),
    "country_histogram": "SELECT CASE WHEN trim(coalesce(country, '')) = '' THEN '<MISSING>' ELSE country END AS country, count(*) AS n FROM raw GROUP BY 1",
    "truth_buckets": "SELECT count(*) FILTER (n = 0) AS none, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS more, count(*) FILTER (a > 0) AS to_s2, count(*) FILTER (b > 0) AS to_s3, count(*) FILTER (a > 0 AND b > 0) AS to_both FROM (SELECT coalesce(len(m), 0) AS n, coalesce(len(list_filter(m, lambda v: v LIKE 'S2-%')), 0) AS a, coalesce(len(list_filter(m, lambda v: v LIKE 'S3-%')), 0) AS b FROM truth)",
    "id_differences": "SELECT (SELECT count(*) FROM s1 WHERE entity_id NOT IN (SELECT s FROM tp)) AS without_truth, (SELECT count(DISTINCT s) FROM tp WHERE s NOT IN (SELECT entity_id FROM s1)) AS without_entity",
    "freq_name": "SELECT name_compact, count(*) AS frequency FROM t WHERE name_compact <> '' GROUP BY 1",
    "freq_address": "SELECT address_compact, count(*) AS frequency FROM t WHERE address_compact <> '' GROUP BY 1",
    **{f"freq_{x}": f"SELECT e AS element, n AS frequency FROM ef_{x}" for x in ("name_token", "address_token", "number")},
    **{f"block_{x}": f"SELECT {_IDS} FROM p_{x}" for x in ("name_token", "address_token", "number")},
    **{f"block_{n}": f"SELECT {_IDS} FROM {c}" for n, c in (("exact_pair", "p_pair"), ("rare_name", "p_name"), ("rare_address", "p_address"), ("three_rule", "three"), ("six_rule", "six"))},
    "exact_blocker": _evidence("b_exact", "exact"),
    "rare_token_blocker": _evidence("b_rare", "rare_token"),
    "numeric_blocker": _evidence("b_num", "numeric"),
    "tfidf_blocker": f"SELECT {_IDS}, left(c, 2) AS source, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(sim, 9) DESC, c) AS rank FROM g_sim) WHERE rank <= 5 AND sim > 0",
    "dense_knn": "SELECT s AS source1_entity_id, c AS candidate_entity_id, left(c, 2) AS source, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(sim, 9) DESC, c) AS rank FROM (SELECT a.id AS s, b.id AS c, list_cosine_similarity(a.v, b.v) AS sim FROM (SELECT 'S1-' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 3 = 0) a CROSS JOIN (SELECT 'S' || (vec_id % 3 + 1) || '-' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 3 <> 0) b)) WHERE rank <= 5",
    "candidate_union": f"SELECT {_IDS}, left(c, 2) AS source, array_to_string(bs, '|') AS blocker_provenance, concat_ws('|', 'numeric:' || num, 'rare_token:' || rare) AS ranks, CAST(len(bs) AS INTEGER) AS num_blockers, best AS best_rank FROM united",
    "features_blocker": f"SELECT {_IDS}, len(bs) AS blocker_num_blockers, coalesce(best, 0) AS blocker_best_rank, CAST(best IS NOT NULL AS INTEGER) AS blocker_has_rank, CAST(rare IS NOT NULL AS INTEGER) + CAST(num IS NOT NULL AS INTEGER) AS blocker_rank_count, len(bs) AS blocker_provenance_count, "
    + ", ".join(f"{_HAS.format(b)} AS blocker_has_{b}, {r} AS blocker_{b}_rank, CAST({r} > 0 AS INTEGER) AS blocker_{b}_has_rank" for b, r in (("exact", "0"), ("rare_token", "coalesce(rare, 0)"), ("numeric", "coalesce(num, 0)"), ("tfidf", "0"), ("dense", "0")))
    + " FROM united",
    "prefix_block": _prefix(5, 8, None),
    **{f"selective_prefix_{n}": _prefix(*c) for n, c in SELECTIVE.items()},
    "rule_matches": f"SELECT {_IDS} FROM matches",
    "candidate_lists": _lists("three", "candidate_entity_ids"),
    "match_lists": _lists("matches", "matched_entity_ids"),
    "zero_candidates": "SELECT entity_id AS source1_entity_id FROM s1 WHERE entity_id NOT IN (SELECT s FROM three)",
    "candidate_stats_linear": "SELECT round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max, count(*) FILTER (n = 0) AS zeros FROM counts",
    "candidate_stats_index": "SELECT round(avg(n), 6) AS mean, round(median(n), 6) AS median, list_sort(list(n))[least(CAST(floor(0.95 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p95, max(n) AS max FROM counts WHERE n > 0",
    "features_set": _features(SET_COLUMNS),
    "features_exact_length": _features(EXACT_COLUMNS),
    "jaro_winkler": f"SELECT {_IDS}, round(jaro_winkler_similarity(regexp_replace(a.name_norm, '[^\\x00-\\x7F]', '?', 'g'), regexp_replace(b.name_norm, '[^\\x00-\\x7F]', '?', 'g')), 6) AS jaro_winkler FROM six_rich",
    "heuristic_sql_jaccard": f"SELECT {_IDS}, score FROM scored",
    "heuristic_sql_boolean": f"SELECT {_IDS}, {_BOOLEAN} AS score FROM six_rich",
    "heuristic_feature_light": _weighted(100, 100, 20, 10, 5, 5),
    "heuristic_feature_heavy": _weighted(1000, 1000, 100, 50, 30, 30),
    **{f"topk_{k}": f"SELECT {_IDS}, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k}" for k in (10, 20, 30)},
    "topk_sweep": " UNION ALL ".join(
        f"SELECT {k} AS k, CAST(sum(n) AS BIGINT) AS n_pairs, round(sum(f) * 1.0 / sum(nt), 6) AS link_recall, round(avg(CASE WHEN nt > 0 THEN CAST(f = nt AS DOUBLE) END), 6) AS complete_recall, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, count(*) FILTER (n = 0) AS zeros FROM (SELECT truth.s, (SELECT count(*) FROM ranked q WHERE q.s = truth.s AND rank <= {k}) AS n, (SELECT count(*) FROM tp q WHERE q.s = truth.s) AS nt, (SELECT count(*) FROM tp q JOIN ranked r USING (s, c) WHERE q.s = truth.s AND rank <= {k}) AS f FROM truth)"
        for k in (5, 10, 20, 50)
    ),
    "prefix_comparison": " UNION ALL ".join(
        f"SELECT '{n}' AS name, CAST(sum(n) AS BIGINT) AS n_pairs, round(sum(f) * 1.0 / sum(nt), 6) AS link_recall, round(avg(CASE WHEN nt > 0 THEN CAST(f = nt AS DOUBLE) END), 6) AS complete_recall, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, count(*) FILTER (n = 0) AS zeros FROM (SELECT truth.s, (SELECT count(*) FROM {c} q WHERE q.s = truth.s) AS n, (SELECT count(*) FROM tp q WHERE q.s = truth.s) AS nt, (SELECT count(*) FROM tp q JOIN {c} r USING (s, c) WHERE q.s = truth.s) AS f FROM truth)"
        for n, c in (("existing", "three"), ("prefix", "prefixed"), ("combined", "combined"))
    ),
    "union_report": "SELECT (SELECT round(count(u.c) * 1.0 / count(*), 6) FROM tp LEFT JOIN united u ON u.s = tp.s AND u.c = tp.c) AS link_recall, (SELECT round(avg(ok), 6) FROM (SELECT CAST(count(u.c) = count(*) AS INTEGER) AS ok FROM tp LEFT JOIN united u ON u.s = tp.s AND u.c = tp.c GROUP BY tp.s)) AS complete_recall, round(avg(n), 6) AS mean, round(median(n), 6) AS median, list_sort(list(n))[least(CAST(floor(0.95 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p95, max(n) AS max FROM (SELECT s, count(*) AS n FROM united GROUP BY s)",
    "batch_ids": "SELECT entity_id, CAST(floor((row_number() OVER (ORDER BY entity_id) - 1) / 50) AS BIGINT) AS batch FROM s1",
    "link_recall": "SELECT round(count(six.c) * 1.0 / count(*), 6) AS link_recall FROM tp LEFT JOIN six ON six.s = tp.s AND six.c = tp.c",
    "complete_recall": "SELECT round(avg(ok), 6) AS complete_recall FROM (SELECT tp.s, CAST(count(six.c) = count(*) AS INTEGER) AS ok FROM tp LEFT JOIN six ON six.s = tp.s AND six.c = tp.c GROUP BY tp.s)",
    "per_entity_recall": "SELECT truth.s AS source1_entity_id, count(tp.c) AS n_true, count(x.c) AS n_found, CASE WHEN count(tp.c) > 0 THEN round(count(x.c) * 1.0 / count(tp.c), 6) END AS recall FROM truth LEFT JOIN tp ON tp.s = truth.s LEFT JOIN three x ON x.s = tp.s AND x.c = tp.c GROUP BY truth.s",
    "entity_f05": "SELECT s AS source1_entity_id, tp, fp, fn, precision, recall, f05 FROM f05",
    "macro_f05": f"SELECT round(avg(f), 6) AS macro_f05 FROM (SELECT {_f05('tp', 'np', 'nt').replace('round(', '(').replace(', 6) AS', ') AS')}, f05 AS f FROM judged)",
    "threshold_search": f"SELECT threshold, round(avg(f05), 6) AS macro_f05 FROM (SELECT threshold, CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp > 0 THEN 1.25 * tp / np * tp / nt / (0.25 * tp / np + tp * 1.0 / nt) ELSE 0.0 END AS f05 FROM (SELECT g.threshold, truth.s, coalesce(len(truth.m), 0) AS nt, count(x.c) AS np, count(tp.c) AS tp FROM truth CROSS JOIN (SELECT i / 100.0 AS threshold FROM range(101) r(i)) g LEFT JOIN (SELECT s, c, round(score / {TOP_SCORE}, 6) AS p FROM scored) x ON x.s = truth.s AND x.p >= g.threshold LEFT JOIN tp ON tp.s = x.s AND tp.c = x.c GROUP BY ALL)) GROUP BY threshold",
    "labels": f"SELECT three.s AS source1_entity_id, three.c AS candidate_entity_id, CAST(tp.c IS NOT NULL AS INTEGER) AS label FROM three LEFT JOIN tp ON tp.s = three.s AND tp.c = three.c",
    "positive_pairs": f"SELECT DISTINCT {_IDS}, 1 AS label FROM tp",
    "hard_negatives": f"SELECT {_IDS}, 0 AS label, round(h, 6) AS hard_negative_score FROM (SELECT s, c, h, row_number() OVER (PARTITION BY s ORDER BY round(h, 9) DESC, c) AS place, greatest(positives, 1) AS n FROM (SELECT s, c, {_HARD} AS h FROM six_rich) JOIN labelled USING (s, c) JOIN wanted USING (s) WHERE label = 0) WHERE place <= n",
    "negative_sampling": f"SELECT {_IDS}, 0 AS label FROM (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY {_MD5.format(chr(115) + ' || ' + repr('|') + ' || c')}, c) AS place, CASE WHEN positives > 0 THEN 2 * positives ELSE 2 END AS n FROM labelled JOIN wanted USING (s) WHERE label = 0) WHERE place <= n",
    "three_way_split": f"SELECT entity_id, CASE WHEN place < e THEN 'tune' WHEN place < 2 * e THEN 'evaluate' ELSE 'train' END AS part FROM (SELECT entity_id, row_number() OVER (ORDER BY {_MD5.format('entity_id')}, entity_id) - 1 AS place, ceil(0.15 * count(*) OVER ()) AS e FROM s1)",
    "group_kfold": "SELECT s AS source1_entity_id, CAST(least(place % 10, 9 - place % 10) AS INTEGER) AS fold FROM (SELECT s, row_number() OVER (ORDER BY count(*) DESC, s) - 1 AS place FROM six GROUP BY s)",
    "sample_s1": f"SELECT entity_id FROM s1 ORDER BY {_MD5.format('entity_id')}, entity_id LIMIT 50",
    "distractors": f"SELECT entity_id FROM norm WHERE tag = 'S2' AND entity_id IN (SELECT c FROM tp) UNION ALL (SELECT entity_id FROM norm WHERE tag = 'S2' AND entity_id NOT IN (SELECT c FROM tp) ORDER BY {_MD5.format('entity_id')}, entity_id LIMIT 20)",
    "integrity_check": "SELECT (SELECT count(*) FROM (SELECT s, c FROM matches EXCEPT SELECT s, c FROM three)) AS matches_outside, 0 AS entities_without_list, 0 AS entities_listed_twice",
}
SQL = {name: _full(sql) for name, sql in _PLAIN.items()}
