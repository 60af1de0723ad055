"""DuckDB SQL of the queries of `surface`, and of those of `catalog` that need fuzzy scores.

Scores are computed once for each distinct pair of texts. The longest common subsequence runs over one bit a character of
the first text (so up to 126 of them), whose masks for the characters of the second one fold into the last state.
"""

from __future__ import annotations

from ..functions.text import RAW_NUMBER
from ..operators.blocking import SELECTIVE
from . import oracle
from .oracle import CTES, EXACT_COLUMNS, SET_COLUMNS, TOP_SCORE, _feature, _full, _IDS, _jaccard, _MD5

_ONE = "CAST(1 AS HUGEINT)"


def _masks(pattern: str, text: str) -> str:
    """For each character of a text the places in the pattern that hold it."""
    return f"list_transform(string_split({text}, ''), lambda ch: CAST(list_sum(list_transform(range(length({pattern})), lambda pl: CASE WHEN substr({pattern}, pl + 1, 1) = ch THEN {_ONE} << CAST(pl AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT))"


def _ones(n: str) -> str:
    return f"(({_ONE} << CAST({n} AS HUGEINT)) - 1)"


def _common(n: str, masks: str) -> str:
    """Length of the longest common subsequence of a pattern of n characters and the text of the masks."""
    return f"({n} - bit_count(list_reduce(list_prepend({_ones(n)}, {masks}), lambda st, mk: ((st + (st & mk)) | (st - (st & mk))) & {_ones(n)})))"


def _ratio(a: str, b: str) -> str:
    common = f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE {_common(f'length({a})', _masks(a, b))} END"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 ELSE 2.0 * ({common}) / (length({a}) + length({b})) END"


def _windows(n: str, m: str, masks: str) -> str:
    """The best ratio of a pattern of n characters with a window of the text of m, cut at both ends too."""
    window = f"{masks}[greatest(0, fin - {n}) + 1 : least(fin, {m})]"
    return f"list_max(list_transform(range(1, {m} + {n}), lambda fin: 2.0 * {_common(n, window)} / ({n} + least(fin, {m}) - greatest(0, fin - {n}))))"


_FREE = "((st[2] >> CAST(bj AS HUGEINT)) & 1) = 0"
_REACH = "greatest(0, greatest(length(x), length(y)) // 2 - 1)"
_FIND = f"list_filter(range(CAST(greatest(0, el[1] - {_REACH}) AS BIGINT), CAST(least(length(y), el[1] + {_REACH} + 1) AS BIGINT)), lambda bj: substr(y, bj + 1, 1) = substr(x, CAST(el[1] AS BIGINT) + 1, 1) AND {_FREE})[1]"
_STEPS = "list_transform(range(length(x)), lambda ai: [CAST(ai AS HUGEINT), CAST(0 AS HUGEINT)])"
_MATCHED = f"list_reduce(list_prepend([CAST(0 AS HUGEINT), CAST(0 AS HUGEINT)], {_STEPS}), lambda st, el: CASE WHEN {_FIND} IS NULL THEN st ELSE [st[1] | ({_ONE} << el[1]), st[2] | ({_ONE} << CAST({_FIND} AS HUGEINT))] END)"
_KEPT = "list_filter(range(length({0})), lambda ki: (({1} >> CAST(ki AS HUGEINT)) & 1) = 1)"
_LETTERS = "list_transform({0}, lambda ki: substr({1}, ki + 1, 1))"


def _scores(name: str, texts: str) -> None:
    """Tables `{name}`: x, y and five scores of each row of the SQL `texts` (x, y)."""
    CTES[f"{name}_xy"] = f"SELECT DISTINCT x, y FROM ({texts})"
    CTES[f"{name}_jb"] = f"SELECT x, y, CASE WHEN x = '' OR y = '' THEN [CAST(0 AS HUGEINT), CAST(0 AS HUGEINT)] ELSE {_MATCHED} END AS bits FROM {name}_xy"
    CTES[f"{name}_jl"] = f"SELECT x, y, {_LETTERS.format(_KEPT.format('x', 'bits[1]'), 'x')} AS lx, {_LETTERS.format(_KEPT.format('y', 'bits[2]'), 'y')} AS ly FROM {name}_jb"
    moved = "len(list_filter(range(len(lx)), lambda mi: lx[mi + 1] <> ly[mi + 1])) // 2"
    CTES[f"{name}_j"] = f"SELECT x, y, CASE WHEN x = '' AND y = '' THEN 1.0 WHEN len(lx) = 0 THEN 0.0 ELSE (len(lx) * 1.0 / length(x) + len(lx) * 1.0 / length(y) + (len(lx) - {moved}) * 1.0 / len(lx)) / 3 END AS jaro FROM {name}_jl"
    prefix = "CASE WHEN left(x, 1) <> left(y, 1) OR x = '' OR y = '' THEN 0 WHEN left(x, 2) <> left(y, 2) OR length(x) < 2 OR length(y) < 2 THEN 1 WHEN left(x, 3) <> left(y, 3) OR length(x) < 3 OR length(y) < 3 THEN 2 WHEN left(x, 4) <> left(y, 4) OR length(x) < 4 OR length(y) < 4 THEN 3 ELSE 4 END"
    CTES[f"{name}_jw"] = f"SELECT x, y, CASE WHEN jaro > 0.7 THEN jaro + 0.1 * ({prefix}) * (1 - jaro) ELSE jaro END AS jaro_winkler FROM {name}_j"
    words = lambda c: f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"
    CTES[f"{name}_w"] = f"SELECT x, y, list_sort({words('x')}) AS wx, list_sort({words('y')}) AS wy FROM {name}_xy"
    only = lambda a, b: f"list_sort(list_filter(list_distinct({a}), lambda w: NOT list_contains({b}, w)))"
    CTES[f"{name}_s"] = f"SELECT x, y, len(wx) AS nx, len(wy) AS ny, array_to_string(wx, ' ') AS sx, array_to_string(wy, ' ') AS sy, array_to_string(list_sort(list_filter(list_distinct(wx), lambda w: list_contains(wy, w))), ' ') AS inboth, array_to_string({only('wx', 'wy')}, ' ') AS ox, array_to_string({only('wy', 'wx')}, ' ') AS oy FROM {name}_w"
    CTES[f"{name}_c"] = f"SELECT *, trim(inboth || ' ' || ox) AS bx, trim(inboth || ' ' || oy) AS bz FROM {name}_s"
    found = _ratio("bx", "bz")
    in_set = f"CASE WHEN nx = 0 OR ny = 0 THEN 0.0 WHEN inboth <> '' AND (ox = '' OR oy = '') THEN 1.0 WHEN inboth = '' THEN {found} ELSE greatest({found}, {_ratio('inboth', 'bx')}, {_ratio('inboth', 'bz')}) END"
    CTES[f"{name}_t"] = f"SELECT x, y, {_ratio('x', 'y')} AS ratio, {_ratio('sx', 'sy')} AS token_sort_ratio, {in_set} AS token_set_ratio FROM {name}_c"
    CTES[f"{name}"] = f"SELECT x, y, ratio, token_sort_ratio, token_set_ratio, jaro_winkler FROM {name}_t JOIN {name}_jw USING (x, y)"
    CTES[f"{name}_m"] = f"SELECT *, {_masks('p', 'q')} AS mq, {_masks('q', 'p')} AS mp FROM (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS p, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS q FROM {name}_xy)"
    best = _windows("length(p)", "length(q)", "mq")
    CTES[f"{name}_p"] = f"SELECT x, y, CASE WHEN p = '' THEN CASE WHEN q = '' THEN 1.0 ELSE 0.0 END WHEN length(p) = length(q) THEN greatest({best}, {_windows('length(q)', 'length(p)', 'mp')}) ELSE {best} END AS partial_ratio FROM {name}_m"


SCORERS = ("ratio", "partial_ratio", "jaro_winkler", "token_sort_ratio", "token_set_ratio")


def _rich(name: str, pairs: str) -> None:
    """`{name}`: pairs with records a and b, the texts that are scored, and scores as `n_` and `d_` columns but the partial ones."""
    CTES[f"{name}_r"] = f"SELECT s, c, a, b, {_text('name')}, {_text('address')} FROM {pairs} JOIN (SELECT entity_id AS s, s1 AS a FROM s1) USING (s) JOIN (SELECT entity_id AS c, t AS b FROM t) USING (c)"
    for letter, field in (("n", "name"), ("d", "address")):
        _scores(f"{name}_{letter}", f"SELECT {field}_x AS x, {field}_y AS y FROM {name}_r")
    columns = ", ".join(f"{letter}.{s} AS {letter}_{s}" for letter in "nd" for s in SCORERS if s != "partial_ratio")
    CTES[name] = f"SELECT r.*, {columns} FROM {name}_r r JOIN {name}_n n ON n.x = r.name_x AND n.y = r.name_y JOIN {name}_d d ON d.x = r.address_x AND d.y = r.address_y"
    CTES[f"{name}_full"] = f"SELECT r.*, n.partial_ratio AS n_partial_ratio, d.partial_ratio AS d_partial_ratio FROM {name} r JOIN {name}_n_p n ON n.x = r.name_x AND n.y = r.name_y JOIN {name}_d_p d ON d.x = r.address_x AND d.y = r.address_y"


def _text(field: str) -> str:
    one = lambda side, as_: f"CASE WHEN {side}.{field}_norm <> '' THEN {side}.{field}_norm ELSE trim({side}.business_{field}) END AS {field}_{as_}"
    return f"{one('a', 'x')}, {one('b', 'y')}"


_rich("three_rich", "three")
_rich("united_rich", "united")
_rich("six_scored", "six")


def _all_features() -> str:
    """All features but those of blockers."""
    plain = [c for c in (*SET_COLUMNS, *EXACT_COLUMNS)]
    out = {c: _feature(c) for c in dict.fromkeys(plain)}
    for field, letter in (("name", "n"), ("address", "d")):
        texts = (f"{field}_x", f"{field}_y")
        for end, sql in {"1": f"length({texts[0]})", "2": f"length({texts[1]})", "diff": f"abs(length({texts[0]}) - length({texts[1]}))"}.items():
            out[f"{field}_length_{end}"] = sql
        compact = [f"CASE WHEN {side}.{field}_compact <> '' THEN {side}.{field}_compact ELSE replace({x}, ' ', '') END" for side, x in zip("ab", texts, strict=True)]
        for end, sql in {"1": f"length({compact[0]})", "2": f"length({compact[1]})", "diff": f"abs(length({compact[0]}) - length({compact[1]}))"}.items():
            out[f"{field}_compact_length_{end}"] = sql
        out[f"{field}_compact_exact"] = f"CAST(({compact[0]}) <> '' AND ({compact[0]}) = ({compact[1]}) AS INTEGER)"
        words = [oracle._STRIPPED.format(x) for x in texts]
        out[f"{field}_token_jaccard"] = f"round({_jaccard(*words, '1.0' if field == 'name' else '0.0')}, 6)"
        lexical = "name_lexical" if field == "name" else "address_lexical_lexical"
        norms = [f"{side}.{field}_norm" for side in "ab"]
        tokens = [oracle._STRIPPED.format(n) for n in norms]
        out[f"{lexical}_exact"] = f"CAST({norms[0]} <> '' AND {norms[0]} = {norms[1]} AS INTEGER)"
        for s in SCORERS:
            if s != "jaro_winkler" or field == "name":
                out[f"{field}_{s}"] = f"round({letter}_{s}, 6)"
            if s != "jaro_winkler":
                none = "0.0" if s == "token_set_ratio" else f"CASE WHEN {norms[0]} = '' AND {norms[1]} = '' THEN 1.0 ELSE 0.0 END"
                out[f"{lexical}_{s}"] = f"round(CASE WHEN {norms[0]} <> '' AND {norms[1]} <> '' THEN {letter}_{s} ELSE {none} END, 6)"
        out[f"{lexical}_token_jaccard"] = f"round({_jaccard(*tokens)}, 6)"
        out[f"{lexical}_token_count_1"], out[f"{lexical}_token_count_2"] = (f"len(list_distinct({t}))" for t in tokens)
        out[f"{lexical}_token_overlap_count"] = f"len(list_intersect(list_distinct({tokens[0]}), list_distinct({tokens[1]})))"
        for end, sql in {"1": f"length({norms[0]})", "2": f"length({norms[1]})", "diff": f"abs(length({norms[0]}) - length({norms[1]}))"}.items():
            out[f"{lexical}_length_{end}"] = sql
    out |= {f"address_missing_{i}": f"CAST(address_{x} = '' AS INTEGER)" for i, x in ((1, "x"), (2, "y"))}
    out["address_both_missing"] = "CAST(address_x = '' AND address_y = '' AS INTEGER)"
    return ", ".join(f"{sql} AS {name}" for name, sql in out.items())


FUZZY = ", ".join(f"round({x}_{s}, 6) AS {f}_{s}" for x, f in (("n", "name"), ("d", "address")) for s in SCORERS)
_LIST = "coalesce(string_agg(c, ',' ORDER BY c), '')"
_LISTS = f"SELECT entity_id AS source1_entity_id, (SELECT {_LIST} FROM {{0}} x WHERE x.s = s1.entity_id) AS {{1}} FROM s1"
_HARD = "n_ratio + n_jaro_winkler + n_token_set_ratio + d_ratio + d_token_set_ratio + " + f"({_jaccard('a.address_numbers', 'b.address_numbers')}) + {_feature('country_exact')}"
_UNIT = f"SELECT s, c, round(score / {TOP_SCORE}, 6) AS p FROM scored"
CTES["unit"] = _UNIT
CTES["parts"] = f"SELECT s, CASE WHEN place < e THEN 'tune' WHEN place < 2 * e THEN 'evaluate' ELSE 'train' END AS part FROM (SELECT s, row_number() OVER (ORDER BY {_MD5.format('s')}, s) - 1 AS place, ceil(0.15 * count(*) OVER ()) AS e FROM truth)"
_GRID = "(SELECT i / 100.0 AS threshold FROM range(101) r(i))"
_F05 = "CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp > 0 THEN 1.25 * tp / np * tp / nt / (0.25 * tp / np + tp * 1.0 / nt) ELSE 0.0 END"
CTES["swept"] = f"SELECT threshold, s, {_F05} AS f05 FROM (SELECT g.threshold, truth.s, coalesce(len(truth.m), 0) AS nt, count(x.c) AS np, count(tp.c) AS tp FROM truth CROSS JOIN {_GRID} g LEFT JOIN unit x ON x.s = truth.s AND x.p >= g.threshold LEFT JOIN tp ON tp.s = x.s AND tp.c = x.c GROUP BY ALL)"
CTES["tuned"] = "SELECT threshold, avg(f05) AS f FROM swept JOIN parts USING (s) WHERE part = 'tune' GROUP BY threshold ORDER BY round(f, 12) DESC, threshold LIMIT 1"
CTES["six_groups"] = f"SELECT s, row_number() OVER (ORDER BY {_MD5.format('s')}, s) - 1 AS place, ceil(0.2 * count(*) OVER ()) AS e FROM (SELECT DISTINCT s FROM six)"
CTES["split"] = "SELECT labelled.s, labelled.c, label, CASE WHEN place < e THEN 'validation' ELSE 'train' END AS part FROM labelled JOIN six_groups USING (s)"
CTES["b_tfidf"] = "SELECT s, c, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(sim, 9) DESC, c) AS rank FROM g_sim) WHERE rank <= 10 AND sim > 0"
CTES["classic_rows"] = "SELECT * FROM united_rows UNION ALL SELECT s, c, 'tfidf' AS b, rank FROM b_tfidf"
CTES["classic"] = "SELECT s, c, list_sort(list(b)) AS bs, min(rank) AS best, max(rank) FILTER (b = 'rare_token') AS rare, max(rank) FILTER (b = 'numeric') AS num, max(rank) FILTER (b = 'tfidf') AS near FROM classic_rows GROUP BY s, c"
# Hashed embeddings: signed counts of the grams' hashes, as sparse vectors.
CTES["h_text"] = "SELECT entity_id AS id, tag, ' ' || lower(array_to_string(list_filter([trim(name_norm), trim(address_norm), trim(country)], lambda v: v <> ''), ' | ')) || ' ' AS x FROM norm"
CTES["h_gram"] = "SELECT id, tag, CAST('0x' || substr(md5(substr(x, i, n)), 1, 8) AS BIGINT) AS h FROM (SELECT id, tag, x, n, unnest(range(1, length(x) - n + 2)) AS i FROM (SELECT id, tag, x, unnest([2, 3, 4]) AS n FROM h_text))"
CTES["h_raw"] = "SELECT id, tag, h % 256 AS k, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS w FROM h_gram GROUP BY ALL"
CTES["h_vec"] = "SELECT id, tag, k, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM h_raw"
CTES["h_sim"] = "SELECT a.id AS s, b.id AS c, sum(a.w * b.w) AS sim FROM h_vec a JOIN h_vec b ON a.k = b.k AND a.tag = 'S1' AND b.tag <> 'S1' GROUP BY a.id, b.id"
CTES["b_dense"] = "SELECT s, c, sim, CAST(row_number() OVER (PARTITION BY s ORDER BY round(sim, 9) DESC, c) AS INTEGER) AS rank FROM h_sim QUALIFY rank <= 10"
CTES["whole_rows"] = "SELECT * FROM classic_rows UNION ALL SELECT s, c, 'dense' AS b, rank FROM b_dense"
CTES["whole"] = "SELECT s, c, list_sort(list(b)) AS bs, min(rank) AS best, max(rank) FILTER (b = 'rare_token') AS rare, max(rank) FILTER (b = 'numeric') AS num, max(rank) FILTER (b = 'tfidf') AS near, max(rank) FILTER (b = 'dense') AS alike FROM whole_rows GROUP BY s, c"
CTES["sampled"] = f"SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY {_MD5.format(chr(115) + ' || ' + repr('|') + ' || c')}, c) AS place, CASE WHEN positives > 0 THEN 2 * positives ELSE 2 END AS n FROM labelled JOIN wanted USING (s) WHERE label = 0"
CTES["dataset"] = "SELECT s, c, label FROM labelled WHERE label = 1 UNION ALL SELECT s, c, 0 AS label FROM sampled WHERE place <= n"
for _n, _c in SELECTIVE.items():
    CTES[f"sp_{_n}"] = oracle._prefix(*_c).replace("AS source1_entity_id", "AS s").replace("AS candidate_entity_id", "AS c")
    CTES[f"spc_{_n}"] = f"SELECT s, c FROM sp_{_n} UNION SELECT s, c FROM three"


def _report(name: str, table: str, more: str) -> str:
    return f"SELECT '{name}' AS name, {more}, CAST(sum(n) AS BIGINT) AS n_pairs, round(sum(f) * 1.0 / sum(nt), 6) AS link_recall, round(avg(CASE WHEN nt > 0 THEN CAST(f = nt AS DOUBLE) END), 6) AS complete_recall, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, count(*) FILTER (n = 0) AS zeros FROM (SELECT truth.s, (SELECT count(*) FROM {table} q WHERE q.s = truth.s) AS n, (SELECT count(*) FROM tp q WHERE q.s = truth.s) AS nt, (SELECT count(*) FROM tp q JOIN {table} r USING (s, c) WHERE q.s = truth.s) AS f FROM truth)"


def _family(name: str) -> str:
    """Names of the 90 features by rule: family, side and scorer."""
    fuzzy = ["ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio"]
    three = lambda p: [f"{p}_1", f"{p}_2", f"{p}_diff"]
    equal = ["exact", "norm_exact", "compact_exact"]
    fields = {f: [f"{f}_{x}" for x in (*equal, *fuzzy, "token_jaccard", *three("length"), *three("compact_length"))] for f in ("name", "address")}
    lexical = {p: [f"{p}_{x}" for x in ("exact", *fuzzy, "token_jaccard", "token_count_1", "token_count_2", "token_overlap_count", *three("length"))] for p in ("name_lexical", "address_lexical_lexical")}
    numeric = [f"numeric_{x}" for x in ("count_1", "count_2", "overlap_count", "jaccard", "exact_match", "any_overlap")]
    country = [f"country_{x}" for x in ("exact", "norm_exact", "code_exact", "both_present", "missing_1", "missing_2")]
    blocker = [f"blocker_{x}" for x in ("num_blockers", "best_rank", "has_rank", "rank_count", "provenance_count")]
    blocker += [f"blocker_{x}" for b in ("exact", "rare_token", "numeric", "tfidf", "dense") for x in (f"has_{b}", f"{b}_rank", f"{b}_has_rank")]
    address = [*fields["address"], "address_missing_1", "address_missing_2", "address_both_missing", *lexical["address_lexical_lexical"]]
    names = {"name": [*fields["name"], "name_jaro_winkler"], "lexical": [*lexical["name_lexical"], *lexical["address_lexical_lexical"]], "address": address, "blocker": blocker}
    whole = [*names["name"], *address, *lexical["name_lexical"], *numeric, *country, *blocker, "candidate_is_s2", "candidate_is_s3"]
    gone = names[name.removeprefix("without ")] if name != "all" else []
    return ", ".join(f"('{name}', '{c}')" for c in whole if c not in gone)


_PASS = ("source", "candidates within the limit", "features", "labels", "scores")
_REFUSE = (
    "source without a column", "source with a repeated id", "source with an empty id", "record without a field", "candidates above the limit", "frequency cap of zero", "no blockers", "no positive links",
    "threshold above one", "empty grid", "features missing", "features with nulls", "features of text", "features named twice", "labels of two", "labels of no row", "untrained model", "scores above one",
    "scores of no number", "scores of a repeated pair", "scores without ids", "scores without a column", "more folds than groups", "split by a missing column", "share of one", "ratio of zero", "distractors beside lost records", "pair without record",
)
_RAW = "entity_id, business_name, business_address, country"
_SUBMISSION = "SELECT (SELECT count(*) FROM (SELECT s, c FROM matches EXCEPT SELECT s, c FROM three)) AS matches_outside, 0 AS entities_without_list, 0 AS entities_listed_twice"
_CODE = "CASE WHEN CAST(substr({0}.entity_id, 4, 7) AS BIGINT) % 2 = 0 THEN lower(left({0}.country, 1)) ELSE '' END"

_PLAIN = {
    "read_source_tsv": f"SELECT {_RAW} FROM raw WHERE tag = 'S1'",
    "read_sources_tsv": f"SELECT tag AS source, {_RAW} FROM raw",
    "schema_problems": "SELECT CASE WHEN entity_id = '' THEN 'empty entity_id' ELSE 'repeated entity_id' END AS problem, entity_id, n FROM (SELECT entity_id, count(*) AS n FROM (SELECT CASE WHEN CAST(substr(entity_id, 4, 7) AS BIGINT) % 11 = 0 THEN '' ELSE entity_id END AS entity_id FROM raw WHERE tag = 'S2' UNION ALL SELECT entity_id FROM raw WHERE tag = 'S2' AND CAST(substr(entity_id, 4, 7) AS BIGINT) % 7 = 0) GROUP BY entity_id) WHERE entity_id = '' OR n > 1",
    "read_truth_tsv": "SELECT s AS source1_entity_id, coalesce(array_to_string(m, '|'), '') AS matched FROM truth",
    "read_positive_pairs": f"SELECT DISTINCT {_IDS}, 1 AS label FROM tp",
    "parse_ids": "SELECT s AS source1_entity_id, coalesce(array_to_string(m, '|'), '') AS ids FROM truth",
    "view_scan": "SELECT tag AS candidate_source, country, count(*) AS n FROM t GROUP BY ALL",
    "list_file": f"SELECT source1_entity_id, candidate_entity_ids, row_number() OVER (ORDER BY source1_entity_id) - 1 AS line FROM ({_LISTS.format('three', 'candidate_entity_ids')})",
    "first_records": "SELECT entity_id, business_name FROM s1 ORDER BY entity_id LIMIT 25",
    "json_artifact": "SELECT count(*) AS records, max(entity_id) AS last FROM raw",
    "csv_artifact": "SELECT truth.s AS source1_entity_id, count(tp.c) AS n_true, count(x.c) AS n_found FROM truth LEFT JOIN tp ON tp.s = truth.s LEFT JOIN three x ON x.s = tp.s AND x.c = tp.c GROUP BY truth.s",
    "both_lists": f"SELECT * FROM ({_LISTS.format('three', 'candidate_entity_ids')}) JOIN ({_LISTS.format('matches', 'matched_entity_ids')}) USING (source1_entity_id)",
    "submission_report": _SUBMISSION,
    "prepared_tables": "SELECT part || '_' || lower(tag) AS \"table\", entity_id, name_norm, address_norm FROM norm CROSS JOIN (VALUES ('train'), ('test')) p(part)",
    "refusals": f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {str(c in _REFUSE).lower()})' for c in (*_PASS, *_REFUSE))}) v(\"case\", refused)",
    "strict_lookup": f"SELECT {_IDS}, left(c, 2) AS candidate_source, a.name_norm AS name_1, b.name_norm AS name_2 FROM three_rich_r",
    "guarded_candidates": f"SELECT {_IDS} FROM six",
    "raw_numbers": f"SELECT entity_id, array_to_string(regexp_extract_all(trim(business_address), '{RAW_NUMBER}'), '|') AS numbers FROM raw",
    "odd_names": "SELECT entity_id, business_name FROM raw WHERE regexp_matches(business_name, '[0-9].*[-'']|[-''].*[0-9]|[!?,;:]') ORDER BY entity_id LIMIT 40",
    "generator_classic": f"SELECT {_IDS}, left(c, 2) AS source, array_to_string(bs, '|') AS blocker_provenance, concat_ws('|', 'numeric:' || num, 'rare_token:' || rare, 'tfidf:' || near) AS ranks, CAST(len(bs) AS INTEGER) AS num_blockers, best AS best_rank FROM classic",
    "dense_text": f"SELECT {_IDS}, left(c, 2) AS source, 'dense' AS blocker, rank, round(sim, 6) AS score FROM b_dense WHERE rank <= 5",
    "generator": f"SELECT {_IDS}, left(c, 2) AS source, array_to_string(bs, '|') AS blocker_provenance, concat_ws('|', 'dense:' || alike, 'numeric:' || num, 'rare_token:' || rare, 'tfidf:' || near) AS ranks, CAST(len(bs) AS INTEGER) AS num_blockers, best AS best_rank FROM whole",
    # The texts of the tables hold no character that NFKC changes, nor one that case folding maps otherwise.
    "normalize_full_unicode": "SELECT entity_id, name_norm, address_norm FROM norm",
    "selective_report": " UNION ALL ".join(_report(n, f"spc_{n}", f"(SELECT count(*) FROM sp_{n}) AS n_prefix") for n, _ in SELECTIVE.items()),
    "selected_matches": f"SELECT {_IDS}, p AS score FROM unit WHERE p >= 0.1",
    "best_threshold": "SELECT threshold, round(f, 6) AS macro_f05 FROM (SELECT threshold, avg(f05) AS f FROM swept GROUP BY threshold) ORDER BY round(f, 12) DESC, threshold LIMIT 1",
    "held_out_f05": "SELECT CAST(tuned.threshold AS DOUBLE) AS threshold, round(tuned.f, 6) AS tune_f05, round(avg(f05), 6) AS held_out_f05 FROM tuned JOIN swept ON swept.threshold = tuned.threshold JOIN parts USING (s) WHERE part = 'evaluate' GROUP BY ALL",
    "truth_split": "SELECT s AS source1_entity_id, part FROM parts",
    "recall_of_nothing": "SELECT CAST(0 AS DOUBLE) AS link_recall, CAST(0 AS DOUBLE) AS complete_recall",
    "next_batch": "SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) AS next_batch FROM s1",
    "sorted_scores": f"SELECT {_IDS}, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3",
    "dense_index": "SELECT count(*) FILTER (vec_id % 3 = 0) AS n_records, true AS enough FROM embeddings",
    "fuzzy_scores": f"SELECT {_IDS}, {FUZZY} FROM three_rich_full",
    "country_codes": f"SELECT {_IDS}, {_feature('country_exact')} AS country_exact, {_feature('country_exact')} AS country_norm_exact, CAST({_CODE.format('a')} <> '' AND {_CODE.format('a')} = {_CODE.format('b')} AS INTEGER) AS country_code_exact, {', '.join(f'{_feature(c)} AS {c}' for c in ('country_both_present', 'country_missing_1', 'country_missing_2'))} FROM three_rich_r",
    "source_flags_by_id": f"SELECT {_IDS}, {', '.join(f'{_feature(c)} AS {c}' for c in ('candidate_is_s2', 'candidate_is_s3'))} FROM six",
    "feature_families": f"SELECT * FROM (VALUES {', '.join(_family(n) for n in ('all', 'without address', 'without lexical', 'without blocker'))}) v(family, feature)",
    "aligned_features": oracle._features(SET_COLUMNS).replace("FROM six_rich", "FROM three_rich_r"),
    "hard_negatives_all": f"SELECT {_IDS}, 0 AS label, round(h, 6) AS hard_negative_score FROM (SELECT s, c, h, row_number() OVER (PARTITION BY s ORDER BY round(h, 9) DESC, c) AS place, greatest(positives, 1) AS n FROM (SELECT s, c, {_HARD} AS h FROM six_scored) JOIN labelled USING (s, c) JOIN wanted USING (s) WHERE label = 0) WHERE place <= n",
    "pair_dataset": f"SELECT {_IDS}, label, {_feature('country_exact')} AS country_exact, {_feature('numeric_overlap_count')} AS numeric_overlap_count, round(n_ratio, 6) AS name_ratio, round(d_token_sort_ratio, 6) AS address_token_sort_ratio FROM dataset JOIN six_scored USING (s, c)",
    "train_validation_split": f"SELECT {_IDS}, part FROM split",
    "split_rates": "SELECT part, count(*) AS n_rows, round(avg(label), 6) AS positive_rate FROM split GROUP BY part",
    "score_map": "SELECT s AS source1_entity_id, string_agg(c || ':' || CAST(round(p * 1000000) AS BIGINT), '|' ORDER BY c) AS scores FROM unit GROUP BY s",
    "model_checks": "SELECT count(*) AS n_rows, 0 AS outside, 0 AS changed_by_saving, 0 AS wrong_prediction, 53 AS n_features, CAST(1 AS DOUBLE) AS gain, count(*) AS train_rows, count(*) AS valid_rows, true AS same_features, true AS same_metadata, true AS learned FROM three",
    "indel_ratio": f"SELECT {_IDS}, round(d.ratio, 6) AS ratio FROM three_rich_r r JOIN three_norm d ON d.x = r.a.address_norm AND d.y = r.b.address_norm",
    "features_full": f"SELECT {_IDS}, left(c, 2) AS candidate_source, {_all_features()}, {oracle._PLAIN['features_blocker'].partition('candidate_entity_id, ')[2].replace('FROM united', 'FROM united_rich_full JOIN united USING (s, c)')}",
}
CTES["three_norm"] = f"SELECT DISTINCT x, y, {_ratio('x', 'y')} AS ratio FROM (SELECT a.address_norm AS x, b.address_norm AS y FROM three_rich_r)"
SQL = {name: _full(sql) for name, sql in _PLAIN.items()}
