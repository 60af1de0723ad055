import math

import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking, evaluation, features, model, nearest, normalize, pairs, profile, ranking
from matchloom.plans import flows
from matchloom.schema import PAIR, LinkageError, NotFittedError, SchemaError

RAW = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def sources(spark):
    s1 = [("S1-1", "Acme Tools Ltd", "12 High Rd", "US"), ("S1-2", "Blue Bird", "7 Oak St", "de"), ("S1-3", "", "", ""), ("S1-4", "Nobody", None, "FR")]
    s2 = [("S2-1", "ACME tools, ltd", "12 high road", "us"), ("S2-2", "Blue Birds", "7 Oak St", "DE"), ("S2-3", "", "", "US")]
    s3 = [("S3-1", "Tools Acme", "12 Other Ave", "US"), ("S3-2", "Blue Bird", "", "de"), ("S3-3", "Other", "99 Road", "US")]
    made = [normalize.normalize(spark.createDataFrame(rows, RAW)) for rows in (s1, s2, s3)]
    return made[0].cache(), normalize.targets(*made[1:]).cache()


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([("S1-1", ["S2-1", "S3-1"]), ("S1-2", ["S2-2", "S3-2"]), ("S1-3", []), ("S1-4", [])], f"{PAIR[0]} string, matched array<string>")


def ids(df):
    return {(r[0], r[1]) for r in df.select(*PAIR).collect()}


def test_normalize_refuses_missing_columns(spark):
    with pytest.raises(SchemaError):
        normalize.normalize(spark.createDataFrame([("a",)], "entity_id string"))


def test_exact_blocker(sources):
    s1, t = sources
    got = {(r[0], r[1]): r["evidence"] for r in blocking.exact_blocker(s1, t).collect()}
    assert got == {("S1-1", "S2-1"): ["address_compact", "address_norm", "name_compact", "name_norm"], ("S1-2", "S2-2"): ["address_compact", "address_norm"], ("S1-2", "S3-2"): ["name_compact", "name_norm"]}
    with pytest.raises(LinkageError):
        blocking.exact_blocker(s1, t, max_frequency=0)


def test_caps_drop_frequent_keys(spark):
    s1 = normalize.normalize(spark.createDataFrame([("S1-1", "same", "", "x")], RAW))
    many = normalize.normalize(spark.createDataFrame([(f"S2-{i}", "same", "", "x") for i in range(5)], RAW))
    t = normalize.targets(many, many.limit(0))
    assert blocking.exact_blocker(s1, t, max_frequency=3).count() == 0
    assert blocking.exact_blocker(s1, t, max_frequency=5).count() == 5
    assert blocking.pair_by_rare_key(s1, t, "name_compact", 4).count() == 0
    assert blocking.pair_by_rare_element(s1, t, "name_tokens", 5).count() == 5
    with pytest.raises(LinkageError):
        blocking.six_rules(s1, t, max_candidates=2)


def test_rare_tokens_and_numbers(spark, sources):
    s1, t = sources
    rare = {(r[0], r[1]): (r["evidence"], r["rank"]) for r in blocking.rare_token_blocker(s1, t).collect()}
    assert rare["S1-1", "S3-1"] == (["12", "acme", "tools"], 2) and rare["S1-1", "S2-1"][1] == 1
    assert ids(blocking.numeric_blocker(s1, t)) == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")}
    one = {(r[0], r[1]): r["evidence"] for r in blocking.rare_token_blocker(s1, t, ("name_tokens",), 100, 1).collect()}
    assert one == {("S1-1", "S2-1"): ["ltd"], ("S1-2", "S3-2"): ["bird"]}


def test_candidate_union(sources):
    s1, t = sources
    got = {(r[0], r[1]): r for r in blocking.candidate_union(blocking.exact_blocker(s1, t), blocking.rare_token_blocker(s1, t), blocking.numeric_blocker(s1, t)).collect()}
    row = got["S1-1", "S2-1"]
    assert row["blocker_provenance"] == ["exact", "numeric", "rare_token"] and row["ranks"] == {"numeric": 1, "rare_token": 1}
    assert row["num_blockers"] == 3 and row["best_rank"] == 1 and row["source"] == "S2"
    assert got["S1-2", "S3-2"]["ranks"] == {"rare_token": 2}
    with pytest.raises(LinkageError):
        blocking.candidate_union()
    odd = blocking.exact_blocker(s1, t)
    with pytest.raises(LinkageError):
        blocking.candidate_union(odd, odd.withColumn("source", F.lit("S9")), check_sources=True)


def test_prefixes(sources):
    s1, t = sources
    assert ids(blocking.prefix_pairs(s1, t)) == {("S1-2", "S3-2")}
    assert ids(blocking.prefix_pairs(s1.withColumn("country", F.upper("country")), t.withColumn("country", F.upper("country")))) == {("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S3-2")}
    assert blocking.prefix_pairs(s1, t, 5, 8, 0).count() == 0


def plain_tfidf(queries, corpus):
    def grams(text):
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in range(2, 6):
                if n > len(w):
                    break
                out += [w[i : i + n] for i in range(len(w) - n + 1)]
        return out

    held = {k: grams(v) for k, v in corpus.items() if v.strip()}
    df = {}
    for g in held.values():
        for x in set(g):
            df[x] = df.get(x, 0) + 1

    def vector(g):
        w = {x: g.count(x) * (math.log((1 + len(held)) / (1 + df[x])) + 1) for x in set(g) if x in df}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()} if norm else {}

    vectors = {k: vector(g) for k, g in held.items()}
    return {(q, k): s for q, text in queries.items() for k, v in vectors.items() if (s := sum(w * v.get(x, 0) for x, w in vector(grams(text)).items())) > 0}


def test_tfidf(sources):
    s1, t = sources
    document = lambda df, key: {r[0]: f"{r[1]} {r[2]}".strip() for r in df.select(key, "name_norm", "address_norm").collect()}
    want = plain_tfidf(document(s1, "entity_id"), document(t, PAIR[1]))
    got = {(r[0], r[1]): r["score"] for r in nearest.tfidf_blocker(s1, t).collect()}
    assert got == pytest.approx(want)
    best = nearest.tfidf_blocker(s1, t, top_k=1).collect()
    assert {(r[0], r[1]) for r in best} == {max((k for k in want if k[0] == q), key=want.get) for q in {k[0] for k in want}}
    with pytest.raises(LinkageError):
        nearest.tfidf_blocker(s1, t, top_k=0)


@pytest.mark.parametrize("block_rows", [2, 1000])
def test_dense(spark, block_rows):
    q = spark.createDataFrame([("S1-1", [1.0, 0.0]), ("S1-2", [1.0, 1.0]), ("S1-3", None)], "entity_id string, embedding array<float>")
    t = spark.createDataFrame([("S2-1", [2.0, 0.1], "S2"), ("S2-2", [0.0, 1.0], "S2"), ("S3-1", [-1.0, 0.0], "S3"), ("S3-2", [2.0, 0.1], "S3")], f"{PAIR[1]} string, embedding array<float>, candidate_source string")
    got = [(r[0], r[1], r["rank"]) for r in nearest.dense_blocker(q, t, 3, block_rows=block_rows).orderBy(PAIR[0], "rank").collect()]
    assert got == [("S1-1", "S2-1", 1), ("S1-1", "S3-2", 2), ("S1-1", "S2-2", 3), ("S1-2", "S2-1", 1), ("S1-2", "S3-2", 2), ("S1-2", "S2-2", 3)]


def test_features(sources):
    s1, t = sources
    united = blocking.candidate_union(blocking.exact_blocker(s1, t), blocking.rare_token_blocker(s1, t), blocking.numeric_blocker(s1, t))
    frame = features.feature_frame(united, s1, t)
    columns = features.feature_columns(frame)
    assert len(columns) == 90 and len(features.feature_columns(features.feature_frame(united.select(*PAIR), s1, t))) == 70
    assert len(features.select_families(frame, blocker=False)) == 70
    assert not [c for c in features.select_families(frame, address=False, lexical=False) if c.startswith("address") or "lexical" in c]
    row = {(r[0], r[1]): r for r in frame.collect()}
    same, other = row["S1-1", "S2-1"], row["S1-2", "S3-2"]
    assert same["name_norm_exact"] == 1 and same["name_exact"] == 0 and same["address_ratio"] == 1 and same["country_exact"] == 1
    assert same["numeric_exact_match"] == 1 and same["numeric_jaccard"] == 1 and same["candidate_is_s2"] == 1 and same["blocker_has_exact"] == 1 and same["blocker_exact_rank"] == 0
    assert other["address_missing_2"] == 1 and other["address_ratio"] == 0 and other["address_token_set_ratio"] == 0 and other["name_jaro_winkler"] == 1
    assert other["blocker_rare_token_rank"] == 2 and other["blocker_best_rank"] == 2
    aligned = features.align(frame, columns[:3])
    assert aligned.columns == [*PAIR, *columns[:3]]
    with pytest.raises(SchemaError):
        features.align(frame, ["absent"])
    with pytest.raises(LinkageError):
        features.feature_frame(united.unionByName(united.limit(1).withColumn(PAIR[1], F.lit("S2-99"))), s1, t, strict=True)


def test_empty_texts_have_the_documented_values(spark):
    both = normalize.normalize(spark.createDataFrame([("S1-1", "", "", "")], RAW))
    t = normalize.targets(both.withColumn("entity_id", F.lit("S2-1")), both.limit(0))
    r = features.feature_frame(spark.createDataFrame([("S1-1", "S2-1")], f"{PAIR[0]} string, {PAIR[1]} string"), both, t).first()
    assert r["name_token_jaccard"] == 1.0 and r["address_token_jaccard"] == 0.0 and r["name_lexical_token_jaccard"] == 0.0 and r["numeric_jaccard"] == 0.0
    assert r["name_ratio"] == 1.0 and r["name_lexical_ratio"] == 1.0 and r["name_token_set_ratio"] == 0.0 and r["address_both_missing"] == 1


def test_top_k_breaks_ties_by_id(spark):
    rows = [("a", "x", 1.0), ("a", "w", 1.0), ("a", "z", 2.0), ("b", "x", 0.0)]
    scored = spark.createDataFrame(rows, f"{PAIR[0]} string, {PAIR[1]} string, score double")
    assert {(r[0], r[1], r["rank"]) for r in ranking.top_k(scored, 2).collect()} == {("a", "z", 1), ("a", "w", 2), ("b", "x", 1)}


def test_recall_and_stats(spark, sources, truth):
    s1, _ = sources
    candidates = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-3"), ("S1-2", "S2-2"), ("S1-2", "S3-2"), ("S1-2", "S2-1")], f"{PAIR[0]} string, {PAIR[1]} string")
    assert tuple(evaluation.recalls(truth, candidates).first()) == (0.75, 0.5)
    assert {r[0]: r["recall"] for r in evaluation.per_entity_recall(truth, candidates).collect()} == {"S1-1": 0.5, "S1-2": 1.0, "S1-3": None, "S1-4": None}
    none = truth.where("size(matched) = 0")
    with pytest.raises(LinkageError):
        evaluation.recalls(none, candidates)
    assert tuple(evaluation.recalls(none, candidates, strict=False).first()) == (0.0, 0.0)
    counts = evaluation.candidate_counts(s1, candidates)
    r = evaluation.linear_stats(counts).first()
    assert (r["mean"], r["median"], r["max"], r["zeros"]) == (1.25, 1.0, 3, 2) and r["p95"] == pytest.approx(2.85)
    r = evaluation.index_stats(spark.createDataFrame([("a", 2), ("b", 1), ("c", 0), ("d", 3)], "e string, n long")).first()
    assert (r["mean"], r["median"], r["p95"], r["max"]) == (1.5, 1.5, 3, 3)
    assert {r[0] for r in evaluation.zero_candidates(s1, candidates).collect()} == {"S1-3", "S1-4"}


def test_reports_and_batches(spark, sources, truth):
    s1, t = sources
    a, b = blocking.three_rules(s1, t), blocking.six_rules(s1, t)
    rows = {r["name"]: r for r in evaluation.compare({"a": a, "b": b}, evaluation.truth_pairs(truth), s1).collect()}
    assert rows["a"]["n_pairs"] == a.count() and rows["b"]["link_recall"] == 1.0 and rows["b"]["zeros"] == 2
    r = evaluation.union_report(truth, b).first()
    assert (r["link_recall"], r["complete_recall"], r["max"]) == (1.0, 1.0, 3)
    assert {x[0]: x[1] for x in pairs.batches(s1, 3).collect()} == {"S1-1": 0, "S1-2": 0, "S1-3": 0, "S1-4": 1}
    with pytest.raises(LinkageError):
        pairs.batches(s1, 0)


def test_f05(spark, truth):
    predicted = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-3"), ("S1-3", "S2-1")], f"{PAIR[0]} string, {PAIR[1]} string")
    rows = {r[0]: (r["tp"], r["fp"], r["fn"], r["f05"]) for r in evaluation.entity_f05(truth, predicted).collect()}
    assert rows == {"S1-1": (1, 1, 1, 0.5), "S1-2": (0, 0, 2, 0.0), "S1-3": (0, 1, 0, 0.0), "S1-4": (0, 0, 0, 1.0)}
    assert evaluation.macro_f05(truth, predicted, truth).first()[0] == 0.375
    for wrong in (truth.limit(2), truth.unionByName(truth.limit(1).withColumn(PAIR[0], F.lit("S1-9")))):
        with pytest.raises(LinkageError):
            evaluation.macro_f05(truth, predicted, wrong)


def test_thresholds(spark, truth):
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.8), ("S1-2", "S2-2", 0.8), ("S1-2", "S3-2", 0.85), ("S1-3", "S2-1", 0.4), ("S1-4", "S3-3", 0.3)], f"{PAIR[0]} string, {PAIR[1]} string, score double")
    table = {r["threshold"]: r["macro_f05"] for r in evaluation.threshold_table(truth, scored).collect()}
    for t in (0.0, 0.31, 0.41, 0.8, 0.81, 1.0):
        assert table[t] == pytest.approx(evaluation.macro_f05(truth, evaluation.select_matches(scored, t)).first()[0])
    best = evaluation.best_threshold(truth, scored).first()
    assert (best["threshold"], best["macro_f05"]) == (0.41, 1.0)
    assert evaluation.best_threshold(truth, scored, grid=[0.8, 0.5]).first()["threshold"] == 0.5
    with pytest.raises(LinkageError):
        evaluation.select_matches(scored, 1.1)
    with pytest.raises(LinkageError):
        evaluation.threshold_table(truth, scored, grid=[])


def test_negatives(spark, truth):
    pool = spark.createDataFrame([(s, c) for s in ("S1-1", "S1-3") for c in ("S2-1", "S3-1", "S2-2", "S2-3", "S3-3")], f"{PAIR[0]} string, {PAIR[1]} string")
    a = ids(pairs.negatives(pool, truth, 1))
    assert a == ids(pairs.negatives(pool.repartition(3), truth, 1))
    assert sum(s == "S1-1" for s, _ in a) == 2 and sum(s == "S1-3" for s, _ in a) == 1
    assert not a & {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    scored = pool.withColumn("name_ratio", (F.col(PAIR[1]) == "S3-3").cast("double"))
    hard = {(r[0], r[1]): r["hard_negative_score"] for r in pairs.hard_negatives(scored, truth).collect()}
    assert hard == {("S1-1", "S3-3"): 1.0, ("S1-1", "S2-2"): 0.0, ("S1-3", "S3-3"): 1.0}
    with pytest.raises(LinkageError):
        pairs.negatives(pool, truth, 0)


def test_pair_dataset(sources, truth):
    s1, t = sources
    out = pairs.pair_dataset(blocking.six_rules(s1, t), truth, s1, t)
    rows = {(r[0], r[1]): r["label"] for r in out.collect()}
    assert {k for k, v in rows.items() if v} == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2"), ("S1-2", "S3-2")}


def test_splits(spark):
    df = spark.createDataFrame([(f"S1-{i // 3}", i) for i in range(60)], f"{PAIR[0]} string, x long")
    train, valid = pairs.train_validation(df)
    groups = [{r[0] for r in part.collect()} for part in (train, valid)]
    assert not groups[0] & groups[1] and len(groups[1]) == 4 and train.count() + valid.count() == 60
    assert groups[1] == {r[0] for r in pairs.train_validation(df.repartition(5))[1].collect()}
    folds = pairs.group_kfold(df, 4)
    assert sorted(x for _, v in folds for x in [r["x"] for r in v.collect()]) == list(range(60))
    for t, v in folds:
        assert not {r[0] for r in t.collect()} & {r[0] for r in v.collect()}
    assert [p.count() for p in pairs.three_way(df.select(F.col(PAIR[0]).alias("entity_id")).distinct())] == [14, 3, 3]
    for broken in (lambda: pairs.train_validation(df, 1.0), lambda: pairs.train_validation(df.limit(0)), lambda: pairs.group_kfold(df, 21), lambda: pairs.train_validation(df.withColumn(PAIR[0], F.lit(None).cast("string")))):
        with pytest.raises(LinkageError):
            broken()
    with pytest.raises(SchemaError):
        pairs.train_validation(df, group="absent")


def test_samples(spark, sources):
    s1, _ = sources
    assert {r[0] for r in pairs.sample_entities(s1, 2).collect()} == {r[0] for r in pairs.sample_entities(s1.repartition(3), 2).collect()}
    need = s1.where("entity_id = 'S1-3'")
    got = {r[0] for r in pairs.with_distractors(s1, need, 2).collect()}
    assert "S1-3" in got and len(got) == 3
    with pytest.raises(LinkageError):
        pairs.with_distractors(s1, need.withColumn("entity_id", F.lit("S1-77")), 1)


def test_profiles(sources, truth):
    s1, _ = sources
    r = profile.profile({"S1": s1}).first()
    assert (r["n_rows"], r["n_ids"], r["repeated_ids"], r["missing_name"], r["missing_address"], r["missing_address_percent"]) == (4, 4, 0, 1, 2, 50.0)
    assert {x[0]: x[1] for x in profile.countries(s1).collect()}["<MISSING>"] == 1
    assert tuple(profile.truth_buckets(truth).first()) == (2, 0, 2, 0, 2, 2, 2)
    assert tuple(profile.id_differences(s1, truth.limit(3)).first()) == (1, 0)
    assert [x[0] for x in profile.oddities(s1, "business_name", "T").collect()] == ["S1-1"]


def test_matcher(spark, tmp_path):
    rows = [(f"S1-{i}", f"S2-{i}", i / 40, float(i % 3), int(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, f"{PAIR[0]} string, {PAIR[1]} string, near double, noise double, label int")
    trained = model.train(df, ["near", "noise"], df.limit(10), maxIter=3, maxDepth=2)
    assert (trained.train_rows, trained.train_positive_rate, trained.valid_rows) == (40, 0.5, 10)
    scores = {r[0]: r["match_probability"] for r in trained.matcher.score(df).collect()}
    assert all(0 <= p <= 1 for p in scores.values()) and scores["S1-0"] < 0.5 < scores["S1-39"]
    assert trained.matcher.predict(df).where("prediction = 1").count() in (19, 20, 21)
    top = trained.matcher.importance(spark).collect()
    assert top[0]["feature"] == "near" and top[0]["splits"] > 0
    trained.matcher.save(str(tmp_path / "m"), {"threshold": 0.5})
    loaded, metadata = model.Matcher.load(spark, str(tmp_path / "m"))
    assert metadata == {"threshold": "0.5"} and loaded.features == ["near", "noise"]
    assert {r[0]: r["match_probability"] for r in loaded.score(df).collect()} == pytest.approx(scores)
    mapped = model.scores_to_map(trained.matcher.score(df))
    assert mapped.count() == 40 and mapped.first()["scores"]
    with pytest.raises(NotFittedError):
        model.Matcher(["near"]).score(df)
    for broken in (df.withColumn("label", F.lit(2)), df.limit(0), df.withColumn("label", F.lit(None).cast("int"))):
        with pytest.raises(LinkageError):
            model.Matcher(["near"]).fit(broken)
    with pytest.raises(SchemaError):
        model.Matcher(["near", "near"])
    with pytest.raises(SchemaError):
        model.Matcher(["near"]).fit(df.withColumn("near", F.lit(None).cast("double")))
    scored = trained.matcher.score(df)
    for broken in (scored.limit(0), scored.withColumn("match_probability", F.lit(1.5)), scored.union(scored)):
        with pytest.raises(LinkageError):
            model.scores_to_map(broken)


def test_rule_flow_and_submission(sources, tmp_path):
    s1, t = sources
    flow = flows.rule_flow(s1, t)
    assert ids(flow.matches) == {("S1-1", "S2-1"), ("S1-2", "S3-2")}
    assert ids(flow.matches) <= ids(flow.candidates)
    assert tuple(flows.submit(s1, flow.candidates, flow.matches, str(tmp_path)).first()) == (0, 0, 0)


def test_generator_refuses_no_targets(sources):
    s1, t = sources
    with pytest.raises(LinkageError):
        flows.generate(s1, t.limit(0))
    assert ids(flows.generate(s1, t)) >= ids(blocking.exact_blocker(s1, t))


def test_generator_with_dense_text(sources):
    s1, t = sources
    rows = {(r[0], r[1]): r for r in flows.generate(s1, t, use_dense=True, top_k=2, embed=nearest.hashed_embedding()).collect()}
    assert "dense" in rows["S1-1", "S2-1"]["blocker_provenance"] and rows["S1-1", "S2-1"]["ranks"]["dense"] == 1
    assert rows["S1-2", "S2-2"]["ranks"]["tfidf"] == 1 and sum("dense" in r["blocker_provenance"] for r in rows.values()) == 8


def test_codes_stand_in_for_the_country(sources):
    s1, t = sources
    pairs_ = blocking.six_rules(s1, t)
    coded = lambda df: df.withColumn("country_norm", F.lit("straße")).withColumn("country_code", F.when(F.col("country") == "US", "us"))
    plain = {tuple(r[:2]): tuple(r[2:]) for r in features.enrich(pairs_, s1, t).select(*PAIR, *[features.country_features()[c] for c in features.COUNTRY[:3]]).collect()}
    own = {tuple(r[:2]): tuple(r[2:]) for r in features.enrich(pairs_, coded(s1), coded(t).withColumn("country_norm", F.lit("STRASSE"))).select(*PAIR, *[features.country_features()[c] for c in features.COUNTRY[:3]]).collect()}
    assert all(v[0] == v[1] == v[2] for v in plain.values())
    assert all(v[1] == 1 for v in own.values()) and own["S1-1", "S2-1"] == (1, 1, 0) and own["S1-1", "S3-1"] == (1, 1, 1)


def test_splits_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(f"S1-{i:03d}", i % 3) for i in range(300)], f"{PAIR[0]} string, n int").repartition(5)
    for part in pairs.split_groups(df, (0.5, 0.5)):
        assert "Python" not in part._jdf.queryExecution().executedPlan().toString()
    numbered = pairs.batches(df, 7, PAIR[0]).collect()
    assert {r[0]: r["batch"] for r in numbered} == {f"S1-{i:03d}": i // 7 for i in range(300)}
    assert pairs.next_batch(pairs.batches(df, 7, PAIR[0])).first()[0] == 43
    assert pairs.next_batch(pairs.batches(df.limit(0), 7, PAIR[0])).first()[0] == 0


def test_entities_without_candidates_count_in_the_search(spark):
    truth = spark.createDataFrame([("S1-1", ["S2-1"]), ("S1-2", ["S2-2"]), ("S1-3", [])], f"{PAIR[0]} string, matched array<string>")
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.7), ("S1-3", "S2-9", 0.4)], f"{PAIR[0]} string, {PAIR[1]} string, score double")
    got = flows.judge(truth, truth, scored, "score")
    assert (got.threshold, round(got.tune_f05, 9), round(got.held_out_f05, 9)) == (0.41, round(2 / 3, 9), round(2 / 3, 9))
    without = flows.judge(truth.where("source1_entity_id <> 'S1-2'"), truth, scored, "score")
    assert without.tune_f05 == 1.0 and round(without.held_out_f05, 9) == round(2 / 3, 9)


def test_training_splits_entities_of_the_truth(spark):
    records = lambda tag: [(f"{tag}-{i:03d}", f"name{i} alpha{i % 7} beta{i % 5}", f"{i} road{i % 9} rd", "us") for i in range(60)]
    s1, s2, s3 = (normalize.normalize(spark.createDataFrame(records(tag), RAW)) for tag in ("S1", "S2", "S3"))
    t = normalize.targets(s2, s3.limit(0))
    truth = spark.createDataFrame([(f"S1-{i:03d}", [f"S2-{i:03d}"]) for i in range(60)] + [(f"S1-9{i:02d}", [f"S2-9{i:02d}"]) for i in range(20)], f"{PAIR[0]} string, matched array<string>")
    got = flows.train_flow(blocking.six_rules(s1, t), s1, t, truth, maxIter=3, maxDepth=2)
    parts = [{r[0] for r in part.collect()} for part in flows.three_truths(truth)]
    assert [len(p) for p in parts] == [56, 12, 12] and not parts[0] & parts[1] and not parts[1] & parts[2]
    known = [sum(not e.startswith("S1-9") for e in p) / len(p) for p in parts]
    assert got.macro_f05 == pytest.approx(known[1], abs=0.01) and got.held_out_f05 <= known[2] + 1e-9
    assert got.training.valid_rows > 0 and 0 <= got.training.valid_logloss < 1


@pytest.mark.parametrize("top_k,seed", [(1, 1), (3, 1), (5, 20), (40, 2)])
def test_tfidf_bounds_lose_no_neighbour(spark, top_k, seed):
    import random

    rng = random.Random(top_k)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(40)]
    row = lambda i: (i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))))
    s1 = spark.createDataFrame([row(f"S1-{i}") for i in range(30)] + [("S1-none", ""), ("S1-far", "zzzz")], "entity_id string, name_norm string")
    t = spark.createDataFrame([row(f"S2-{i}") for i in range(80)], f"{PAIR[1]} string, name_norm string")
    asked, held = nearest._vectors(s1, t, ("name_norm",), (2, 4))
    whole = {(r[0], r[1]): r[2] for r in nearest._similar(asked, held, "similarity").collect()}
    got = {(r[0], r[1]): r[2] for r in nearest.tfidf_similarities(asked, held, top_k, seed).collect()}
    assert all(whole[p] == pytest.approx(v, abs=1e-12) for p, v in got.items())
    for e in {p[0] for p in whole}:
        best = sorted((-v for p, v in whole.items() if p[0] == e))[:top_k]
        assert sorted(-v for p, v in got.items() if p[0] == e)[:top_k] == pytest.approx(best, abs=1e-9)
    assert len(got) < len(whole) or top_k == 40


def test_index_of_dense_vectors(spark):
    import random

    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    near = lambda c: [x + rng.gauss(0, 0.2) for x in centres[c]]
    s1 = spark.createDataFrame([(f"S1-{i}", near(i % 9)) for i in range(40)] + [("S1-x", None)], "entity_id string, embedding array<double>")
    t = spark.createDataFrame([(f"S2-{i:03d}", "S2", near(0 if i % 3 == 0 else i % 9)) for i in range(300)], f"{PAIR[1]} string, candidate_source string, embedding array<double>")
    exact = nearest.dense_blocker(s1, t, 4)
    found = nearest.dense_blocker(s1, t, 4, block_rows=16, lists=9)
    assert found.count() == exact.count() == 160 and nearest.recall_at(found, exact) >= 0.9


def test_selective_report_skips_what_is_too_large(spark, sources, truth):
    s1, t = sources
    out = flows.selective_report(s1, t, truth, blocking.three_rules(s1, t))
    assert out.count() == 5 and out.where("link_recall is null").isEmpty()
    with pytest.raises(LinkageError):
        flows.selective_report(s1, t, truth, blocking.three_rules(s1, t), max_candidates=-1)


@pytest.mark.parametrize("top_k,first,rows", [(1, 3, 7), (4, 8, 8), (30, 2, 50)])
def test_sparse_search_in_small_blocks(spark, monkeypatch, top_k, first, rows):
    """Copies on both sides, repeated ids, and targets read in many blocks give the neighbours of the whole join."""
    import random

    rng = random.Random(top_k)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    s1 = spark.createDataFrame([(f"S1-{i:02d}", rng.choice(names)) for i in range(30)] + [("S1-00", "abc zzz"), ("S1-no", "")], "entity_id string, name_norm string")
    t = spark.createDataFrame([(f"S2-{i:03d}", rng.choice(names), "S2") for i in range(120)] + [("S2-001", "bcd ae", "S2")], f"{PAIR[1]} string, name_norm string, candidate_source string")
    whole = nearest._similar(*nearest._vectors(s1, t, ("name_norm",), (2, 4)), "score").collect()
    search = nearest.search.sparse_search
    monkeypatch.setattr(nearest.search, "sparse_search", lambda *args: search(*args, first=first, rows=rows, frequent=20))
    got = nearest.tfidf_blocker(s1, t.dropDuplicates([PAIR[1]]).unionByName(t).dropDuplicates(), ("name_norm",), (2, 4), top_k).distinct().collect()
    for e in {r[0] for r in whole}:
        best = sorted(((-round(r[2], 9), r[1]) for r in whole if r[0] == e))[:top_k]
        assert sorted((-round(r["score"], 9), r[1]) for r in got if r[0] == e) == best


def test_exact_dense_search_shuffles_no_copies_of_vectors(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", [float(i % 5), 1.0, 0.0]) for i in range(50)] + [("S1-zero", [0.0] * 3), ("S1-null", None)], "entity_id string, embedding array<double>")
    t = spark.createDataFrame([(f"S2-{i:03d}", "S2", [1.0, float(i % 7), 0.0]) for i in range(300)], f"{PAIR[1]} string, candidate_source string, embedding array<double>")
    got = nearest.dense_blocker(s1, t, 50, block_rows=16)
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy(PAIR[0], "rank").collect()
    assert len(rows) == 51 * 50
    assert [r[1] for r in rows if r[0] == "S1-zero"] == [f"S2-{i:03d}" for i in range(50)]
    assert [r[1] for r in rows if r[0] == "S1-0"] == [f"S2-{i:03d}" for i in sorted(range(300), key=lambda i: (-(i % 7), i))[:50]]


def test_truth_of_repeated_ids(spark):
    from matchloom.plans.fixture import _truth

    left = spark.createDataFrame([("S1-1", "a"), ("S1-2", "b"), ("S1-2", "a"), ("S1-3", "c")], f"{PAIR[0]} string, beginning string")
    right = spark.createDataFrame([("S2-2", "a"), ("S2-1", "a"), ("S2-1", "a"), ("S3-1", "b")], "entity_id string, beginning string")
    assert sorted((r[0], r[1]) for r in _truth(left, right).collect()) == [("S1-1", ["S2-1", "S2-2"])] + [("S1-2", ["S2-1", "S2-2", "S3-1"])] * 2 + [("S1-3", [])]


@pytest.mark.parametrize("cap", [None, 6])
def test_prefix_pairs_are_made_once(spark, monkeypatch, cap):
    """Repeated ids and beginnings of many records: the pairs of both joins, each once, without a shuffle of pairs."""
    import random

    rng = random.Random(3)
    row = lambda tag, i: (f"{tag}-{i:02d}", rng.choice(["", "aaaaax", "aaaaay", "bbbbb", "ccccccc"]), rng.choice(["", "12345678a", "12345678b", "9"]), rng.choice(["us", "de", ""]))
    left, right = [row("S1", i % 25) for i in range(30)], [row("S2", i % 35) for i in range(45)]
    s1 = spark.createDataFrame(left, "entity_id string, name_compact string, address_compact string, country string")
    t = spark.createDataFrame(right, f"{PAIR[1]} string, name_compact string, address_compact string, country string")
    monkeypatch.setattr(blocking, "SHARE", 2)
    got = blocking.prefix_pairs(s1, t, 5, 8, cap)
    often = lambda b, c, n: cap is None or sum(x[c][:n] == b[c][:n] for x in right if x[c]) <= cap
    want = {(a[0], b[0]) for a in left for b in right for c, n in ((1, 5), (2, 8)) if a[3] and a[3] == b[3] and a[c] and b[c] and a[c][:n] == b[c][:n] and often(b, c, n)}
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted(want)


def test_truth_by_groups_is_the_truth_of_its_pairs(spark):
    left = [("S1-1", "a"), ("S1-2", "b"), ("S1-2", "a"), ("S1-3", "c"), ("S1-4", None)]
    right = [("a", "S2-1"), ("a", "S2-2"), ("a", "S2-2"), ("b", "S2-2"), ("b", "S3-1"), (None, "S3-2")]
    groups = evaluation.Groups(spark.createDataFrame(left, f"{PAIR[0]} string, group string"), spark.createDataFrame(right, f"group string, {PAIR[1]} string"))
    held = {i: sorted({c for e, g in left for h, c in right if e == i and g is not None and g == h}) for i, _ in left}
    truth = spark.createDataFrame(list(held.items()), f"{PAIR[0]} string, matched array<string>")
    scored = spark.createDataFrame([(i, c, 0.3 + 0.1 * j) for j, i in enumerate(held) for c in ("S2-1", "S2-2", "S3-2")], f"{PAIR[0]} string, {PAIR[1]} string, score double")
    rows = lambda f: [sorted(map(tuple, f(t).collect())) for t in (groups, truth)]
    for f in (lambda t: pairs.label(scored, t), evaluation.truth_sizes, lambda t: evaluation.entity_f05(t, scored.where("score > 0.4")), lambda t: evaluation.threshold_table(t, scored)):
        got, want = rows(f)
        assert got == want and got


def test_full_pipeline_makes_no_pairs_of_the_truth(spark, monkeypatch):
    """Pairs of the truth grow with the square of a group; labels, threshold and score come from groups and candidates."""
    from matchloom.plans import catalog
    from matchloom.plans.fixture import load

    monkeypatch.setattr(evaluation, "truth_pairs", lambda truth: pytest.fail("pairs of the truth"))
    got = catalog.QUERIES["full_pipeline"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == load(spark, "/root/testdata/sf0.001").s1.count() and any(r["matched_entity_ids"] for r in got)


def test_full_pipeline_trains_the_whole_model(spark, monkeypatch):
    """The matcher's own trees and cut: ten small trees and ten candidates were a small part of the work."""
    import inspect

    from matchloom.plans import catalog

    given, asked = {}, inspect.signature(flows.train_and_match)

    def watched(*args, **options):
        bound = asked.bind(*args, **options)
        bound.apply_defaults()
        given.update(bound.arguments)
        return None, args[0].limit(0)

    monkeypatch.setattr(flows, "train_and_match", watched)
    catalog.QUERIES["full_pipeline"](spark, "/root/testdata/sf0.001")
    assert model.DEFAULTS | given["params"] == model.DEFAULTS and model.DEFAULTS["maxIter"] == 300
    assert given["k"] == 30 == inspect.signature(flows.infer_flow).parameters["k"].default


def test_matches_of_training_are_those_of_inference(spark):
    from matchloom.plans.fixture import load

    r = load(spark, "/root/testdata/sf0.001")
    trained, matches = flows.train_and_match(blocking.six_rules(r.s1, r.targets), r.s1, r.targets, r.groups, k=2, maxIter=3, maxDepth=2)
    again = flows.infer_flow(r.s1, r.targets, trained.matcher, trained.threshold, k=2)[1]
    rows = [sorted((x[PAIR[0]], x[PAIR[1]], x["match_probability"]) for x in df.collect()) for df in (matches, again)]
    assert rows[0] == rows[1] and rows[0]
