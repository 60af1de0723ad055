import pytest

from matchloom.operators import blocking
from matchloom.operators.normalize import normalize, targets
from matchloom.plans import catalog, oracle, prepare
from matchloom.schema import PAIR, LinkageError, SchemaError
from matchloom.sources import readers, writers
from matchloom.streaming import incremental

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_sources(spark, tmp_path):
    path = put(tmp_path / "a.tsv", HEAD + 'S1-001\t"Say ""hi"", Co"\t\tUS\n007\tNA\tx\t\n')
    assert [tuple(r) for r in readers.read_source(spark, path).collect()] == [("S1-001", 'Say "hi", Co', "", "US"), ("007", "NA", "x", "")]
    for bad in ("entity_id\tcountry\na\tb\n", HEAD + " \ta\tb\tc\n", HEAD + "x\ta\tb\tc\nx\ta\tb\tc\n"):
        with pytest.raises(SchemaError):
            readers.read_source(spark, put(tmp_path / "b.tsv", bad))
    for n in readers.FILES.values():
        put(tmp_path / n, HEAD + "S1-1\ta\tb\tc\n")
    assert set(readers.read_sources(spark, str(tmp_path))) == {"S1", "S2", "S3"}


def test_truth(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    path = put(tmp_path / "t.tsv", head + "S1-1\tS2-1, S3-2,,S2-1\nS1-2\t\n")
    assert {r[0]: r[1] for r in readers.read_truth(spark, path).collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    for bad in (head, head + "X-1\tS2-1\n", head + "S1-1\tS4-1\n", head + "S1-1\t\nS1-1\t\n", head + "S1-1\t-\n"):
        with pytest.raises(SchemaError):
            readers.read_truth(spark, put(tmp_path / "u.tsv", bad))
    loose = put(tmp_path / "v.tsv", head + "S1-1\tS2-1,S3-1\nS1-2\t-\nS1-3\t\n")
    assert [tuple(r) for r in readers.read_positive_pairs(spark, loose).collect()] == [("S1-1", "S2-1", 1), ("S1-1", "S3-1", 1)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, n int")
    writers.write_parquet(df, str(tmp_path / "a.parquet"))
    writers.write_csv(df, str(tmp_path / "a.csv"))
    writers.write_json(df, str(tmp_path / "a.json"))
    assert readers.read_parquet(spark, str(tmp_path / "a.parquet"), view="seen").count() == spark.table("seen").count() == 1
    assert readers.read_metadata(spark, str(tmp_path / "a.json")) == {"n": 1, "x": "a"}
    with pytest.raises(LinkageError):
        writers.write_parquet(df, str(tmp_path / "a.txt"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        writers.write_parquet(df, str(tmp_path / "a.parquet"), overwrite=False)
    assert readers.first_rows(df, "x", 1).count() == 1


def test_lists(spark, tmp_path):
    entities = spark.createDataFrame([("S1-2",), ("S1-1",)], "entity_id string")
    found = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-9"), ("S1-1", "S2-9")], f"{PAIR[0]} string, {PAIR[1]} string")
    lists = writers.list_per_entity(entities, found, "matched_entity_ids")
    writers.write_lists(lists, str(tmp_path / "l.tsv"), single_file=True)
    assert [tuple(r) for r in readers.read_output(spark, str(tmp_path / "l.tsv")).collect()] == [("S1-1", "S2-9,S3-1"), ("S1-2", "")]


def test_stream_gives_the_rows_of_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.tsv", HEAD + "S1-1\tAcme Tools\t12 High Rd\tUS\n")
    put(tmp_path / "in" / "b.tsv", HEAD + "S1-2\tBlue Bird\t7 Oak St\tDE\n")
    raw = spark.createDataFrame([("S2-1", "acme tools", "12 high road", "US"), ("S2-2", "Blue Birds", "7 Oak St", "DE")], "entity_id string, business_name string, business_address string, country string")
    held = targets(normalize(raw), normalize(raw).limit(0))
    seen = []
    query = incremental.link_stream(incremental.read_source_stream(spark, str(tmp_path / "in")), held, str(tmp_path / "out"), str(tmp_path / "cp"), then=lambda df, n: seen.append(n))
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*PAIR, "score").collect()}
    batch = readers.read_source(spark, str(tmp_path / "in"))
    assert got == {tuple(r) for r in incremental.link_batch(batch, held).select(*PAIR, "score").collect()} and seen
    assert {(a, b) for a, b, _ in got} == {(r[0], r[1]) for r in blocking.six_rules(normalize(batch), held).collect()}


def test_every_oracle_has_a_query():
    assert set(oracle.SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(oracle.SQL) == {"normalize_full_unicode", "dense_text", "generator", "features_full", "indel_ratio", "train_and_score", "feature_importance", "full_pipeline"}


def test_prepare(spark, tmp_path):
    for part in ("train", "test"):
        (tmp_path / part).mkdir()
        for name, file in readers.FILES.items():
            put(tmp_path / part / file, HEAD + f"{name}-1\tＡcme\t1 rd\tUS\n")
    put(tmp_path / "train" / prepare.TRUTH_FILE, "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n")
    paths = prepare.prepare(spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "out"))
    assert len(paths) == 7
    assert spark.read.parquet(paths[0]).first()["name_norm"] == "acme" and spark.read.parquet(paths[-1]).count() == 1


def test_quoted_line_breaks_are_read_on_request(spark, tmp_path):
    path = put(tmp_path / "q.tsv", HEAD + 'S1-1\t"two\nlines"\tx\tUS\n')
    assert [tuple(r) for r in readers.read_source(spark, path, quoted_breaks=True).collect()] == [("S1-1", "two\nlines", "x", "US")]


def test_both_outputs_come_from_one_table(spark, tmp_path):
    entities = spark.createDataFrame([("S1-2",), ("S1-1",)], "entity_id string")
    schema = f"{PAIR[0]} string, {PAIR[1]} string"
    lists = writers.write_both_outputs(entities, spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-9")], schema), spark.createDataFrame([("S1-1", "S2-9"), ("S1-1", "S2-9")], schema), str(tmp_path / "out"))
    assert {tuple(r) for r in lists.collect()} == {("S1-1", "S2-9,S3-1", "S2-9"), ("S1-2", "", "")}
    assert [tuple(r) for r in readers.read_output(spark, str(tmp_path / "out" / "matches.tsv")).orderBy(PAIR[0]).collect()] == [("S1-1", "S2-9"), ("S1-2", "")]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from matchloom.sources import scratch

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(LinkageError):
        scratch.folder(SimpleNamespace(sparkContext=context), "x")


def test_lines_of_a_file_read_in_pieces(spark, tmp_path):
    path = str(tmp_path / "list.tsv")
    rows = [(f"S1-{i:04d}", "" if i % 5 else f"S2-{i}") for i in range(3000)]
    writers.write_lists(spark.createDataFrame(rows[::-1], f"{PAIR[0]} string, ids string").repartition(7), path, single_file=True)
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(sizes, ("3000", "100"), strict=True):
            spark.conf.set(k, v)
        read = readers.read_output(spark, path)
        assert read.rdd.getNumPartitions() > 3
        assert sorted(tuple(r) for r in readers.numbered_lines(read).collect()) == [(*r, i) for i, r in enumerate(rows)]
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)
