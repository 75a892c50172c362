import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from kinvote import constants as C
from kinvote.functions.patterns import with_patterns
from kinvote.operators import labels, ml_stages, sampling, vocabulary, votes
from kinvote.plans import experiment
from kinvote.session import materialize, scratch_path
from kinvote.sources import readers, writers


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """1,000 rows, 90 % of them of one class."""
    return spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(1).alias("label"))


def test_recode(spark):
    df = spark.createDataFrame([(0,), (2,), (4,), (3,), (None,)], "label int")
    got = lambda m: [r[0] for r in df.select(labels.recode(F.col("label"), m)).collect()]
    assert got(C.NUMERIC_BINARY) == [0, None, 1, None, None]
    assert got(C.NUMERIC_TERNARY) == [0, 1, 2, None, None]
    keep = df.select(labels.recode_keep(F.col("label"), C.NUMERIC_BINARY)).collect()
    assert [r[0] for r in keep] == [0, 2, 1, 3, None]
    words = spark.createDataFrame([("Negative",), ("NEUTRAL",), ("positive",), ("other",), (None,)], "label string")
    assert [r.label for r in labels.recode_labels(words, C.WORD_TERNARY).collect()] == [0, 1, 2]


def test_class_and_column_checks(spark, skewed):
    assert labels.require_two_classes(skewed) is skewed
    with pytest.raises(ValueError):
        labels.require_two_classes(skewed.where("label = 1"))
    with pytest.raises(ValueError, match="train.*text"):
        labels.require_columns(skewed, ["id", "text"], "train")


def test_samples(skewed):
    balanced = sampling.sample_balanced(skewed, 70)
    counts = {r.label: r["count"] for r in balanced.groupBy("label").count().collect()}
    assert counts == {0: 70, 1: 70}
    assert sampling.sample_balanced(skewed, 500).count() == 600  # all of the small class
    assert sampling.sample_balanced(skewed, 0).count() == 1000
    by_hash = sorted(
        (r.h, r.id)
        for r in skewed.select(F.md5(F.concat(F.lit("42:"), "id")).alias("h"), "id").collect()
    )
    for n in (1, 10, 500, 1000, 5000):
        assert ids(sampling.sample_uniform(skewed, n)) == sorted(i for _, i in by_hash[:n])
    small, large = ids(sampling.sample_uniform(skewed, 100)), ids(sampling.sample_uniform(skewed, 300))
    assert set(small) < set(large)
    assert ids(sampling.sample_uniform(skewed.repartition(13), 100)) == small


def test_splits(skewed):
    split = sampling.split_stratified(skewed)
    assert split.count() == 1000
    shares = split.groupBy("label").agg(F.count(F.when(F.col("is_test"), 1)).alias("n")).collect()
    assert {r.label: r.n for r in shares} == {0: 180, 1: 20}
    whole = sampling.split_stratified(skewed, fraction=0.0)
    assert whole.where("is_test").count() == 0 and whole.count() == 1000
    one, many = (ids(sampling.split_random(skewed.repartition(n)).where("is_test")) for n in (1, 16))
    assert one == many and 150 < len(one) < 250


def test_dedupe_keeps_first(spark):
    rows = [(3, 1, "x"), (1, 0, "x"), (2, 2, "y")]
    df = spark.createDataFrame(rows, "id bigint, label int, text string")
    assert sorted(map(tuple, sampling.dedupe(df, "text").collect())) == [(1, 0, "x"), (2, 2, "y")]


def test_fraction_sizes(spark):
    df = spark.range(1)
    got = [tuple(r) for r in sampling.sample_sizes(df, [1.5, 0.2, 0.2, 0.0], 50).collect()]
    assert got == [(0.05, 2, 0.04), (0.2, 10, 0.2), (1.0, 50, 1.0)]


NEIGHBORS = "test_id int, test_label int, train_label int, overlap bigint, union_size bigint"


def test_votes_and_fallback(spark):
    rows = [(1, 1, 1, 1, 2), (1, 1, 0, 1, 2), (2, 0, 2, 0, 5), (2, 0, 1, 0, 5), (3, 1, 0, 1, 10), (3, 1, 0, 1, 10), (3, 1, 1, 9, 10)]
    near = spark.createDataFrame(rows, NEIGHBORS)
    plain = {r.test_id: r.prediction for r in votes.vote_winner(votes.plain_votes(near)).collect()}
    assert plain == {1: 0, 2: 1, 3: 0}  # ties go to the smaller class
    counted = votes.weighted_votes(near)
    weight = {(r.test_id, r.train_label): r.votes for r in counted.collect()}
    assert weight[2, 1] == votes.ZERO_SIMILARITY_WEIGHT and weight[1, 1] == votes.WEIGHT_UNIT // 2
    weighted = {r.test_id: r.prediction for r in votes.vote_winner(counted).collect()}
    assert weighted == {1: 0, 2: 1, 3: 1}
    tests = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 2)], "test_id int, test_label int")
    predictions = votes.predict_with_fallback(tests, votes.vote_winner(counted), F.lit(2))
    assert {r.test_id: (r.prediction, r.is_fallback) for r in predictions.collect()}[4] == (2, True)
    row = votes.accuracy(predictions).first()
    assert (row.n_correct, row.test_size, row.n_fallback, row.accuracy) == (2, 4, 1, 0.5)
    assert votes.accuracy(predictions.where("false")).first().accuracy == 0.0


def test_smaller_k_is_a_prefix(spark):
    ranked = spark.createDataFrame([(1, n, n) for n in range(1, 8)], "test_id int, train_id int, rank int")
    rows = votes.at_each_k(ranked, [5, 3, 100]).collect()
    by_k = {k: {r.train_id for r in rows if r.k == k} for k in (3, 5, 100)}
    assert [len(by_k[k]) for k in (3, 5, 100)] == [3, 5, 7] and by_k[3] < by_k[5] < by_k[100]


def test_csv_edge_rows(spark):
    path = scratch_path(spark, "edges")
    rows = [("1", 'He said "hi", then left', "x", "Positive"), ("2", "two\nlines ", None, "negative"), ("3", None, "y", "neutral")]
    df = spark.createDataFrame(rows, readers.FOUR_COLUMNS)
    writers.write_csv(df.coalesce(1), path)
    back = readers.read_four_columns(spark, path, multi_line=True)
    assert sorted(map(tuple, back.collect())) == [("Positive", 'He said "hi", then left'), ("negative", "two\nlines ")]
    pair = readers.load_pair(spark, path, path, multi_line=True)
    assert [r.textID for r in pair.train.collect()] == ["1"]
    load = lambda *extra, **options: readers.load_labelled(spark, path, True, *extra, four_columns=True, **options)
    assert [r.label for r in load().orderBy("label").collect()] == [0, 1]
    assert load(path).count() == 4
    assert [r.label for r in load(max_rows=1).collect()] == [1]


def one_file(spark, lines, name="named"):
    path = scratch_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_csv_columns_are_found_by_name(spark):
    path = one_file(spark, ["text,role,conv_id", "hello,user,1", "bye,assistant,2"])
    got = readers.read_named_columns(spark, path, "role", "text", multi_line=False)
    assert sorted(map(tuple, got.collect())) == [("assistant", "bye"), ("user", "hello")]
    wanted = readers.fields(conv_id=readers.IntegerType(), text=readers.StringType())
    rows = readers.read_by_name(spark, path, wanted, multi_line=False)
    assert rows.columns == ["conv_id", "text"] and {tuple(r) for r in rows.collect()} == {(1, "hello"), (2, "bye")}
    lacking = one_file(spark, ["conv_id,foo,bar", "1,a,b"])
    with pytest.raises(ValueError, match=r"(?s)named.*role"):
        readers.read_named_columns(spark, lacking, "role", "text", multi_line=False)
    moved = one_file(spark, ["textID,sentiment,text,selected_text", "1,positive,good,go"])
    assert [tuple(r) for r in readers.read_four_columns(spark, moved, multi_line=False).collect()] == [("positive", "good")]
    pair = readers.load_pair(spark, moved, moved, multi_line=False)
    assert pair.test.first().asDict() == {"textID": "1", "text": "good", "selected_text": "go", "sentiment": "positive"}


def test_files_of_one_input_must_agree(spark):
    path = one_file(spark, ["text,role", "hello,user"])
    spark.createDataFrame([("role,text",), ("user,hello",)], "value string").coalesce(1).write.mode("append").text(path)
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_named_columns(spark, path, "role", "text", multi_line=False).collect()


def test_refused_records_keep_their_reason(spark):
    lines = [
        '4,"1",d,q,u,"fits, with ""quotes"", commas"', '4,"2",d,q', 'x,"3",d,q,u,"no, number"', '0,"4",d,q,u,"one, more",7,8',
        '0,"5",d,q,u,""', '"6"',
    ]
    path = one_file(spark, lines, "refused")
    for multi_line in (False, True):
        got = readers.read_csv_quarantine(spark, path, readers.SIX_COLUMNS, False, multi_line)
        kept = {(r.label_raw, r.tweet_id, r.text or "") for r in got.kept.collect()}
        assert kept == {(4, "1", 'fits, with "quotes", commas'), (0, "5", "")}
        assert {(r.record.strip(), r.reason) for r in got.refused.collect()} == {
            (lines[1], "missing fields"), (lines[2], "bad value"), (lines[3], "surplus fields"), (lines[5], "missing fields"),
        }
        assert {(r.reason, r.n_rows) for r in readers.refused_counts(got.refused).collect()} == {
            ("missing fields", 2), ("bad value", 1), ("surplus fields", 1),
        }


def test_skip_malformed_lines(spark):
    lines = ["0,1,d,q,u,fine", "x,2,d,q,u,bad label", "4,3,d,q,u,too,many", "4,5,d,q,u,also fine"]
    path = one_file(spark, lines, "malformed")
    got = readers.read_six_columns(spark, path, multi_line=False, skip_malformed=True)
    assert sorted(map(tuple, got.collect())) == [(0, "fine"), (4, "also fine")]


def test_latin1_file(spark):
    path = scratch_path(spark, "latin1")
    df = spark.createDataFrame([(4, "1", "d", "q", "u", "café ñandú")], readers.SIX_COLUMNS)
    writers.write_csv(df, path, header=False, encoding=readers.SIX_COLUMN_ENCODING)
    assert readers.read_six_columns(spark, path, multi_line=False).first().text == "café ñandú"


def test_results_round_trip(spark):
    path = scratch_path(spark, "results")
    df = spark.createDataFrame([(128, 0.5, "unigram", "0.2"), (250, 0.7, "all", "1.0")], "num_hash_tables int, accuracy double, scenario string, fraction string")
    writers.write_results(df, path, ["num_hash_tables"], ["scenario", "fraction"])
    schema = df.drop("scenario", "fraction").schema
    back = readers.read_results(spark, path, schema)
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    runs = [("unigram", "0.2"), ("all", "1.0")]
    assert readers.read_results(spark, path, schema, runs).count() == 2
    with pytest.raises(ValueError, match="all.*0.2"):
        readers.read_results(spark, path, schema, [*runs, ("all", "0.2")])
    writers.write_results(df.where("false"), path, ["num_hash_tables"], ["scenario", "fraction"])
    with pytest.raises(ValueError):
        readers.read_results(spark, path, schema)


def test_best_rows(spark):
    rows = [("unigram", 0.2, 128, 50, 0.8, 2.0, None), ("unigram", 0.2, 128, 100, 0.8, 1.0, 0.5), ("all", 0.2, 250, 50, 0.9, 1.0, None)]
    df = spark.createDataFrame(rows, "scenario string, fraction double, num_hash_tables int, k int, accuracy double, training_time_sec double, evaluation_time_sec double")
    best = {r.scenario: (r.k, r.total_time_sec) for r in experiment.best_per_run(df, ("scenario", "fraction"), ["k"]).collect()}
    assert best == {"unigram": (100, 1.5), "all": (50, 1.0)}
    untimed = experiment.best_per_run(df.drop("evaluation_time_sec"), ("scenario", "fraction"), ["k"])
    assert {r.scenario: r.total_time_sec for r in untimed.collect()} == {"unigram": 1.0, "all": 1.0}
    summary = experiment.sweep_summary(df, 100)
    assert {r.scenario_label: r.sample_size for r in summary.collect()} == {"scenario1_unigram": 20, "scenario4_all": 20}
    pivot = experiment.sweep_pivot(summary, ["training_time_sec", "total_time_sec"]).collect()
    assert [tuple(r) for r in pivot] == [("total_time_sec", 0.2, 1.5, 0.0, 0.0, 1.0), ("training_time_sec", 0.2, 1.0, 0.0, 0.0, 1.0)]


def test_positions(spark):
    rows = sampling.with_position(spark.range(500).withColumnRenamed("id", "key"), "key").collect()
    assert sorted(r.position for r in rows) == list(range(1, 501))
    sizes = {f: sorted(r.key for r in rows if r.position <= 500 * f) for f in (0.2, 0.6)}
    for f, keys in sizes.items():
        part = sampling.sample_uniform(spark.range(500), int(500 * f))
        assert ids(part) == keys


def test_full_vocabulary(spark):
    docs = [(1, ["b", "a", "b"]), (2, ["c", "a"]), (3, []), (4, ["b"])]
    df = spark.createDataFrame(docs, "id int, t array<string>")
    index = vocabulary.full_index(df, F.col("t"))
    assert {r.term: r["index"] for r in index.collect()} == {"b": 0, "a": 1, "c": 2}
    found = {r.id: r.indices for r in vocabulary.full_presence(df, "id", F.col("t"), index).collect()}
    assert found == {1: [0, 1], 2: [1, 2], 4: [0]}
    kept = vocabulary.with_presence(df, "t", ["c", "b"])
    assert {r.id: list(r.indices) for r in kept.collect()} == {1: [1], 2: [0], 3: [], 4: [1]}
    with pytest.raises(ValueError):
        vocabulary.frequent_words(df, "t", vocabulary.MOST_TERMS + 1)


def test_terms_are_worked_out_once(spark):
    """A filter on the size of the exploded lists would make them a second time."""
    numbers = spark.createDataFrame([(i,) for i in range(9)], "id int")
    df = numbers.select("id", F.transform(F.sequence(F.lit(0), "id"), lambda i: (i % 3).cast("string")).alias("t"))
    counts = vocabulary.term_counts(df, F.col("t"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("transform(") == 1
    assert {r.term: r.n_uses for r in counts.collect()} == {"0": 18, "1": 15, "2": 12}
    some = spark.createDataFrame([(1, ["a", None]), (2, None), (3, [])], "id int, t array<string>")
    assert {r.term: r.n_uses for r in vocabulary.term_counts(some, F.col("t")).collect()} == {"a": 1, None: 1}


def test_full_index_in_one_shuffle_of_ranges(spark):
    docs = [(i, [f"w{j}" for j in range(i)]) for i in range(60)]
    df = spark.createDataFrame(docs + [(7, ["w1", "x"])], "id int, t array<string>").repartition(5)
    index = vocabulary.full_index(df, F.col("t"))
    assert "row_number" not in index._jdf.queryExecution().optimizedPlan().toString()
    uses = {t: sum(t in d for _, d in docs) + (t in ("w1", "x")) for _, d in [*docs, (7, ["x"])] for t in d}
    ordered = sorted(uses, key=lambda t: (-uses[t], t))
    assert {r.term: r["index"] for r in index.collect()} == {t: i for i, t in enumerate(ordered)}
    found = {r.id: r.indices for r in vocabulary.full_presence(df, "id", F.col("t"), index).collect()}
    assert found[7] == sorted({ordered.index(t) for t in [*docs[7][1], "w1", "x"]})


def test_presence_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, ["a"])], "id int, t array<string>")
    plan = vocabulary.with_presence(df, "t", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_pattern_cap_is_an_option(spark):
    words = [f"w{i * i % 23}" for i in range(200)]
    df = spark.createDataFrame([(words,)], "tokens array<string>")
    every = with_patterns(df, "tokens", "p", ["w0", "w1", "w3"]).first().p
    some = with_patterns(df, "tokens", "p", ["w0", "w1", "w3"], cap=5).first().p
    assert len(every) > 5 and some == every[:5]


def test_patterns_without_cap_are_told_apart_once(spark):
    words = [f"w{i * i % 7}" for i in range(90)]
    df = spark.createDataFrame([(words,), (["w0"],), ([],), (None,)], "tokens array<string>")
    found = with_patterns(df, "tokens", "p", ["w0", "w1", "w3"])
    assert "array_union" not in found._jdf.queryExecution().optimizedPlan().toString()
    masked = [w if w in ("w0", "w1", "w3") else "*" for w in words]
    cut = [masked[i : i + n] for n in range(C.PATTERN_MIN_N, C.PATTERN_MAX_N + 1) for i in range(len(masked) - n + 1)]
    listed = dict.fromkeys("_".join(c) for c in cut if sum(w != "*" for w in c) >= C.PATTERN_MIN_HFW)
    assert [r.p for r in found.collect()] == [list(listed), [], [], []]


def test_jobs_of_the_sweep_do_not_grow_with_its_cells(spark):
    rows = [(i, i % 2, [f"w{(i * k) % 11}" for k in range(1, 8)]) for i in range(60)]
    df = materialize(spark.createDataFrame(rows, "id bigint, label int, tokens array<string>"), "rows")
    jobs = []
    for name, fractions, scenarios in (("small", [0.5], ["unigram"]), ("large", [0.3, 0.5, 0.7, 1.0], list(C.SCENARIOS))):
        spark.sparkContext.setJobGroup(name, name)
        cells = experiment.fraction_sweep(df, scenarios, fractions, base=60, table_counts=[16], k_values=[1, 3])
        assert cells.count() == 2 * len(fractions) * len(scenarios)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] * 1.5  # adaptive execution may run a few more stages as jobs
