import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinvote.operators import forest, lsh_join, prefix_join, similarity_join as sj
from kinvote.plans import catalog, experiment
from kinvote.session import materialize


def random_rows(seed, n, hot_share=0.9):
    """Short token sets with two tokens in most rows and a third of the rows copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            words = {"hot1", "hot2", "copy"}
        else:
            words = {f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 6))}
            words |= {w for w in ("hot1", "hot2", "hot3") if rng.random() < hot_share}
            words = words or {"only"}
        rows.append((i, rng.randint(0, 2), sorted(words), rng.random() < 0.3))
    return rows


def brute(rows, threshold):
    out = {}
    for i, _, a, test in rows:
        for j, _, b, other in rows:
            if test and not other:
                inter = len(set(a) & set(b))
                union = len(set(a) | set(b))
                if inter and (union - inter) / union < threshold:
                    out[i, j] = (union - inter) / union
    return out


SCHEMA = "id bigint, label int, features array<string>, is_test boolean"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sj, "TEST_ROWS", 13)
    monkeypatch.setattr(sj, "TRAIN_ROWS", 29)


@pytest.mark.parametrize("threshold", [1.0, 0.9, 0.7, 2 / 3])
@pytest.mark.parametrize("blocks", ["small", "own"])
def test_threshold_pairs(spark, request, threshold, blocks):
    if blocks == "small":
        request.getfixturevalue("small_blocks")
    rows = random_rows(1, 150)
    got = sj.threshold_pairs(spark.createDataFrame(rows, SCHEMA), threshold).collect()
    assert len(got) == len({(r.test_id, r.train_id) for r in got})
    assert {(r.test_id, r.train_id): r.distance for r in got} == brute(rows, threshold)
    label = {r[0]: r[1] for r in rows}
    assert all(r.test_label == label[r.test_id] and r.train_label == label[r.train_id] for r in got)


@pytest.mark.parametrize("k", [1, 4, 200])
def test_topk_pairs(spark, small_blocks, k):
    for seed, hot_share in [(2, 0.9), (3, 0.3)]:
        rows = random_rows(seed, 160, hot_share)
        near = {}
        for (i, j), d in brute(rows, 0.9).items():
            near.setdefault(i, []).append((d, j))
        expected = {
            (i, j, d, n + 1) for i, js in near.items() for n, (d, j) in enumerate(sorted(js)[:k])
        }
        got = sj.topk_pairs(spark.createDataFrame(rows, SCHEMA), k, 0.9).collect()
        assert {(r.test_id, r.train_id, r.distance, r["rank"]) for r in got} == expected
        assert len(got) == len(expected)


def test_many_frequent_tokens(spark, small_blocks):
    rng = random.Random(4)
    words = [f"h{i:03d}" for i in range(200)]
    rows = [
        (i, 0, sorted(rng.sample(words, rng.randint(1, 60))), rng.random() < 0.4) for i in range(120)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.test_id, r.train_id): r.distance for r in sj.threshold_pairs(df, 0.9).collect()}
    assert got == brute(rows, 0.9)


def test_frequent_tokens_bound_no_task(spark, small_blocks):
    """One token in all rows, another in half of them: groups have a block's rows, no more."""
    rows = [(i, 0, ["all", "half", f"w{i}"][:: 1 if i % 2 else 2], i % 3 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = sj._block_counts(df)
    groups = sj._dealt(df, blocks).groupBy("tb", "rb", "is_test").count().collect()
    assert max(r["count"] for r in groups if r.is_test) < 4 * sj.TEST_ROWS
    assert max(r["count"] for r in groups if not r.is_test) < 4 * sj.TRAIN_ROWS
    got = sj.block_pairs(df, 0.9, k=2)  # a block offers a test row two rows at most
    assert got.count() <= 2 * 300 * blocks[1]


def test_candidates_stay_below_all_pairs(spark):
    rows = materialize(catalog.unigram_rows(spark, "/root/testdata/sf0.01"), "unigrams")
    tests = rows.where("is_test").count()
    pairs = sj.block_pairs(rows, 0.9).count()
    assert 0 < pairs < tests * (rows.count() - tests) / 10
    assert sj.block_pairs(rows, 0.9, k=5).count() <= 5 * tests * sj._block_counts(rows)[1]


def test_strict_threshold(spark):
    rows = [(0, 0, ["1", "2"], True), (1, 0, ["2", "3"], False), (2, 0, ["7"], False)]
    df = spark.createDataFrame(rows, SCHEMA)
    count = lambda t: sj.threshold_pairs(df, t).count()
    assert (count(1.0), count(0.7), count(2 / 3)) == (1, 1, 0)


def test_same_result_on_any_partitioning(spark, small_blocks):
    df = spark.createDataFrame(random_rows(5, 120), SCHEMA)
    results = [sorted(map(tuple, sj.topk_pairs(df.repartition(n), 5, 0.9).collect())) for n in (1, 16)]
    assert results[0] == results[1]


def test_no_training_rows(spark):
    df = spark.createDataFrame([(0, 1, ["a"], True)], SCHEMA)
    assert sj.topk_pairs(df, 3, 0.9).count() == 0
    assert lsh_join.lsh_pairs(df, 8, 0.9).count() == 0


@pytest.mark.parametrize("threshold", [0.1, 1 / 3, 0.5, 0.8])
@pytest.mark.parametrize("common, piece", [(4096, 4096), (2, 7)])
def test_prefix_pairs(spark, small_blocks, monkeypatch, threshold, common, piece):
    monkeypatch.setattr(prefix_join, "COMMON", common)
    monkeypatch.setattr(prefix_join, "PIECE", piece)
    rows = random_rows(12, 160, 0.5)
    df = materialize(spark.createDataFrame(rows, SCHEMA), "prefix-rows")
    got = prefix_join.prefix_pairs(df, threshold).collect()
    assert {(r.test_id, r.train_id): r.distance for r in got} == brute(rows, threshold)
    assert len(got) == len({(r.test_id, r.train_id) for r in got})
    label = {r[0]: r[1] for r in rows}
    assert all(r.test_label == label[r.test_id] and r.train_label == label[r.train_id] for r in got)


def test_prefix_join_of_nothing(spark):
    for rows in ([], [(0, 1, ["a"], True)], [(0, 1, ["a"], False)], [(0, 1, [], True), (1, 1, ["a"], False)]):
        assert prefix_join.prefix_pairs(spark.createDataFrame(rows, SCHEMA), 0.5).count() == 0


def test_few_candidates_beside_the_pairs(spark):
    """Scored pairs stay below three times the result, where the block join compares all."""
    rows = materialize(catalog.unigram_rows(spark, "/root/testdata/sf0.1"), "unigrams")
    for threshold in (0.3, 0.5):
        pairs = prefix_join.prefix_pairs(rows, threshold)
        exact = sj.threshold_pairs(rows, threshold)
        found, asked = pairs.count(), prefix_join.candidate_count(rows, threshold)
        assert found == exact.count() and found <= asked <= 3 * found
        assert pairs.exceptAll(exact.select(pairs.columns)).count() == 0


def forest_by_definition(rows, signatures, k, trees, around):
    """{(test, train): (distance, rank)}: candidates lie around the test row in a tree's order."""
    half, found = around // 2, {}
    for t in range(trees):
        value = lambda i: (signatures[i][4 * t : 4 * t + 4], i)
        train = sorted((i for i, _, _, test in rows if not test), key=value)
        for i in (i for i, _, _, test in rows if test):
            place = sum(value(j) < value(i) for j in train)
            found.setdefault(i, set()).update(train[max(0, place - half) : place + half])
    near, out = brute(rows, 1.0), {}
    for i, js in found.items():
        first = sorted((near[i, j], j) for j in js if (i, j) in near)[:k]
        out.update({(i, j): (d, n + 1) for n, (d, j) in enumerate(first)})
    return out


@pytest.mark.parametrize("blocks", ["small", "own"])
@pytest.mark.parametrize("k, around", [(1, 2), (6, 8), (31, 30)])
def test_forest_topk(spark, request, k, around, blocks):
    if blocks == "small":
        request.getfixturevalue("small_blocks")
    rows = random_rows(6, 150)
    df = materialize(spark.createDataFrame(rows, SCHEMA), "forest-rows")
    signatures = {r.id: list(r.signature) for r in forest.with_signature(df, 32).collect()}
    got = forest.forest_topk(df, k, [8, 32], around=around).collect()
    for n in (8, 32):
        ranked = {(r.test_id, r.train_id): (r.distance, r["rank"]) for r in got if r.num_hash_tables == n}
        assert ranked == forest_by_definition(rows, signatures, k, n // 4, around)
    assert len(got) == len({(r.num_hash_tables, r.test_id, r.train_id) for r in got})


def test_forest_runs_are_separate(spark):
    df = spark.createDataFrame(random_rows(7, 60), SCHEMA)
    small = df.where("id < 40")
    both = df.withColumn("run", F.lit("a")).unionByName(small.withColumn("run", F.lit("b")))
    got = forest.forest_topk(materialize(both, "forest-rows"), 5, [32], runs=("run",)).collect()
    for run, rows in (("a", df), ("b", small)):
        one = {tuple(r) for r in forest.forest_topk(rows, 5, [32]).collect()}
        assert {(r[0], *r[2:]) for r in got if r.run == run} == one


def test_forest_of_nothing(spark):
    for rows in ([], [(0, 1, ["a"], True)], [(0, 1, ["a"], False)], [(0, 1, [], True), (1, 1, ["a"], False)]):
        assert forest.forest_topk(spark.createDataFrame(rows, SCHEMA), 3, [8]).count() == 0


def test_places_run_on_over_ranges(spark):
    rows = random_rows(3, 400)
    entries = forest.tree_entries(spark.createDataFrame(rows, SCHEMA), 8).cache()
    listed = sorted((r.tree, r.high, r.low, r.id, r.is_test) for r in entries.collect())
    before, expected = 0, {}
    for tree, _, _, i, test in listed:
        expected[tree, i] = before
        before += not test
    assert {(r.tree, r.id): r.at for r in forest.placed(entries).collect()} == expected


@pytest.mark.parametrize("scale, least", [("0.01", 0.99), ("0.1", 0.9)])
def test_recall_of_the_forest(spark, scale, least):
    """Share found of the 50 nearest below distance 0.9."""
    rows = materialize(catalog.unigram_rows(spark, f"/root/testdata/sf{scale}"), "unigrams")
    exact = {(r.test_id, r.train_id) for r in sj.topk_pairs(rows, 50, 0.9).collect()}
    got = {(r.test_id, r.train_id) for r in forest.forest_topk(rows, 50, [128]).collect()}
    assert len(exact & got) >= least * len(exact)


@pytest.mark.parametrize("k", [2, 6, 500])
def test_lsh_topk_with_few_tables(spark, small_blocks, k):
    """With few tables many near pairs disagree everywhere and have to be left out."""
    rows = random_rows(8, 120, 0.4)
    df = spark.createDataFrame(rows, SCHEMA)
    counts = [2, 5]
    signatures = {r.id: list(r.signature) for r in forest.with_signature(df, 5).collect()}
    expected = set()
    for n in counts:
        near = {}
        for (i, j), d in brute(rows, 0.9).items():
            if any(a == b for a, b in zip(signatures[i][:n], signatures[j][:n])):
                near.setdefault(i, []).append((d, j))
        expected |= {
            (n, i, j, r + 1) for i, js in near.items() for r, (_, j) in enumerate(sorted(js)[:k])
        }
    got = experiment.lsh_topk(df, k, counts, 0.9).collect()
    assert {(r.num_hash_tables, r.test_id, r.train_id, r["rank"]) for r in got} == expected
    assert len(got) == len(expected)


@pytest.mark.parametrize("threshold", [0.9, 1.0])
@pytest.mark.parametrize("rows_per_band", [1, 2, 4])
def test_lsh_join_by_definition(spark, small_blocks, rows_per_band, threshold):
    rows = random_rows(9, 120, 0.4)
    df = spark.createDataFrame(rows, SCHEMA)
    signatures = {r.id: list(r.signature) for r in forest.with_signature(df, 16, 7).collect()}
    bands = lambda i: [tuple(signatures[i][b : b + rows_per_band]) for b in range(0, 16, rows_per_band)]
    expected = {}
    for (i, j), d in brute(rows, threshold).items():
        agreed = [n for n, (x, y) in enumerate(zip(bands(i), bands(j))) if x == y]
        if agreed:
            expected[i, j] = (d, agreed[0] + 1)
    got = lsh_join.lsh_pairs(df, 16, threshold, rows_per_band, 7).collect()
    assert {(r.test_id, r.train_id): (r.distance, r.first_band) for r in got} == expected
    assert len(got) == len(expected)


def test_recall_of_the_lsh_join(spark):
    """Of the pairs below distance 0.9: all with one hash a band, the near ones with two."""
    rows = materialize(catalog.unigram_rows(spark, "/root/testdata/sf0.01"), "unigrams")
    exact = {(r.test_id, r.train_id): r.distance for r in sj.threshold_pairs(rows, 0.9).collect()}
    one, two = (
        {(r.test_id, r.train_id) for r in lsh_join.lsh_pairs(rows, 128, 0.9, n).collect()} for n in (1, 2)
    )
    assert one <= set(exact) and len(one) >= 0.999 * len(exact)
    assert two <= one and len(two) >= 0.5 * len(exact)
    close = {p for p, d in exact.items() if d < 0.6}
    assert close <= two


def test_recall_of_the_hashed_join(spark):
    """Of the pairs of hashed features below distance 0.9: all with one hash a band, 0.9 with two and more bands."""
    folder = "/root/testdata/sf0.01"
    hashed = materialize(catalog._hashed_rows(catalog.engine_rows(spark, folder)), "hashed-exact")
    exact = {(r.test_id, r.train_id): r.distance for r in sj.threshold_pairs(hashed, 0.9).collect()}
    got = {(r.test_id, r.train_id): r.distance for r in catalog.QUERIES["lsh_join_hashed_tables"](spark, folder).collect()}
    far = {p for p, d in exact.items() if d >= 0.85}
    assert got.items() <= exact.items() and len(got) >= 0.999 * len(exact)
    assert far and len(far & got.keys()) >= 0.99 * len(far)
    two = {(r.test_id, r.train_id): r.distance for r in catalog.QUERIES["lsh_join_hashed"](spark, folder).collect()}
    assert two.items() <= exact.items() and len(two) >= 0.9 * len(exact) and len(far & two.keys()) >= 0.9 * len(far)


def test_rows_enter_one_block(spark, small_blocks):
    """However many blocks there are, a row is dealt and shuffled once."""
    rows = random_rows(10, 300)
    df = materialize(spark.createDataFrame(rows, SCHEMA), "block-rows")
    blocks = sj.block_counts(df)
    assert min(blocks) > 5 and sj._dealt(df, blocks).count() == len(rows)


@pytest.mark.parametrize(
    "join",
    [
        lambda df: sj.threshold_pairs(df, 0.9),
        lambda df: lsh_join.lsh_pairs(df, 16, 0.9),
        lambda df: prefix_join.prefix_pairs(df, 0.5),
        lambda df: sj.meet(forest.with_places(df, forest.placed(forest.tree_entries(df, 8)), 2), (3, 3), forest._matcher(4), 2, [1], ["places"]),
    ],
    ids=["exact", "lsh", "prefix", "forest"],
)
def test_candidates_are_not_shuffled(spark, small_blocks, join):
    """Block tables meet as they are read; what they find is shuffled by no one."""
    df = materialize(spark.createDataFrame(random_rows(11, 200), SCHEMA), "block-rows")
    plan = join(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_blocks_are_read_one_by_one(spark, small_blocks):
    """A file of several blocks is not decoded whole: each block is a row group."""
    df = materialize(spark.createDataFrame(random_rows(13, 300), SCHEMA), "block-rows")
    dealt = sj._dealt(df, sj.block_counts(df)).where("not is_test")
    files = sj._packed(dealt, "rb", 2, [], []).inputFiles()
    written = [pq.ParquetFile(name.removeprefix("file://")).metadata for name in files]
    assert max(m.num_rows for m in written) > 1 and all(m.num_row_groups == m.num_rows for m in written)


def test_long_rows_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK_TOKENS", 50)
    df = spark.createDataFrame([(i, 0, [f"w{j}" for j in range(i, i + 10)], i % 2 == 0) for i in range(60)], SCHEMA)
    assert sj.block_counts(df) == (6, 6)
    assert sj.threshold_pairs(df, 0.9).count() == len(brute([tuple(r) for r in df.collect()], 0.9))


def test_unlabelled_rows_meet(spark):
    df = spark.createDataFrame([(0, None, ["a"], True), (1, None, ["a", "b"], False), (2, 1, ["a"], False)], SCHEMA)
    got = sorted(tuple(r) for r in sj.topk_pairs(df, 2, 0.9).select("train_id", "test_label", "train_label").collect())
    assert got == [(1, None, None), (2, None, 1)]


class _Sets(sj._Side):
    """A block of plain sets of numbers."""

    def __init__(self, sets):
        self.id, self.label = np.arange(len(sets)), pa.array([0] * len(sets), pa.int32())
        self.size = np.array([len(s) for s in sets], np.int64)
        self.tokens = np.array([t for s in sets for t in s], np.int64)
        self.by_token, self.extra = np.argsort(self.tokens, kind="stable").astype(np.int32), {}
        self.at = np.concatenate([[0], np.cumsum(self.size)])


def drawn_sets(seed, n, words, most):
    """Sets with some tokens in nearly all of them and many in few; every ninth is small."""
    rng = random.Random(seed)
    return [
        {int(words * rng.random() ** 3) for _ in range(rng.randint(1, 4 if i % 9 == 0 else most))} for i in range(n)
    ]


@pytest.mark.parametrize("often, room", [(64, 1 << 17), (1, 1 << 17), (10**9, 1 << 17), (8, 1)])
@pytest.mark.parametrize("rows, words, most", [(1, 40, 20), (64, 300, 80), (203, 2000, 900), (700, 100, 90)])
def test_overlaps(monkeypatch, often, room, rows, words, most):
    """By bits, by lists or both, in groups or one by one, with more than 255 counted tokens a row."""
    monkeypatch.setattr(sj, "OFTEN", often)
    monkeypatch.setattr(sj, "ROOM", room)
    mine, other = drawn_sets(1, 37, words, most), drawn_sets(2, rows, words, most)
    mine[5] = {-1, -2}  # nothing in common
    overlaps, got = sj.Overlaps(_Sets(mine), _Sets(other)), {}
    for group in overlaps.groups():
        got.update(zip(group.tolist(), overlaps.of(group).tolist()))
    assert got == {i: [len(a & b) for b in other] for i, a in enumerate(mine)}


@pytest.mark.parametrize("chunk", [1, 1 << 18])
def test_near_pairs_keep_to_the_bounds(monkeypatch, chunk):
    monkeypatch.setattr(sj, "CHUNK_PAIRS", chunk)
    mine, other = drawn_sets(3, 50, 60, 30), drawn_sets(4, 130, 60, 30)
    bound = np.array([np.inf, 0.5, 2 / 3, 0.0, 0.8] * 10)
    got = {}
    for found in sj.near_pairs(_Sets(mine), _Sets(other), 0.9, bound):
        got.update(zip(zip(found["i"].tolist(), found["j"].tolist()), found["distance"].tolist()))
    near = {(i, j): (len(a | b) - len(a & b)) / len(a | b) for i, a in enumerate(mine) for j, b in enumerate(other)}
    assert got == {p: d for p, d in near.items() if d < 0.9 and d <= bound[p[0]]}


def test_many_test_rows_share_an_index(spark):
    """Beyond a block for every task, test rows lie in large blocks: each pair of blocks costs an index."""
    df = spark.range(12000).selectExpr("id", "0 label", "array(string(id % 97)) features", "id % 6 > 0 is_test")
    tests, trains = sj.block_counts(df)
    assert trains == 1 and tests == 10000 // sj.EVEN_ROWS
    many = spark.range(80000).selectExpr("id", "0 label", "array(string(id % 97)) features", "id % 2 = 0 is_test")
    tests, trains = sj.block_counts(many)
    assert trains == 5 and tests <= 10


def test_columns_that_no_one_reads_stay_in_the_join(spark):
    df = spark.createDataFrame(random_rows(14, 90), SCHEMA)
    for join in (
        lambda *names: sj.threshold_pairs(df, 0.9, *names),
        lambda *names: lsh_join.lsh_pairs(df, 16, 0.9, 1, 42, *names),
    ):
        whole, two = join(), join(["train_id", "test_id"])
        assert two.columns == ["train_id", "test_id"] and whole.count()
        assert sorted(map(tuple, two.collect())) == sorted(map(tuple, whole.select("train_id", "test_id").collect()))
