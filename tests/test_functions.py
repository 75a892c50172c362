import random
import zlib
from collections import Counter

import pytest
from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from kinvote import constants as C
from kinvote.functions import cleaning, hashing, patterns, tokens
from kinvote.operators import vocabulary

TEXTS = [
    "RT @bob: I LOVE #Spark! see https://t.co/ab12 now",
    "Tom &amp; Jerry aren't 2 bad &lt;3 &quot;ok&quot;",
    "www.foo.com/x?y=1 it&#39;s   fine",
    "Café à Paris 100%",
    "@@@ !!! ...",
    "",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)


def column(df, expr, order="id"):
    return [r[0] for r in df.orderBy(order).select(expr).collect()]


@pytest.mark.parametrize(
    "cleaner, expected",
    [
        (
            cleaning.clean_letters,
            ["rt bob i love spark see now", "tom amp jerry aren t bad lt quot ok quot", "it s fine", "caf paris", "", ""],
        ),
        (
            cleaning.clean_social,
            ["i love spark see now", "tom and jerry aren't 2 bad 3 ok", "it's fine", "caf paris 100", "", ""],
        ),
        (
            cleaning.clean_alnum,
            ["rt bob i love spark see now", "tom amp jerry aren t 2 bad lt 3 quot ok quot", "it 39 s fine", "caf paris 100", "", ""],
        ),
    ],
)
def test_cleaners(texts, cleaner, expected):
    assert column(texts, cleaner(F.col("text"))) == expected


def test_match_tokens(texts):
    assert column(texts, tokens.match_tokens(F.col("text"), [])) == [
        ["rt", "@bob", "i", "love", "#spark", "see", "now"],
        ["tom", "jerry", "aren't", "bad", "ok"],
        ["www", "foo", "com", "x", "y", "it", "#39", "s", "fine"],
        ["caf", "paris"],
        ["@@@"],
        [],
    ]
    assert column(texts, tokens.tokenize_match(F.col("text"), ["bad", "it"]))[1:3] == [
        ["tom", "jerry", "aren't", "ok"],
        ["www", "foo", "com", "x", "y", "#39", "s", "fine"],
    ]


def test_stop_word_list_is_sparks(spark):
    assert C.ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_tokenizers_equal_spark_ml(spark):
    rows = ["it's ' #a @b __ 12", "", "  ", "a  b ", " Lead", "x\ny\tz", "É b"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    ws = Tokenizer(inputCol="text", outputCol="ml").transform(df)
    assert column(ws, tokens.tokenize_ws(F.col("text"))) == column(ws, "ml")
    gaps = RegexTokenizer(inputCol="text", outputCol="ml", pattern=C.GAP_PATTERN).transform(df)
    assert column(gaps, tokens.tokenize_gaps(F.col("text"))) == column(gaps, "ml")
    assert column(gaps, "ml")[0] == ["it's", "'", "#a", "@b", "__", "12"]


def test_stop_words_and_ngrams_equal_spark_ml(spark):
    lists = [["The", "a", "cat", "cat", "I'm"], ["a"], [], ["x", "y", "z"], ["b\\s", "it's", "it"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, t array<string>")
    words = C.EXTENDED_STOP_WORDS + ["b\\s"]
    removed = StopWordsRemover(inputCol="t", outputCol="ml", stopWords=words).transform(df)
    assert column(removed, tokens.remove_stop_words(F.col("t"), words)) == column(removed, "ml")
    grams = NGram(n=2, inputCol="t", outputCol="ml").transform(df)
    assert column(grams, tokens.ngrams(F.col("t"), 2)) == column(grams, "ml")
    assert column(df, tokens.sequence_grams(F.col("t"), 1)) == [[]] * 5
    assert column(df, tokens.sequence_grams(F.col("t"), 3))[3] == ["x_y_z"]


def test_scenario_features(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", ""],)], "t array<string>")
    take = lambda s, v=(): df.select(tokens.scenario_features(F.col("t"), s, vocabulary=v)).first()[0]
    assert take("unigram") == ["a", "b"]
    assert take("bigram") == ["a_b", "b_a", "b_"]
    assert take("patterns") == ["a_b_a", "b_a_b", "a_b_"]  # no vocabulary keeps everything
    assert take("patterns", ["b_a_b"]) == ["b_a_b"]
    assert take("all", ["b_a_b"]) == ["a", "b", "a_b", "b_a", "b_", "b_a_b"]


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(tokens.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]


def plain_patterns(words, frequent, lo, hi, least, cap):
    stream = [w if w in frequent else "*" for w in words]
    found = {}
    for n in range(lo, hi + 1):
        for i in range(len(stream) - n + 1):
            window = stream[i : i + n]
            if n - window.count("*") >= least:
                found.setdefault("_".join(window))
    return list(found)[:cap]  # None: all


def test_patterns_equal_definition(spark):
    rng = random.Random(7)
    words = ["i", "love", "and", "x", "y", "z", "q's"]
    lists = [[rng.choice(words) for _ in range(rng.choice([0, 2, 3, 5, 9, 40, 90]))] for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, t array<string>")
    frequent = ["i", "love", "and", "q's"]
    for lo, hi, least, cap in [(3, 6, 2, None), (2, 3, 1, 10), (3, 6, 2, 5)]:
        out = patterns.with_patterns(df, "t", "p", frequent, lo, hi, least, cap)
        assert column(out, "p") == [plain_patterns(w, frequent, lo, hi, least, cap) for w in lists]
    fixed = spark.createDataFrame([("i love * * and i love *".split(),)], "t array<string>")
    got = patterns.with_patterns(fixed, "t", "p", frequent).first()["p"]
    assert len(got) == 15
    assert got[:5] == ["i_love_*", "*_and_i", "and_i_love", "i_love_*_*", "love_*_*_and"]


def test_bloom_equals_zlib(spark):
    rng = random.Random(3)
    alphabet = "abcé漢😀_#"
    lists = [
        ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 30))]
        for _ in range(60)
    ]
    lists += [["good", "café"], ["good", "good"], [], ["x" * 100000]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, t array<string>")

    def bits(words, size, hashes):
        out = set()
        for w in words:
            raw = w.encode()
            out |= {(zlib.crc32(raw) + i * zlib.adler32(raw)) % size for i in range(hashes)}
        return sorted(out)

    for size, hashes in [(64, 3), (32768, 5)]:
        got = column(df, hashing.bloom_indices(F.col("t"), size, hashes))
        assert got == [bits(w, size, hashes) for w in lists]
    assert bits(["good", "café"], 64, 3) == [12, 18, 35, 38, 53, 60]


def test_minhash_equals_definition(spark):
    import hashlib

    rng = random.Random(5)
    lists = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([0, 1, 3, 50]))] for _ in range(80)]
    lists.append([f"long{i}" for i in range(40000)])  # more than one chunk
    df = spark.createDataFrame(list(enumerate(lists)), "id int, t array<string>").repartition(3)
    a, b = hashing.coefficients(16)
    x = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    expected = [
        [min(((1 + x(w)) * aj + bj) % hashing.PRIME for w in ws) for aj, bj in zip(a, b)] if ws else []
        for ws in lists
    ]
    assert column(df, hashing.minhash_signature(F.col("t"), 16)) == expected
    # a signature with fewer hashes is a prefix of one with more
    short = column(df, hashing.minhash_signature(F.col("t"), 8))
    assert short == [s[:8] for s in expected]


def test_vocabulary_and_assembly(spark):
    df = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b", "c"]), (2, [])], "id int, t array<string>")
    top = vocabulary.top_terms(df, F.col("t"), 2)
    assert [(r.term, r.n_uses) for r in top.collect()] == [("a", 2), ("b", 2)]
    got = vocabulary.with_presence(df, "t", vocabulary.term_list(df, "t", 2))
    assert column(got, "indices") == [[0, 1], [1], []]
    both = vocabulary.assemble([(F.col("indices"), 2), (F.col("indices"), 2)])
    assert column(got, both) == [[0, 1, 2, 3], [1, 3], []]


@pytest.mark.parametrize("capacity", [3, 20, 1 << 16])
def test_heavy_terms_are_the_top_terms(spark, capacity):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, rng.choices(words, weights, k=rng.randint(0, 40))) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None), (901, [None, "w0"])], "id int, t array<string>").repartition(5)
    for n in (1, 7, 400):
        want = [tuple(r) for r in vocabulary.top_terms(df, F.filter("t", lambda x: x.isNotNull()), n).collect()]
        assert [tuple(r) for r in vocabulary.heavy_terms(df, F.col("t"), n, capacity).collect()] == want
    assert vocabulary.heavy_terms(df.limit(0), F.col("t"), 3).count() == 0


def test_summaries_keep_their_bound(spark):
    """What a summary says of a term is at most what occurs, and short of it by ``missed`` at most."""
    rng = random.Random(9)
    rows = [(i % 3, rng.choices([f"w{i}" for i in range(500)], [1 / (i + 1) for i in range(500)], k=30)) for i in range(900)]
    for part in range(3):
        df = spark.createDataFrame([r for r in rows if r[0] == part], "p int, t array<string>").coalesce(1)
        true = Counter(w for p, t in rows if p == part for w in t)
        got = vocabulary.summaries(df, F.col("t"), 40).collect()
        missed = next(r.missed for r in got if r.term is None)
        kept = {r.term: r.n for r in got if r.term is not None}
        assert len(kept) <= 40 and 0 < missed <= sum(true.values()) / 40
        assert all(n <= true[t] <= n + missed for t, n in kept.items())
        assert all(c <= missed for t, c in true.items() if t not in kept)


def test_bloom_takes_some_words_at_a_time(monkeypatch):
    """What is held beside a batch does not follow the batch's size."""
    import pyarrow as pa

    seen, real = [], hashing._adler32
    monkeypatch.setattr(hashing, "_adler32", lambda flat: seen.append(len(flat)) or real(flat))
    lists = [[f"w{i}-{j}" for j in range(i % 7)] for i in range(20000)] + [None, [], ["a"] * 40000]
    crcs = [None if ws is None else [zlib.crc32(w.encode()) for w in ws] for ws in lists]
    got = hashing.bloom_udf(64, 3).func(pa.array(lists, pa.list_(pa.string())), pa.array(crcs, pa.list_(pa.int64())))
    want = lambda ws: sorted({(zlib.crc32(w.encode()) + i * zlib.adler32(w.encode())) % 64 for w in ws for i in range(3)})
    assert got.to_pylist() == [None if ws is None else want(ws) for ws in lists]
    assert sorted(seen)[-2] <= 1 << 14 and max(seen) == 40000  # the one long row stays whole


def test_heavy_terms_move_no_uses(spark):
    """A term that all rows have is counted where it is read: no shuffle or sort of its uses."""
    rows = [(i, ["all", "all", f"w{i % 50}"]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, t array<string>").repartition(4)
    plan = vocabulary.heavy_terms(df, F.col("t"), 1, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "strategy=broadcast" in plan


def test_heavy_terms_of_even_counts(spark, monkeypatch):
    """Terms too many and too alike for summaries are counted, all of them."""
    monkeypatch.setattr(vocabulary, "MOST_TERMS", 64)
    df = spark.createDataFrame([(i, [f"w{i:04d}", None]) for i in range(900)] + [(901, ["w0007"])], "id int, t array<string>").coalesce(2)
    got = vocabulary.heavy_terms(df, F.col("t"), 3, 16).collect()
    assert [tuple(r) for r in got] == [("w0007", 2), ("w0000", 1), ("w0001", 1)]


def test_sequence_vocabulary_is_summarised(spark, monkeypatch):
    """All different sequences are in no task's memory: they come from ``heavy_terms``."""
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["b", "c"],), (["x", "y"],)], "t array<string>")
    seen, real = [], vocabulary.heavy_terms
    monkeypatch.setattr(vocabulary, "heavy_terms", lambda *a: seen.append(a) or real(*a))
    assert vocabulary.sequence_vocabulary(df, "t", 2, 2) == ["a_b", "b_c"] and len(seen) == 1
