"""Registered queries: every operator, run over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from .. import constants as C
from ..functions import cleaning, hashing, patterns, tokens
from ..operators import forest, labels, lsh_join, ml_stages, prefix_join, sampling, similarity_join, vocabulary, votes
from ..session import materialize, scratch_path
from ..sources import readers, writers
from . import experiment, features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUSTOM_STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "que", "de", "la", "und", "der"]
BLOOM_BITS, BLOOM_HASHES = 32768, 3
SIGNATURE_HASHES = 128
WELL_COMPRESSED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
LSH_COLUMNS = ["test_id", "train_id", "distance", "first"]
BAND_HASHES, ROWS_PER_BAND = 512, 2  # 256 bands: 92 % of the pairs at similarity 0.1, 97 % at 0.12


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def labelled(spark, sf_dir, keep_unlabelled: bool = False) -> DataFrame:
    """``id, text, quality, raw_label, word_label`` of the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels")
    joined = docs.join(marks, "doc_id", "left" if keep_unlabelled else "inner")
    raw = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 4).when(F.col("quality") == 0, 2)
    word = F.when(raw == 0, "Negative").when(raw == 2, "neutral").when(raw == 4, "POSITIVE")
    return joined.select(
        F.col("doc_id").alias("id"),
        "text",
        "quality",
        raw.cast("int").alias("raw_label"),
        word.alias("word_label"),
    )


def engine_rows(spark, sf_dir, classes: dict | None = None) -> DataFrame:
    """Main engine input: cleaned, de-duplicated, split; ``id, label, is_test, tokens``.

    ``classes``: recode the raw label (rows without a class go); else the label is ``quality``.
    """
    rows = labelled(spark, sf_dir).select(
        "id",
        F.col("raw_label" if classes else "quality").alias("label"),
        cleaning.clean_social(F.col("text")).alias("text_clean"),
    )
    if classes:
        rows = labels.recode_labels(rows, classes)
    kept = sampling.split_random(sampling.dedupe(rows, "text_clean"))
    listed = tokens.remove_stop_words(
        tokens.tokenize_gaps(F.col("text_clean")), C.EXTENDED_STOP_WORDS
    )
    return materialize(kept.select("id", "label", "is_test", listed.alias("tokens")), "engine")


def unigram_rows(spark, sf_dir) -> DataFrame:
    return features.engine_features(engine_rows(spark, sf_dir), 1)


def harness_rows(spark, sf_dir) -> DataFrame:
    """Second path input: raw-text duplicates dropped, non-empty token lists."""
    rows = labelled(spark, sf_dir).select("id", F.col("quality").alias("label"), "text")
    listed = tokens.tokenize_match(F.col("text"), CUSTOM_STOP_WORDS + C.PLATFORM_STOP_WORDS)
    kept = sampling.dedupe(rows, "text").select("id", "label", listed.alias("tokens"))
    return labels.keep_nonempty(materialize(kept, "harness"), "tokens")


def document_tokens(spark, sf_dir) -> DataFrame:
    """``id, tokens`` of all documents, written once for plans that read it repeatedly."""
    rows = documents(spark, sf_dir).select("id", tokens.social_tokens(F.col("text")).alias("tokens"))
    return materialize(rows, "tokens")


def joined(col, sep: str = " ", name: str = "tokens"):
    """Array as one string: a value both engines compare alike."""
    strings = F.transform(col, lambda t: t.cast("string"))
    return F.array_join(strings, sep).alias(name)


# ---------------------------------------------------------------- sources


def _six_column_csv(spark, sf_dir, label) -> str:
    path = scratch_path(spark, "six_columns")
    rows = labelled(spark, sf_dir).select(
        label.alias("label_raw"),
        F.col("id").cast("string").alias("tweet_id"),
        F.lit("Mon Apr 06 22:19:45 2009").alias("date"),
        F.lit("NO_QUERY").alias("query"),
        F.concat(F.lit("user"), F.col("id").cast("string")).alias("user"),
        "text",
    )
    writers.write_csv(rows, path, header=False, encoding=readers.SIX_COLUMN_ENCODING)
    return path


def _four_column_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "four_columns")
    # the longest line stands for the selected phrase; the columns are not in the reader's order
    lines = F.split("text", "\n")
    longest = F.array_max(F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))
    rows = labelled(spark, sf_dir).select(
        F.col("word_label").alias("sentiment"),
        F.when(F.col("raw_label") != 2, longest["line"]).alias("selected_text"),
        F.col("id").cast("string").alias("textID"),
        "text",
    )
    writers.write_csv(rows, path)
    return path


@query
def src_csv_fixed(spark, sf_dir):
    path = _six_column_csv(spark, sf_dir, F.col("raw_label"))
    return readers.load_labelled(spark, path, multi_line=True, vocabulary=C.NUMERIC_TERNARY)


@query
def src_csv_header(spark, sf_dir):
    path = _four_column_csv(spark, sf_dir)
    return readers.load_labelled(spark, path, True, four_columns=True, vocabulary=C.WORD_TERNARY)


@query
def src_named_columns(spark, sf_dir):
    path = scratch_path(spark, "named")
    writers.write_csv(table(spark, sf_dir, "conversations").select("text", "turn", "role", "conv_id"), path)
    return readers.read_named_columns(spark, path, "role", "text", multi_line=True)


@query
def src_pair_dropna(spark, sf_dir):
    path = _four_column_csv(spark, sf_dir)
    pair = readers.load_pair(spark, path, path, multi_line=True)
    return pair.train.withColumn("part", F.lit("train")).unionByName(
        pair.test.withColumn("part", F.lit("test"))
    )


@query
def src_skip_malformed(spark, sf_dir):
    label = F.when(F.col("raw_label") == 2, F.lit("n/a")).otherwise(F.col("raw_label").cast("string"))
    path = _six_column_csv(spark, sf_dir, label)
    return readers.read_six_columns(spark, path, multi_line=True, skip_malformed=True)


def _uneven_lines(spark, sf_dir) -> str:
    """Six-column lines of all documents, many of which do not fit their schema.

    Neutral labels are no number, negative ones have a seventh field, unlabelled lines two.
    """
    path = scratch_path(spark, "uneven")
    dialect = {"quote": '"', "escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    raw = F.col("raw_label")
    first = F.when(raw == 2, F.lit("n/a")).otherwise(raw.cast("string"))
    parts = [F.col("id").cast("string"), F.lit("date"), F.lit("query"), F.lit("user"), F.coalesce("text", F.lit(""))]
    line = lambda columns: F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), dialect)
    lines = F.when(raw.isNull(), line(parts[-1:] + parts[:1])).when(raw == 0, line([first, *parts, parts[0]])).otherwise(line([first, *parts]))
    labelled(spark, sf_dir, True).select(lines.alias("value")).write.text(path)
    return path


@query
def src_quarantine(spark, sf_dir):
    """Rows that fit their schema, and how many records were refused for which reason."""
    path = _uneven_lines(spark, sf_dir)
    parsed = readers.read_csv_quarantine(spark, path, readers.SIX_COLUMNS, False, multi_line=True)
    kept = parsed.kept.select(F.lit("kept").alias("outcome"), "label_raw", "text", F.lit(1).cast("bigint").alias("n_rows"))
    counts = readers.refused_counts(parsed.refused)
    nothing = [F.lit(None).cast("int").alias("label_raw"), F.lit(None).cast("string").alias("text")]
    return kept.unionByName(counts.select(F.col("reason").alias("outcome"), *nothing, "n_rows"))


@query
def src_row_cap(spark, sf_dir):
    rows = labels.project_label_text(labelled(spark, sf_dir, True), "raw_label", "text", "id")
    capped = sampling.row_cap(rows, 100)
    return labels.recode_labels(capped, C.NUMERIC_BINARY)


RESULT_SCHEMA = readers.fields(
    num_hash_tables=IntegerType(),
    k=IntegerType(),
    accuracy=DoubleType(),
    avg_candidates=DoubleType(),
    neighbor_pairs=LongType(),
    n_fallback=LongType(),
    test_size=LongType(),
    train_size=LongType(),
    train_rows_m=DoubleType(),
    pairs_m=DoubleType(),
    scenario=StringType(),
    fraction=StringType(),
)


def _sweep(spark, sf_dir) -> tuple[DataFrame, int]:
    """Cells of the whole sweep, and the rows that fraction 1 stands for."""
    rows = harness_rows(spark, sf_dir)
    base = rows.count()
    return experiment.fraction_sweep(rows, base=base), base


# what a run costs, in place of seconds, which no two runs share: rows indexed and pairs read
COSTS = ("train_rows_m", "pairs_m")


def _with_costs(results: DataFrame) -> DataFrame:
    """Rows indexed and neighbour pairs read, in millions."""
    return materialize(
        results.withColumn("train_rows_m", F.col("train_size") / F.lit(1e6)).withColumn(
            "pairs_m", F.col("neighbor_pairs") / F.lit(1e6)
        ),
        "results",
    )


@query
def src_results_partitioned(spark, sf_dir):
    path = scratch_path(spark, "runs")
    results = _with_costs(_sweep(spark, sf_dir)[0])
    results = results.withColumn("fraction", F.col("fraction").cast("string"))
    writers.write_results(results, path, ["num_hash_tables", "k"], ["scenario", "fraction"])
    columns = [f for f in results.columns if f not in ("scenario", "fraction")]
    schema = StructType([RESULT_SCHEMA[c] for c in columns])
    runs = [(scenario, str(f)) for scenario in C.SCENARIOS for f in C.FRACTIONS]
    return readers.read_results(spark, path, schema, runs).select(RESULT_SCHEMA.names)


# ---------------------------------------------------------------- sinks


@query
def sink_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "features_out")
    rows = labelled(spark, sf_dir).select(
        F.col("quality").alias("label"), cleaning.clean_letters(F.col("text")).alias("text_clean")
    )
    model = ml_stages.featurise_pipeline().fit(rows)
    writers.write_features(model.transform(rows), path)
    back = spark.read.parquet(path)
    return back.select("label", ml_stages.vector_entries(F.col("features")).alias("entries"))


@query
def sink_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "clean_csv")
    rows = documents(spark, sf_dir).select("id", cleaning.clean_alnum(F.col("text")).alias("text"))
    writers.write_csv(rows, path, single_file=False)
    back = readers.read_csv(
        spark, path, StructType.fromDDL("id bigint, text string"), header=True, multi_line=False
    )
    return back.fillna("", subset=["text"])


@query
def sink_csv_single_file(spark, sf_dir):
    """The cleaned labelled texts as one file, read back by name with the file's row count.

    Join and cleaning run in parallel; only the copy into the one file is a single task, which
    reads well compressed parts.
    """
    path = scratch_path(spark, "one_csv")
    rows = labelled(spark, sf_dir).select(
        "id", cleaning.clean_alnum(F.col("text")).alias("text"), F.col("quality").alias("label")
    )
    writers.write_csv(materialize(rows, "one-csv", WELL_COMPRESSED), path, single_file=True)
    schema = StructType.fromDDL("label int, id bigint, text string")
    back = readers.read_by_name(spark, path, schema, multi_line=False).fillna("", subset=["text"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return back.withColumn("n_files", F.lit(files.select("path").count()))


def _cells(spark, sf_dir) -> DataFrame:
    """Every cell of the engine's grid, two classes and three."""
    grids = [
        experiment.knn_grid(engine_rows(spark, sf_dir, classes), use_neutral=neutral)
        for neutral, classes in ((False, C.NUMERIC_BINARY), (True, C.NUMERIC_TERNARY))
    ]
    return materialize(grids[0].unionByName(grids[1]), "cells")


@query
def sink_results(spark, sf_dir):
    path = scratch_path(spark, "results_out")
    cells = _cells(spark, sf_dir)
    writers.write_results(cells, path, ["num_hash_tables", "k"], ["scenario"])
    schema = StructType([f for f in cells.schema.fields if f.name != "scenario"])
    return spark.read.schema(schema.add("scenario", IntegerType())).option("header", True).csv(path)


@query
def sink_signature_sample(spark, sf_dir):
    path = scratch_path(spark, "signatures")
    rows = harness_rows(spark, sf_dir).withColumnRenamed("tokens", "features")
    writers.write_signature_sample(rows, 3, SIGNATURE_HASHES, path)
    schema = StructType.fromDDL("key bigint, tokens array<string>, signature array<int>, label int")
    back = spark.read.schema(schema).json(path)
    return back.select(
        "label", "key", joined("tokens"), joined("signature", ",", "signature")
    )


# ---------------------------------------------------------------- projections and filters


@query
def project_label_text(spark, sf_dir):
    return labels.project_label_text(labelled(spark, sf_dir, True), "word_label", "text", "id")


def _recoded(spark, sf_dir, column, mapping):
    rows = labelled(spark, sf_dir, True).select("id", F.col(column).alias("label"))
    return labels.recode_labels(rows, mapping)


@query
def recode_numeric_binary(spark, sf_dir):
    return _recoded(spark, sf_dir, "raw_label", C.NUMERIC_BINARY)


@query
def recode_numeric_ternary(spark, sf_dir):
    return _recoded(spark, sf_dir, "raw_label", C.NUMERIC_TERNARY)


@query
def recode_word_binary(spark, sf_dir):
    return _recoded(spark, sf_dir, "word_label", C.WORD_BINARY)


@query
def recode_word_ternary(spark, sf_dir):
    return _recoded(spark, sf_dir, "word_label", C.WORD_TERNARY)


@query
def recode_keep_unmapped(spark, sf_dir):
    rows = labelled(spark, sf_dir, True)
    return rows.select("id", labels.recode_keep(F.col("raw_label"), C.NUMERIC_BINARY).alias("label"))


@query
def project_features(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(
        F.col("id").alias("row_id"),
        F.col("quality").alias("label"),
        cleaning.clean_letters(F.col("text")).alias("text_clean"),
    )
    out = ml_stages.featurise_pipeline().fit(rows).transform(rows)
    plain = out.select("row_id", "label", ml_stages.without_attributes("features"))
    return plain.select("row_id", "label", ml_stages.vector_entries(F.col("features")).alias("entries"))


@query
def drop_null_subset(spark, sf_dir):
    return labelled(spark, sf_dir, True).dropna(subset=["word_label", "text"]).select("id", "word_label")


@query
def filter_nonempty_features(spark, sf_dir):
    # trigrams: texts of fewer than three tokens have none
    rows = document_tokens(spark, sf_dir).select("id", tokens.ngrams(F.col("tokens"), 3).alias("features"))
    return labels.keep_nonempty(materialize(rows, "grams"), "features").select(
        "id", F.size("features").cast("bigint").alias("n_features")
    )


@query
def check_two_classes(spark, sf_dir):
    return labels.class_check(labelled(spark, sf_dir), "raw_label")


# ---------------------------------------------------------------- text and tokens


def _cleaned(cleaner) -> Query:
    return lambda spark, sf_dir: documents(spark, sf_dir).select(
        "id", cleaner(F.col("text")).alias("text_clean")
    )


QUERIES["clean_letters"] = _cleaned(cleaning.clean_letters)
QUERIES["clean_social"] = _cleaned(cleaning.clean_social)
QUERIES["clean_alnum"] = _cleaned(cleaning.clean_alnum)
QUERIES["clean_ascii"] = _cleaned(cleaning.clean_ascii)


def _token_query(spark, sf_dir, listed) -> DataFrame:
    rows = documents(spark, sf_dir).select("id", listed.alias("list"))
    return rows.select("id", joined("list"), F.size("list").cast("bigint").alias("n_tokens"))


@query
def tokenize_ws(spark, sf_dir):
    return _token_query(spark, sf_dir, tokens.tokenize_ws(cleaning.clean_letters(F.col("text"))))


@query
def tokenize_regex(spark, sf_dir):
    return _token_query(spark, sf_dir, tokens.tokenize_gaps(cleaning.clean_social(F.col("text"))))


@query
def tokenize_match(spark, sf_dir):
    return _token_query(spark, sf_dir, tokens.match_tokens(F.col("text"), C.PLATFORM_STOP_WORDS))


@query
def stopwords_default(spark, sf_dir):
    listed = tokens.tokenize_ws(cleaning.clean_letters(F.col("text")))
    return _token_query(spark, sf_dir, tokens.remove_stop_words(listed, C.ENGLISH_STOP_WORDS))


@query
def stopwords_extended(spark, sf_dir):
    return _token_query(spark, sf_dir, tokens.social_tokens(F.col("text")))


@query
def stopwords_custom(spark, sf_dir):
    words = CUSTOM_STOP_WORDS + C.PLATFORM_STOP_WORDS
    return _token_query(spark, sf_dir, tokens.match_tokens(F.col("text"), words))


@query
def tokens_dedupe(spark, sf_dir):
    listed = tokens.tokenize_gaps(cleaning.clean_social(F.col("text")))
    return _token_query(spark, sf_dir, tokens.dedupe_tokens(listed))


@query
def ngram_bigram(spark, sf_dir):
    rows = documents(spark, sf_dir).select("id", tokens.social_tokens(F.col("text")).alias("t"))
    grams = rows.select("id", tokens.ngrams(F.col("t"), 2).alias("list"))
    return grams.select("id", joined("list", "|"), F.size("list").cast("bigint").alias("n_tokens"))


@query
def ngram_n(spark, sf_dir):
    rows = documents(spark, sf_dir).select("id", tokens.social_tokens(F.col("text")).alias("t"))
    grams = rows.select("id", tokens.sequence_grams(F.col("t"), 4).alias("list"))
    return grams.select("id", joined("list", "|"), F.size("list").cast("bigint").alias("n_tokens"))


@query
def mask_rare_words(spark, sf_dir):
    rows = document_tokens(spark, sf_dir)
    words = vocabulary.frequent_words(rows, "tokens", C.HFW_TOP_N)
    masked = rows.select("id", patterns.mask_rare_words(F.col("tokens"), words).alias("list"))
    return masked.select("id", joined("list"), F.size("list").cast("bigint").alias("n_tokens"))


@query
def hfw_patterns(spark, sf_dir):
    rows = features.with_frequent_patterns(document_tokens(spark, sf_dir))
    return rows.select(
        "id", joined("patterns", name="patterns"), F.size("patterns").cast("bigint").alias("n_patterns")
    )


@query
def pattern_vocab_filter(spark, sf_dir):
    rows = document_tokens(spark, sf_dir)
    words = vocabulary.sequence_vocabulary(rows, "tokens", 2)
    kept = tokens.keep_vocabulary(tokens.sequence_grams(F.col("tokens"), 2), words)
    return rows.select("id", kept.alias("list")).select("id", joined("list"))


def _features_query(scenario: str) -> Query:
    def run(spark, sf_dir):
        rows = documents(spark, sf_dir).select(
            "id", tokens.tokenize_match(F.col("text"), C.PLATFORM_STOP_WORDS).alias("tokens")
        )
        out = features.harness_features(materialize(rows, "match_tokens"), scenario)
        return out.select(
            "id",
            joined("features", name="features"),
            F.size("features").cast("bigint").alias("n_features"),
        )

    return run


for _scenario in C.SCENARIOS:
    QUERIES[f"features_{_scenario}"] = _features_query(_scenario)


@query
def jaccard_pair(spark, sf_dir):
    """Similarity of neighbouring turns of each conversation."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_distinct(tokens.tokenize_gaps(F.col("text"))).alias("t")
    )
    order = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("u", F.lead("t").over(order)).withColumn("after", F.lead("turn").over(order))
    return both.where(F.col("after") == F.col("turn") + 1).select(
        "conv_id", "turn", tokens.jaccard(F.col("t"), F.col("u")).alias("similarity")
    )


# ---------------------------------------------------------------- vectors


def _vector_query(spark, sf_dir, pipeline, cleaner) -> DataFrame:
    rows = labelled(spark, sf_dir).select(
        "id", F.col("quality").alias("label"), cleaner(F.col("text")).alias("text_clean")
    )
    out = pipeline.fit(rows).transform(rows)
    plain = out.select("id", "label", ml_stages.without_attributes("features"))
    return plain.select("id", "label", ml_stages.vector_entries(F.col("features")).alias("entries"))


@query
def hashing_tf_counts(spark, sf_dir):
    pipeline = ml_stages.featurise_pipeline()
    return _vector_query(spark, sf_dir, pipeline, cleaning.clean_letters)


@query
def hashing_tf_binary(spark, sf_dir):
    return _vector_query(spark, sf_dir, ml_stages.experiment_pipeline(1), cleaning.clean_social)


@query
def count_vectorizer(spark, sf_dir):
    rows = document_tokens(spark, sf_dir)
    terms = vocabulary.term_list(rows, "tokens")
    return vocabulary.with_presence(rows, "tokens", terms).select("id", joined("indices", ",", "indices"))


@query
def assemble_blocks(spark, sf_dir):
    """Presence of every token and every bigram of the corpus, side by side."""
    rows = document_tokens(spark, sf_dir)
    blocks = {"tokens": F.col("tokens"), "bigrams": tokens.ngrams(F.col("tokens"), 2)}
    out, parts = rows.select("id"), []
    for name, terms in blocks.items():
        index = materialize(vocabulary.full_index(rows, terms), f"{name}_index")
        found = vocabulary.full_presence(rows, "id", terms, index, f"{name}_indices")
        out = out.join(found, "id", "left")
        listed = F.coalesce(f"{name}_indices", F.expr("cast(array() as array<bigint>)"))
        parts.append((listed, index.count()))
    return out.select("id", joined(vocabulary.assemble(parts), ",", "indices"))


@query
def bloom_indices(spark, sf_dir):
    rows = documents(spark, sf_dir).select("id", tokens.social_tokens(F.col("text")).alias("tokens"))
    bits = hashing.bloom_indices(F.col("tokens"), BLOOM_BITS, BLOOM_HASHES)
    return rows.select("id", bits.alias("bits")).select("id", joined("bits", ",", "indices"))


@query
def bloom_vs_hashing(spark, sf_dir):
    """The same classifier on hashed presence and on Bloom presence features."""
    rows = engine_rows(spark, sf_dir)
    bits = hashing.bloom_indices(F.col("tokens"), C.HASH_BUCKETS, BLOOM_HASHES)
    bloom = rows.select(
        "id", "label", "is_test", F.transform(bits, lambda i: i.cast("string")).alias("features")
    )
    out = None
    for kind, df in {"hashing": _hashed_rows(rows), "bloom": bloom}.items():
        feats = materialize(df, kind)
        one = experiment.knn_evaluate(labels.keep_nonempty(feats, "features"), 50)
        one = one.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def _pipeline_query(scenario: int) -> Query:
    def run(spark, sf_dir):
        rows = labelled(spark, sf_dir).select(
            "id",
            F.col("quality").alias("label"),
            cleaning.clean_social(F.col("text")).alias("text_clean"),
        )
        rows = materialize(sampling.split_random(rows), "pipeline_in")
        model = ml_stages.experiment_pipeline(scenario).fit(rows.where("not is_test"))
        entries = ml_stages.vector_entries(F.col("features"))
        out = model.transform(rows).select("id", "label", "is_test", entries.alias("entries"))
        return materialize(out, "pipeline_out").where("entries <> ''")

    return run


for _number in (1, 2, 3, 4):
    QUERIES[f"pipeline_scenario_{_number}"] = _pipeline_query(_number)


# ---------------------------------------------------------------- aggregations


@query
def count_rows(spark, sf_dir):
    """Rows of the table and of its labelled, training and test parts, in one pass."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("marked"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left")
    split = sampling.split_random(docs, "doc_id")
    parts = {
        "documents": F.lit(True),
        "labelled": F.col("marked"),
        "train": F.col("marked") & ~F.col("is_test"),
        "test": F.col("marked") & F.col("is_test"),
    }
    counts = split.agg(*[F.count(F.when(test, 1)).alias(name) for name, test in parts.items()])
    listed = [F.struct(F.lit(name).alias("part"), F.col(name).alias("n_rows")) for name in parts]
    return counts.select(F.inline(F.array(*listed)))


@query
def count_per_class(spark, sf_dir):
    return labels.count_per_class(labelled(spark, sf_dir), "raw_label")


@query
def hfw_top_words(spark, sf_dir):
    return vocabulary.heavy_terms(document_tokens(spark, sf_dir), F.col("tokens"), C.HFW_TOP_N)


@query
def pattern_vocab_topn(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        tokens.tokenize_match(F.col("text"), C.PLATFORM_STOP_WORDS).alias("t")
    )
    rows = materialize(rows, "match-tokens")
    return vocabulary.heavy_terms(rows, tokens.sequence_grams(F.col("t"), 2), C.SEQUENCE_VOCAB)


@query
def majority_label(spark, sf_dir):
    return labels.majority_label(labelled(spark, sf_dir), "raw_label")


@query
def dedupe_clean_text(spark, sf_dir):
    rows = documents(spark, sf_dir).select("id", cleaning.clean_social(F.col("text")).alias("text_clean"))
    return sampling.dedupe(rows, "text_clean")


@query
def dedupe_raw_text(spark, sf_dir):
    return sampling.dedupe(documents(spark, sf_dir), "text")


@query
def retained_pct(spark, sf_dir):
    """Rows that have features in each scenario, the learnt vocabulary applied."""
    rows = harness_rows(spark, sf_dir).withColumn("is_test", F.lit(False)).withColumn("run", F.lit(1))
    listed = features.harness_features_by_run(rows, "run", list(C.SCENARIOS))
    filled = [(F.col("scenario") == s) & (F.size("features") > 0) for s in C.SCENARIOS]
    per_row = listed.groupBy("id").agg(
        *[F.bool_or(test).alias(s) for s, test in zip(C.SCENARIOS, filled)]
    )
    return labels.retained(per_row, {s: F.col(s) for s in C.SCENARIOS})


@query
def first_n_per_class(spark, sf_dir):
    return sampling.first_per_class(
        labelled(spark, sf_dir).select("id", F.col("raw_label").alias("label")), 3
    )


@query
def union_by_name(spark, sf_dir):
    docs = labelled(spark, sf_dir).select(F.col("word_label").alias("label"), "text")
    turns = table(spark, sf_dir, "conversations").select("text", F.col("role").alias("label"))
    return labels.append_by_name(docs, turns)


@query
def preview_features(spark, sf_dir):
    rows = documents(spark, sf_dir).orderBy("id").limit(5)
    return rows.select("id", joined(tokens.social_tokens(F.col("text"))))


# ---------------------------------------------------------------- neighbours and votes


def _neighbors(spark, sf_dir, k: int = 50):
    rows = unigram_rows(spark, sf_dir)
    return rows, similarity_join.topk_pairs(rows, k, C.DISTANCE_THRESHOLD)


@query
def jaccard_threshold_join(spark, sf_dir):
    return similarity_join.threshold_pairs(unigram_rows(spark, sf_dir), C.DISTANCE_THRESHOLD)


@query
def jaccard_prefix_join(spark, sf_dir):
    """Pairs of at least half their tokens in common, by the prefix index."""
    rows = materialize(unigram_rows(spark, sf_dir), "unigrams")
    return prefix_join.prefix_pairs(rows, C.NEAR_THRESHOLD)


@query
def pairs_distinct(spark, sf_dir):
    # the join gives every pair once
    pairs = similarity_join.threshold_pairs(unigram_rows(spark, sf_dir), C.DISTANCE_THRESHOLD, ["test_id", "train_id"])
    return pairs.select("test_id", "train_id")


@query
def lsh_similarity_join(spark, sf_dir):
    """One hash a table, as few as a candidate can have."""
    rows = unigram_rows(spark, sf_dir)
    pairs = lsh_join.lsh_pairs(rows, SIGNATURE_HASHES, C.DISTANCE_THRESHOLD, columns=LSH_COLUMNS)
    return pairs.select("test_id", "train_id", "distance", F.col("first_band").alias("first_table"))


def _hashed_rows(rows: DataFrame) -> DataFrame:
    """The engine's rows with their hashed presence features."""
    hashed = ml_stages.presence("tokens", "vector", C.HASH_BUCKETS).transform(rows)
    bits = F.transform(ml_stages.vector_indices(F.col("vector")), lambda i: i.cast("string"))
    return hashed.select("id", "label", "is_test", bits.alias("features"))


def _hashed_pairs(spark, sf_dir, hashes: int, rows_per_band: int) -> DataFrame:
    rows = materialize(_hashed_rows(engine_rows(spark, sf_dir)), "hashed")
    rows = labels.keep_nonempty(rows, "features")
    return lsh_join.lsh_pairs(rows, hashes, C.DISTANCE_THRESHOLD, rows_per_band, columns=LSH_COLUMNS)


@query
def lsh_join_hashed(spark, sf_dir):
    """Hashed features into the LSH join, two signature values a band, with bands for a recall of 0.9.

    A pair just below the threshold is found with chance 0.92; ``lsh_join_hashed_tables`` has all.
    """
    pairs = _hashed_pairs(spark, sf_dir, BAND_HASHES, ROWS_PER_BAND)
    return pairs.select("test_id", "train_id", "distance", "first_band")


@query
def lsh_join_hashed_tables(spark, sf_dir):
    """Hashed features into the LSH join, one hash a table: practically every pair below the threshold."""
    pairs = _hashed_pairs(spark, sf_dir, SIGNATURE_HASHES, 1)
    return pairs.select("test_id", "train_id", "distance", F.col("first_band").alias("first_table"))


@query
def knn_topk(spark, sf_dir):
    return _neighbors(spark, sf_dir)[1].select("test_id", "train_id", "train_label", "distance", "rank")


@query
def vote_counts(spark, sf_dir):
    return votes.plain_votes(_neighbors(spark, sf_dir)[1])


@query
def vote_winner(spark, sf_dir):
    return votes.vote_winner(votes.plain_votes(_neighbors(spark, sf_dir)[1]))


@query
def vote_weighted(spark, sf_dir):
    counted = materialize(votes.weighted_votes(_neighbors(spark, sf_dir)[1]), "votes")
    return counted.join(votes.vote_winner(counted), "test_id")


def _predictions(spark, sf_dir) -> DataFrame:
    rows, near = _neighbors(spark, sf_dir)
    fallback, _ = experiment.fallback_and_size(rows)
    tests = rows.where("is_test").select(
        F.col("id").alias("test_id"), F.col("label").alias("test_label")
    )
    winners = votes.vote_winner(votes.plain_votes(near))
    return votes.predict_with_fallback(tests, winners, F.lit(fallback))


@query
def predict_with_fallback(spark, sf_dir):
    return _predictions(spark, sf_dir)


@query
def accuracy(spark, sf_dir):
    return votes.accuracy(_predictions(spark, sf_dir))


@query
def avg_neighbors(spark, sf_dir):
    return knn_evaluate(spark, sf_dir).select("avg_candidates", "neighbor_pairs", "test_size")


@query
def minhash_signature(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "id", F.array_distinct(tokens.social_tokens(F.col("text"))).alias("features")
    )
    signed = forest.with_signature(rows, SIGNATURE_HASHES).select("id", "signature")
    return signed.select("id", joined("signature", ",", "signature"))


@query
def lsh_banded_topk(spark, sf_dir):
    rows = materialize(unigram_rows(spark, sf_dir), "unigrams")
    found = forest.forest_topk(rows, 50, [SIGNATURE_HASHES])
    return found.select("test_id", "train_id", "distance", "rank")


# ---------------------------------------------------------------- samples and splits


@query
def sample_balanced(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", F.col("raw_label").alias("label"))
    return sampling.sample_balanced(materialize(rows, "labels"), 40)


@query
def sample_fractions(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", F.col("raw_label").alias("label"))
    return sampling.sample_fractions(rows, 100)


@query
def sample_uniform(spark, sf_dir):
    rows = materialize(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "ids")
    return sampling.sample_uniform(rows, 500)


@query
def split_random(spark, sf_dir):
    return sampling.split_random(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query
def split_stratified(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", F.col("raw_label").alias("label"))
    return sampling.split_stratified(materialize(rows, "labels"))


@query
def row_key(spark, sf_dir):
    rows = documents(spark, sf_dir).select("id", cleaning.clean_social(F.col("text")).alias("text_clean"))
    return sampling.row_key(rows, "text_clean").select("id", "row_id")


# ---------------------------------------------------------------- experiments


@query
def knn_evaluate(spark, sf_dir):
    return experiment.knn_evaluate(unigram_rows(spark, sf_dir), 50)


@query
def knn_evaluate_ternary(spark, sf_dir):
    """Three classes through split, join, vote and fallback."""
    rows = features.engine_features(engine_rows(spark, sf_dir, C.NUMERIC_TERNARY), 1)
    return experiment.knn_evaluate(rows, 50)


@query
def knn_grid(spark, sf_dir):
    return _cells(spark, sf_dir)


@query
def fraction_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)[0]


@query
def best_config(spark, sf_dir):
    best = experiment.best_config(_cells(spark, sf_dir), experiment.RESULT_KEYS)
    return best.select(*experiment.RESULT_KEYS, "accuracy")


@query
def results_sorted(spark, sf_dir):
    return experiment.results_sorted(_cells(spark, sf_dir))


@query
def best_per_run(spark, sf_dir):
    best = experiment.best_per_run(
        _with_costs(_sweep(spark, sf_dir)[0]), ("scenario", "fraction"), ["num_hash_tables", "k"], COSTS, "total_m"
    )
    return best.select("scenario", "fraction", "num_hash_tables", "k", "accuracy", "total_m")


def _summary(spark, sf_dir) -> DataFrame:
    cells, base = _sweep(spark, sf_dir)
    return experiment.sweep_summary(_with_costs(cells), base, COSTS, "total_m")


@query
def sweep_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def sweep_pivot(spark, sf_dir):
    return experiment.sweep_pivot(_summary(spark, sf_dir), ["train_rows_m", "total_m"])
