"""Spark ML pipeline of the experiment: feature stages by scenario."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import (
    CountVectorizerModel,
    HashingTF,
    NGram,
    RegexTokenizer,
    StopWordsRemover,
    Tokenizer,
    VectorAssembler,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.patterns import with_patterns
from .vocabulary import frequent_words


class _PatternParams(HasInputCol, HasOutputCol):
    topN = Param(Params._dummy(), "topN", "frequent words kept", TypeConverters.toInt)
    minN = Param(Params._dummy(), "minN", "shortest window", TypeConverters.toInt)
    maxN = Param(Params._dummy(), "maxN", "longest window", TypeConverters.toInt)
    minFrequent = Param(
        Params._dummy(), "minFrequent", "frequent words a window needs", TypeConverters.toInt
    )
    maxPatterns = Param(
        Params._dummy(), "maxPatterns", "patterns per row, 0 for all", TypeConverters.toInt
    )

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(
            inputCol="tokens",
            outputCol="patterns",
            topN=C.HFW_TOP_N,
            minN=C.PATTERN_MIN_N,
            maxN=C.PATTERN_MAX_N,
            minFrequent=C.PATTERN_MIN_HFW,
            maxPatterns=0,
        )


class FrequentWordPatterns(Estimator, _PatternParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the most frequent words; its model turns tokens into masked-window patterns."""

    @keyword_only
    def __init__(
        self,
        *,
        inputCol=None,
        outputCol=None,
        topN=None,
        minN=None,
        maxN=None,
        minFrequent=None,
        maxPatterns=None,
    ):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FrequentWordPatternsModel:
        words = frequent_words(dataset, self.getInputCol(), self.getOrDefault("topN"))
        model = FrequentWordPatternsModel(words=words)
        return self._copyValues(model)


class FrequentWordPatternsModel(Model, _PatternParams, DefaultParamsReadable, DefaultParamsWritable):
    """Patterns over the word list; the list and the sizes are Params, so saving keeps them."""

    words = Param(Params._dummy(), "words", "frequent words", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, words=None):
        super().__init__()
        if words is not None:
            self._set(words=words)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_patterns(
            dataset,
            self.getInputCol(),
            self.getOutputCol(),
            self.getOrDefault("words"),
            self.getOrDefault("minN"),
            self.getOrDefault("maxN"),
            self.getOrDefault("minFrequent"),
            self.getOrDefault("maxPatterns") or None,
        )


class OrderedVocabulary(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A ``CountVectorizer`` of presence whose vocabulary has a total order.

    Terms are ordered by their number of uses, ties by term, where ``CountVectorizer`` leaves
    ties to chance; the fitted model is Spark's own ``CountVectorizerModel``.
    """

    vocabSize = Param(Params._dummy(), "vocabSize", "terms kept", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, vocabSize=None):
        super().__init__()
        self._setDefault(vocabSize=C.PATTERN_COLUMN_VOCAB)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        source = self.getInputCol()
        terms = frequent_words(dataset, source, self.getOrDefault("vocabSize"))
        return CountVectorizerModel.from_vocabulary(
            terms, inputCol=source, outputCol=self.getOutputCol(), binary=True
        )


def experiment_pipeline(scenario: int, num_features: int = C.HASH_BUCKETS) -> Pipeline:
    """Stages from ``text_clean`` to binary ``features``.

    1 unigrams, 2 bigrams, 3 frequent-word patterns, 4 all three side by side.
    """
    stages = [
        RegexTokenizer(
            inputCol="text_clean", outputCol="tokens_raw", pattern=C.GAP_PATTERN, toLowercase=True
        ),
        StopWordsRemover(
            inputCol="tokens_raw", outputCol="tokens", stopWords=C.EXTENDED_STOP_WORDS
        ),
    ]
    last = scenario in (1, 2, 3)

    def out(name: str) -> str:
        return "features" if last else name

    if scenario in (1, 4):
        stages.append(presence("tokens", out("unigram_vector"), num_features))
    if scenario in (2, 4):
        stages.append(NGram(n=2, inputCol="tokens", outputCol="bigrams"))
        stages.append(presence("bigrams", out("bigram_vector"), num_features))
    if scenario in (3, 4):
        stages.append(FrequentWordPatterns(inputCol="tokens", outputCol="patterns"))
        stages.append(
            OrderedVocabulary(
                inputCol="patterns",
                outputCol=out("pattern_vector"),
                vocabSize=C.PATTERN_COLUMN_VOCAB,
            )
        )
    if scenario == 4:
        blocks = ["unigram_vector", "bigram_vector", "pattern_vector"]
        stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
    return Pipeline(stages=stages)


def presence(source: str, target: str, buckets: int) -> HashingTF:
    return HashingTF(inputCol=source, outputCol=target, numFeatures=buckets, binary=True)


def featurise_pipeline(
    num_features: int = C.JOB_HASH_BUCKETS, unigrams: bool = True
) -> Pipeline:
    """Stages of the featurisation job: hashed counts of unigrams and bigrams, side by side.

    Without ``unigrams`` the bigram counts alone are the features.
    """
    stages = [
        Tokenizer(inputCol="text_clean", outputCol="tokens"),
        StopWordsRemover(inputCol="tokens", outputCol="unigrams"),
        NGram(n=2, inputCol="unigrams", outputCol="bigrams"),
    ]
    names = {"bigrams": "bigram_features" if unigrams else "features"}
    if unigrams:
        names = {"unigrams": "unigram_features", **names}
    for source, target in names.items():
        stages.append(HashingTF(inputCol=source, outputCol=target, numFeatures=num_features))
    if unigrams:
        stages.append(VectorAssembler(inputCols=list(names.values()), outputCol="features"))
    return Pipeline(stages=stages)


def without_attributes(vector: str) -> Column:
    """The vector column without its per-entry attribute metadata."""
    return F.col(vector).alias(vector, metadata={})


def vector_nonzeros(vector: Column) -> Column:
    """Number of non-zero entries, read from the vector's own fields (no UDF)."""
    raw = F.unwrap_udt(vector)
    nonzero = F.size(F.filter(raw["values"], lambda v: v != 0))
    return F.when(raw["values"].isNull(), F.lit(0)).otherwise(nonzero)


def vector_entries(vector: Column) -> Column:
    """``index:value`` of each non-zero entry, values as whole numbers, joined by commas."""
    raw = F.unwrap_udt(vector)
    positions = F.when(raw["type"] == 0, raw["indices"]).otherwise(
        F.sequence(F.lit(0), F.size(raw["values"]) - 1)
    )
    paired = F.zip_with(
        positions,
        raw["values"],
        lambda i, v: F.when(v != 0, F.concat_ws(":", i.cast("string"), v.cast("bigint").cast("string"))),
    )
    return F.array_join(F.filter(paired, lambda e: e.isNotNull()), ",")


def vector_indices(vector: Column) -> Column:
    """Positions of the non-zero entries of a sparse or dense vector."""
    raw = F.unwrap_udt(vector)
    positions = F.when(raw["type"] == 0, raw["indices"]).otherwise(
        F.sequence(F.lit(0), F.size(raw["values"]) - 1)
    )
    paired = F.zip_with(positions, raw["values"], lambda i, v: F.when(v != 0, i))
    return F.filter(paired, lambda i: i.isNotNull())
