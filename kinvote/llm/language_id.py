"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's n-grams are the 2 and 3 bytes long runs of its UTF-8 bytes, A-Z lower-cased, with ASCII
characters that are no letters blanked, hashed to ``DIMENSIONS`` numbers. A number's weight is
``(1 + ln count) * idf`` (0 without the n-gram), and vectors have length 1. The inverse document frequency
is counted over all training texts. Each language gets up to ``CENTROIDS`` centroids by
spherical k-means, fitted on at most about ``SAMPLE`` texts of the language: those whose hashed
key falls below SAMPLE / count, so a documented bound, whatever the size. A text takes the language of the centroid
with the largest cosine, its score. It is marked rejected if it is farther from that centroid
than nearly all texts of the centroid were (a quantile of their distances, with a margin).

Edge cases: a null text, and one without a letter, is ``und`` with score 0; texts of a null
language are not learned from; ids may be null (never held out, never learned from) and rows may
repeat; equal cosines go to the first language in order; without any training text every
text is ``und``; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import as_strings, slices, unit_hash
from kinvote.session import materialize

DIMENSIONS = 4096
SAMPLE = 1000
CENTROIDS = 4
ROUNDS = 10
LEAST_SHARE = 0.05
"""A centroid with less of its language's sample is dropped: odd or wrongly labelled texts."""
REJECT_QUANTILE = 0.01
REJECT_MARGIN = 0.8
MOST_LANGUAGES = 1024
"""So a model has at most 4,096 centroids of 16 kB, 64 MB."""
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SLICE = 2 << 20
ROWS = 512


def gram_counts(texts: pa.Array) -> np.ndarray:
    """(texts, DIMENSIONS): how often each hashed n-gram occurs in each whole text."""
    texts = as_strings(texts)
    raw = [b" " + (t.encode().translate(_LETTERS)) + b" " for t in texts.to_pylist()]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if not len(data):
        return np.zeros((len(raw), DIMENSIONS), np.int64)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
    last = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes left in the text
    two = (data[:-1] << 8) | data[1:]
    three = (two[:-1] << 8) | data[2:]
    total = np.zeros(len(raw) * DIMENSIONS, np.int64)
    for grams, length in ((two, 2), (three, 3)):
        bucket = (((grams + np.uint32(length << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        whole = (last[: len(grams)] >= length) & (grams != (0x2020 if length == 2 else 0x202020))
        total += np.bincount((owner[: len(grams)] * DIMENSIONS + bucket)[whole], minlength=len(total))
    return total.reshape(len(raw), DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.array([any(c.isalpha() for c in t) for t in as_strings(texts).to_pylist()], dtype=bool)


@dataclass
class CentroidModel:
    """Languages (sorted) and their centroids; ``floor`` is each centroid's least accepted cosine."""

    languages: list[str]
    centroids: np.ndarray
    floor: np.ndarray
    idf: np.ndarray


def held_out(key: Column) -> Column:
    """Whether crc32(key as text) mod 4 is 2; false for null keys."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def document_frequencies(texts: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """The number of texts, and of texts with each hashed n-gram, over all rows.

    A task sums its slices and gives DIMENSIONS rows; their sum is DIMENSIONS rows too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in slices(batches, "_text", SLICE, ROWS):
            held += (gram_counts(batch.column("_text")) > 0).sum(axis=0)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[rows], held]))], ["gram", "n"]
            )

    made = texts.select(F.col(text).alias("_text")).mapInArrow(run, "gram bigint, n bigint")
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for row in made.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # DIMENSIONS + 1 rows
        out[row["gram"] + 1] = row["n"]
    return int(out[0]), out[1:]


def spherical_means(x: np.ndarray, count: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and the nearest centroid of each row; starts from rows far apart."""
    chosen = [int(np.argmin(x @ x.mean(axis=0)))]
    while len(chosen) < min(count, len(x)):
        nearest = np.max(x @ x[chosen].T, axis=1)
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-6:
            break
        chosen.append(far)
    centers = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else centers[i] for i in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    members = np.bincount(np.argmax(x @ centers.T, axis=1), minlength=len(centers))
    centers = centers[members >= min(LEAST_SHARE * len(x), members.max())]
    return centers, np.argmax(x @ centers.T, axis=1)


def fit(docs: DataFrame, key: str, text: str, lang: str) -> CentroidModel:
    """Learn from the texts with a language and a letter whose key is not held out."""
    learned = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & F.col(key).isNotNull()).filter(
        ~held_out(F.col(key))
    ).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    rows, frequency = document_frequencies(learned, "_text")
    idf = (np.log((1 + rows) / (1 + frequency)) + 1).astype(np.float32)
    counts = learned.groupBy("_lang").count()
    shares = [(row["_lang"], SAMPLE / row["count"]) for row in counts.limit(MOST_LANGUAGES + 1).collect()]
    if len(shares) > MOST_LANGUAGES:
        raise ValueError("more languages than a model of this kind is meant for")
    # a literal, so texts are chosen where they are read and only chosen ones are shuffled
    share = F.lit(None).cast("double")
    if shares:
        share = F.create_map(*[F.lit(x) for pair in sorted(shares) for x in pair])[F.col("_lang")]
    drawn = unit_hash(F.lit("language sample"), F.col("_key"))
    sample = learned.filter(drawn < share).select("_lang", "_key", "_text")

    def means(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_key", "_text"])
        texts = pa.array(group["_text"], pa.string())
        parts = pa.RecordBatch.from_arrays([texts], ["_text"])
        x = np.concatenate([vectors(gram_counts(s.column(0)), idf) for s in slices([parts], "_text", SLICE, ROWS)])
        centers, own = spherical_means(x, CENTROIDS)
        cosines = np.sum(x * centers[own], axis=1)
        floors = [
            float(np.quantile(cosines[own == i], REJECT_QUANTILE)) * REJECT_MARGIN if (own == i).any() else 0.0
            for i in range(len(centers))
        ]
        return pd.DataFrame(
            {"_lang": group["_lang"].iloc[0], "cluster": range(len(centers)), "center": list(centers), "floor": floors}
        )

    made = sample.groupBy("_lang").applyInPandas(means, "_lang string, cluster int, center array<float>, floor double")
    found = sorted(materialize(made, "language-centroids").collect(), key=lambda r: (r["_lang"], r["cluster"]))
    return CentroidModel(
        [r["_lang"] for r in found],
        np.array([r["center"] for r in found], dtype=np.float32).reshape(len(found), DIMENSIONS),
        np.array([r["floor"] for r in found]),
        idf,
    )


def identify(docs: DataFrame, key: str, text: str, model: CentroidModel) -> DataFrame:
    """Per row: key, held_out, lang_pred, score (the cosine) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "_text", SLICE, ROWS):
            texts = batch.column("_text")
            letters = has_letter(texts)
            names = np.full(batch.num_rows, "und", dtype=object)
            scores, rejected = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if len(known.languages):
                cosines = vectors(gram_counts(texts), known.idf) @ known.centroids.T
                best = np.argmax(cosines, axis=1)
                names[letters] = np.array(known.languages, dtype=object)[best[letters]]
                top = cosines[np.arange(len(best)), best]
                scores[letters] = np.clip(top, 0, 1)[letters]
                rejected = letters & (top < known.floor[best])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    batch.column("held_out"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected),
                ],
                ["_key", "held_out", "lang_pred", "score", "rejected"],
            )

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), held_out(F.col(key)).alias("held_out"))
    kind = slim.schema["_key"].dataType.simpleString()
    made = slim.mapInArrow(run, f"_key {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
    return made.withColumnRenamed("_key", key)


def language_of(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out and identify all rows."""
    return identify(docs, key, text, fit(docs, key, text, lang))
