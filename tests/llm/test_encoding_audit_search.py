"""SentencePiece encoding, the filter audit and ranked search against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from kinvote.llm import filter_audit, ranked_search, sentencepiece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
# columns beside those asked for, with names that the operators use inside
EXTRA = "doc_id bigint, text string, source string, _id string, _text string, part string, ids string, term string, item string, n_tokens string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", "x", "x", "x") for i, t, s in rows], EXTRA)


TRICKY = [
    None, "", " ", "   ", "a  b\n c", "▁x y", "  lead", "ﬁ é é", "\t<s></s><0x41>", "\x00a", "  trail  ",
    "x" * 3000, "日本語テキスト  🙂🙂 ok", "▁▁▁", " " * 40 + "q" + " " * 17, "\n\n  \n", "a▁ ▁b", LONG, "same", "same",
]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = list("ab eéß▁ \n\tthing日🙂s")
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rows = [(i, t) for i, t in enumerate(TRICKY + random_texts(300))]
    return rows + [(None, "no id here"), (3, "an id again"), (3, "an id again")]


def test_ids_are_those_of_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = table(spark, [(i, t, "s") for i, t in texts])
    assert sentencepiece_bpe.differences(docs, "doc_id", "text", MODEL).count() == 0
    got = sentencepiece_bpe.encode_ids(docs, "doc_id", "text", MODEL)
    want = [(i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in texts]
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == sorted(want, key=repr)
    back = sentencepiece_bpe.decode_ids(got, "doc_id", "ids", MODEL).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(i), library.decode(x)) for i, x in want)


def test_digests_and_whole_documents(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = table(spark, [(i, t, "s") for i, t in texts])

    def digest(i, t):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        coded = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        return repr(i), len(ids), coded, hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = sentencepiece_bpe.encoding_digests(docs, "doc_id", "text", MODEL).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(digest(*x) for x in texts)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sentencepiece_bpe.differences(real, "doc_id", "text", MODEL).count() == 0
    assert sentencepiece_bpe.encoding_digests(docs.limit(0), "doc_id", "text", MODEL).count() == 0


def test_rows_and_heap_merge_alike():
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.read_model(MODEL))
    rng = np.random.default_rng(3)
    chars = [i for s, i in encoder.vocabulary.symbols.items() if len(s) == 1 and s.isascii()] + [-50]
    for width in (2, 3, 9, 40):
        grid = rng.choice(chars, (200, width)).astype(np.int32)
        rows = sentencepiece_bpe.merge_rows(grid, encoder.table)
        assert rows.tolist() == [sentencepiece_bpe.merge(r.tolist(), encoder.vocabulary) for r in grid]


def test_a_difference_from_the_library_raises():
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.read_model(MODEL))
    encoder.table.rank[:-1] = encoder.table.rank[:-1][::-1].copy()
    with pytest.raises(ValueError, match="is not the library's"):
        encoder.encode(pa.array(["international cooperation"]))


def test_known_segments_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "MOST_KNOWN", 5)
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.read_model(MODEL))
    for text in ["one two three", "four five six seven eight nine", "one two three"]:
        ids, bounds = encoder.encode(pa.array([text, text]))
        assert ids[: bounds[1]].tolist() == encoder.vocabulary.library.encode(text, add_bos=True, add_eos=True)


# ---- filter audit


def audit_by_definition(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = Counter()
    for i, t, s in docs:
        t, part = t or "", s or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        good = any(q == 1 for d, q, _ in labels if d == i and i is not None)
        toxic = any(x == 1 for d, _, x in labels if d == i and i is not None)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                removed = fails[f] and not gone
                out[key, "redundant"] += fails[f] and gone
                gone = gone or fails[f]
                out[key, "kept"] += not gone
                out[key, "removed"] += removed
                out[key, "good_lost"] += removed and good
                out[key, "toxic_lost"] += removed and toxic
                out[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                if removed:
                    out[part, f] += 1
    for key in {k[0] for k in out if isinstance(k[0], tuple)}:
        out[key, "shapley"] = out[key[0], key[1][key[2] - 1]]
    return out


def test_audit_of_every_order(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "delta#", "eps", "zeta", "x|y", "é", "1.5"] + [f"w{i}" for i in range(80)]

    def said():
        pool = rng.sample(words, rng.randint(3, len(words)))
        return " ".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))

    docs = [(i, said(), rng.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(i, docs[i % 7][1], "copies") for i in range(200, 260)] + [(300 + i, None, "b") for i in range(4)]
    docs += [(None, docs[0][1], "a"), (None, docs[0][1], "a"), (5, docs[9][1], "a"), (5, docs[9][1], "a")]
    docs += [(400, LONG, "long"), (401, LONG, "long"), (402, "", "long"), (403, " \n\t", "long")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 300, 2)]
    labels += [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame([(*x, "x", "x") for x in labels], "doc_id bigint, quality int, toxic int, text string, _id string")
    got = filter_audit.filter_audit(table(spark, docs), marks).collect()
    want = audit_by_definition(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})
    names = ["kept", "removed", "redundant", "good_lost", "toxic_lost", "unique_fails", "shapley"]
    for r in got:
        for name in names:
            assert r[name] == want[(r.part, r.filter_order, r.step), name], (r, name)
    empty = filter_audit.filter_audit(table(spark, docs).limit(0), marks.limit(0))
    assert empty.count() == 0 and set(names) < set(empty.columns)


def test_fields_do_not_run_over(spark):
    most = (1 << 63) // 120 - 1
    counts = spark.createDataFrame([("p", 1, most // 2), ("p", 1, most - most // 2), ("q", 3 + 32, 7)], "part string, kind int, n bigint")
    rows = filter_audit.unpacked(filter_audit.packed_totals(counts)).collect()
    for r in rows:
        filter_, before = r.filter_order[r.step - 1], r.filter_order[: r.step - 1]
        if r.part == "p":
            assert r.removed == (most if filter_ == "A" else 0) and r.shapley == (120 * most if filter_ == "A" else 0)
            assert r.kept == (0 if "A" in before + filter_ else most) and r.redundant == r.good_lost * 0
        else:
            gone = "A" in before or "B" in before
            assert r.removed == r.good_lost == (7 if filter_ in "AB" and not gone else 0) and r.toxic_lost == 0
            assert r.redundant == (7 if filter_ in "AB" and gone else 0) and r.unique_fails == 0


# ---- ranked search


def ranks_by_definition(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = [re.findall(pattern, (t or "").translate(LOWER)) for _, t in docs]
    count = sum(bool(t) for t in terms)
    whole = sum(map(len, terms))
    df = Counter(t for x in terms for t in set(x))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(re.findall(pattern, (t or "").translate(LOWER)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for (i, _), listed in zip(docs, terms):
            tf, m = Counter(listed), 100 - 50 + (50 * len(listed) * count) // whole if whole else 0
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in wanted if tf[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def searched(spark, docs, items, k):
    extra = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in items], "item_id string, text string, term string, item string, block string")
    found = ranked_search.ranked(table(spark, [(i, t, "s") for i, t in docs]).repartition(3), extra, k)
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()]


@pytest.mark.parametrize("segment_docs, at_once, block_items", [(8192, 128, 256), (7, 2, 3), (40, 1, 1)])
def test_ranks(spark, monkeypatch, segment_docs, at_once, block_items):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", segment_docs)
    monkeypatch.setattr(ranked_search, "AT_ONCE", at_once)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block_items)
    rng = random.Random(11)
    words = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    said = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, said(rng.randint(0, 40))) for i in range(250)]
    docs += [(1000 + i, docs[8][1]) for i in range(40)] + [(None, docs[8][1]), (None, said(9)), (7, docs[8][1]), (7, docs[8][1])]
    docs += [(2000, None), (2001, ""), (2002, "... !!"), (2003, "T1 t1, T2-É"), (2004, " ".join(words) * 3), (2005, LONG)]
    items = [(f"i{n}", said(rng.randint(1, 12))) for n in range(8)]
    items += [("copy", docs[8][1]), ("copy", "É t59"), ("none", "zzz"), ("null", None), ("empty", ""), (None, "t1 t40 t41"), ("all", LONG)]
    want = ranks_by_definition(docs, items, 10)
    assert sorted(searched(spark, docs, items, 10), key=repr) == sorted(want, key=repr)


def test_search_of_nothing(spark):
    assert searched(spark, [], [("a", "t1")], 5) == []
    assert searched(spark, [(1, None), (2, "")], [("a", "t1")], 5) == []
    assert searched(spark, [(1, "t1 t2")], [], 5) == []
    assert searched(spark, [(1, "t1 t2"), (2, "t3")], [("a", "t1")], 5) == ranks_by_definition([(1, "t1 t2"), (2, "t3")], [("a", "t1")], 5)


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 50, 300)
    lists = [np.flatnonzero(rng.random(300) < p) for p in (0.9, 0.3, 0.02, 0.5)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    docs, tfs = np.concatenate(lists), rng.integers(1, 9, bounds[-1])
    segment = ranked_search.Segment(sizes, list(range(300)), docs, tfs, bounds, (300, int(sizes.sum())))
    item = ranked_search.Item(segment, np.arange(4), np.array([5, 700, 3000, 90]))
    scores = item.score(np.arange(300))
    for _ in range(200):
        low, high = sorted(rng.choice(301, 2, replace=False))
        bound, at = item.bound(np.array([low]), np.array([high]))
        assert bound[0] >= scores[low:high].max() and (bound[0] == 0 or low <= at[0] < high)
    single, at = item.bound(np.arange(300), np.arange(1, 301))
    assert (single == scores).all()
