"""Corpus operators against brute force, and their edge cases."""

import base64
import datetime
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinvote.llm import (
    common,
    decontamination,
    language_id,
    licenses,
    mixing,
    pii,
    repetition,
    sharding,
    sketch_join,
    url_filters,
    warc,
)
from kinvote.llm.components import components
from kinvote.session import materialize, scratch_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# columns beside id and text, with names that the operators use inside
EXTRA = "doc_id bigint, text string, n_words string, key string, _key string, shard string, term string, source string, lang string"


def table(spark, rows, schema=EXTRA):
    full = [(i, t, "x", "x", "x", "x", "x", "s" if i else None, "en") for i, t in rows]
    return spark.createDataFrame(full, schema)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Two words"), (None, "a b c d e f"), (6, LONG), (7, LONG),
    (8, "same row twice here"), (8, "same row twice here"), (9, "É ñ ß 漢字   end"), (10, "... !!! ###"),
]


def test_words_are_those_of_the_definitions():
    texts = ["  A b\tC\x0bc ", None, "", "É Ñ\n\nb z x-y_z 1.5", "tail"]
    for keyword, pattern in ((common.LOWER_BLANK_WORDS, r"[^\x20\x09-\x0D]+"), (common.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = common.words_of(pa.array(texts), keyword)
        lists = [got.vocabulary.take(pa.array(got.codes[a:b])).to_pylist() for a, b in zip(got.starts, got.starts[1:])]
        assert lists == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        part = common.words_of(pa.array(texts).slice(3), keyword)
        assert np.diff(part.starts).tolist() == [len(x) for x in lists[3:]]


def test_numbers_have_no_gaps_and_follow_counts(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 4 + 1).alias("n"))
    rows = common.numbered(df, ["g"], ["id"], "at", F.col("n")).collect()
    for g in range(3):
        taken = sorted((r.at, r.n) for r in rows if r.g == g)
        assert [a for a, _ in taken] == np.concatenate([[0], np.cumsum([n for _, n in taken])[:-1]]).tolist()


def test_marks_lose_no_id(spark):
    ids = spark.range(0, 50_000, 97).withColumnRenamed("id", "x")
    hits = common.marked(spark.range(50_000), F.col("id"), ids, "x").filter("_hit").collect()
    assert {r.id for r in hits} >= set(range(0, 50_000, 97)) and len(hits) < 2000


# ---- 1 ------------------------------------------------------------------------------


def hits_by_definition(docs, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = {}
    for i, t in items:
        w = words(t)
        for x in [tuple(w[a : a + n]) for a in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] * bool(w):
            windows.setdefault(x, set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if found := windows.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark):
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, said(rng.randint(1, 14))) for i in range(40)] + [(None, "one"), (7, ""), (8, None), (3, said(12)), (9, "É ñ ß")]
    docs = EDGES + [(100 + i, said(rng.randint(0, 60))) for i in range(60)] + [(200, items[4][1].upper() + "!")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, terms int")
    got = decontamination.contamination(table(spark, docs), bench).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == hits_by_definition(docs, items)
    none = decontamination.contamination(table(spark, docs), bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontamination.contamination(table(spark, []), bench).count() == 0


def test_phrases_and_proximity(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(50)]
    index = decontamination.build_index(table(spark, docs), "doc_id", "text", segment_bytes=200)
    queries = [(k, [rng.choice("abcdefghz") for _ in range(rng.randint(1, 4))]) for k in range(30)]
    asked = spark.createDataFrame(queries, "query bigint, terms array<string>")
    got = {(r.doc_id, r.query, r.first_word, r.n_words) for r in decontamination.phrase_matches(index, asked).collect()}
    expected = {
        (i, k, a, len(q)) for i, t in docs for k, q in queries for a in range(len(t.split()) - len(q) + 1) if t.split()[a : a + len(q)] == q
    }
    assert got == expected
    span = 6
    near = {}
    for i, t in docs:
        w = t.split()
        for k, q in queries:
            found = [(b - a, a) for a in range(len(w)) for b in range(a, min(a + span, len(w))) if set(q) <= set(w[a : b + 1])]
            if found:
                near[i, k] = (min(found)[1], min(found)[0] + 1)
    got = decontamination.proximity_matches(index, asked, span).collect()
    assert {(r.doc_id, r.query): (r.first_word, r.n_words) for r in got} == near and len(got) == len(near)


# ---- 2 ------------------------------------------------------------------------------


def components_by_definition(rows, n, percent):
    sets, parent = [], {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
        parent[k] = k

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    for x in named:
        for y in named:
            both = len(sets[x] & sets[y])
            alike = both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)
            if x < y and (alike or rows[x][0] == rows[y][0] and sets[x] and sets[y]):
                parent[root(x)] = root(y)
    least = {}
    for k in named:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((i, len(sets[k]), None if i is None else least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50), (2, 60)])
def test_jaccard_components(spark, n, percent):
    rng = random.Random(n)
    rows = [*EDGES, (8, "another text of the id eight"), (3, "another text of the id eight"), (8, "")]
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 80))] for _ in range(12)]
    line = "this line stands in very many of the documents".split()
    for k in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((100 + k, " ".join(line + w if k % 3 == 0 else w)))
    got = sketch_join.jaccard_components(table(spark, rows), n=n, percent=percent).drop("representative")
    assert sorted(map(tuple, got.collect()), key=str) == components_by_definition(rows, n, percent)


def test_copies_of_one_text_do_not_all_meet(spark, monkeypatch):
    """Copies with one change each link, but the first ids, the keys' hubs, have two changes and link with none."""
    rng, met, rows = random.Random(11), [], []
    for k in range(240):
        w = [f"w{i}" for i in range(100)]
        for at in rng.sample(range(5, 95, 6), 2 if k < 30 else 1):
            w[at] = f"x{k}-{at}"
        rows.append((k, " ".join(w)))

    def noted(df, name):
        out = materialize(df, name)
        if name == "sketch-rest":
            met.append(out.count())
        return out

    monkeypatch.setattr(sketch_join, "materialize", noted)
    got = sketch_join.jaccard_components(table(spark, rows), n=5, percent=80).drop("representative")
    assert sorted(map(tuple, got.collect()), key=str) == components_by_definition(rows, 5, 80)
    assert met[0] < len(rows)


def test_null_text_of_an_id_with_a_near_copy(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, None), (2, " ".join(words[:-1] + ["x"])), (3, None), (1, None)]
    got = sketch_join.jaccard_components(table(spark, rows), n=3, percent=90).drop("representative")
    assert sorted(map(tuple, got.collect()), key=str) == components_by_definition(rows, 3, 90)


def test_jaccard_components_of_nothing(spark):
    assert sketch_join.jaccard_components(table(spark, [])).count() == 0


def test_every_linked_pair_shares_a_key():
    """The pigeonhole argument, on sets that differ as much as they may."""
    rng = np.random.default_rng(1)
    for percent in (60, 80, 90):
        for size in [*range(1, 40), 100, 333, 1000]:
            for _ in range(5):
                most = size * (100 - percent) // 100
                drop = int(rng.integers(0, most + 1))
                a = np.sort(rng.integers(0, 2**63, size).astype(np.uint64))
                b = np.sort(rng.choice(a, size - drop, replace=False))
                if not len(b) or 100 * len(b) < percent * len(a):
                    continue
                which, keys, native = sketch_join._keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                shared = set(keys[which == 0].tolist()) & set(keys[which == 1].tolist())
                natives = set(keys[native].tolist())
                assert (shared & natives) or not drop or len(a) == len(b)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 500, 200).astype(np.uint64)) for _ in range(2))
    bits, ends = sketch_join._bits(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert ends.tolist() == [0, 4, 8]
    assert sum(int(x & (2**64 - 1)).bit_count() for x in (bits[:4] ^ bits[4:]).tolist()) <= len(np.setxor1d(a, b))


def test_sketches_refuse_only_what_cannot_link(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], []
    for i in range(300):
        size, changed = int(rng.integers(1, 3000)), rng.choice([0.0, 0.02, 0.08, 0.11, 0.2, 1.0])
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = a.copy()
        b[rng.random(len(b)) < changed] += np.uint64(12345)
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(size * changed / 3)).astype(np.uint64)]))
        bits, ends = sketch_join._bits(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        rows.append((i, len(a), bits[: ends[1]].tolist(), len(b), bits[ends[1] :].tolist()))
        truth.append(sketch_join._links(a, b, 80))
    df = spark.createDataFrame(rows, "i int, n_x bigint, bits_x array<bigint>, n_y bigint, bits_y array<bigint>")
    got = {r.i: r.may for r in df.select("i", sketch_join.may_link("x", "y", 80).alias("may")).collect()}
    assert all(got[i] for i, t in enumerate(truth) if t) and sum(truth) > 50
    far = [i for i, r in enumerate(rows) if not truth[i] and min(r[1], r[3]) > 300]
    assert sum(got[i] for i in far) < 0.5 * len(far)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(2000, 2000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    expected = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                expected[a] = expected[b] = min(expected[a], expected[b])
    assert got == expected


@pytest.mark.parametrize("edges, rounds", [([(3, 1), (4, 1), (9, 8)], 0), ([(3, 1), (4, 3)], 1), ([], 0)])
def test_components_end_with_stars(spark, monkeypatch, edges, rounds):
    """No round runs on edges that are stars already."""
    written = []
    monkeypatch.setattr(
        "kinvote.llm.components.materialize", lambda df, name: written.append(name) or materialize(df, name)
    )
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: 8 if n >= 8 else 1 for e in edges for n in e}
    assert len(written) == 1 + rounds


# ---- 3 and 4 ------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(5, "again")] * 2000 + EDGES
    df = table(spark, rows)
    got = sharding.shard_slots(df, "doc_id", "text", [1.0] * 4, [1.0] * 5).collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.grown_shard for r in got if r.grown_shard != r.shard} == {4}
    assert 600 < sum(r.grown_shard == 4 for r in got if r.doc_id != 5) < 1000
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert all(r.size == 1 and r.text_crc32 == 0 for r in got if r.doc_id in (1, 2) and r.size == 1)
    one, many = (sorted(map(str, sharding.shard_slots(df.repartition(n), "doc_id", "text", [1.0] * 4).collect())) for n in (1, 9))
    assert one == many
    assert sharding.shard_slots(table(spark, []), "doc_id", "text", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


def test_weighted_shards_move_few_rows(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    a = sharding.assign_shards(keys, "k", [1.0, 3.0]).groupBy("shard").count().collect()
    assert {r.shard: round(r["count"] / 5000) for r in a} == {0: 1, 1: 3}
    moved = keys.select(
        sharding.rendezvous(F.col("k"), [1.0, 3.0]).alias("a"), sharding.rendezvous(F.col("k"), [2.0, 3.0]).alias("b")
    ).filter("a <> b")
    assert {(r.a, r.b) for r in moved.distinct().collect()} == {(1, 0)}


def test_poisson_counts(spark):
    df = spark.range(20_000)
    for rate in (0.14, 1.0, 3.5, 200.0):
        counts = df.select(mixing.poisson_count(F.lit(rate), F.col("id").cast("string"), "t").alias("n"))
        row = counts.agg(F.avg("n").alias("m"), F.variance("n").alias("v")).first()
        assert abs(row.m - rate) < 5 * (rate / 20_000) ** 0.5 and abs(row.v / rate - 1) < 0.06


def test_mixture_reaches_its_weights(spark):
    rows = [(i, "x" * (i % 50), "a" if i % 10 else "b") for i in range(6000)] + [(None, None, None), (1, "", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixture(df, "doc_id", "text", "source", weights={"b": 2.0}, epochs=2.0).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + (len("x" * (r.doc_id % 50)) + 1 if r.doc_id is not None else 1)
    assert 1.8 < sizes["b"] / sizes["a"] < 2.2
    again = mixing.mixture(df.repartition(7), "doc_id", "text", "source", weights={"b": 2.0}, epochs=2.0).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixture(df.limit(0), "doc_id", "text", "source").count() == 0


def test_mixture_of_edge_rows_and_clashing_names(spark):
    df = table(spark, EDGES)
    for name in ("_source", "_count", "_Rate", "_values", "_size"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    copies = mixing.shuffled(mixing.replicate(df, "doc_id", "text", "source", epochs=4.0), "doc_id")
    assert copies.columns == [*df.columns, "_copy", "_order"]
    rows = copies.collect()
    assert [(r._order, r._copy) for r in rows] == sorted((r._order, r._copy) for r in rows)
    assert all(r[n] == f"own {n}" for r in rows for n in ("_source", "_count", "_Rate", "_values", "_size"))
    # the count hangs on the key alone, so both rows of id 8 have it, and numbers begin at 0
    drawn = {}
    for r in rows:
        drawn.setdefault((r.doc_id, r.text), []).append(r._copy)
    given = [(i, t) for i, t in EDGES]
    for pair, numbers in drawn.items():
        assert sorted(set(numbers)) == list(range(max(numbers) + 1))
        assert len(numbers) == given.count(pair) * (max(numbers) + 1)
    again = mixing.replicate(df.repartition(5), "doc_id", "text", "source", epochs=4.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    with pytest.raises(ValueError, match="other names"):
        mixing.replicate(df.withColumn("_ORDER", F.lit(1)), "doc_id", "text", "source")


def test_pseudonyms_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([("a@b.example 4111 1111 1111 1111", "v", 5)], "text string, _values string, _new int")
    row = pii.pseudonymise(df, "text", "k", counts="found").first()
    assert (row._values, row._new) == ("v", 5) and row.found.email == row.found.card == 1
    assert row.asDict().keys() == {"text", "_values", "_new", "found"}


# ---- 5 and 6 ------------------------------------------------------------------------

RULES = [("allow", "com/"), ("block", "bad.com/x/"), ("block", "worse.org/")]


def test_links_spread_trust_and_distrust(spark):
    link = lambda h: f'<a HREF = "https://{h}/p">l</a>'
    pages = [
        (1, "http://good.com/a", link("friend.org") * 3),
        (2, "http://worse.org/", ""),
        (3, "http://farm.org/1", link("worse.org") * 9 + link("Worse.org")),
        (4, "http://friend.org/1", link("worse.org") + link("good.com") * 9),
        (5, "http://lonely.net/", None),
        (6, None, link("worse.org")),
        (7, "no scheme", link("worse.org")),
        (8, "HTTP://GOOD.COM?q", ""),
        (9, "https://sub.bad.com/x/y#f", ""),
        (9, "https://sub.bad.com/x/y#f", ""),
        (10, "http://farm.org/2", ""),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, host string")
    got = url_filters.judge_urls(df, "page_id", "url", "html", RULES).collect()
    verdicts = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(pages)
    assert verdicts[3] == ("farm.org", "/1", None, "block") and verdicts[10][3] == "block"
    assert verdicts[4] == ("friend.org", "/1", None, "allow") and verdicts[5][3] == "allow"
    assert verdicts[6] == ("", "", None, "allow") and verdicts[7] == ("", "", None, "allow")
    assert verdicts[8] == ("good.com", "", None, "allow") and verdicts[9] == ("sub.bad.com", "/x/y", "bad.com/x/", "block")
    scores = {r.host: (r.trust, r.distrust) for r in url_filters.host_scores(df, "url", "html", RULES).collect()}
    expected = ranks_by_definition({("good.com", "friend.org"): 3, ("farm.org", "worse.org"): 10, ("friend.org", "worse.org"): 1, ("friend.org", "good.com"): 9})
    for host, (trust, distrust) in scores.items():
        assert abs(trust - expected[0].get(host, 0)) < 1e-6 and abs(distrust - expected[1].get(host, 0)) < 1e-6
    assert url_filters.judge_urls(df.limit(0), "page_id", "url", "html", RULES).count() == 0


@pytest.mark.parametrize("farms", [3, 40])
def test_every_farm_of_a_blocked_host_is_blocked(spark, farms):
    link = lambda h: f'<a href="https://{h}/p">l</a>'
    pages = [(0, "http://worse.org/", link("worse2.worse.org")), (1, "http://worse2.worse.org/", link("worse.org"))]
    pages += [(10 + i, f"http://farm{i}.net/", link("worse.org")) for i in range(farms)]
    pages += [(100, "http://second.net/", link("farm0.net")), (101, "http://tenth.net/", link("worse.org") + link("fine.net") * 9)]
    pages += [(102, "http://half.net/", link("worse.org") + link("fine.net")), (103, "http://fine.net/", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(df, "page_id", "url", "html", RULES).collect()}
    blocked = {0, 1, 100, *range(10, 10 + farms)}
    assert got == {p[0]: "block" if p[0] in blocked else "allow" for p in pages}
    scores = {r.host: r for r in url_filters.host_scores(df, "url", "html", RULES).collect()}
    expected = {"worse.org": 1, "farm0.net": 0.85, "second.net": 0.7225, "half.net": 0.425, "tenth.net": 0.085}
    assert all(abs(scores[h].exposure - e) < 1e-6 for h, e in expected.items())


def ranks_by_definition(edges, damping=0.85, rounds=10):
    # good.com: one of two pages allowed (the other has no path); worse.org and sub.bad.com blocked
    seeds = ({"good.com": 0.5}, {"worse.org": 1.0, "sub.bad.com": 1.0})
    out = []
    for seed, way in zip(seeds, (edges, {(b, a): n for (a, b), n in edges.items()})):
        total = {}
        for (a, _), n in way.items():
            total[a] = total.get(a, 0) + n
        base = {h: (1 - damping) * s for h, s in seed.items()}
        score = dict(base)
        for _ in range(rounds):
            new = dict(base)
            for (a, b), n in way.items():
                if score.get(a):
                    new[b] = new.get(b, 0) + damping * score[a] * n / total[a]
            score = new
        out.append({h: s / (1 - damping) for h, s in score.items()})
    return out


def test_archives_round_trip(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" * 3000
    pages = [
        (1, "http://a/é\r\n x", "same"), (2, None, "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"),
        (None, "u", "only null"), (7, "u", big), (8, "u", big + "x"), (9, "u", "twice"), (9, "u", "twice"), (10, "u", "Content-Length: 3\r\n\r\n"),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, chunk int")
    for chunk in (7, 1000, 1 << 20):
        path = scratch_path(spark, "warc")
        warc.archive_pages(df, path, chunk_bytes=chunk)
        got = sorted((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
        expected = []
        for i, _, html in pages:
            data = (html or "").encode()
            alike = [k for k, _, h in pages if (h or "") == (html or "") and k is not None]
            first = max(alike, default=None)
            refers = str(first) if first is not None and first != i else None
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            expected.append(("null" if i is None else str(i), len(data), digest, "revisit" if refers else "response", refers))
        assert [tuple(map(str, g)) for g in got] == sorted(tuple(map(str, e)) for e in expected)
    urls = {r.url for r in warc.read_archives(spark, path).collect()}
    assert "http://a/é\r\n x" in urls and None in urls
    segments = warc.chunks(df.filter("page_id = 7"), "page_id", "url", "html", 1000).orderBy("chunk").collect()
    assert b"".join(bytes(r.data) for r in segments).decode() == big
    assert segments[0].so_far == base64.b32encode(hashlib.sha1(big[:1000].encode()).digest()).decode()
    empty = scratch_path(spark, "warc")
    warc.archive_pages(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_broken_archives_are_refused():
    row = {"key": "1", "url": None, "chunk": 0, "chunks": 1, "data": b"abc", "payload_bytes": 3, "so_far": "A" * 32, "role": "response", "refers_to": None}
    whole = warc._record(row | {"so_far": warc.base32_sha1(hashlib.sha1(b"abc"))}) + warc.END
    assert next(warc.parse_archive(memoryview(whole)))["payload_bytes"] == 3
    for broken in (whole[:-20], warc._record(row) + warc.END, whole.replace(b"Content-Length: 3\r\n\r\nabc", b"Content-Length: 3\r\n\r\nabcd"), b"x" + whole):
        with pytest.raises(ValueError):
            list(warc.parse_archive(memoryview(broken)))


# ---- 7 ------------------------------------------------------------------------------


def longest_matches(w):
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_suffix_matches():
    rng = random.Random(11)
    for _ in range(150):
        texts = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        words = common.words_of(pa.array(texts), common.BLANK_WORDS)
        assert repetition.suffix_matches(words).tolist() == sum((longest_matches(t.split()) for t in texts), [])


def test_quality_measures(spark):
    fresh = " ".join(f"word{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = EDGES + [
        (20, fresh), (21, "a b\na b\n\n \na b\nc"), (22, "x " * 300), (23, f"{passage} {fresh} {fresh.upper()} {passage}"),
        (24, " ".join([fresh, *(" ".join(f"p{i}" for i in range(k, k + 20)) for k in (0, 20, 40) for _ in range(3))])), (25, "# * $ a|b <c> " + fresh),
    ]
    got = {r.doc_id: r for r in repetition.quality_measures(table(spark, rows), "doc_id", "text").collect()}
    assert repetition.quality_measures(table(spark, rows), "doc_id", "text").count() == len(rows)
    assert (got[1].n_words, got[1].word_chars, got[1].base_failed, got[1].kept) == (0, 0, True, False)
    assert got[20].kept and (got[20].n_repeat_words, got[20].longest_repeat) == (0, 0)
    assert (got[21].n_dup_lines, got[21].n_words) == (2, 7)
    assert got[22].base_failed and (got[22].n_repeat_words, got[22].longest_repeat) == (300, 299)
    assert not got[23].base_failed and not got[23].kept and got[23].longest_repeat == 120
    assert not got[24].base_failed and not got[24].kept and got[24].n_covered_words == 180
    assert got[25].n_symbols == 6 and got[9].word_chars == sum(len(w) for w in "É ñ ß 漢字   end".split(" "))
    kept = repetition.quality_filter(table(spark, rows), "text")
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert kept.columns == table(spark, []).columns
    spans = repetition.repeated_spans(table(spark, [(23, rows[-3][1])]), "doc_id", "text").collect()
    assert {(r.first_word, r.n_words) for r in spans} == {(0, 120), (520, 120)} and spans[0]["words"] == passage
    assert repetition.quality_measures(table(spark, []), "doc_id", "text").count() == 0


# ---- 8 ------------------------------------------------------------------------------


def test_pseudonyms(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111111111111111.", "not one: 4111111111111112", "+1 (017) 555-7713 or 212-555-0199",
        "at 97.51.17.173, not 999.1.1.1 or 1.2.3.4.5", "1999-12-31 is 31.12.1999 and 12/31/1999; 2001-02-30 is none", "joe.34@mail7.example.com", None, "", "plain",
    ]
    df = table(spark, list(enumerate(texts, 1)))
    new = pii.pseudonymise(df, "text", "k", counts="found")
    rows = {r.doc_id: r for r in new.collect()}
    first, second = re.findall(r"\d[\d ]{14,}\d", rows[1].text)
    assert first.replace(" ", "") == second != "4111111111111111" and first[4] == " "
    digits = [int(c) for c in second]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert rows[2].text == texts[1] and rows[9].text == "plain" and rows[7].text is None and rows[8].text == ""
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", rows[3].text)
    address = re.match(r"at (\d+)\.(\d+)\.(\d+)\.(\d+), not 999\.1\.1\.1 or 1\.2\.3\.4\.5$", rows[4].text)
    assert all(int(g) < 256 for g in address.groups()) and rows[4].found.ipv4 == 1
    iso, dmy, mdy = re.match(r"(\S+) is (\S+) and (\S+); 2001-02-30 is none", rows[5].text).groups()
    assert iso != "1999-12-31" and dmy == ".".join(iso.split("-")[::-1]) and mdy == f"{iso[5:7]}/{iso[8:]}/{iso[:4]}"
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", rows[6].text) and rows[6].text != texts[5]
    back = {r.doc_id: r.text for r in pii.pseudonymise(new.drop("found"), "text", "k", undo=True).collect()}
    assert back == dict(enumerate(texts, 1))
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "text", "another key").collect()}
    assert other[1] != rows[1].text
    assert pii.pseudonymise(table(spark, []), "text", "k").count() == 0


def test_cards_beside_other_numbers(spark):
    card, grouped, short = "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005"
    forms = [
        "{} 12/27", "{} 123", "{} 2 items", "{} 12/27 123", "no. 7 {} end", "2-{}", "{} 01/02/2027", "{} 2027-01-05", "{}/12", "x {}, 1"
    ]
    texts = [f.format(c) for c in (card, grouped, grouped.replace(" ", "-"), short) for f in forms]
    texts += [f"{grouped} {code}" for code in range(100, 180)] + ["4111111111111112 123", "12 34 56 78 90 12 34 56"]
    df = table(spark, list(enumerate(texts, 1)))
    new = pii.pseudonymise(df, "text", "k", counts="found")
    rows = {r.doc_id: r for r in new.collect()}
    for i, text in enumerate(texts[:-2], 1):
        assert rows[i].found.card == 1 and len(rows[i].text) == len(text)
        assert not any(c in rows[i].text for c in (card, grouped, grouped.replace(" ", "-"), short))
    assert rows[7].found.date == rows[8].found.date == 1
    assert [rows[i].text for i in (len(texts) - 1, len(texts))] == texts[-2:]
    back = {r.doc_id: r.text for r in pii.pseudonymise(new.drop("found"), "text", "k", undo=True).collect()}
    assert back == dict(enumerate(texts, 1))


def plain_feistel(text, key):
    """The network of ``feistel_text`` in plain Python."""
    state, half = text, len(text) // 2
    for number in range(pii.ROUNDS):
        left, right = state[:half], state[half:]
        target, other = (left, right) if number % 2 == 0 else (right, left)
        new = ""
        for i, c in enumerate(target):
            by = int(hashlib.sha256(f"{key}|{number}|{i}|{other}".encode()).hexdigest()[:12], 16) % 260
            low, size = (48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26)
            new += chr((ord(c) - low + by) % size + low)
        state = new + right if number % 2 == 0 else left + new
    return state


def test_pseudonyms_keep_the_written_shape(spark):
    dates = [
        "1.2.1999", "01.02.1999", "01.2.1999", "1.02.1999", "3/4/1999", "03/04/1999", "3/04/1999", "31/12/1999", "31/5/1999", "29.2.2000",
        "13/01/1900", "9/30/2099", "30/9/2099", "1/1/1900", "9.9.2099", "2000-02-29",
    ]
    dates += [f"{d}.{m}.{y}" for d in (1, 5, 9) for m in (1, 4, 9) for y in range(1990, 2000)]
    dates += [f"{d}/{m}/1987" for d in range(13, 31) for m in (1, 3, 4, 9, 10, 12)]
    numbers = ["123-45-6789", "899-01-0001", "DE89370400440532013000", "GB29NWBK60161331926819", "10.1.2.3", "0.0.0.0"]
    stay = [
        "010.1.2.3", "32/12/1999", "30.2.1999", "31/13/1999", "1/1/1899", "000-12-3456", "666-12-3456", "123-00-6789",
        "DE88370400440532013000", "xDE89370400440532013000", "123-45-67890", "DE00370400440532013000",
    ]
    values = dates + numbers + stay
    df = table(spark, [(i, f"on {v}, or {v} so") for i, v in enumerate(values)] + [(i, f"on {v}, or {v} so") for i, v in enumerate(values)])
    new = pii.pseudonymise(df, "text", "k", counts="found")
    rows = new.collect()
    got = {}
    for r in rows:
        one, two = re.fullmatch(r"on (.*), or (.*) so", r.text).groups()
        assert one == two and got.setdefault(values[r.doc_id], one) == one
    assert all(got[v] == v for v in stay) and all(got[v] != v for v in dates + numbers)
    assert len(set(got.values())) == len(values)
    shape = lambda v: re.sub(r"[0-9]", "0", v)
    assert all(shape(got[v]) == shape(v) for v in dates + ["123-45-6789", "899-01-0001", "DE89370400440532013000"])
    for v in dates:
        year, month, day = [int(x) for x in (got[v].split("-") if "-" in v else re.split(r"[./]", got[v])[::-1])]
        if "/" in v and int(v.split("/")[0]) <= 12:
            month, day = day, month
        assert 1900 <= datetime.date(year, month, day).year <= 2099
    counts = {values[r.doc_id]: r.found for r in rows}
    assert all(counts[v].date == 2 for v in dates) and counts["123-45-6789"].ssn == counts["GB29NWBK60161331926819"].iban == 2
    for v in ("DE89370400440532013000", "GB29NWBK60161331926819"):
        new_one = got[v]
        assert new_one[:2] == v[:2] and int("".join(str(int(c, 36)) for c in new_one[4:] + new_one[:4])) % 97 == 1
        assert new_one[4:] == plain_feistel(v[4:], "k|iban")
    for v in ("123-45-6789", "899-01-0001"):
        walked = v
        while walked == v or not re.match(pii.SSN_USED, walked):
            digits = plain_feistel(walked.replace("-", ""), "k|ssn")
            walked = f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"
        assert got[v] == walked
    back = pii.pseudonymise(new.drop("found"), "text", "k", undo=True)
    assert sorted(back.select("doc_id", "text").collect()) == sorted(df.select("doc_id", "text").collect())


def test_pseudonyms_of_a_very_long_text(spark):
    text = "pay 1.2.1999 to 123-45-6789 now " * 4000
    row = pii.pseudonymise(table(spark, [(1, text)]), "text", "k", counts="found").first()
    assert (row.found.date, row.found.ssn) == (4000, 4000) and len(row.text) == len(text)
    assert row.text == row.text[:32] * 4000 and row.text[:32] != text[:32]


def test_feistel_numbers_are_a_permutation(spark):
    df = spark.range(49).select(pii.feistel_number(F.col("id"), 7, "k").alias("v"))
    assert sorted(r.v for r in df.collect()) == list(range(49))
    days = spark.range(0, 73049, 7).select("id", pii._in_range(F.col("id"), "k", False).alias("v"))
    back = days.select("id", "v", pii._in_range(F.col("v"), "k", True).alias("b"))
    assert back.filter("b <> id OR v < 0 OR v >= 73049").count() == 0
    assert back.select("v").distinct().count() == back.count()


def test_no_python_on_the_pseudonym_path(spark):
    plan = pii.pseudonymise(table(spark, EDGES), "text", "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 9 and 10 -----------------------------------------------------------------------


def test_license_matches(spark):
    rng = random.Random(13)
    filler = lambda n: " ".join(f"f{rng.randint(0, 5000)}" for _ in range(n))
    rows, planted = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for j, before in enumerate((0, 1, 37, 500)):
            rows.append((1000 * k + j, f"{filler(before)} {text.upper()} {filler(rng.randint(0, 50))}"))
            planted.add((1000 * k + j, name))
        words = text.split()
        if len(words) > 30:  # one word in the middle changed: a containment above 0.8
            words[len(words) // 2] = "changed"
            rows.append((1000 * k + 9, f"{filler(100)} {' '.join(words)} {filler(100)}"))
            planted.add((1000 * k + 9, name))

    def shingles(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {name: shingles(text) for name, text in licenses.TEMPLATES.items()}
    # some templates hold most of another
    expected = {(i, n) for i, t in rows for n, s in sets.items() if len(s & shingles(t)) >= 0.8 * len(s)}
    assert planted < expected
    rows += [(10**6 + i if i else None, t) for i, t in EDGES]
    got = licenses.license_matches(table(spark, rows)).collect()
    assert {(r.doc_id, r.license) for r in got} == expected
    exact = [r for r in got if (r.doc_id, r.license) in planted and r.doc_id % 1000 < 9]
    assert len(exact) == 4 * len(sets) and all(r.containment == 1.0 for r in exact)
    assert {r.first_word for r in exact if r.doc_id % 1000 == 2} == {37}
    assert licenses.hit_chance(0.36) > 1 - 1e-6
    assert licenses.license_matches(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.template_classes({"none": "..."})


def test_language_of(spark):
    rng = random.Random(17)
    parts = {"aa": ["ba", "ka", "ta", "ra"], "bb": ["shi", "mo", "no", "ke"], "cc": ["ölg", "ürt", "äk", "ß"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(3, 60))), lang))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ...", "cc"), (1003, "baka tara kata", None), (None, "shimo noke moshi", "bb"), (1004, LONG, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, score double")
    got = language_id.language_of(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == lang for i, _, lang in rows[:600])
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "aa" and by[None].lang_pred == "bb" and not by[None].held_out
    import zlib

    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    assert by[1004].rejected and language_id.language_of(df.limit(0)).count() == 0
    unlabelled = language_id.language_of(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
