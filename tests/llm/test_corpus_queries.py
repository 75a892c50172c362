"""The registered corpus queries at the smallest scale: against SQL, or for their rows."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in entry.CORPUS_QUERIES if n in entry.CORPUS_SQL]
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, entry.CORPUS_SQL[name]) is None


def test_urls_follow_the_rules(spark):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op5_url_filters"](spark, FOLDER).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = urls[r.page_id].split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [
            rule for rule in rules
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0]))
            and path.startswith(rule[rule.index("/"):])
        ]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")


def test_languages_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op10_language"](spark, folder).collect() if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows)
    assert len(rows) > 200 and right >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_licenses_equal_a_plain_search(spark):
    from kinvote.llm.licenses import TEMPLATES

    def words(text):
        return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text).split()

    plain = {name: f" {' '.join(words(text))} " for name, text in TEMPLATES.items()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    expected = {(d.doc_id, n) for d in docs for n, t in plain.items() if t in f" {' '.join(words(d.text))} "}
    got = QUERIES["op9_licenses"](spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.license) for r in got if r.containment == 1.0} == expected
    assert len(got) == len({(r.doc_id, r.license) for r in got}) and expected


def test_pseudonyms_can_be_undone(spark):
    from kinvote.llm import pii, queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    changed = QUERIES["op8_pii"](spark, "/root/testdata/sf0.01")
    back = {r.doc_id: r.text for r in pii.pseudonymise(changed, "text", queries.PSEUDONYM_KEY, undo=True).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    now = {r.doc_id: r for r in changed.collect()}
    assert back == before
    found = {i for i, r in now.items() if sum(r[f"n_{k}"] for k in pii.KINDS)}
    assert found and all(now[i].text != before[i] for i in found)
    assert all(now[i].text == before[i] for i in before if i not in found)
    assert all(len(now[i].text) == len(before[i]) for i in found if not now[i].n_ipv4 and not now[i].n_date)
