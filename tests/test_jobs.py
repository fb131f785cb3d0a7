"""The jobs end to end, clusters and the registered queries."""

import base64
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from check import difference
from filings.functions.text import words
from filings.operators.cluster import (
    cluster_report,
    fit_clusters,
    hash_vocabulary,
    hashed_tf,
    idf_weight,
)
from filings.plans.jobs import (
    VARIANTS,
    Variant,
    cluster_job,
    cluster_terms,
    cluster_texts,
    cluster_tokens,
    phrase_job,
    phrase_outcome,
    table_job,
    table_outcome,
    tagcheck_job,
    tagcheck_outcome,
)

SF = "/root/testdata/sf0.001"
CT = "http://www.govtalk.gov.uk/taxation/CT/"


def filed(path, mark, *pages):
    body = "".join(
        f"<Instance><F>{base64.b64encode(p.encode()).decode()}</F></Instance>" for p in pages
    )
    source = (
        '<E xmlns="http://www.govtalk.gov.uk/CM/envelope"><Key>77</Key>'
        f'<I xmlns="{CT}9"><To>2017-03-31</To><IRmark>{mark}</IRmark>'
        f"<Computation>{body}</Computation></I></E>"
    )
    return (path, bytearray(source.encode()))


def test_phrase_job_counts_attachments_and_lists_marks(spark):
    words15 = " ".join(f"w{chr(97 + i)}" for i in range(15))
    footer = f"<a><p>{words15} out</p><div class='foot'>{words15} tail 2017 end</div></a>"
    other = f"<a><div class='foot'>{words15}</div></a>"
    files = [
        filed("f/1", "M2", footer, footer, "<broken"),
        filed("f/2", "M1", other),
        filed("g/3", "M1", "<a><div class='foot'>too short</div></a>"),
        ("g/4", bytearray(b"not xml")),
    ]
    corpus = spark.createDataFrame(files, "path string, content binary")
    (row,) = phrase_job(corpus, low=2, high=5).collect()
    assert (row.phrase, row.irmarks, row.n) == (words15, ["M1", "M2", "M2"], 3)
    assert phrase_job(corpus, low=4, high=5).count() == 0


def test_table_job_keeps_listed_taxpayers(spark):
    page = (
        '<html xmlns="http://www.w3.org/1999/xhtml"><p>Tax reconciliation</p>'
        "<table><tr><td>a</td></tr></table></html>"
    )
    corpus = spark.createDataFrame(
        [filed("f/1", "M1", page, "<x/>")], "path string, content binary"
    )
    listed = spark.createDataFrame([("77",)], "key string")
    rows = table_job(corpus, listed).orderBy("pos").collect()
    assert [(r.irmark, r.utr, r.period_to, r.pos) for r in rows] == [
        ("M1", "77", "2017-03-31", 0),
        ("M1", "77", "2017-03-31", 1),
    ]
    assert rows[0].tables[0].rows[0].cells == ["a"] and rows[1].tables == []
    assert table_job(corpus, listed.filter("key = 'x'")).count() == 0


def test_tagcheck_job_skips_broken_files(spark):
    page = "<a>\n<p>we are a small company</p><f name='n'>We are a small company.</f></a>"
    rows = [("f/1", bytearray(page.encode())), ("f/2", bytearray(b"<a"))]
    corpus = spark.createDataFrame(rows, "path string, content binary")
    (row,) = tagcheck_job(corpus).collect()
    assert (row.path, row.name, row.context) == ("f/1", "n", "Ukn Conv")


THEMES = ["apple pear plum fig", "red green blue pink", "one two three four"]


@pytest.fixture(scope="module")
def themed(spark):
    """Thirty documents on three themes."""
    rows = [
        (n, [" ".join([THEMES[n % 3]] * (1 + n % 4)) + " the"]) for n in range(30)
    ]
    return spark.createDataFrame(rows, "doc_id int, fragments array<string>")


def test_clusters_find_the_themes_and_name_them(spark, themed):
    variant = Variant(1000, k=3, max_iter=10, runs=3)
    clusters = cluster_texts(themed, variant, ["the"])
    rows = clusters.documents.collect()
    groups = Counter((r.doc_id % 3, r.cluster) for r in rows)
    assert len(rows) == 30 and len(groups) == 3
    named = clusters.explain().collect()
    for theme in range(3):
        (cluster,) = {c for t, c in groups if t == theme}
        terms = {r.term for r in named if r.cluster == cluster}
        assert set(THEMES[theme].split()) <= terms and "the" not in terms
    top = clusters.explain(top=2).collect()
    assert Counter(r.cluster for r in top) == {0: 2, 1: 2, 2: 2}
    report = cluster_report(clusters.documents, "doc_id").first()
    assert report.tfidf.size == 1000 and set(report.terms)


def test_more_runs_never_cost_more_and_seeds_repeat(spark, themed):
    hashed = hashed_tf(themed.withColumn("terms", words(F.col("fragments")[0])), 500)
    weighted = idf_weight(hashed).cache()
    costs = [
        fit_clusters(weighted, 4, 5, runs, seed=2).summary.trainingCost for runs in (1, 3, 6)
    ]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(costs, costs[1:]))
    again = [fit_clusters(weighted, 4, 5, seed=2).clusterCenters() for _ in range(2)]
    assert np.array_equal(*again)
    # More clusters than distinct documents.
    same = weighted.filter("doc_id = 0")
    assert len(fit_clusters(same, 4, 5).clusterCenters()) == 1


def test_idf_and_vocabulary(spark):
    rows = [(n, ["all"] + (["six"] if n < 6 else []) + (["four"] if n < 4 else [])) for n in range(9)]
    documents = spark.createDataFrame(rows, "doc_id int, terms array<string>")
    index = {r.term: r["index"] for r in hash_vocabulary(documents, 5000).collect()}
    assert set(index) == {"all", "six", "four"}
    row = idf_weight(hashed_tf(documents, 5000)).filter("doc_id = 0").first()
    weights = {term: row.tfidf[at] for term, at in index.items()}
    assert weights["all"] == 0 and weights["four"] == 0
    assert math.isclose(weights["six"], math.log(10 / 7))
    crowded = hash_vocabulary(documents, 1).collect()
    assert sorted((r["index"], r.term) for r in crowded) == [(0, "all"), (0, "four"), (0, "six")]


def test_variants_of_terms(spark):
    rows = spark.createDataFrame([(["The cat -  sat", "on a b c d mat"],)], "f array<string>")
    terms = {
        name: rows.select(cluster_terms(cluster_tokens(F.col("f"), v, ["The", "a"]), v)).first()[0]
        for name, v in VARIANTS.items()
    }
    assert terms["words"] == "The cat -  sat on a b c d mat".split(" ")
    assert terms["stopworded"] == "cat sat on b c d mat".split()
    assert terms["ngrams"] == ["cat sat on b c", "sat on b c d", "on b c d mat"]


def test_cluster_job_on_files(spark):
    pages = [
        (f"f/{n}", bytearray(f"<a>\n<p>{THEMES[n % 3]} and {THEMES[n % 3]}</p></a>".encode()))
        for n in range(18)
    ] + [("f/bad", bytearray(b"<a"))]
    corpus = spark.createDataFrame(pages, "path string, content binary")
    clusters = cluster_job(corpus, Variant(500, 3, 5, 1), ["and"])
    rows = clusters.documents.collect()
    assert len(rows) == 18
    (reject,) = clusters.rejects.collect()
    assert (reject.path, reject.stage) == ("f/bad", "document") and reject.reason
    with pytest.raises(ValueError, match="stop words"):
        cluster_job(corpus, VARIANTS["ngrams"])
    assert len({(int(r.path[2:]) % 3, r.cluster) for r in rows}) == 3


def test_every_query_has_sql_or_is_not_expressible():
    optional = {"pipeline"} | {name for name in registered.queries() if name.startswith("op")}
    assert set(registered.queries()) - set(registered.oracle_sql()) <= optional
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    database = duckdb.connect()
    for table in ("customer", "documents", "embeddings", "lineitem", "orders", "pages"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours = registered.queries()[name](spark, SF).toPandas()
    assert len(ours) > 0
    assert difference(ours, database.execute(registered.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_outcomes_name_what_was_not_read(spark):
    page = (
        '<html xmlns="http://www.w3.org/1999/xhtml"><p>Tax reconciliation</p>'
        "<table><tr><td>a</td></tr></table></html>"
    )
    path, good = filed("f/1", "M1", page, "<broken")
    bad = bytes(good).replace(b"</Computation>", b"<Instance><F>x</F></Instance></Computation>")
    rows = [(path, good), ("f/2", bytearray(bad)), ("f/3", bytearray(b"<cut"))]
    corpus = spark.createDataFrame(rows, "path string, content binary")
    outcome = table_outcome(corpus)
    found = {(r.path, r.pos, r.stage) for r in outcome.rejects.collect()}
    assert found == {
        ("f/1", 1, "document"), ("f/2", 1, "document"), ("f/2", 2, "attachment"),
        ("f/3", None, "envelope"),
    }
    assert all(r.reason for r in outcome.rejects.collect())
    kept = lambda rows: sorted((r.path, r.pos) for r in rows.collect())
    assert kept(outcome.rows) == kept(table_job(corpus)) == [("f/1", 0), ("f/2", 0)]
    assert {r.stage for r in phrase_outcome(corpus).rejects.collect()} == {
        "document", "attachment", "envelope"
    }
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in outcome.rejects.inputFiles()}
    outcome.release()
    assert not os.path.exists(folder)


def test_tagcheck_outcome(spark):
    page = "<a>\n<p>we are a small company</p><f name='n'>We are a small company.</f></a>"
    rows = [("f/1", bytearray(page.encode())), ("f/2", bytearray(b"<a"))]
    corpus = spark.createDataFrame(rows, "path string, content binary")
    outcome = tagcheck_outcome(corpus)
    assert [r.path for r in outcome.rows.collect()] == ["f/1"]
    assert [(r.path, r.stage) for r in outcome.rejects.collect()] == [("f/2", "document")]


def test_only_named_parts_are_made(spark):
    corpus = spark.createDataFrame([filed("f/1", "M1", "<a/>")], "path string, content binary")
    made = table_job(corpus, parts=("tables",))
    assert "tables" in made.columns and "sections" not in made.columns
    assert "sections" not in made._jdf.queryExecution().toString()


def test_attachments_of_other_kinds(spark):
    path, source = filed("f/1", "M1", "<a/>")
    more = bytes(source).replace(b"</I>", b"<Accounts><Instance><F>PGIvPg==</F></Instance></Accounts></I>")
    corpus = spark.createDataFrame([(path, bytearray(more))], "path string, content binary")
    kinds = ("Computation", "Accounts")
    assert table_job(corpus).count() == 1
    assert sorted(r.pos for r in table_job(corpus, kinds=kinds).collect()) == [0, 1]


def test_clusters_do_not_depend_on_the_layout(spark, themed):
    variant = Variant(1000, k=4, max_iter=3, runs=1)
    results = []
    for n in (1, 5):
        documents = cluster_texts(themed.repartition(n), variant, ["the"]).documents
        results.append({r.doc_id: r.cluster for r in documents.collect()})
    assert results[0] == results[1]
