"""SQL functions and the table function against the column functions."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import q_block15_sql, q_ngram5_sql
from filings.functions import text as t
from filings.functions.lateral import register_parse_elements
from filings.functions.sql import register_functions
from filings.operators.markup import parse_elements, parse_markup, well_formed

TEXTS = ["", "one two  three", "a1 b_2 c　d 4e the", " \tx  ", "w " * 40, None]


def plan(rows):
    """The optimized plan without the numbers of its columns."""
    import re

    return re.sub(r"#\d+L?", "#", rows._jdf.queryExecution().optimizedPlan().toString())


@pytest.fixture(scope="module")
def texts(spark):
    register_functions(spark)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "i int, s string")
    rows.createOrReplaceTempView("texts")
    return rows


@pytest.mark.parametrize(
    "call, column",
    [
        ("strip_text(s)", lambda s: t.strip(s)),
        ("words(s)", lambda s: t.words(s)),
        ("word_tokens(s)", lambda s: t.word_tokens(s)),
        ("alpha_tokens(s)", lambda s: t.alpha_tokens(s)),
        ("space_tokens(s)", lambda s: t.space_tokens(s)),
        ("join_words(words(s))", lambda s: t.join_words(t.words(s))),
        ("ngrams(words(s), 2)", lambda s: t.ngrams(t.words(s), 2)),
        ("block_ngrams(words(s), 15)", lambda s: t.block_ngrams(t.words(s), 15)),
        ("remove_stopwords(words(s), array('the', 'one'))", lambda s: t.remove_stopwords(t.words(s), ["the", "one"])),
    ],
)
def test_functions_like_the_columns(spark, texts, call, column):
    found = spark.sql(f"SELECT i, {call} AS value FROM texts ORDER BY i").collect()
    assert found == texts.select("i", column(F.col("s")).alias("value")).orderBy("i").collect()


def test_the_plan_is_that_of_the_expressions(spark, texts):
    sql = spark.sql("SELECT i, alpha_tokens(lower(s)) AS value FROM texts")
    assert plan(sql) == plan(texts.select("i", t.alpha_tokens(F.lower("s")).alias("value")))
    grams = plan(spark.sql("SELECT explode(g) AS term FROM (SELECT ngrams(word_tokens(s), 5) AS g FROM texts)"))
    assert "Python" not in grams and "ngrams" not in grams and "transform(" in grams


def test_elements_of_a_table_function(spark):
    pages = ["<a>x\n<b c='1'> y </b> tail<i/>\n<p>\n<b> style </b></p></a>", "<a><!--note--><b>", "<a/>", None]
    rows = spark.createDataFrame([(i, p.encode() if p else None) for i, p in enumerate(pages)], "i int, content binary")
    rows.createOrReplaceTempView("some_pages")
    register_parse_elements(spark)
    fields = ["seq", "end_seq", "parent_seq", "depth", "kind", "qname", "attrs", "text", "tail", "text_no"]
    found = spark.sql(f"SELECT i, e.* FROM some_pages, LATERAL parse_elements(content, '{', '.join(fields)}') e")
    expected = parse_elements(well_formed(parse_markup(rows)), columns=fields)
    key = lambda r: (r.i, r.seq)
    assert found.schema.names == expected.schema.names
    assert sorted(found.collect(), key=key) == sorted(expected.collect(), key=key)
    every = spark.sql("SELECT * FROM some_pages, LATERAL parse_elements(decode(content, 'UTF-8'))")
    assert every.filter("i = 0").count() == found.filter("i = 0").count() > 1
    for call in ("parse_elements(content, 'seq, nothing')", "parse_elements(i)", "parse_elements(content, cast(i AS string))"):
        with pytest.raises(Exception, match="parse_elements:"):
            spark.sql(f"SELECT * FROM some_pages, LATERAL {call}").collect()


def test_runs_of_words_are_made_once(spark):
    for query in (q_ngram5_sql, q_block15_sql):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
