"""Registered queries and the SQL that checks them.

Every query reads whole tables. Markup queries parse documents that Spark
writes from the tables (`filings.plans.sample_corpus`), so that plain SQL on
the same tables knows the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions.lateral import register_parse_elements
from filings.functions.sql import register_functions
from filings.functions.text import (
    alpha_tokens,
    block_ngrams,
    ngrams,
    remove_stopwords,
    space_tokens,
    word_tokens,
)
from filings.operators.cluster import (
    cluster_means,
    cluster_report,
    hash_vocabulary,
    hashed_tf,
    idf_weight,
    nearest_centres,
    term_weights,
    vector_entries,
)
from filings.operators.computed import computed
from filings.operators.envelope import (
    decode_attachments,
    explode_attachments,
    normalise_namespace,
    submission_flags,
    submissions,
)
from filings.operators.facts import (
    documents_with_text,
    line_fragments,
    resolve_facts,
    with_facts,
    with_fragments,
)
from filings.operators.increments import FolderCounts
from filings.operators.keys import restrict_to_keys
from filings.operators.markup import (
    footer_subtrees,
    parse_elements,
    parse_markup,
    parse_rows,
    quarantine,
    well_formed,
)
from filings.operators.phrases import (
    phrase_band,
    phrase_count_histogram,
    phrase_counts,
    phrase_postings,
    phrase_with_count,
    phrase_with_irmark,
    with_phrases,
)
from filings.operators.storage import materialise, new_path, release
from filings.operators.structure import cell_rows, footer_rows, section_rows
from filings.operators.tables import (
    render_tables,
    select_tables,
    sibling_sections,
    table_cells,
    with_cells,
    with_sections,
)
from filings.operators.tagging import tag_lookup, tag_lookup_fuzzy
from filings.operators.terms import (
    doc_frequency,
    preview,
    tfidf_terms,
    word_count,
)
from filings.operators.tagging import FUZZY_THRESHOLD
from filings.operators.vocabulary import id_vectors, term_ids, term_rows
from filings.plans.jobs import (
    CLUSTER_MIN_WORDS,
    PHRASE_MIN_WORDS,
    TAG_MIN_WORDS,
    VARIANTS,
    cluster_job,
    cluster_texts,
    count_folder,
    phrase_job,
    phrase_outcome,
    table_job,
    table_outcome,
    tagcheck_job,
    word_count_job,
)
from filings.plans.sample_corpus import (
    HEADINGS,
    TAXATION_YEAR,
    customer_pages,
    footer_envelopes,
    footer_pages,
    item_envelopes,
    item_pages,
    mixed_files,
    order_envelopes,
    order_pages,
    prose_pages,
    segment_pages,
    segment_text,
)
from filings.schemas import FACT_FIELDS, FOOTER_FIELDS, TABLE_FIELDS
from filings.sinks.export import (
    csv_text,
    encode_cp1252,
    export_tables,
    write_cells,
    write_phrases,
)
from filings.sinks.named import write_named
from filings.sources.corpus import (
    read_cells,
    read_corpus,
    read_index,
    read_key_list,
    read_lines,
    read_phrase_lines,
    read_phrases,
    spread,
    spread_tasks,
)

from filings.sources.packed import PackedCorpus

# The operators for training data are a subpackage that may be absent; what they
# themselves fail to import is an error.
try:
    import corpus_pipeline
    from filings.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "filings.llm", "filings.llm.queries"):
        raise
    corpus_pipeline = llm = None

SF_ENTRY = "/root/testdata/sf0.001"

# The stop words of these queries; the operators take any list.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is",
    "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "de", "des", "la", "le", "les", "un", "une", "der", "die", "das", "und",
)

# Shared 15-word blocks are rare in the test tables, so the band starts at 2.
BAND = (2, 199)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows Python will parse."""
    return spread(_table(spark, sf_dir, name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _lines(spark: SparkSession, sf_dir: str, min_words: int) -> DataFrame:
    """Documents with their long lines as fragments."""
    fragments = line_fragments(F.col("text"), min_words)
    documents = computed(_documents(spark, sf_dir), fragments=fragments)
    return documents_with_text(documents, "fragments").select(
        "doc_id", "source", "fragments"
    )


def _tokens(spark: SparkSession, sf_dir: str, tokens) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select(
        "doc_id", F.posexplode(tokens(F.lower("text"))).alias("pos", "token")
    )


def _joined(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("irmarks", F.array_join("irmarks", ","))


# Words and text


def q_word_count(spark, sf_dir):
    return word_count(_documents(spark, sf_dir), "text")


def q_top_words_preview(spark, sf_dir):
    return preview(word_count(_documents(spark, sf_dir), "text"))


def q_fragments_long(spark, sf_dir):
    return _lines(spark, sf_dir, CLUSTER_MIN_WORDS).select(
        "doc_id", F.posexplode("fragments").alias("frag_no", "fragment")
    )


def q_documents_with_text(spark, sf_dir):
    return _lines(spark, sf_dir, CLUSTER_MIN_WORDS).select("doc_id")


def q_tokens_word(spark, sf_dir):
    return _tokens(spark, sf_dir, word_tokens)


def q_tokens_alpha(spark, sf_dir):
    return _tokens(spark, sf_dir, alpha_tokens)


def q_tokens_space(spark, sf_dir):
    return _tokens(spark, sf_dir, space_tokens)


def q_stopword_filtered(spark, sf_dir):
    return _tokens(
        spark, sf_dir, lambda text: remove_stopwords(word_tokens(text), STOPWORDS)
    )


def q_ngram5_docfreq(spark, sf_dir):
    terms = ngrams(word_tokens(F.lower("text")), 5)
    return doc_frequency(_documents(spark, sf_dir), terms).filter("df >= 5")


def q_ngram15_distinct(spark, sf_dir):
    phrases = ngrams(alpha_tokens(F.lower("text")), 15, distinct=True)
    return _documents(spark, sf_dir).select(
        "doc_id", F.explode(phrases).alias("phrase")
    )


def q_ngram5_sql(spark, sf_dir):
    """The document frequencies of 5-grams in SQL alone.

    `explode` would add filters that make the n-grams again; `explode_outer` has none,
    and the nulls that it gives are left out above.
    """
    register_functions(spark)
    _documents(spark, sf_dir).createOrReplaceTempView("documents")
    return spark.sql(
        "WITH grams AS (SELECT array_distinct(ngrams(word_tokens(lower(text)), 5)) AS terms FROM documents) "
        "SELECT term, count(*) AS df FROM (SELECT explode_outer(terms) AS term FROM grams) "
        "WHERE term IS NOT NULL GROUP BY term HAVING df >= 5"
    )


def q_block15_sql(spark, sf_dir):
    register_functions(spark)
    _documents(spark, sf_dir).createOrReplaceTempView("documents")
    return spark.sql(
        "WITH blocks AS (SELECT doc_id, block_ngrams(alpha_tokens(lower(text)), 15) AS phrases FROM documents) "
        "SELECT * FROM (SELECT doc_id, explode_outer(phrases) AS phrase FROM blocks) WHERE phrase IS NOT NULL"
    )


def q_block15_phrases(spark, sf_dir):
    phrases = block_ngrams(alpha_tokens(F.lower("text")), 15)
    return _documents(spark, sf_dir).select(
        "doc_id", F.explode(phrases).alias("phrase")
    )


# Phrases


def _postings(spark, sf_dir, *ids):
    lines = _lines(spark, sf_dir, PHRASE_MIN_WORDS)
    return phrase_postings(with_phrases(lines), "source", *ids)


def _band(spark, sf_dir):
    # Counted and then joined, so stored once.
    return phrase_band(materialise(_postings(spark, sf_dir), "postings"), *BAND)


def q_phrase_postings(spark, sf_dir):
    return (
        _postings(spark, sf_dir)
        .groupBy("phrase", "irmark")
        .agg(F.count("*").alias("n"))
    )


def q_phrase_band(spark, sf_dir):
    return _joined(_band(spark, sf_dir))


def q_phrase_histogram(spark, sf_dir):
    return phrase_count_histogram(phrase_counts(_postings(spark, sf_dir)))


def q_phrase_counts(spark, sf_dir):
    return phrase_with_count(_band(spark, sf_dir))


def q_phrase_irmarks(spark, sf_dir):
    return phrase_with_irmark(_band(spark, sf_dir))


def q_phrase_total(spark, sf_dir):
    return _band(spark, sf_dir).agg(F.count("*").alias("phrases"))


def q_phrases_stored(spark, sf_dir):
    path = new_path(spark, "phrases")
    write_phrases(_band(spark, sf_dir), path)
    return _joined(read_phrases(spark, path))


def q_phrase_job(spark, sf_dir):
    envelopes = footer_envelopes(_spread(spark, sf_dir, "documents"))
    low, high = BAND
    return _joined(phrase_job(envelopes, low=low, high=high))


def q_folder_counts(spark, sf_dir):
    """The band of counts that are kept by folder: two merges, and a folder counted anew."""
    counts = FolderCounts(spark, new_path(spark, "folder-counts"))
    postings = materialise(_postings(spark, sf_dir, "doc_id"), "postings")
    of = lambda rest: postings.filter(F.col("doc_id") % 3 == rest).select("phrase", "irmark")
    counts.add("a", of(0))
    counts.add("b", of(1).limit(100))
    counts.add("c", of(2))
    counts.add("b", of(1))
    return _joined(counts.band(*BAND))


def q_phrase_job_folders(spark, sf_dir):
    """The phrase job over folders that arrive one by one; the second comes twice."""
    counts = FolderCounts(spark, new_path(spark, "folder-counts"))
    envelopes = footer_envelopes(_spread(spark, sf_dir, "documents"))
    half = F.pmod(F.xxhash64("content"), F.lit(2))
    for name, rest in (("a", 0), ("b", 1), ("b", 1)):
        count_folder(counts, name, envelopes.filter(half == rest))
    return _joined(counts.band(*BAND))


def q_phrase_job_rejects(spark, sf_dir):
    return phrase_outcome(mixed_files(_spread(spark, sf_dir, "customer")).select(
        F.col("doc_id").cast("string").alias("path"), "content"
    )).rejects.select("path", "stage")


# Weights and clusters


def _tfidf(spark, sf_dir):
    terms = word_tokens(F.lower("text"))
    return tfidf_terms(_documents(spark, sf_dir), "doc_id", terms)


def q_tfidf_terms(spark, sf_dir):
    return _tfidf(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def q_idf_floor(spark, sf_dir):
    rare = _tfidf(spark, sf_dir).filter("df < 5")
    return rare.groupBy("term").agg(
        F.max("df").alias("df"), F.max("weight").alias("weight")
    )


def q_idf_weight(spark, sf_dir):
    """Weights of documents of one term, of which a few are known."""
    terms = F.array("c_mktsegment").alias("terms")
    documents = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", terms)
    weighted = idf_weight(hashed_tf(documents, VARIANTS["words"].n_features))
    return weighted.select("c_custkey", _only_weight("tfidf").alias("weight"))


def _only_weight(vector):
    """The value of a vector with one."""
    return F.round(F.get(F.unwrap_udt(vector)["values"], F.lit(0)), 6)


def q_hash_vocabulary(spark, sf_dir):
    """For each term: is its index set in every document that holds it."""
    n_features = VARIANTS["words"].n_features
    terms = word_tokens(F.lower("text"))
    documents = _documents(spark, sf_dir).select("doc_id", terms.alias("terms"))
    vocabulary = hash_vocabulary(documents, n_features)
    cells = vector_entries(hashed_tf(documents, n_features), ["doc_id"], "tf").drop("value")
    held = documents.select("doc_id", F.explode(F.array_distinct("terms")).alias("term"))
    found = held.join(vocabulary, "term", "left").join(
        cells.withColumn("is_set", F.lit(True)), ["doc_id", "index"], "left"
    )
    is_set = F.coalesce("is_set", F.lit(False))
    return found.groupBy("term").agg(F.bool_and(is_set).alias("set_everywhere"))


def q_term_ids(spark, sf_dir):
    """Every term with its gapless number by falling document frequency."""
    rows = term_rows(_documents(spark, sf_dir), "doc_id", word_tokens(F.lower("text")))
    return term_ids(rows)


def q_id_vectors(spark, sf_dir):
    """Every document as counts by term ids, of terms in five documents or more."""
    rows = term_rows(_documents(spark, sf_dir), "doc_id", word_tokens(F.lower("text")))
    vectors = id_vectors(rows, materialise(term_ids(rows, 5), "ids"), "doc_id")
    joined = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return vectors.select("doc_id", joined("ids"), joined("counts"))


def _clusters(spark, sf_dir, variant):
    lines = _lines(spark, sf_dir, CLUSTER_MIN_WORDS).drop("source")
    return cluster_texts(lines, VARIANTS[variant], STOPWORDS)


def _nearest(clusters):
    """Documents, and whether their centre is the nearest by the weights of its terms."""
    centres = clusters.explain().select("cluster", "index", "weight").distinct()
    k = len(clusters.model.clusterCenters())
    return nearest_centres(clusters.documents, ["doc_id"], centres, k).select("doc_id", "nearest")


def q_cluster_documents(spark, sf_dir):
    return _nearest(_clusters(spark, sf_dir, "words"))


def q_cluster_stopworded(spark, sf_dir):
    return _nearest(_clusters(spark, sf_dir, "stopworded"))


def q_cluster_ngrams(spark, sf_dir):
    return _nearest(_clusters(spark, sf_dir, "ngrams"))


def _same(one, other):
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    return F.abs(zero(one) - zero(other)) <= 1e-6 * (1 + F.abs(zero(other)))


def _with_means(clusters):
    """The clusters with the means of their documents' weights, made from their terms."""
    weights = term_weights(clusters.documents, clusters.vocabulary, ["doc_id", "cluster"])
    return materialise(cluster_means(clusters.documents, weights, ["doc_id"]), "means")


def q_explain_clusters(spark, sf_dir):
    """For each term: is its weight in every centre the mean of the documents there."""
    clusters = _clusters(spark, sf_dir, "stopworded")
    centres = clusters.explain().select("cluster", "index", "weight").distinct()
    compared = centres.join(_with_means(clusters), ["cluster", "index"], "full")
    wrong = compared.filter(~_same("weight", "mean")).select("index").distinct().withColumn("wrong", F.lit(True))
    named = clusters.vocabulary.join(wrong, "index", "left")
    return named.select("term", F.col("wrong").isNull().alias("is_mean"))


def q_explain_clusters_top(spark, sf_dir):
    """For each term: is it among the 20 heaviest of a centre just where the means put it.

    Where it is listed, the weight at its rank is that of the mean of this rank and
    of its own mean; where it is not, no listed weight is smaller than its mean.
    """
    clusters = _clusters(spark, sf_dir, "stopworded")
    ranked = Window.partitionBy("cluster").orderBy(F.desc("mean"), "term")
    means = _with_means(clusters).join(clusters.vocabulary, "index").filter("mean <> 0")
    first = means.withColumn("rank", F.row_number().over(ranked)).filter("rank <= 20")
    first = materialise(first.select("cluster", "rank", F.col("mean").alias("at_rank")), "first")
    # Up to 20 rows for each centre.
    top = materialise(clusters.explain(20).select("cluster", "term", "rank", "weight"), "top")
    least = F.broadcast(first.groupBy("cluster").agg(F.min("at_rank").alias("least"), F.count("*").alias("n")))
    listed = F.broadcast(top.join(first, ["cluster", "rank"], "full"))
    placed = means.join(listed, ["cluster", "term"], "left").join(least, "cluster")
    in_place = F.when(F.col("rank").isNotNull(), _same("weight", "at_rank") & _same("weight", "mean")).otherwise(
        (F.col("n") == 20) & ((F.col("mean") <= F.col("least")) | _same("mean", "least"))
    )
    wrong = placed.filter(~in_place).select("term")
    # Ranks that one side lacks, and terms that are listed without a mean.
    lost = listed.filter("term IS NULL OR at_rank IS NULL").agg(F.count("*").alias("lost"))
    strange = top.join(means.select("cluster", "term"), ["cluster", "term"], "left_anti").select("term")
    wrong = wrong.union(strange).distinct().withColumn("wrong", F.lit(True))
    named = clusters.vocabulary.join(wrong, "term", "left").crossJoin(F.broadcast(lost))
    return named.select("term", (F.col("wrong").isNull() & (F.col("lost") == 0)).alias("in_place"))


def q_cluster_report(spark, sf_dir):
    """For each document: its terms, and whether its vector holds their weights."""
    clusters = _clusters(spark, sf_dir, "stopworded")
    report = cluster_report(clusters.documents, "doc_id")
    weights = term_weights(clusters.documents, clusters.vocabulary, ["doc_id"])
    entries = vector_entries(report, ["doc_id"], "tfidf").withColumnRenamed("value", "shown")
    wrong = entries.join(weights, ["doc_id", "index"], "full").filter(~_same("shown", "value"))
    wrong = wrong.select("doc_id").distinct().withColumn("wrong", F.lit(True))
    terms = F.array_join(F.sort_array("terms"), ",").alias("terms")
    return report.join(wrong, "doc_id", "left").select("doc_id", terms, F.col("wrong").isNull().alias("has_weights"))


def q_cluster_job(spark, sf_dir):
    pages = prose_pages(_spread(spark, sf_dir, "documents"))
    return _nearest(cluster_job(pages, VARIANTS["stopworded"], STOPWORDS))


# Customers as documents that say nothing but their segment: clusters are segments.


def _segment_clusters(spark, sf_dir, variant, text=None):
    fragments = F.array(F.lower("c_mktsegment") if text is None else text)
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), fragments.alias("fragments")
    )
    return cluster_texts(rows, VARIANTS[variant], STOPWORDS)


def _named(documents, *columns):
    """Documents with the smallest doc_id of their cluster for its number."""
    least = documents.groupBy("cluster").agg(F.min("doc_id").alias("cluster_id"))
    return documents.join(least, "cluster").select("doc_id", "cluster_id", *columns)


def q_cluster_segments(spark, sf_dir):
    return _named(_segment_clusters(spark, sf_dir, "words").documents)


def q_cluster_segments_stopworded(spark, sf_dir):
    return _named(_segment_clusters(spark, sf_dir, "stopworded").documents)


def q_cluster_segments_ngrams(spark, sf_dir):
    clusters = _segment_clusters(spark, sf_dir, "ngrams", segment_text())
    return _named(clusters.documents)


def _explained(clusters, top=None):
    named = _named(clusters.documents.select("doc_id", "cluster"), "cluster")
    ids = named.select("cluster", "cluster_id").distinct()
    rank = ["rank"] if top else []
    return clusters.explain(top).join(ids, "cluster").select(
        "cluster_id", "term", F.round("weight", 6).alias("weight"), *rank
    )


def q_explain_clusters_segments(spark, sf_dir):
    return _explained(_segment_clusters(spark, sf_dir, "words"))


def q_explain_clusters_top_segments(spark, sf_dir):
    clusters = _segment_clusters(spark, sf_dir, "stopworded", segment_text())
    return _explained(clusters, top=3)


def q_cluster_report_segments(spark, sf_dir):
    documents = _segment_clusters(spark, sf_dir, "stopworded").documents
    report = cluster_report(documents, "doc_id")
    return _named(
        report, F.array_join("terms", ",").alias("terms"), _only_weight("tfidf").alias("weight")
    )


def q_cluster_job_segments(spark, sf_dir):
    pages = segment_pages(_spread(spark, sf_dir, "customer"))
    return _named(cluster_job(pages, VARIANTS["stopworded"], STOPWORDS).documents)


# Markup


def _customers(spark, sf_dir, fields=None):
    pages = customer_pages(_spread(spark, sf_dir, "customer"))
    return parse_markup(pages, fields=fields)


def _order_pages(spark, sf_dir, fields=TABLE_FIELDS):
    pages = order_pages(_spread(spark, sf_dir, "orders"))
    return well_formed(parse_markup(pages, fields=fields))


def q_malformed_pages(spark, sf_dir):
    """Raw web pages, none of which is well-formed, and files some of which are."""
    pages = _spread(spark, sf_dir, "pages").select(
        F.concat(F.lit("page/"), "page_id").alias("name"), F.col("html").cast("binary").alias("content")
    )
    files = mixed_files(_spread(spark, sf_dir, "customer")).select(
        F.concat(F.lit("customer/"), "doc_id").alias("name"), "content"
    )
    rejected = quarantine(parse_markup(pages.union(files)))
    reason = F.when(F.col("error").contains("undefined entity"), "entity").otherwise("other")
    return rejected.select(
        "name", F.when(F.col("name").startswith("customer"), reason).alias("reason")
    )


def q_elements_basic(spark, sf_dir):
    columns = ["seq", "end_seq", "parent_seq", "depth", "qname", "text", "tail"]
    return parse_elements(_customers(spark, sf_dir), columns=columns)


def q_style_dropped(spark, sf_dir):
    fields = ("seq", "kind", "qname", "text", "tail", "style_first_line")
    nodes = parse_elements(_order_pages(spark, sf_dir, fields), style_rule=None)
    own = F.when(F.col("qname") == "style", "own_tag")
    line = F.when(F.col("style_first_line"), "first_line")
    rules = F.array_compact(F.array(own, line))
    return nodes.select("doc_id", "qname", F.explode(rules).alias("rule"))


def q_root_namespaces(spark, sf_dir):
    return _customers(spark, sf_dir).select(
        "doc_id", F.explode("nsmap").alias("prefix", "namespace")
    )


def q_facts_resolved(spark, sf_dir):
    return resolve_facts(_customers(spark, sf_dir, FACT_FIELDS))


def q_footer_subtrees(spark, sf_dir):
    pages = footer_pages(_spread(spark, sf_dir, "documents"), nested=True)
    parsed = well_formed(parse_markup(pages, fields=FOOTER_FIELDS))
    found = footer_subtrees(parsed)
    return found.select("doc_id", F.inline("subtrees")).select(
        "doc_id", "anchor_seq", "element.seq", "element.text"
    )


def q_elements_lateral(spark, sf_dir):
    """The elements once more, by a table function in SQL."""
    register_parse_elements(spark)
    customer_pages(_spread(spark, sf_dir, "customer")).createOrReplaceTempView("customer_pages")
    return spark.sql(
        "SELECT doc_id, e.* FROM customer_pages, LATERAL parse_elements(content, "
        "'seq, end_seq, parent_seq, depth, qname, text, tail') e"
    )


# Documents whose nodes are rows


def _node_rows(pages, fields):
    """Stored: every axis reads the nodes again."""
    rows = parse_rows(pages, fields=fields).filter("error IS NULL").drop("error")
    return materialise(rows, "nodes")


def q_footer_rows(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    pages = spread(footer_pages(documents, nested=True), documents.count())
    return footer_rows(_node_rows(pages, FOOTER_FIELDS), ["doc_id"])


def q_item_cell_rows(spark, sf_dir):
    # Both tables are dealt by order once, as rows: the pages made of them stay there.
    orders = _table(spark, sf_dir, "orders")
    tasks = spread_tasks(orders)
    items = _table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey")
    pages = item_pages(orders.repartition(tasks, "o_orderkey"), items)
    return cell_rows(_node_rows(pages, TABLE_FIELDS), ["doc_id"])


def q_section_rows(spark, sf_dir):
    pages = order_pages(_spread(spark, sf_dir, "orders"))
    return section_rows(_node_rows(pages, TABLE_FIELDS), ["doc_id"])


# Envelopes


def _envelopes(spark, sf_dir):
    return order_envelopes(_spread(spark, sf_dir, "orders"))


def q_envelope_fields(spark, sf_dir):
    return submissions(_envelopes(spark, sf_dir)).select(
        "path", "utr", "period_to", "irmark", "error"
    )


def q_attachments(spark, sf_dir):
    rows = decode_attachments(explode_attachments(submissions(_envelopes(spark, sf_dir))))
    return rows.select(
        "path", "irmark", "pos", F.md5("content").alias("content_md5")
    )


def q_attachments_all_kinds(spark, sf_dir):
    envelopes = submissions(_envelopes(spark, sf_dir), kinds=("Computation", "Accounts"))
    rows = decode_attachments(explode_attachments(envelopes))
    return rows.select("path", "pos", F.md5("content").alias("content_md5"))


def q_namespace_normalised(spark, sf_dir):
    parsed = parse_markup(
        _envelopes(spark, sf_dir), fields=("qname", "tag", "text", "tail")
    )
    nodes = parse_elements(parsed, style_rule=None)
    return nodes.filter(F.col("qname") == "IRmark").select(
        "path", "tag", normalise_namespace(F.col("tag")).alias("normalised")
    )


def q_submission_flags(spark, sf_dir):
    flags = submission_flags(submissions(_envelopes(spark, sf_dir)))
    flags.createOrReplaceTempView("submission_flags")
    return spark.sql("SELECT path, irmark, pos, is_ct, is_ix FROM submission_flags")


def q_submission_flags_sql(spark, sf_dir):
    """The flags query in SQL alone, over decoded attachments."""
    rows = decode_attachments(explode_attachments(submissions(_envelopes(spark, sf_dir))))
    rows.createOrReplaceTempView("decoded_attachments")
    return spark.sql(
        "SELECT path, irmark, pos, utr IS NOT NULL AS is_ct, content IS NOT NULL AS is_ix FROM decoded_attachments"
    )


def _taxpayers(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer")
    return customers.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("key")
    )


def q_restrict_to_keys(spark, sf_dir):
    return restrict_to_keys(
        submissions(_envelopes(spark, sf_dir)), _taxpayers(spark, sf_dir), "utr"
    ).select("path", "utr")


# Tables and sections


def _tables(spark, sf_dir):
    return with_cells(select_tables(_order_pages(spark, sf_dir)))


def q_table_selected(spark, sf_dir):
    return select_tables(_order_pages(spark, sf_dir)).select(
        "doc_id", F.explode("selected").alias("t")
    ).select("doc_id", "t.seq")


def q_table_cells(spark, sf_dir):
    return table_cells(_tables(spark, sf_dir))


def q_sibling_sections(spark, sf_dir):
    return sibling_sections(with_sections(_order_pages(spark, sf_dir)))


def q_render_tables(spark, sf_dir):
    return render_tables(_tables(spark, sf_dir))


def q_render_tables_csv(spark, sf_dir):
    rendered = render_tables(_tables(spark, sf_dir))
    return rendered.select("doc_id", csv_text(F.col("rendered")).alias("lines"))


def q_export_cp1252(spark, sf_dir):
    encoded = encode_cp1252(F.col("text"), "ignore")
    return _documents(spark, sf_dir).select(
        "doc_id", F.hex(encoded).alias("octets")
    )


def q_table_job(spark, sf_dir):
    keys = _taxpayers(spark, sf_dir)
    return table_cells(table_job(_envelopes(spark, sf_dir), keys, parts=("tables",)))


def q_table_job_rejects(spark, sf_dir):
    outcome = table_outcome(_envelopes(spark, sf_dir), _taxpayers(spark, sf_dir))
    return outcome.rejects.select("path", "pos", "stage", "reason")


# Pages with a row for each line item


def _items(spark, sf_dir):
    orders, lineitem = _spread(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    parsed = well_formed(parse_markup(item_pages(orders, lineitem), fields=TABLE_FIELDS))
    return with_cells(select_tables(parsed))


def q_item_table_cells(spark, sf_dir):
    return table_cells(_items(spark, sf_dir))


def q_item_render_tables(spark, sf_dir):
    return render_tables(_items(spark, sf_dir))


def q_item_table_job(spark, sf_dir):
    orders, lineitem = _spread(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    made = table_job(
        item_envelopes(orders, lineitem), _taxpayers(spark, sf_dir), parts=("tables",)
    )
    return table_cells(made).select("irmark", "utr", "table_no", "row_no", "col_no", "text")


def _exported(spark, sf_dir, sep):
    """Digest of each written file, by the submission that its name has."""
    path = new_path(spark, "export")
    made = table_job(_envelopes(spark, sf_dir), _taxpayers(spark, sf_dir), parts=("tables",))
    files = read_corpus(spark, export_tables(render_tables(made), path, sep))
    mark = F.regexp_extract("path", "/irmark=([^/,]*)[/,]", 1)
    return files.select(mark.alias("irmark"), F.md5("content").alias("md5"))


def q_export_tsv_files(spark, sf_dir):
    return _exported(spark, sf_dir, "\t")


def q_export_csv_files(spark, sf_dir):
    return _exported(spark, sf_dir, ",")


def q_cells_stored(spark, sf_dir):
    path = new_path(spark, "cells")
    write_cells(
        table_job(_envelopes(spark, sf_dir), _taxpayers(spark, sf_dir)), path
    )
    return render_tables(read_cells(spark, path)).select("irmark", "pos", "rendered")


# Tag check


def _prose(spark, sf_dir):
    facts = with_facts(well_formed(_customers(spark, sf_dir, FACT_FIELDS)))
    return with_fragments(facts, TAG_MIN_WORDS)


def q_tag_lookup(spark, sf_dir):
    return tag_lookup(_prose(spark, sf_dir)).drop("seq")


def q_tag_lookup_fuzzy(spark, sf_dir):
    return tag_lookup_fuzzy(_prose(spark, sf_dir)).drop("seq")


def q_tagcheck_job(spark, sf_dir):
    pages = customer_pages(_spread(spark, sf_dir, "customer"))
    return tagcheck_job(pages).select("doc_id", "name", "context", "matched_in")


# Files


def q_word_count_job(spark, sf_dir):
    path = new_path(spark, "lines")
    _documents(spark, sf_dir).select("text").write.text(path)
    return word_count_job(read_lines(spark, path))


def q_corpus_files(spark, sf_dir):
    path = new_path(spark, "corpus")
    documents = _documents(spark, sf_dir).select("source", "text")
    documents.write.partitionBy("source").text(path)
    files = read_corpus(spark, f"{path}/*")
    folder = F.regexp_extract("folder", "source=(.*)$", 1)
    # Each file is the texts of one source, a line for each of their lines.
    lines = F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n", -1)
    rows = files.select(folder.alias("folder"), F.explode(lines).alias("line"))
    return rows.groupBy("folder", F.md5("line").alias("line_md5")).agg(
        F.count("*").alias("n")
    )


def q_corpus_packed(spark, sf_dir):
    """A file for each document, packed in two runs; a third finds nothing new."""
    path, packed = new_path(spark, "corpus"), PackedCorpus(spark, new_path(spark, "packed"), 1 << 20)
    rows = _documents(spark, sf_dir).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = rows.select("doc_id", name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    added = []
    for rest in (0, 1):
        release(write_named(files.filter(F.col("doc_id") % 2 == rest).drop("doc_id"), f"{path}/{rest}"))
        added.append(packed.add([f"{path}/{run}/*/*" for run in range(rest + 1)]))
    again = packed.add([f"{path}/0/*/*", f"{path}/1/*/*"])
    found = packed.corpus().select(
        F.regexp_extract("path", "/([0-9]+)[.]txt$", 1).cast("long").alias("doc_id"), F.md5("content").alias("md5")
    )
    return found.withColumn("added_again", F.lit(again))


def q_key_list_file(spark, sf_dir):
    path = new_path(spark, "keys")
    _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", "c_name", "c_mktsegment"
    ).write.csv(path)
    keys = read_key_list(spark, path)
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("utr")
    )
    return restrict_to_keys(orders, keys, "utr")


def q_index_file(spark, sf_dir):
    path = new_path(spark, "index")
    _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("IR"), F.col("o_orderkey").cast("string")).alias("irmark"),
        "o_orderstatus",
    ).write.json(path)
    return read_index(spark, path).select("irmark")


def q_index_literals(spark, sf_dir):
    """Records printed as literals, in the forms such files have, and broken ones."""
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    forms = (
        ("{'irmark': '", name, "'}"),
        ("{'key': ", key, "L, 'irmark': u'", name, "'}"),
        ("{'x': None, 'irmark': u\"", name, "'s\"}"),
        ("{'irmark': '", name, "', 'x': True, 'y': [1., .5, -2e3]}"),
        ("{'irmark': u'", name, r"\'s \\ \xe9 \u20ac', 'x': 'it is \"so\"'}"),
        ("{'t': (1, ('", name, "', {2: None}),), 'irmark': \"", name, ", {'a': 'b'}\",}"),
        ('{"irmark": "', name, '", "x": null}'),
        ("{'irmark': '", name, "}"),
        ("{'other': '", name, "'}"),
    )
    lines = [F.concat(*[F.lit(part) if isinstance(part, str) else part for part in form]) for form in forms]
    path = new_path(spark, "index")
    line = F.element_at(F.array(*lines), (F.col("c_custkey") % len(forms) + 1).cast("int"))
    _table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return read_index(spark, path)


def q_phrase_lines(spark, sf_dir):
    """The stored phrases once more, by way of printed tuples."""
    path = new_path(spark, "phrases")
    phrases = _joined(_band(spark, sf_dir))
    phrases.select(F.format_string("('%s', ('%s', %d))", "phrase", "irmarks", "n")).write.text(path)
    return _joined(read_phrase_lines(spark, path).drop("corrupt_record"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name; each takes the session and the table folder."""
    found = {
        name[2:]: query
        for name, query in globals().items()
        if name.startswith("q_") and callable(query)
    }
    if llm:
        found |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def entry(spark: SparkSession) -> DataFrame:
    """The phrase job, from envelopes to shared footer phrases."""
    return q_phrase_job(spark, SF_ENTRY)


# SQL on the same tables

# Documents as fragments: stripped, lower-cased lines of more than N words.
_LINE_SQL = """
raw_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
lines AS (
  SELECT doc_id, source, line_no,
         lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS fragment
  FROM raw_lines
  WHERE len(regexp_extract_all(line, '\\S+')) > {min_words})
"""

_BLOCKS = """
list_distinct(list_transform(range(0, len({t}) - 14, 15),
              lambda i: array_to_string({t}[i + 1 : i + 15], ' ')))
"""

_ALPHA = "list_filter(regexp_extract_all({s}, '[A-Za-z0-9_]+'), lambda t: NOT regexp_matches(t, '[0-9]'))"

_POSTING_SQL = (
    "WITH "
    + _LINE_SQL.format(min_words=PHRASE_MIN_WORDS)
    + ", joined AS (SELECT doc_id, source, "
    "string_agg(fragment, ' ' ORDER BY line_no) AS text FROM lines GROUP BY ALL), "
    "tokens AS (SELECT doc_id, source, "
    + _ALPHA.format(s="text")
    + " AS t FROM joined), "
    "postings AS (SELECT doc_id, source AS irmark, unnest("
    + _BLOCKS.format(t="t")
    + ") AS phrase FROM tokens), "
    "counts AS (SELECT phrase, count(*) AS n FROM postings GROUP BY phrase), "
    f"band AS (SELECT phrase, n FROM counts WHERE n BETWEEN {BAND[0]} AND {BAND[1]}) "
)

_BAND_SQL = (
    _POSTING_SQL
    + "SELECT phrase, string_agg(irmark, ',' ORDER BY irmark) AS irmarks, "
    "count(*) AS n FROM postings JOIN band USING (phrase) GROUP BY phrase"
)


def _token_sql(tokens: str) -> str:
    return (
        "SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, "
        f"unnest(t) AS token FROM (SELECT doc_id, {tokens} AS t FROM documents)"
    )


_WORDS = "regexp_extract_all(lower(text), '[A-Za-z0-9_]+')"

_TFIDF_SQL = (
    f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "weights AS (SELECT doc_id, term, tf, df, CASE WHEN df >= 5 THEN "
    "tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) ELSE 0.0 END "
    "AS weight FROM tf JOIN df USING (term)) "
)


def _case(column: str, values: dict[str, str]) -> str:
    whens = "".join(f" WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column}{whens} END"


# Orders with the values that their pages and envelopes show.
_ORDER_SQL = f"""
WITH o AS (
  SELECT *, {_case('o_orderpriority', HEADINGS)} AS heading,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents,
         strftime(o_orderdate, '%Y-%m-%d') AS due,
         {_case('o_orderstatus', TAXATION_YEAR)} AS year,
         o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') AS computed
  FROM orders)
"""

_PAGE_SQL = """
'<html xmlns="http://www.w3.org/1999/xhtml">' || '<head><title>Order ' || o_orderkey
|| '</title>' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE chr(10) END
|| '<style type="text/css">td {}</style></head>' || chr(10) || '<body>' || chr(10)
|| '<div><h2>' || heading || '</h2>' || chr(10) || '<!-- filed -->' || chr(10)
|| '<table><tr><th>Item</th><th>Value</th></tr><tr><td>Status</td><td> <b>'
|| o_orderstatus || '</b> as filed</td></tr><tr><td>Price</td><td>' || cents
|| '</td><td/></tr></table>' || chr(10) || '<p>Priority <i>' || o_orderpriority
|| '</i></p></div>' || chr(10) || '<div><p>Due</p><table><tr><td>' || due
|| '</td></tr></table></div>' || chr(10)
|| '<div><h3>Adjustment of Profit</h3><p>Customer ' || o_custkey
|| '</p><table><tbody><tr><td>hidden</td></tr></tbody><tr><td>Tax</td><td>' || due
|| '</td></tr></table></div>' || chr(10) || '</body></html>'
"""

_INLINE_PAGE_SQL = (
    "regexp_replace(replace(replace(" + _PAGE_SQL + ", '<html ', "
    "'<html xmlns:env=\"http://www.govtalk.gov.uk/CM/envelope\" '), "
    "'<td/>', '<td></td>'), '\\s+', ' ', 'g')"
)

# Cells of both tables a page can show: the first under a telling heading only.
_CELL_SQL = """
cells AS (
  SELECT o.*, c.* FROM o, LATERAL (
    VALUES (1, 2, 1, 'Status'), (1, 2, 2, ' ' || o_orderstatus || ' as filed'),
           (1, 3, 1, 'Price'), (1, 3, 2, cents), (1, 3, 3, ''),
           (2, 1, 1, 'Tax'), (2, 1, 2, due)) c(t, row_no, col_no, text)
  WHERE t = 2 OR computed)
"""
_TABLE_NO = "CASE WHEN computed THEN t ELSE 1 END"

_RENDERED = (
    "CASE WHEN computed THEN 'Status' || chr(9) || o_orderstatus || ' as filed' "
    "|| chr(10) || 'Price' || chr(9) || cents || chr(9) || {gap} ELSE '' END "
    "|| 'Tax' || chr(9) || due"
)
_GAP = "repeat(chr(10), 3) || repeat('#---------' || chr(9), 5) || repeat(chr(10), 3)"

_SECTION_SQL = """
sections AS (
  SELECT o_orderkey AS doc_id, 1 AS section_no,
         ['Adjustment of Profit', '', '', 'Item', 'Value', '', 'Status', '',
          o_orderstatus, '', 'Price', cents, '', 'Priority', o_orderpriority] AS texts
  FROM o WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END,
         ['Adjustment of Profit', 'Customer ' || o_custkey, '', '', '', 'hidden',
          '', 'Tax', due]
  FROM o)
"""

_FILED = "o_orderpriority <> '4-NOT SPECIFIED'"
_BUILDING = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"

# Elements of a customer page.
_CUSTOMER_SQL = """
WITH c AS (
  SELECT c_custkey AS doc_id, c_name AS who, c_mktsegment AS segment, c_nationkey,
         CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS cents,
         c_acctbal >= 0 AS credit FROM customer),
page AS (
  SELECT doc_id, e.* FROM c, LATERAL (VALUES
    (1, 6, 0, 1, 'body', '', NULL, 'No attr', 'No ctx'),
    (2, 2, 1, 2, 'p', 'Statement of ' || who || ' for the period ended', '',
     'No attr', 'No ctx'),
    (3, 3, 1, 2, 'ix:nonNumeric',
     'Business of ' || who || ' is in the segment ' || segment,
     'and these words stand after the tag', 'uk:Segment', 'n' || c_nationkey),
    (4, 4, 1, 2, 'span', 'Balance of ' || who || ' stands at ' || cents || ' pence',
     '', 'Ukn Conv', 'Ukn Conv'),
    (5, 5, 1, 2, 'b', 'short', '', 'No attr', 'No ctx'),
    (6, 6, 1, 2, 'ix:nonFraction',
     CASE WHEN credit THEN 'Statement' ELSE 'Report' END || ' of ' || who
     || ' for the period ended, restated', '', 'uk:Balance', 'now'))
    e(seq, end_seq, parent_seq, depth, qname, text, tail, name, context))
"""

_MATCH_SQL = (
    _CUSTOMER_SQL
    + "SELECT doc_id, lower('Statement of ' || who || ' for the period ended') "
    "AS fragment, CASE WHEN credit THEN 'tagged' ELSE 'untagged' END AS status, "
    "CASE WHEN credit THEN 'uk:Balance' END AS name, "
    "CASE WHEN credit THEN 'now' END AS context, "
    "CASE WHEN credit THEN 'text' END AS matched_in FROM c"
)


# Rows of a page with line items. Numbers repeat, so values decide the order.
_ITEM_SQL = """
WITH li AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS no, CAST(l_quantity AS BIGINT) AS q,
         CAST(round(l_tax * 100) AS BIGINT) AS tax,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
           CAST(l_quantity AS BIGINT), CAST(round(l_tax * 100) AS BIGINT)) AS INTEGER) AS row_no
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
cells AS (
  SELECT doc_id, 1 AS table_no, row_no, 1 AS col_no, CAST(no AS VARCHAR) AS text FROM li
  UNION ALL SELECT doc_id, 1, row_no, 2, CAST(q AS VARCHAR) FROM li
  UNION ALL SELECT doc_id, 1, row_no, 3, CAST(tax AS VARCHAR) FROM li WHERE tax > 0
  UNION ALL SELECT doc_id, 1, row_no, CASE WHEN tax > 0 THEN 4 ELSE 3 END, 'see ' || no
  FROM li WHERE no % 3 = 0)
"""

_CSV = (
    "CASE WHEN computed THEN "
    "'Status,' || o_orderstatus || ' as filed' || chr(13) || chr(10) || 'Price,' "
    "|| cents || ',' || chr(13) || chr(10) || repeat('\"\"' || chr(13) || chr(10), 2) "
    "|| repeat('#---------,', 5) || chr(13) || chr(10) "
    "|| repeat('\"\"' || chr(13) || chr(10), 2) ELSE '' END "
    "|| 'Tax,' || due"
)

# Customers by segment: the groups that clusters have to find.
_SEGMENT_SQL = """
WITH s AS (
  SELECT c_custkey AS doc_id, lower(c_mktsegment) AS term,
         min(c_custkey) OVER (PARTITION BY c_mktsegment) AS cluster_id,
         round(ln((count(*) OVER () + 1) / (count(*) OVER (PARTITION BY c_mktsegment) + 1)), 6)
           AS weight
  FROM customer)
"""


def _clustered_sql(tokens: str, columns: str = "true AS nearest") -> str:
    """Documents that have a token in their long lines."""
    return (
        "WITH "
        + _LINE_SQL.format(min_words=CLUSTER_MIN_WORDS)
        + ", joined AS (SELECT doc_id, string_agg(fragment, ' ' ORDER BY line_no) AS text "
        f"FROM lines GROUP BY doc_id) SELECT doc_id, {columns} FROM joined "
        f"WHERE len({tokens}) > 0"
    )


def _cp1252_sql() -> str:
    """Hexadecimal octets of the characters that code page 1252 has."""
    high = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
    cases = " ".join(f"WHEN '{c}' THEN '{c.encode('cp1252').hex().upper()}'" for c in high)
    kept = f"regexp_replace(text, '[^\\x{{00}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}{high}]', '', 'g')"
    return (
        "SELECT doc_id, array_to_string(list_transform("
        f"regexp_extract_all({kept}, '(?s).'), "
        f"lambda c: CASE c {cases} ELSE printf('%02X', unicode(c)) END), '') AS octets "
        "FROM documents"
    )


def oracle_sql() -> dict[str, str]:
    """The same results as plain SQL.

    Sampled and learned results of the optional operators have none; tests
    check those against brute force.
    """
    long_lines = "WITH " + _LINE_SQL.format(min_words=CLUSTER_MIN_WORDS)
    stopwords = ", ".join(f"'{word}'" for word in STOPWORDS)
    alpha = _ALPHA.format(s="lower(text)")
    # Fragments are in lower case already.
    kept_words = f"list_filter({_WORDS}, lambda t: t NOT IN ({stopwords}))"
    word_counts = (
        "SELECT word, count(*) AS n FROM (SELECT "
        "unnest(regexp_extract_all(text, '\\S+')) AS word FROM documents) GROUP BY word"
    )
    sql = {
        "word_count": word_counts,
        "word_count_job": word_counts,
        "top_words_preview": word_counts + " ORDER BY n DESC, word LIMIT 10",
        "fragments_long": long_lines
        + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) "
        "- 1 AS INTEGER) AS frag_no, fragment FROM lines",
        "documents_with_text": long_lines + "SELECT DISTINCT doc_id FROM lines",
        "tokens_word": _token_sql(_WORDS),
        "tokens_alpha": _token_sql(alpha),
        "tokens_space": _token_sql("string_split(lower(text), ' ')"),
        "stopword_filtered": _token_sql(
            f"list_filter({_WORDS}, lambda t: t NOT IN ({stopwords}))"
        ),
        "ngram5_docfreq": "SELECT term, count(*) AS df FROM (SELECT doc_id, "
        "unnest(list_distinct(list_transform(range(0, len(t) - 4), "
        "lambda i: array_to_string(t[i + 1 : i + 5], ' ')))) AS term "
        f"FROM (SELECT doc_id, {_WORDS} AS t FROM documents)) "
        "GROUP BY term HAVING count(*) >= 5",
        "ngram5_sql": "SELECT term, count(*) AS df FROM (SELECT doc_id, "
        "unnest(list_distinct(list_transform(range(0, len(t) - 4), "
        "lambda i: array_to_string(t[i + 1 : i + 5], ' ')))) AS term "
        f"FROM (SELECT doc_id, {_WORDS} AS t FROM documents)) "
        "GROUP BY term HAVING count(*) >= 5",
        "ngram15_distinct": "SELECT doc_id, "
        "unnest(list_distinct(list_transform(range(0, len(t) - 14), "
        "lambda i: array_to_string(t[i + 1 : i + 15], ' ')))) AS phrase "
        f"FROM (SELECT doc_id, {alpha} AS t FROM documents)",
        "block15_phrases": f"SELECT doc_id, unnest({_BLOCKS.format(t='t')}) AS phrase "
        f"FROM (SELECT doc_id, {alpha} AS t FROM documents)",
        "block15_sql": f"SELECT doc_id, unnest({_BLOCKS.format(t='t')}) AS phrase "
        f"FROM (SELECT doc_id, {alpha} AS t FROM documents)",
        "phrase_postings": _POSTING_SQL
        + "SELECT phrase, irmark, count(*) AS n FROM postings GROUP BY ALL",
        "phrase_band": _BAND_SQL,
        "phrases_stored": _BAND_SQL,
        "folder_counts": _BAND_SQL,
        "phrase_job": _BAND_SQL,
        "phrase_job_folders": _BAND_SQL,
        "phrase_histogram": _POSTING_SQL
        + "SELECT n, count(*) AS phrases FROM counts GROUP BY n",
        "phrase_counts": _POSTING_SQL + "SELECT phrase, n FROM band",
        "phrase_irmarks": _POSTING_SQL
        + "SELECT phrase, irmark FROM postings JOIN band USING (phrase)",
        "phrase_total": _POSTING_SQL + "SELECT count(*) AS phrases FROM band",
        "tfidf_terms": _TFIDF_SQL
        + "SELECT doc_id, term, tf, df, round(weight, 6) AS weight FROM weights",
        "idf_floor": _TFIDF_SQL
        + "SELECT term, max(df) AS df, max(weight) AS weight FROM weights "
        "WHERE df < 5 GROUP BY term",
        "phrase_job_rejects": "SELECT CAST(c_custkey AS VARCHAR) AS path, "
        "'envelope' AS stage FROM customer",
        "idf_weight": _SEGMENT_SQL + "SELECT doc_id AS c_custkey, weight FROM s",
        "hash_vocabulary": "SELECT DISTINCT term, true AS set_everywhere FROM "
        f"(SELECT unnest({_WORDS}) AS term FROM documents)",
        "term_ids": _TFIDF_SQL
        + "SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id FROM df",
        "id_vectors": _TFIDF_SQL
        + ", ids AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS id FROM df WHERE df >= 5) "
        "SELECT doc_id, string_agg(id, ',' ORDER BY id) AS ids, string_agg(tf, ',' ORDER BY id) AS counts "
        "FROM tf JOIN ids USING (term) GROUP BY doc_id",
        "cluster_documents": _clustered_sql("string_split(text, ' ')"),
        "cluster_stopworded": _clustered_sql(kept_words),
        "cluster_ngrams": _clustered_sql(kept_words),
        "cluster_job": _clustered_sql(kept_words),
        "cluster_report": _clustered_sql(
            kept_words, f"array_to_string(list_sort(list_distinct({kept_words})), ',') AS terms, true AS has_weights"
        ),
        "explain_clusters": "SELECT DISTINCT unnest(terms) AS term, true AS is_mean FROM ("
        + _clustered_sql(kept_words, f"{kept_words} AS terms")
        + ")",
        "explain_clusters_top": "SELECT DISTINCT unnest(terms) AS term, true AS in_place FROM ("
        + _clustered_sql(kept_words, f"{kept_words} AS terms")
        + ")",
        "cluster_segments": _SEGMENT_SQL + "SELECT doc_id, cluster_id FROM s",
        "cluster_segments_stopworded": _SEGMENT_SQL + "SELECT doc_id, cluster_id FROM s",
        "cluster_segments_ngrams": _SEGMENT_SQL + "SELECT doc_id, cluster_id FROM s",
        "cluster_job_segments": _SEGMENT_SQL + "SELECT doc_id, cluster_id FROM s",
        "cluster_report_segments": _SEGMENT_SQL
        + "SELECT doc_id, cluster_id, term AS terms, weight FROM s",
        "explain_clusters_segments": _SEGMENT_SQL + "SELECT DISTINCT cluster_id, term, weight FROM s",
        "explain_clusters_top_segments": _SEGMENT_SQL
        + "SELECT DISTINCT cluster_id, term, weight, 1 AS rank FROM s",
        "malformed_pages": "SELECT 'page/' || page_id AS name, CAST(NULL AS VARCHAR) AS reason "
        "FROM pages UNION ALL SELECT 'customer/' || c_custkey, "
        "CASE c_nationkey % 3 WHEN 1 THEN 'other' ELSE 'entity' END FROM customer "
        "WHERE c_nationkey % 3 > 0",
        "elements_basic": _CUSTOMER_SQL
        + "SELECT doc_id, seq, end_seq, parent_seq, depth, qname, text, tail FROM page",
        "elements_lateral": _CUSTOMER_SQL
        + "SELECT doc_id, seq, end_seq, parent_seq, depth, qname, text, tail FROM page",
        "facts_resolved": _CUSTOMER_SQL
        + "SELECT doc_id, seq, name, context, text, tail, "
        "name NOT IN ('Ukn Conv', 'No attr') AS is_tagged FROM page",
        "root_namespaces": "SELECT c_custkey AS doc_id, prefix, namespace FROM customer, "
        "(VALUES ('', 'http://www.w3.org/1999/xhtml'), "
        "('ix', 'http://www.xbrl.org/2008/inlineXBRL')) v(prefix, namespace)",
        "style_dropped": "SELECT o_orderkey AS doc_id, qname, rule FROM orders, "
        "(VALUES ('style', 'own_tag'), ('style', 'first_line'), ('head', 'first_line')) "
        "v(qname, rule) WHERE qname = 'style' OR o_orderstatus = 'F'",
        "footer_subtrees": "WITH l AS (SELECT doc_id, "
        "unnest(string_split(text, chr(10))) AS line, "
        "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) "
        "SELECT doc_id, anchor_seq, CAST(6 + line_no AS INTEGER) AS seq, "
        "nullif(line, '') AS text FROM l, (VALUES (5), (6)) a(anchor_seq) UNION ALL "
        "SELECT doc_id, anchor_seq, seq, NULL FROM documents, "
        "(VALUES (5, 5), (5, 6), (6, 6)) a(anchor_seq, seq)",
        "footer_rows": "WITH l AS (SELECT doc_id, "
        "unnest(string_split(text, chr(10))) AS line, "
        "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) "
        "SELECT doc_id, anchor_seq, CAST(6 + line_no AS INTEGER) AS seq, "
        "nullif(line, '') AS text FROM l, (VALUES (5), (6)) a(anchor_seq) UNION ALL "
        "SELECT doc_id, anchor_seq, seq, NULL FROM documents, "
        "(VALUES (5, 5), (5, 6), (6, 6)) a(anchor_seq, seq)",
        "envelope_fields": _ORDER_SQL
        + "SELECT 'order/' || o_orderkey AS path, CAST(o_custkey AS VARCHAR) AS utr, "
        "due AS period_to, 'IR' || o_orderkey AS irmark, CAST(NULL AS VARCHAR) AS error "
        "FROM o",
        "attachments": _ORDER_SQL
        + "SELECT 'order/' || o_orderkey AS path, 'IR' || o_orderkey AS irmark, pos, "
        "CASE WHEN pos = 2 THEN NULL WHEN o_orderstatus = 'P' THEN md5("
        + _INLINE_PAGE_SQL
        + ") ELSE md5("
        + _PAGE_SQL
        + ") END AS content_md5 FROM o, (VALUES (0), (2)) v(pos) "
        f"WHERE {_FILED} AND (pos = 0 OR o_orderstatus = 'O')",
        "attachments_all_kinds": _ORDER_SQL
        + "SELECT 'order/' || o_orderkey AS path, pos, "
        "CASE WHEN pos = 2 THEN NULL WHEN o_orderstatus = 'P' THEN md5("
        + _INLINE_PAGE_SQL
        + ") ELSE md5("
        + _PAGE_SQL
        + ") END AS content_md5 FROM o, (VALUES (0), (2)) v(pos) "
        f"WHERE {_FILED} AND (pos = 0 OR o_orderstatus = 'O') UNION ALL "
        f"SELECT 'order/' || o_orderkey, CASE WHEN NOT {_FILED} THEN 0 "
        "WHEN o_orderstatus = 'O' THEN 3 ELSE 1 END, md5('A') FROM o",
        "namespace_normalised": _ORDER_SQL
        + "SELECT 'order/' || o_orderkey AS path, "
        "'{http://www.govtalk.gov.uk/taxation/CT/' || year || '}IRmark' AS tag, "
        "'{http://www.govtalk.gov.uk/taxation/CT/X}IRmark' AS normalised FROM o",
        "submission_flags": "SELECT 'order/' || o_orderkey AS path, "
        "'IR' || o_orderkey AS irmark, pos, true AS is_ct, pos = 0 AS is_ix "
        f"FROM orders, (VALUES (0), (2)) v(pos) WHERE {_FILED} "
        "AND (pos = 0 OR o_orderstatus = 'O')",
        "submission_flags_sql": "SELECT 'order/' || o_orderkey AS path, "
        "'IR' || o_orderkey AS irmark, pos, true AS is_ct, pos = 0 AS is_ix "
        f"FROM orders, (VALUES (0), (2)) v(pos) WHERE {_FILED} "
        "AND (pos = 0 OR o_orderstatus = 'O')",
        "restrict_to_keys": "SELECT 'order/' || o_orderkey AS path, "
        f"CAST(o_custkey AS VARCHAR) AS utr FROM orders WHERE {_BUILDING}",
        "table_selected": _ORDER_SQL
        + "SELECT o_orderkey AS doc_id, seq FROM o, (VALUES (8), (30)) v(seq) "
        "WHERE seq = 30 OR computed",
        "table_cells": _ORDER_SQL
        + ", "
        + _CELL_SQL
        + f"SELECT o_orderkey AS doc_id, {_TABLE_NO} AS table_no, row_no, col_no, text "
        "FROM cells",
        "table_job": _ORDER_SQL
        + ", "
        + _CELL_SQL
        + "SELECT 'order/' || o_orderkey AS path, 'IR' || o_orderkey AS irmark, "
        "CAST(o_custkey AS VARCHAR) AS utr, due AS period_to, 0 AS pos, "
        f"{_TABLE_NO} AS table_no, row_no, col_no, text FROM cells "
        f"WHERE {_FILED} AND {_BUILDING}",
        "table_job_rejects": "SELECT 'order/' || o_orderkey AS path, 2 AS pos, "
        "'attachment' AS stage, 'not base64' AS reason FROM orders "
        f"WHERE {_FILED} AND {_BUILDING} AND o_orderstatus = 'O'",
        "item_table_cells": _ITEM_SQL + "SELECT * FROM cells",
        "item_cell_rows": _ITEM_SQL + "SELECT * FROM cells",
        "item_render_tables": _ITEM_SQL
        + "SELECT doc_id, string_agg(line, chr(10) ORDER BY row_no) AS rendered FROM ("
        "SELECT doc_id, row_no, string_agg(text, chr(9) ORDER BY col_no) AS line "
        "FROM cells GROUP BY doc_id, row_no) GROUP BY doc_id",
        "item_table_job": _ITEM_SQL
        + "SELECT 'IR' || doc_id AS irmark, CAST(o_custkey AS VARCHAR) AS utr, table_no, "
        "row_no, col_no, text FROM cells JOIN orders ON doc_id = o_orderkey "
        f"WHERE {_BUILDING}",
        "export_tsv_files": _ORDER_SQL
        + "SELECT 'IR' || o_orderkey AS irmark, md5("
        + _RENDERED.format(gap=_GAP)
        + f" || chr(10)) AS md5 FROM o WHERE {_FILED} AND {_BUILDING}",
        "export_csv_files": _ORDER_SQL
        + f"SELECT 'IR' || o_orderkey AS irmark, md5({_CSV} || chr(13) || chr(10)) AS md5 "
        f"FROM o WHERE {_FILED} AND {_BUILDING}",
        "cells_stored": _ORDER_SQL
        + "SELECT 'IR' || o_orderkey AS irmark, 0 AS pos, "
        + _RENDERED.format(gap=_GAP)
        + f" AS rendered FROM o WHERE {_FILED} AND {_BUILDING}",
        "render_tables": _ORDER_SQL
        + "SELECT o_orderkey AS doc_id, "
        + _RENDERED.format(gap=_GAP)
        + " AS rendered FROM o",
        "render_tables_csv": _ORDER_SQL + f"SELECT o_orderkey AS doc_id, {_CSV} AS lines FROM o",
        "export_cp1252": _cp1252_sql(),
        "sibling_sections": _ORDER_SQL
        + ", "
        + _SECTION_SQL
        + "SELECT doc_id, section_no, "
        "CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS pos, "
        "unnest(texts) AS text FROM sections",
        "section_rows": _ORDER_SQL
        + ", "
        + _SECTION_SQL
        + "SELECT doc_id, section_no, "
        "CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS pos, "
        "unnest(texts) AS text FROM sections",
        "tag_lookup": _MATCH_SQL,
        "tag_lookup_fuzzy": _CUSTOMER_SQL
        + ", f AS (SELECT doc_id, lower('Statement of ' || who || ' for the period ended') "
        "AS fragment FROM c), pairs AS (SELECT doc_id, seq, fragment, t, "
        "CASE WHEN length(fragment) <= length(t) THEN fragment ELSE t END AS short, "
        "CASE WHEN length(fragment) <= length(t) THEN t ELSE fragment END AS long, "
        "length(fragment) + length(t) AS total FROM page JOIN f "
        "USING (doc_id), LATERAL (VALUES (coalesce(nullif(text, ''), '###')), "
        "(coalesce(nullif(tail, ''), '###'))) v(t) WHERE name NOT IN ('Ukn Conv', 'No attr')), "
        # The fewest edits to any part of the longer text, of all lengths that pass.
        f"fits AS (SELECT DISTINCT short, long, total, CAST(floor(length(short) - {FUZZY_THRESHOLD / 2} "
        f"* total) AS BIGINT) AS edits FROM pairs WHERE 2 * length(short) > {FUZZY_THRESHOLD} * total), "
        "parts AS (SELECT *, unnest(range(greatest(length(short) - edits, 1), length(short) + edits + 1)) "
        "AS n FROM fits), starts AS (SELECT *, unnest(range(1, greatest(length(long) - n + 1, 1) + 1)) AS i FROM parts), "
        "near_pairs AS (SELECT short, long FROM starts GROUP BY short, long, total HAVING "
        f"2 * (length(short) - min(levenshtein(short, substr(long, i, n)))) > {FUZZY_THRESHOLD} * total), "
        "near AS (SELECT doc_id, min(seq) AS seq FROM pairs JOIN near_pairs USING (short, long) GROUP BY doc_id) "
        "SELECT f.doc_id, fragment, CASE WHEN near.seq IS NULL THEN 'untagged' "
        "ELSE 'tagged' END AS status, page.name, page.context FROM f "
        "LEFT JOIN near USING (doc_id) "
        "LEFT JOIN page ON page.doc_id = near.doc_id AND page.seq = near.seq",
        "tagcheck_job": "SELECT doc_id, name, context, matched_in FROM ("
        + _MATCH_SQL
        + ") WHERE status = 'tagged'",
        "corpus_files": "SELECT source AS folder, md5(line) AS line_md5, count(*) AS n FROM "
        "(SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) "
        "GROUP BY ALL",
        "corpus_packed": "SELECT doc_id, md5(text) AS md5, 0 AS added_again FROM documents "
        "WHERE doc_id IS NOT NULL AND text IS NOT NULL",
        "key_list_file": "SELECT CAST(o_custkey AS VARCHAR) AS utr, o_orderkey "
        f"FROM orders WHERE {_BUILDING}",
        "phrase_lines": _BAND_SQL,
        "index_literals": r"""
SELECT CASE c_custkey % 9
         WHEN 2 THEN c_name || '''s' WHEN 4 THEN c_name || '''s \ é €'
         WHEN 5 THEN c_name || ', {''a'': ''b''}' WHEN 7 THEN NULL WHEN 8 THEN NULL
         ELSE c_name END AS irmark,
       CASE c_custkey % 9
         WHEN 7 THEN '{''irmark'': ''' || c_name || '}'
         WHEN 8 THEN '{''other'': ''' || c_name || '''}' END AS corrupt_record
FROM customer""",
        "index_file": "SELECT 'IR' || o_orderkey AS irmark FROM orders",
    }
    if llm:
        own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
        sql |= llm.ORACLE_SQL | own
    return sql
