"""The five jobs, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.functions.text import (
    join_words,
    ngrams,
    remove_stopwords,
    space_tokens,
    word_tokens,
)
from filings.operators.cluster import (
    cluster_documents,
    explain_clusters,
    fit_clusters,
    hash_vocabulary,
    hashed_tf,
    idf_weight,
    in_fixed_layout,
)
from filings.operators.computed import computed
from filings.operators.envelope import attachments_or_reasons, submissions
from filings.operators.facts import facts_of, fragments_of, with_facts
from filings.operators.keys import restrict_to_keys
from filings.operators.markup import (
    document_columns,
    footer_subtrees,
    parse_markup,
    with_reasons,
)
from filings.operators.phrases import (
    BAND,
    PHRASE_WORDS,
    phrase_band,
    phrase_postings,
    with_phrases,
)
from filings.operators.increments import FolderCounts
from filings.operators.storage import materialise, release
from filings.operators.tables import select_tables, with_cells, with_sections
from filings.operators.tagging import keep_tagged, tag_lookup
from filings.operators.terms import word_count
from filings.schemas import FACT_FIELDS, FOOTER_FIELDS, TABLE_FIELDS


@dataclass(frozen=True)
class Variant:
    """Fixed values of one way to cluster documents."""

    n_features: int
    k: int
    max_iter: int
    runs: int
    ngram: int | None = None
    raw_words: bool = False


VARIANTS = {
    "words": Variant(20_000, k=5, max_iter=10, runs=10, raw_words=True),
    "stopworded": Variant(30_000, k=8, max_iter=100, runs=1),
    "ngrams": Variant(100_000, k=8, max_iter=100, runs=1, ngram=5),
}

# A fragment has more words than this.
CLUSTER_MIN_WORDS = 5
PHRASE_MIN_WORDS = 7
TAG_MIN_WORDS = 4

KINDS = ("Computation",)
PARTS = ("tables", "sections")


@dataclass
class Outcome:
    """Rows of a job, and what it could not read: path, pos, stage, reason.

    Both are read from one stored table, made in one pass over the corpus.
    """

    rows: DataFrame
    rejects: DataFrame

    def release(self) -> None:
        """Delete the stored table; the rows cannot be read any more."""
        release(self.rejects)


def _good(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("stage").isNull()).drop("stage", "reason")


def _rejects(rows: DataFrame) -> DataFrame:
    places = [c for c in ("path", "doc_id", "pos") if c in rows.columns]
    return rows.filter(F.col("stage").isNotNull()).select(*places, "stage", "reason")


@dataclass
class Clusters:
    """Result of the cluster job; the tables are lazy."""

    documents: DataFrame
    vocabulary: DataFrame
    model: KMeansModel
    rejects: DataFrame | None = None

    def explain(self, top: int | None = None) -> DataFrame:
        return explain_clusters(self.vocabulary, self.documents, self.model, top)

    def release(self) -> None:
        """Delete the stored tables; the results cannot be read any more."""
        release(self.documents)
        if self.rejects is not None:
            release(self.rejects)


def cluster_tokens(
    fragments: Column, variant: Variant, stopwords: Sequence[str]
) -> Column:
    text = join_words(fragments)
    if variant.raw_words:
        return space_tokens(text)
    return remove_stopwords(word_tokens(text), stopwords)


def cluster_terms(tokens: Column, variant: Variant) -> Column:
    return tokens if variant.ngram is None else ngrams(tokens, variant.ngram)


def cluster_texts(
    documents: DataFrame,
    variant: Variant,
    stopwords: Sequence[str] = (),
    seed: int = 1,
) -> Clusters:
    """Cluster documents that have `fragments`.

    A variant that does not take raw words is defined with a list of stop words
    (`read_stopwords`), so it has to be given one.
    """
    if not variant.raw_words and not stopwords:
        raise ValueError("this variant removes stop words: give a list of them")
    tokens = cluster_tokens(F.col("fragments"), variant, stopwords)
    key = [c for c in documents.columns if c != "fragments"]
    kept = computed(documents, tokens=tokens).drop("fragments")
    kept = kept.filter(F.size("tokens") > 0)
    terms = cluster_terms(F.col("tokens"), variant)
    hashed = hashed_tf(kept.withColumn("terms", terms), variant.n_features)
    # Fits read their input many times, so it is stored once, parsed and hashed.
    # N-grams repeat each word n times; they are made again where they are read.
    stored = materialise(hashed.drop("terms"), "tf").withColumn("terms", terms)
    weighted = idf_weight(stored)
    vectors = in_fixed_layout(weighted.select(*key, "tfidf"), key)
    model = fit_clusters(vectors, variant.k, variant.max_iter, variant.runs, seed)
    return Clusters(
        cluster_documents(weighted, model).drop("tokens"),
        hash_vocabulary(stored, variant.n_features),
        model,
    )


def _prose(corpus: DataFrame, min_words: int) -> DataFrame:
    """Facts and fragments of files; unreadable ones with stage and reason."""
    parsed = with_reasons(parse_markup(corpus, fields=FACT_FIELDS))
    facts = with_facts(parsed, "first_line")
    prose = computed(facts, fragments=fragments_of(F.col("facts"), min_words))
    return prose.filter(F.col("stage").isNotNull() | (F.size("fragments") > 0))


def cluster_job(
    corpus: DataFrame,
    variant: Variant = VARIANTS["words"],
    stopwords: Sequence[str] = (),
    seed: int = 1,
) -> Clusters:
    """Group filings by the untagged prose in them."""
    prose = materialise(_prose(corpus, CLUSTER_MIN_WORDS).drop("facts"), "prose")
    clusters = cluster_texts(_good(prose), variant, stopwords, seed)
    clusters.rejects = _rejects(prose)
    return clusters


def attachments(
    corpus: DataFrame, required: Sequence[str], kinds: Sequence[str] = KINDS
) -> DataFrame:
    """Decoded attachments of all envelopes; failures with stage and reason."""
    return attachments_or_reasons(submissions(corpus, kinds=kinds, required=required))


def _footers(corpus: DataFrame, n: int, kinds: Sequence[str]) -> DataFrame:
    """Phrases of the footers of each attachment."""
    pages = attachments(corpus, ("irmark",), kinds)
    parsed = with_reasons(parse_markup(pages, fields=FOOTER_FIELDS))
    found = footer_subtrees(parsed)
    ids = [c for c in document_columns(found) if c != "subtrees"]
    nodes = F.transform("subtrees", lambda s: s["element"])
    facts = computed(found, facts=facts_of(nodes)).select(*ids, "facts")
    fragments = fragments_of(F.col("facts"), PHRASE_MIN_WORDS, untagged_only=False)
    prose = computed(facts, fragments=fragments)
    kept = prose.filter(F.col("stage").isNotNull() | (F.size("fragments") > 0))
    return with_phrases(kept, n).select("path", "irmark", "pos", "stage", "reason", "phrases")


def footer_phrases(
    corpus: DataFrame, n: int = PHRASE_WORDS, kinds: Sequence[str] = KINDS
) -> DataFrame:
    """One row (phrase, irmark) per attachment and phrase in its footers."""
    return phrase_postings(_good(_footers(corpus, n, kinds)))


def phrase_outcome(
    corpus: DataFrame,
    n: int = PHRASE_WORDS,
    low: int = BAND[0],
    high: int = BAND[1],
    kinds: Sequence[str] = KINDS,
) -> Outcome:
    """Footer phrases shared by `low` to `high` attachments, and rejects."""
    # Counted and then joined: stored so that the corpus is parsed only once.
    stored = materialise(_footers(corpus, n, kinds), "postings")
    return Outcome(phrase_band(phrase_postings(_good(stored)), low, high), _rejects(stored))


def phrase_job(
    corpus: DataFrame,
    n: int = PHRASE_WORDS,
    low: int = BAND[0],
    high: int = BAND[1],
    kinds: Sequence[str] = KINDS,
) -> DataFrame:
    """Footer phrases shared by `low` to `high` attachments."""
    return phrase_outcome(corpus, n, low, high, kinds).rows


def count_folder(
    counts: FolderCounts,
    folder: str,
    corpus: DataFrame,
    n: int = PHRASE_WORDS,
    kinds: Sequence[str] = KINDS,
) -> None:
    """Add the footer phrases of one folder to counts that are kept by folder.

    `counts.band()` is then what `phrase_job` gives for all folders added so far.
    """
    counts.add(folder, footer_phrases(corpus, n, kinds))


def _table_rows(
    corpus: DataFrame,
    keys: DataFrame | None,
    kinds: Sequence[str],
    parts: Sequence[str],
) -> DataFrame:
    envelopes = submissions(corpus, kinds=kinds)
    if keys is not None:
        # An envelope without a key is none of a listed taxpayer.
        envelopes = restrict_to_keys(envelopes, keys, "utr")
    made = with_reasons(parse_markup(attachments_or_reasons(envelopes), fields=TABLE_FIELDS))
    if "tables" in parts:
        made = with_cells(select_tables(made))
    if "sections" in parts:
        made = with_sections(made)
    return made.select(
        *[c for c in document_columns(made) if c not in ("folder", "selected")]
    )


def table_job(
    corpus: DataFrame,
    keys: DataFrame | None = None,
    kinds: Sequence[str] = KINDS,
    parts: Sequence[str] = PARTS,
) -> DataFrame:
    """Tables and sections of the attachments of the listed taxpayers.

    Only the named `parts` are made.
    """
    return _good(_table_rows(corpus, keys, kinds, parts))


def table_outcome(
    corpus: DataFrame,
    keys: DataFrame | None = None,
    kinds: Sequence[str] = KINDS,
    parts: Sequence[str] = PARTS,
) -> Outcome:
    """As `table_job`, with rejects."""
    stored = materialise(_table_rows(corpus, keys, kinds, parts), "tables")
    return Outcome(_good(stored), _rejects(stored))


def _tagged_prose(corpus: DataFrame) -> DataFrame:
    return tag_lookup(_prose(corpus, TAG_MIN_WORDS))


def tagcheck_job(corpus: DataFrame) -> DataFrame:
    """Filings whose first long untagged text also stands under a tag."""
    return keep_tagged(_good(_tagged_prose(corpus)))


def tagcheck_outcome(corpus: DataFrame) -> Outcome:
    """As `tagcheck_job`, with rejects."""
    stored = materialise(_tagged_prose(corpus), "tagged")
    return Outcome(keep_tagged(_good(stored)), _rejects(stored))


def word_count_job(lines: DataFrame) -> DataFrame:
    return word_count(lines)
