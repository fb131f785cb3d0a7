"""Facts, fragments and the tag check."""

import random

from filings.operators.facts import (
    resolve_facts,
    with_facts,
    with_fragments,
)
from filings.operators.markup import parse_markup, well_formed
from tests.test_fuzzy import brute as distance
from filings.operators.tagging import keep_tagged, tag_lookup, tag_lookup_fuzzy


def pages(spark, *sources):
    rows = list(enumerate(sources))
    return well_formed(
        parse_markup(spark.createDataFrame(rows, "doc_id int, content string"))
    )


def test_fact_names_contexts_and_sentinels(spark):
    source = (
        "<a>\n<b NAME='n1' contextRef='c1'>x</b><b name='n2' Name='n3'>y</b>"
        "<b id='1'>z</b><b ContextRef='c4' class='k'>u</b><b>v</b><!--w--></a>"
    )
    rows = resolve_facts(pages(spark, source)).collect()
    assert [(r.name, r.context, r.text, r.is_tagged) for r in rows] == [
        ("No attr", "No ctx", "", False),
        ("n1", "c1", "x", True),
        ("n3", "Ukn Conv", "y", True),
        ("Ukn Conv", "Ukn Conv", "z", False),
        ("Ukn Conv", "c4", "u", False),
        ("No attr", "No ctx", "v", False),
        ("No attr", "No ctx", "w", False),
    ]


def test_fragments_of_text_and_tail(spark):
    source = (
        "<a>\n<b>One two THREE</b> tail of three words <c name='n'>in a tag here</c>"
        " after the tag too<d>two words</d><e/> one two</a>"
    )
    facts = with_facts(pages(spark, source, "<a>none</a>"))
    prose = with_fragments(facts, 2).collect()
    assert [r.fragments for r in prose] == [["one two three", "tail of three words"]]
    everything = with_fragments(facts, 2, untagged_only=False).collect()
    assert [r.fragments for r in everything] == [
        ["one two three", "tail of three words", "in a tag here", "after the tag too"]
    ]


def test_tag_lookup_takes_the_first_match_of_the_first_fragment(spark):
    inside = "<a>\n<p>we sell nice blue hats</p><p>a second long fragment is here</p>"
    sources = [
        inside + "<f name='n1' contextRef='c1'>no</f>"
        "<f name='n2' contextRef='c2'>Yes WE sell nice blue hats.</f>"
        "<f name='n3' contextRef='c3'>we sell nice blue hats</f></a>",
        inside + "<f name='n4'>short</f> for we sell nice blue hats too</a>",
        inside + "<f id='q'>Q we sell nice blue hats</f>"
        "<f name='n5'>a second long fragment is here</f></a>",
        "<a>\n<p>too short</p><f name='n'>too short</f></a>",
    ]
    prose = with_fragments(with_facts(pages(spark, *sources)), 4)
    found = {r.doc_id: r for r in tag_lookup(prose).collect()}
    assert (found[0].name, found[0].context, found[0].matched_in) == ("n2", "c2", "text")
    assert (found[1].name, found[1].matched_in) == ("n4", "tail")
    assert (found[2].status, found[2].name, found[2].matched_in) == ("untagged", None, None)
    assert 3 not in found
    assert sorted(r.doc_id for r in keep_tagged(tag_lookup(prose)).collect()) == [0, 1]


def test_a_fragment_within_a_longer_fact_matches(spark):
    fragment = "a fragment of thirty letters x"
    within = "this fact: " + fragment + " plus words"
    assert len(fragment) == 30 and len(within) == 52
    texts = (within, within + " and more of them than can match", fragment[:12], "")
    sources = [f"<a>\n<p>{fragment}</p><f name='n'>{text}</f></a>" for text in texts]
    prose = with_fragments(with_facts(pages(spark, *sources)), 5)
    found = {r.doc_id: r.status for r in tag_lookup_fuzzy(prose).collect()}
    assert found == {0: "tagged", 1: "untagged", 2: "untagged", 3: "untagged"}


def test_fuzzy_lookup_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta".split()

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    documents = []
    for _ in range(60):
        first = text(6)
        facts = [
            (first[: rng.randint(5, len(first))] + text(2) if rng.random() < 0.3
             else text(rng.randint(0, 9)), text(rng.randint(0, 6)))
            for _ in range(4)
        ]
        documents.append((first, facts))
    sources = [
        f"<a>\n<p>{first}</p>"
        + "".join(f"<f name='n{i}'>{t}</f>{tail}" for i, (t, tail) in enumerate(facts))
        + "</a>"
        for first, facts in documents
    ]
    prose = with_fragments(with_facts(pages(spark, *sources)), 5)
    got = {r.doc_id: r.name for r in tag_lookup_fuzzy(prose).collect()}

    def alike(a, b):
        b = b or "###"
        short, long = sorted((a, b), key=len)
        return 2 * (len(short) - distance(short, long)) / (len(a) + len(b)) > 0.6

    expected = {
        n: next((f"n{i}" for i, pair in enumerate(facts) if any(alike(first, t) for t in pair)), None)
        for n, (first, facts) in enumerate(documents)
    }
    assert got == expected
    assert 5 < sum(name is not None for name in got.values()) < 60
