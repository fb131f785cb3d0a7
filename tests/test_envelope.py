"""Envelopes: fields, attachments, base64 and namespaces."""

import base64

from pyspark.sql import functions as F

from filings.operators.envelope import (
    decode_attachments,
    decode_base64,
    drop_empty_attachments,
    explode_attachments,
    normalise_namespace,
    submission_flags,
    submissions,
)
from filings.operators.keys import restrict_to_keys
from filings.operators.markup import parse_markup

CM = "http://www.govtalk.gov.uk/CM/envelope"
CT = "http://www.govtalk.gov.uk/taxation/CT/"


def envelope(*instances, year="7", key="<cm:Key>11</cm:Key><cm:Key>12</cm:Key>"):
    body = "".join(f"<Instance>{i}</Instance>" for i in instances)
    return (
        f'<cm:E xmlns:cm="{CM}">{key}<I xmlns="{CT}{year}"><To>2016-12-31</To>'
        "<IRmark>M1</IRmark><IRmark>M2</IRmark>"
        f"<Computation>{body}</Computation>"
        "<Accounts><Instance><F>ACC</F></Instance></Accounts></I></cm:E>"
    )


def corpus(spark, *sources):
    rows = [(f"f/{n}", bytearray(s.encode())) for n, s in enumerate(sources)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_first_key_period_and_mark_win(spark):
    (row,) = submissions(corpus(spark, envelope())).collect()
    assert (row.utr, row.period_to, row.irmark, row.error) == (
        "11", "2016-12-31", "M1", None,
    )


def test_namespace_of_another_service_is_not_an_envelope(spark):
    other = envelope().replace(CT + "7", CT + "7a")
    (row,) = submissions(corpus(spark, other)).collect()
    assert (row.irmark, row.error) == (None, "no period_to, irmark")


def test_required_fields_and_malformed_files(spark):
    files = corpus(spark, envelope("<F>QQ==</F>", key=""), "<broken>")
    errors = {r.path: r.error for r in submissions(files).collect()}
    assert errors["f/0"] == "no utr" and errors["f/1"]
    assert explode_attachments(submissions(files)).count() == 0
    marked = submissions(files, required=("irmark",))
    assert [r.irmark for r in explode_attachments(marked).collect()] == ["M1"]


def test_attachments_in_order_with_inline_and_empty_ones(spark):
    page = "<x:p xmlns:x='u:x'>a  \n b<x:q/></x:p>"
    source = envelope("<F>QUI=</F><F>0</F>", f"<F>{page}</F><F/>", "<F>\nQUJD\n</F>")
    files = corpus(spark, source)
    rows = decode_attachments(explode_attachments(submissions(files))).collect()
    assert [r.pos for r in rows] == [0, 2, 4]
    assert bytes(rows[0].content) == b"AB"
    assert bytes(rows[2].content) == b"ABC"
    inline = bytes(rows[1].content).decode()
    assert "a b<x:q></x:q>" in inline and f'xmlns="{CT}X"' in inline
    parsed = parse_markup(spark.createDataFrame([(inline,)], "content string"))
    assert [e.tag for e in parsed.first().elements] == ["{u:x}p", "{u:x}q"]


def test_accounts_on_request(spark):
    (row,) = submissions(
        corpus(spark, envelope("<F>QQ==</F>")), kinds=("Computation", "Accounts")
    ).collect()
    assert row.attachments == ["QQ==", "ACC"]


def test_base64_is_lenient(spark):
    texts = ["QUI=", "QU\nI=", "QUI=\n ", "QUI=QUI=", "@QUI=", "QUI", "@@@", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(decode_base64(F.col("t"))).collect()]
    assert [None if g is None else bytes(g) for g in got] == [
        b"AB", b"AB", b"AB", b"AB", b"AB", b"AB", b"", None, None,
    ]
    long = base64.encodebytes(bytes(range(256)) * 9).decode()
    (row,) = spark.createDataFrame([(long,)], "t string").select(
        decode_base64(F.col("t")).alias("b")
    ).collect()
    assert bytes(row.b) == bytes(range(256)) * 9


def test_normalise_namespace(spark):
    rows = spark.createDataFrame([(f"a {CT}12 b {CT}X",), ("none",)], "t string")
    got = [r[0] for r in rows.select(normalise_namespace(F.col("t"))).collect()]
    assert got == [f"a {CT}X b {CT}X", "none"]


def test_flags_and_empty_attachments(spark):
    made = spark.createDataFrame([("0",), (None,), ("QQ==",)], "encoded string")
    assert [r.encoded for r in drop_empty_attachments(made).collect()] == ["QQ=="]
    flags = submission_flags(
        submissions(corpus(spark, envelope("<F>QQ==</F>", "<F>x</F>")))
    ).collect()
    assert [(r.is_ct, r.is_ix) for r in flags] == [(True, True), (True, False)]


def test_restrict_to_keys_within_and_beyond_the_broadcast_bound(spark):
    rows = spark.createDataFrame([(str(i % 7), i) for i in range(70)], "utr string, i int")
    keys = spark.createDataFrame([("1",), ("3",), ("3",), ("x",)], "key string")
    for bound in (10, 1):
        kept = restrict_to_keys(rows, keys, "utr", broadcast_keys=bound)
        assert sorted(r.i for r in kept.collect()) == [
            i for i in range(70) if i % 7 in (1, 3)
        ]
