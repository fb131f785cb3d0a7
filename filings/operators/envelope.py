"""Submission envelopes: their fields and their attached documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.functions.tree import children
from filings.operators.computed import computed
from filings.operators.markup import document_columns, parse_markup
from filings.schemas import ENVELOPE_FIELDS

# Namespaces of an envelope. The year in the second one varies
# and is rewritten to X.
ENVELOPE_NS = "http://www.govtalk.gov.uk/CM/envelope"
TAXATION_NS = "http://www.govtalk.gov.uk/taxation/CT/X"
_YEARLY_NS = r"http://www\.govtalk\.gov\.uk/taxation/CT/\d+"

# Fixed value: an attachment of this text is no attachment.
EMPTY_ATTACHMENT = "0"

FIELDS = {
    "utr": f"{{{ENVELOPE_NS}}}Key",
    "period_to": f"{{{TAXATION_NS}}}To",
    "irmark": f"{{{TAXATION_NS}}}IRmark",
}


def normalise_namespace(text: Column) -> Column:
    return F.regexp_replace(text, _YEARLY_NS, TAXATION_NS)


def _named(node: Column, tag: str) -> Column:
    local = tag.rpartition("}")[2]
    return node["tag"].endswith("}" + local) & (
        normalise_namespace(node["tag"]) == tag
    )


def _first(tag: str) -> Column:
    """First element of the tag, as a node."""
    return F.get(F.filter("elements", lambda e: _named(e, tag)), F.lit(0))


def parse_envelopes(corpus: DataFrame, content: str = "content") -> DataFrame:
    return parse_markup(corpus, content, ENVELOPE_FIELDS, keep_xml_under="Instance")


def envelope_fields(
    parsed: DataFrame, required: Sequence[str] = tuple(FIELDS), **more: Column
) -> DataFrame:
    """Adds taxpayer, period end and receipt mark: the first of each.

    A document without one of the required elements gets an `error`. Columns in
    `more` are computed in the same pass.
    """
    firsts = {f"_{name}": _first(tag) for name, tag in FIELDS.items()}
    found = computed(parsed, **firsts, **more)
    lacking = F.concat_ws(
        ", ", *[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in required]
    )
    missing = F.when(F.length(lacking) > 0, F.concat(F.lit("no "), lacking))
    return found.withColumns(
        {
            **{name: F.col(f"_{name}.text") for name in FIELDS},
            "error": F.coalesce("error", missing),
        }
    ).drop(*[f"_{name}" for name in FIELDS])


def _payload(child: Column) -> Column:
    """Attachment as base64: its text, or its first child's markup encoded."""
    elements = F.col("elements")
    inline = F.get(elements, child["seq"] + 1)["xml"]
    flat = F.regexp_replace(normalise_namespace(inline), r"\s+", " ")
    # Spark breaks long base64 into lines, as the encoded form may hold.
    encoded = F.base64(F.encode(flat, "UTF-8"))
    return F.when(child["end_seq"] == child["seq"], child["text"]).otherwise(encoded)


def attachments_of(kinds: Sequence[str] = ("Computation",)) -> Column:
    """Base64 texts of all attachments, in document order."""
    elements = F.col("elements")
    holders = [f"{{{TAXATION_NS}}}{kind}" for kind in kinds]
    instance = f"{{{TAXATION_NS}}}Instance"
    instances = F.filter(
        elements,
        lambda e: _named(e, instance)
        & normalise_namespace(F.get(elements, e["parent_seq"])["tag"]).isin(holders),
    )
    return F.flatten(
        F.transform(
            instances, lambda i: F.transform(children(elements, i), _payload)
        )
    )


def submissions(
    corpus: DataFrame,
    content: str = "content",
    kinds: Sequence[str] = ("Computation",),
    required: Sequence[str] = tuple(FIELDS),
) -> DataFrame:
    """One row per envelope with its fields, `attachments` and `error`."""
    parsed = parse_envelopes(corpus, content)
    made = envelope_fields(parsed, required, attachments=attachments_of(kinds))
    return made.select(
        *document_columns(parsed), *FIELDS, "attachments", "error"
    )


def drop_empty_attachments(attachments: DataFrame) -> DataFrame:
    return attachments.filter(
        F.col("encoded").isNotNull() & (F.col("encoded") != EMPTY_ATTACHMENT)
    )


def explode_attachments(envelopes: DataFrame) -> DataFrame:
    """One row per attachment of the readable envelopes: `pos` and `encoded`."""
    kept = [c for c in envelopes.columns if c not in ("attachments", "error")]
    rows = envelopes.filter(F.col("error").isNull()).select(
        *kept, F.posexplode("attachments").alias("pos", "encoded")
    )
    return drop_empty_attachments(rows)


def decode_base64(encoded: Column) -> Column:
    """Bytes of a base64 text, NULL where it is none.

    Characters outside the alphabet are skipped and so is what follows the
    padding; that is looked at only where the text as it stands does not decode.
    """
    form = F.lit("base64")
    alphabet = F.regexp_replace(encoded, "[^A-Za-z0-9+/=]+", "")
    body = F.substring_index(alphabet, "=", 1)
    return F.coalesce(F.try_to_binary(encoded, form), F.try_to_binary(body, form))


def decode_attachments(attachments: DataFrame) -> DataFrame:
    """`encoded` gives way to `content`, NULL where it is not base64."""
    return computed(attachments, content=decode_base64(F.col("encoded"))).drop(
        "encoded"
    )


def attachments_or_reasons(envelopes: DataFrame) -> DataFrame:
    """Decoded attachments, and what could not be read with `stage` and `reason`.

    An unreadable envelope is one row, with neither `pos` nor `content`; an
    attachment that is not base64 keeps its row.
    """
    kept = [c for c in envelopes.columns if c not in ("attachments", "error")]
    listed = F.when(F.col("error").isNull(), F.col("attachments"))
    rows = envelopes.select(
        *kept, F.col("error").alias("_why"), F.posexplode_outer(listed).alias("pos", "encoded")
    )
    is_file = F.col("encoded").isNotNull() & (F.col("encoded") != EMPTY_ATTACHMENT)
    rows = rows.filter(F.col("_why").isNotNull() | is_file)
    rows = computed(rows, content=decode_base64(F.col("encoded"))).drop("encoded")
    no_content = F.col("content").isNull()
    return rows.withColumns(
        {
            "stage": F.when(F.col("_why").isNotNull(), "envelope").when(no_content, "attachment"),
            "reason": F.coalesce("_why", F.when(no_content, "not base64")),
        }
    ).drop("_why")


def submission_flags(envelopes: DataFrame) -> DataFrame:
    """Per attachment: does it have a taxpayer (`is_ct`) and content (`is_ix`)."""
    return decode_attachments(explode_attachments(envelopes)).select(
        "path",
        "irmark",
        "pos",
        F.col("utr").isNotNull().alias("is_ct"),
        F.col("content").isNotNull().alias("is_ix"),
    )
