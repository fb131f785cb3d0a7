"""Fixed schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One node of a document. `elements` arrays hold the nodes in document order,
# so `seq` is both the preorder number and the array position, and the subtree
# of a node is the slice seq..end_seq. Comments, processing instructions and
# unresolved entities are nodes too (`kind`). `text_no` and `tail_no` place the
# node's text and tail among all text nodes of the document.
ELEMENT = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("end_seq", T.IntegerType()),
        T.StructField("parent_seq", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("qname", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("tail", T.StringType()),
        T.StructField("text_no", T.IntegerType()),
        T.StructField("tail_no", T.IntegerType()),
        T.StructField("style_first_line", T.BooleanType()),
        T.StructField("xml", T.StringType()),
    ]
)

# The fields that each kind of work reads.
FACT_FIELDS = ("seq", "attrs", "text", "tail", "style_first_line")
FOOTER_FIELDS = ("seq", "end_seq", "kind", "qname", "attrs", "text", "tail")
ENVELOPE_FIELDS = ("seq", "end_seq", "parent_seq", "kind", "tag", "text", "xml")
TABLE_FIELDS = (
    "seq", "end_seq", "parent_seq", "kind", "tag", "text", "tail", "text_no", "tail_no",
)

# One row per attachment in the stored result of the table job.
TABLE = T.StructType(
    [
        T.StructField("table_no", T.IntegerType()),
        T.StructField(
            "rows",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("row_no", T.IntegerType()),
                        T.StructField("cells", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

CELL_RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("irmark", T.StringType()),
        T.StructField("utr", T.StringType()),
        T.StructField("period_to", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("tables", T.ArrayType(TABLE)),
        T.StructField("sections", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

# One row per phrase in the stored result of the phrase job.
PHRASE_RECORD = T.StructType(
    [
        T.StructField("phrase", T.StringType()),
        T.StructField("irmarks", T.ArrayType(T.StringType())),
        T.StructField("n", T.LongType()),
    ]
)
