"""`parse_elements` as a table function: FROM pages, LATERAL parse_elements(content).

The columns are chosen when a query is analysed: all fields of a node, or those
of a constant list of names. A document that does not parse gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from filings.functions.text import SPACE_CHARS
from filings.operators.markup import read_nodes
from filings.schemas import ELEMENT

NAME = "parse_elements"
# A node's own markup belongs to envelopes.
_OFFERED = [field for field in ELEMENT.fields if field.name != "xml"]


class ParseElements:
    """Nodes with text or tail, but for styled ones, in document order; text and tail stripped."""

    @staticmethod
    def analyze(content: AnalyzeArgument, fields: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(content.dataType, (BinaryType, StringType)):
            raise ValueError(f"{NAME}: the content is binary or a string, not {content.dataType.simpleString()}")
        if fields is None:
            return AnalyzeResult(StructType(_OFFERED))
        if not fields.isConstantExpression or not isinstance(fields.dataType, StringType):
            raise ValueError(f"{NAME}: the fields are a constant string of names")
        names = [name.strip() for name in fields.value.split(",")]
        offered = {field.name: field for field in _OFFERED}
        if unknown := [name for name in names if name not in offered]:
            raise ValueError(f"{NAME}: no such field: {', '.join(unknown)}")
        return AnalyzeResult(StructType([offered[name] for name in names]))

    def eval(self, content, fields: str | None = None) -> Iterator[tuple]:
        names = [name.strip() for name in fields.split(",")] if fields else [f.name for f in _OFFERED]
        content = content.encode() if isinstance(content, str) else content
        for node in read_nodes(content):
            if (node["text"] is None and node["tail"] is None) or node["style_first_line"]:
                continue
            yield tuple(
                node[name].strip(SPACE_CHARS) if name in ("text", "tail") and node[name] is not None else node[name]
                for name in names
            )


def register_parse_elements(spark: SparkSession) -> None:
    spark.udtf.register(NAME, udtf(ParseElements))
