"""Documents whose rows lie together, and those whose rows do not."""

from pyspark.sql import functions as F

from filings.operators import structure
from filings.operators.markup import parse_markup, parse_rows, well_formed
from filings.operators.structure import cell_rows, in_place, joined_cell_rows, joined_section_rows, section_rows
from filings.operators.tables import select_tables, sibling_sections, table_cells, with_cells, with_sections
from tests.test_structure import PAGES, rows_of


def test_rows_that_do_not_lie_together_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, p.encode()) for i, p in enumerate(PAGES)], "doc_id int, content binary")
    parsed = well_formed(parse_markup(pages))
    nodes = parse_rows(pages).filter("error IS NULL").drop("error").persist()
    cells = rows_of(table_cells(with_cells(select_tables(parsed))))
    sections = rows_of(sibling_sections(with_sections(parsed)))
    # Cut by the ends of partitions, dealt by node, and turned round.
    ordered = nodes.coalesce(1).sortWithinPartitions("doc_id", F.desc("seq"))
    for rows, split in ((nodes.repartitionByRange(4, "doc_id", "seq"), 3), (nodes.repartition(5, "seq"), structure.SPLIT), (ordered, 3)):
        monkeypatch.setattr(structure.within, "__defaults__", (split,))
        assert rows_of(cell_rows(rows, ["doc_id"])) == cells
        assert rows_of(section_rows(rows, ["doc_id"])) == sections
    assert rows_of(joined_cell_rows(nodes, ["doc_id"])) == cells
    assert rows_of(joined_section_rows(nodes, ["doc_id"])) == sections


def test_documents_are_made_where_they_lie_and_no_node_is_lost(spark):
    options = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {key: spark.conf.get(key) for key in options}
    sizes = [1, 5, 6, 7, 8, 13, 14, 20, 21, 40, 3]
    rows = [("k", d, s, n - 1 if s == 0 else s, f"{d}.{s}") for d, n in enumerate(sizes) for s in range(n)]
    nodes = spark.createDataFrame(rows, "k string, doc int, seq int, end_seq int, text string")
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        nodes, keys = nodes.coalesce(1), ["k", "doc"]
        texts = lambda documents: documents.withColumn("texts", F.col("elements.text"))
        for rows_in, most, whole in (
            (nodes, 20, {d for d, n in enumerate(sizes) if n <= 20}),
            (nodes.filter("NOT (doc = 5 AND seq IN (4, 12)) AND NOT (doc = 6 AND seq = 0)"), 100, set(range(11)) - {5, 6}),
        ):
            made, rest = in_place(rows_in, keys, texts, "texts", most)
            assert {r.doc: r.texts for r in made.collect()} == {d: [f"{d}.{s}" for s in range(sizes[d])] for d in whole}
            left = rows_in.filter(~F.col("doc").isin(sorted(whole)))
            assert rows_of(rest) == rows_of(left) and rest.columns == nodes.columns
        made, rest = in_place(nodes.limit(0), keys, texts, "texts")
        assert made.count() == rest.count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_documents_that_lie_together_are_not_shuffled(spark, monkeypatch):
    pages = spark.range(0, 400, 1, 4).select("id", F.lit(PAGES[0].encode()).alias("content"))
    nodes = parse_rows(pages).filter("error IS NULL").drop("error")
    joined, within = [], structure.within
    monkeypatch.setattr(structure, "within", lambda anchors, places, *more: joined.append(places.count()) or within(anchors, places, *more))
    assert cell_rows(nodes, ["id"]).count() == 3 * 400 and section_rows(nodes, ["id"]).count() == 0
    assert joined and sum(joined) == 0
