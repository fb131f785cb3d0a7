"""Axes of node rows against those of arrays, and a document of many splits."""

from pyspark.sql import functions as F

from filings.operators import structure
from filings.operators.markup import footer_subtrees, parse_markup, parse_rows, well_formed
from filings.operators.structure import cell_rows, footer_rows, section_rows, within
from filings.operators.tables import select_tables, sibling_sections, table_cells, with_cells, with_sections

X = 'xmlns="http://www.w3.org/1999/xhtml"'
PAGES = [
    f"<html {X}><body><p>Tax reconciliation</p><table><tr><td>a<b>b</b>c</td><td/></tr><tr><th>x</th></tr>"
    "<tr><td>t<!--n-->u<table><tr><td>in</td></tr></table>v</td></tr></table></body></html>",
    f"<html {X}><body><p>Contents: adjustment of profit</p><table><tr><td>no</td></tr></table></body></html>",
    f"<html {X}><div class='foot'>f<p>one</p>two<div class='x foot'>n<i>m</i></div></div><p>end</p></html>",
    f"<html {X}><p>Adjustment of Profit</p><p>one<b>two</b></p>tail<p> </p><p>three</p></html>",
    f"<html {X}><p>adjustment of loss</p>and<table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table></html>",
    f"<html {X}/>", "<broken>",
]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_like_the_arrays_in_a_row(spark, monkeypatch):
    pages = spark.createDataFrame([(i, p.encode()) for i, p in enumerate(PAGES)], "doc_id int, content binary")
    parsed, nodes = well_formed(parse_markup(pages)), parse_rows(pages)
    assert [r.doc_id for r in nodes.filter("error IS NOT NULL").collect()] == [6]
    nodes = nodes.filter("error IS NULL").drop("error").persist()
    assert nodes.count() == parsed.select(F.explode("elements")).count()
    footers = footer_subtrees(parsed).select("doc_id", F.inline("subtrees"))
    footers = rows_of(footers.select("doc_id", "anchor_seq", "element.seq", "element.text"))
    cells = rows_of(table_cells(with_cells(select_tables(parsed))))
    sections = rows_of(sibling_sections(with_sections(parsed)))
    assert footers and cells and sections
    for split in (structure.SPLIT, 3):
        monkeypatch.setattr(structure.within, "__defaults__", (split,))
        assert rows_of(footer_rows(nodes, ["doc_id"])) == footers
        assert rows_of(cell_rows(nodes, ["doc_id"])) == cells
        assert rows_of(section_rows(nodes, ["doc_id"])) == sections


def test_a_document_of_a_million_elements_is_joined_by_several_tasks(spark):
    n = 1_000_000
    nodes = spark.range(n).select(F.lit(0).alias("doc"), F.col("id").alias("at"), (F.col("id") % 7).alias("v"))
    # One anchor over all, one over each tenth, and small ones.
    anchors = [(0, -1, n - 1, "all")] + [(0, i * n // 10 - 1, (i + 1) * n // 10 - 1, f"t{i}") for i in range(10)]
    anchors += [(0, i * 1000, i * 1000 + 3, "small") for i in range(500)]
    ranges = spark.createDataFrame(anchors, "doc int, low long, high long, name string")
    options = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        found = within(ranges, nodes, ["doc"]).withColumn("task", F.spark_partition_id())
        counts = found.groupBy("name", "task").count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    total = {}
    for r in counts:
        total[r.name] = total.get(r.name, 0) + r["count"]
    assert total == {"all": n, "small": 1500} | {f"t{i}": n // 10 for i in range(10)}
    assert len({r.task for r in counts if r.name == "all"}) >= 5


def test_no_anchor_and_no_place(spark):
    nodes = spark.createDataFrame([(0, 5, "x")], "doc int, at int, v string")
    ranges = spark.createDataFrame([(0, 5, 5, 1), (1, 0, 9, 2)], "doc int, low int, high int, name int")
    assert within(ranges, nodes, ["doc"]).count() == 0
    assert within(ranges.limit(0), nodes, ["doc"]).count() == 0
    assert within(ranges, nodes.limit(0), ["doc"]).count() == 0


def test_splits_that_share_a_task_keep_their_keys_apart(spark):
    nodes = spark.range(3000).select(
        F.concat(F.lit("d"), (F.col("id") % 30).cast("string")).alias("doc"), (F.col("id") % 2).alias("part"),
        F.col("id").alias("at"), F.concat(F.lit("é"), "id").alias("v"),
    )
    ranges = spark.createDataFrame(
        [(f"d{i}", i % 2, low, low + 1500, ("x", i)) for i in range(0, 40) for low in (-1, 700)],
        "doc string, part long, low long, high long, mark struct<a:string,b:int>",
    )
    expected = ranges.join(nodes, ["doc", "part"]).filter("low < at AND at <= high")
    columns = ["doc", "part", "mark", "at", "v"]
    found = within(ranges, nodes, ["doc", "part"], 100)
    assert rows_of(found.select(columns)) == rows_of(expected.select(columns)) and found.count() > 0


def test_cells_select_their_tables_once(spark):
    pages = spark.createDataFrame([(i, p.encode()) for i, p in enumerate(PAGES)], "doc_id int, content binary")
    nodes = parse_rows(pages).filter("error IS NULL").drop("error")
    plan = cell_rows(nodes, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroups") == 1 and "adjustment of profit" not in plan
