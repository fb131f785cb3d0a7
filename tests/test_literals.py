import ast
import json
import random

from pyspark.sql import functions as F

from filings.functions.literals import literal_json
from filings.sources.corpus import read_index, read_phrase_lines, read_records


def plain(value):
    """A literal's value as JSON has it."""
    if isinstance(value, dict):
        names = {None: "null", True: "true", False: "false"}
        return {k if isinstance(k, str) else names.get(k, str(k)) if not isinstance(k, int) or isinstance(k, bool) else str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.decode() if isinstance(value, bytes) else value


def rewritten(spark, lines):
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return [r.json for r in frame.select("i", literal_json(F.col("line")).alias("json")).orderBy("i").collect()]


def some_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 2:
        return "".join(rng.choice(["a", "'", '"', "\\", "\n", "\t", "\x07", "é", "€", "\U0001f600", ",", ":", "]", "{", " ", "\x1b"]) for _ in range(rng.randint(0, 8)))
    if kind < 6:
        return [None, True, rng.randint(-99, 99), rng.uniform(-1e6, 1e6)][kind - 2]
    if kind == 6:
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == 7:
        return tuple(some_value(rng, depth + 1) for _ in range(rng.randint(0, 3)))
    keys = [rng.choice(["k", "it's", 'a"b', 3, None, "x\\"]) for _ in range(rng.randint(0, 3))]
    return {key: some_value(rng, depth + 1) for key in keys}


def test_printed_values_read_back(spark):
    rng = random.Random(5)
    values = [some_value(rng) for _ in range(600)]
    lines = [ascii(v) if i % 3 == 0 else repr(v) for i, v in enumerate(values)]
    for line, found in zip(lines, rewritten(spark, lines)):
        assert found is not None and json.loads(found) == plain(ast.literal_eval(line)), line


def test_forms_that_are_not_printed_today(spark):
    lines = [
        "u'a'", 'U"it\'s"', "12L", "-3l", "5.", ".5", "-.5e3", "+7", "007", r"'\101\60\x41€\U0001F600\q\a\v'", "(1,)",
        "{'a': (1, 2,), }", '{"a": null, "b": [true, false]}', "b'x'", "'tab\there'", "'" + r"x\'" * 5000 + "'",
    ]
    values = [
        "a", "it's", 12, -3, 5.0, 0.5, -500.0, 7, 7, "A0A€\U0001f600\\q\a\v", [1], {"a": [1, 2]},
        {"a": None, "b": [True, False]}, "x", "tab\there", "x'" * 5000,
    ]
    assert [json.loads(found) for found in rewritten(spark, lines)] == values


def test_what_is_no_literal(spark):
    lines = ["", "  ", "name", "{'a': b}", "'open", "{'a': 'b}", "f('x')", "1 + 2", "{'a': 1} x", "'﷐'", "12ab", "None1", None]
    assert rewritten(spark, lines) == [None] * len(lines)


def test_index_of_all_forms_and_rejects(spark, tmp_path):
    good = {
        "{'irmark': u'B'}": "B", "{'irmark': 'C', 'x': None}": "C", "{'x': None, 'irmark': 'D'}": "D",
        "{'x': True, 'irmark': 'F'}": "F", '{"irmark": "J", "n": null}': "J", "{'irmark': None}": None,
        r"{'irmark': 'it\'s', 'y': ('a', {'b': [1L]})}": "it's",
    }
    bad = ["{'irmark': 'open}", "{'other': 1}", "('irmark', 1)", "{'irmark': 'a'} {", "{'irmark': 'a'}, {'irmark': 'b'}", "{'irmark' 'a'}", "{'irmark': {'a'}}", "[1, 2"]
    path = tmp_path / "index.txt"
    path.write_text("\n".join([*good, "", *bad]))
    found = read_index(spark, str(path)).collect()
    assert sorted(r.irmark or "" for r in found if r.corrupt_record is None) == sorted(v or "" for v in good.values())
    assert sorted(r.corrupt_record for r in found if r.corrupt_record) == sorted(bad)
    assert all(r.irmark is None for r in found if r.corrupt_record)


def test_typed_records(spark, tmp_path):
    path = tmp_path / "records.txt"
    path.write_text("{'n': 3L, 'when': u'2016', 'parts': ('a', 'b')}\nnonsense")
    rows = read_records(spark, str(path), "n long, parts array<string>", required=("n",)).collect()
    assert {(r.n, tuple(r.parts or ()), r.corrupt_record) for r in rows} == {(3, ("a", "b"), None), (None, (), "nonsense")}


def test_phrase_lines(spark, tmp_path):
    path = tmp_path / "part-00000"
    path.write_text("('p q', ('m1,m2', 2))\n\n(1,)\n(u'it', (u'm\\xe9', 15L))\n('p', ('m1', 'many'))\n('p', 3)\nbroken line\n")
    rows = read_phrase_lines(spark, str(path)).collect()
    good = {(r.phrase, tuple(r.irmarks), r.n) for r in rows if r.corrupt_record is None}
    assert good == {("p q", ("m1", "m2"), 2), ("it", ("mé",), 15)}
    assert sorted(r.corrupt_record for r in rows if r.corrupt_record) == ["('p', ('m1', 'many'))", "('p', 3)", "broken line"]
