"""Paged services, served from files; top-level nodes of pages."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from vellum.operators import convert
from vellum.sources import rest


def test_batches_follow_their_cursors(spark, tmp_path):
    pages = {"a|b_*": ([1, 2], "x"), "a|b_x": ([3], None), "c_*": ([4], "y"), "c_y": ([], "z")}
    for name, (ids, cursor) in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"results": [{"id": i} for i in ids], "meta": {"next_cursor": cursor}}))
    df = rest.read_pages(spark, f"file://{tmp_path}/{{ids}}_{{cursor}}.json", ["a", "b", None, "c"], batch="2")
    rows = df.withColumn("id", F.from_json("record", "id int")["id"]).orderBy("id").collect()
    assert [(r.batch, r.page, r.n, r.id) for r in rows] == [(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 3), (1, 0, 0, 4)]


def test_numbers_are_cursors(spark, tmp_path):
    for at, (ids, cursor) in {"0": ([1], 25), "25": ([2], 50), "50": ([3], False)}.items():
        (tmp_path / f"p{at}.json").write_text(json.dumps({"results": [{"id": i} for i in ids], "meta": {"next_cursor": cursor}}))
    df = rest.read_pages(spark, f"file://{tmp_path}/p{{cursor}}.json", first="0")
    assert sorted(r.record for r in df.collect()) == ['{"id": 1}', '{"id": 2}', '{"id": 3}']


def test_a_page_that_goes_on_failing_fails(spark, tmp_path):
    with pytest.raises(PythonException):
        rest.read_pages(spark, f"file://{tmp_path}/none_{{cursor}}.json", pause="0").collect()


def test_top_level_nodes(spark):
    html = '<html><head><title>t</title></head><body>lone <p class="x">One <b>two</b><sup class="footnote-ref" id="Fn1" fn-count-id="1">1</sup></p><script>no()</script>\n<div><p>in</p><a class="in-text-citation" href="#smith2001">S</a><a class="in-text-citation" data-refs="a1,b2" href="#a1">A</a></div><hr><ul><li>x<li>y</ul></body></html>'
    pages = spark.createDataFrame([(7, html), (8, None), (9, "<h1>No body</h1>")], "page_id long, html string")
    got = [(r.node_id, r.chunk, r.type, r.plain, r.references, [f.asDict() for f in r.footnotes]) for r in convert.top_nodes(pages, per_chunk=2).orderBy("book", "line").collect()]
    assert got == [
        ("7_1", 0, "p", "lone", [], []), ("7_2", 0, "p", "Onetwo1", [], [{"id": "Fn1", "marker": "1"}]), ("7_3", 1, "div", "inSA", ["smith2001", "a1", "b2"], []), ("7_4", 1, "hr", "", [], []), ("7_5", 2, "ul", "xy", [], []),
        ("9_1", 0, "h1", "No body", [], []),
    ]
