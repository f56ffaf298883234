import json

import pytest
from pyspark.sql import functions as F

from weblode.operators import parsers, relational, sinks
from weblode.plans import engine
from weblode.sources import detect, files


def documents(spark, *rows):
    raw = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)], "i long, name string, text string")
    return engine.documents(raw, "i", "name", "text")


def test_types(spark):
    cases = [("a.JS", None, ""), ("x.js?v=1", None, ""), ("a", "text/html", ""), ("a", "application/xml+svg", ""), ("a", None, "  <!DOCTYPE HTML>"), ("a", None, "[1]"), ("a", None, "x"), ("b.map", "text/html", "")]
    rows = spark.createDataFrame(cases, "n string, m string, c string")
    kinds = [r[0] for r in rows.select(detect.file_type(F.col("n"), F.col("m"), F.col("c"))).collect()]
    assert kinds == ["js", "unknown", "html", "svg", "html", "json", "unknown", "sourcemap"]


def test_first_document_wins_and_script_lines_win_over_the_page(spark):
    page = '<html>\n<a href="/link">x</a>\n<script>\nfetch("/inline")</script></html>'
    found = {r.url: r for r in engine.extract(documents(spark, ("p.html", page), ("b.js", 'x("/link"); y("/only/b")'))).collect()}
    assert (found["/link"].source_file, found["/link"].detection_method, found["/link"].source_line) == ("p.html", "html_a_href", 2)
    assert found["/inline"].source_line == 2  # of the script
    assert found["/only/b"].source_file == "b.js"
    assert [r for r in found if r.startswith("/")] == sorted(r for r in found if r.startswith("/"))


def test_methods_are_kept_apart(spark):
    found = engine.extract(documents(spark, ("a.js", "r.open('GET', '/same/x'); r.open('POST', '/same/x')")), techniques=(16,), with_parsers=False).collect()
    assert sorted(r.http_method for r in found) == ["GET", "POST"]


def test_empty_inputs(spark):
    assert engine.extract(documents(spark, ("a.js", ""), ("b.js", None))).count() == 0
    assert files.collect(spark).count() == 0


def test_filters(spark, capsys):
    urls = spark.createDataFrame([("https://a.example.com/1",), ("https://b.example.org/2",), ("/x",)], "url string")
    assert relational.filtered(urls, scope="example.com").count() == 1
    assert relational.filtered(urls, exclude="example").count() == 1
    assert relational.filtered(urls, include="^https", exclude="org").count() == 1
    assert relational.filtered(urls, exclude="(").count() == 3
    assert "invalid exclude pattern" in capsys.readouterr().err


def test_parsers_on_bad_text(spark):
    rows = spark.createDataFrame([("",), ("{",), ("<",), ("<a href=",), ('{"a": NaN}',), ("[" * 3000,), ('"/x" {',)], "c string")
    for kind, parse in parsers.PARSERS.items():
        assert rows.select(F.inline(parse(F.col("c")))).count() >= 0, kind
    assert parsers.json_rows("{") is None and parsers.source_map_text("{") == []


def test_html_parser():
    text = '<META HTTP-EQUIV=refresh content="0; URL=\'/next\'"><a href="/a&amp;b"><a href="#"><video src=/v poster=/p><img srcset="/1.png 1x, /2.png"><div data-x="/d" data-y="d">'
    assert [r["url"] for r in parsers.html_rows(text)] == ["/next", "/a&b", "/v", "/p", "/1.png", "/2.png", "/d"]
    assert [s["content"] for s in parsers.inline_scripts("<script>a</script><script src=x>b</script><script> </script>")] == ["a"]


def test_manifest_and_source_map():
    rows = parsers.json_rows('{"start_url": "/s", "icons": [{"src": "i.png"}, 1], "n": {"href": "/h"}}')
    assert [(r["url"], r["detection_method"]) for r in rows] == [("/s", "manifest_start_url"), ("i.png", "manifest_icon"), ("/s", "json_value"), ("i.png", "json_url_key"), ("/h", "json_url_key")]
    rows = parsers.json_rows('{"mappings": "", "sources": ["a.js", null, "/b.js"], "sourceRoot": "r/"}')
    assert [r["url"] for r in rows] == ["r/", "r/a.js", "/b.js"]


def test_sources_and_sinks(spark, tmp_path):
    site = tmp_path / "site"
    for name, content in {"a.js": 'x("/one/1")', "sub/b.html": '<a href="/two">', "node_modules/c.js": '"/no/1"', ".git/d.js": '"/no/2"', "e.bin": "x", "f.json": "\x00"}.items():
        (site / name).parent.mkdir(parents=True, exist_ok=True)
        (site / name).write_text(content)
    docs = files.collect(spark, folders=[str(site)], raw='fetch("/raw/1")')
    assert sorted(r.file_name.rsplit("/", 1)[-1] for r in docs.collect()) == ["a.js", "b.html", "stdin"]
    assert files.rejected(spark, [str(site / "f.json")]).first().reason == "binary"
    results = engine.extract(docs).cache()
    assert {"/one/1", "/two", "/raw/1"} <= {r.url for r in results.collect()}
    sinks.write_category_folders(results, str(tmp_path / "out"))
    assert (tmp_path / "out/by_category/category_file=page_routes.txt").is_dir()
    rows = [json.loads(x) for x in sinks.as_json(results).toJSON().collect()]
    assert all("http_method" not in r or r["http_method"] for r in rows)
    sinks.write_csv(results, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(sinks.CSV_COLUMNS)
    assert len(json.loads(sinks.json_array(results).first()[0])) == results.count()


def test_text_line(spark):
    hits = engine.extract(documents(spark, ("a.js", "r.open('GET', '/x/y?a=1&b=2')")), techniques=(16,), with_parsers=False)
    assert sinks.as_text(hits, methods=True, params=True, source=True, debug=True).first()[0] == "GET /x/y?a=1&b=2 [a,b] (a.js:1) {xmlhttprequest #16}"


def test_url_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# a\n\n https://a.example.com/ \n//b\nhttp://c.example.com\n")
    assert [r.url for r in files.url_list(spark, str(tmp_path / "list.txt")).collect()] == ["https://a.example.com/", "http://c.example.com"]


def test_stream(spark, tmp_path):
    from weblode.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.js").write_text('x("/s/1"); y("/s/1")')
    (tmp_path / "in/b.js").write_text('x("/s/1"); z("/s/2")')
    found = incremental.new_results(incremental.watch_folder(spark, str(tmp_path / "in")), techniques=(2,))
    query = found.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.url for r in spark.table("seen").collect()) == ["/s/1", "/s/2"]


def test_incremental_run(spark):
    now = spark.createDataFrame([("", "/a"), ("GET", "/a")], "http_method string, url string")
    assert [r.http_method for r in relational.unseen(now, now.where("http_method = ''")).collect()] == ["GET"]


def test_entry_runs_without_the_training_operators(monkeypatch):
    """The package imports and registers its queries when the training operators are taken out."""
    import subprocess
    import sys

    code = "import sys; sys.modules['weblode.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60; assert 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["category_summary", "extract_pages", "technique_confidence_rollup"])
def test_plans_over_pages(spark, name):
    from weblode.plans.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_summaries_run_all_techniques(spark, monkeypatch):
    from weblode.plans.queries import QUERIES

    seen, few = [], engine.all_hits

    def all_hits(docs, techniques, with_parsers):
        seen.append((techniques, with_parsers))
        return few(docs, (2,), False)

    monkeypatch.setattr(engine, "all_hits", all_hits)
    for name in ("category_summary", "technique_confidence_rollup"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [(list(range(1, 68)), True)] * 2
