"""Order of inputs, what is left out, totals, and the files that a run writes."""

import http.server
import json
import os
import threading

import pytest

from weblode import cli
from weblode.operators import parsers, relational, sinks
from weblode.plans import engine, layers
from weblode.sources import files


@pytest.fixture
def site(tmp_path):
    for name, content in {
        "z.js": 'x("/same/1"); y("/z/only")', "b.js": 'x("/same/1"); y("/b/only")', "dir/a-b/x.js": 'x("/same/2")', "dir/a/x.js": 'x("/same/2")', "dir/a/y.js": 'x("/same/2")',
        "dir/.git/no.js": '"/no/1"', "dir/node_modules/no.js": '"/no/2"', "dir/bin.js": "\0\0", "odd[1].js": 'x("/odd/1")',
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    return tmp_path


def winners(spark, **inputs):
    found = engine.extract(files.collect(spark, **inputs), techniques=(2,), with_parsers=False)
    return {r.url: r.source_file.rsplit("/", 1)[-1] if "/dir/" not in r.source_file else r.source_file.split("/dir/")[1] for r in found.collect()}


def test_arguments_and_names_order_the_documents(spark, site):
    z, b = str(site / "z.js"), str(site / "b.js")
    assert winners(spark, paths=[z, b])["/same/1"] == "z.js"
    assert winners(spark, paths=[b, z])["/same/1"] == "b.js"
    assert winners(spark, paths=[b, z, b])["/same/1"] == "b.js"
    assert winners(spark, folders=[str(site / "dir")]) == {"/same/2": "a/x.js"}  # folder a before a-b
    assert winners(spark, paths=[str(site / "odd[1].js")]) == {"/odd/1": "odd[1].js"}
    order = {r.file_name.rsplit("/", 1)[-1]: r.doc_ord for r in files.collect(spark, paths=[z, b], raw="x").collect()}
    assert order["z.js"] < order["b.js"] < order["stdin"]


def test_relative_folder(spark, site):
    assert sorted(r.file_name.split("/dir/")[1] for r in files.folder(spark, os.path.relpath(site / "dir") + "/").collect()) == ["a-b/x.js", "a/x.js", "a/y.js"]


def test_what_cannot_be_read_is_a_row(spark, site, capsys):
    inputs = files.read_inputs(spark, lists=[str(site / "gone.txt")], paths=[str(site / "z.js"), str(site / "gone.js")], folders=[str(site / "dir"), str(site / "gone")])
    assert sorted((r.file_name.rsplit("/", 1)[-1], r.reason) for r in inputs.rejected.collect()) == [
        ("bin.js", "binary"), ("gone", "not found"), ("gone.js", "not found"), ("gone.txt", "not found"),
    ]
    assert inputs.docs.count() == 4
    small = files.rejected(spark, [str(site / "z.js")], max_megabytes=0)
    assert small.count() == 0
    assert cli.main(["-f", str(site / "z.js"), "-f", str(site / "gone.js"), "-v", "-oD", str(site / "out")], spark) == 0
    said = capsys.readouterr()
    assert "gone.js: not found" in said.err and "errors                       1" in said.out and "inputs processed             2" in said.out


def test_totals_and_summary(spark, site):
    inputs = files.read_inputs(spark, paths=[str(site / "z.js"), str(site / "gone.js")], raw="u = 'mailto:a@b.example.com'; fetch('/api/x'); v = 'tg://a.b'")
    results = engine.extract(inputs.docs)
    assert tuple(relational.totals(inputs.docs, results, inputs.rejected).first()) == (3, results.count(), 1)
    lines = [(r.category, r.urls) for r in relational.summary_lines(results).orderBy("place").collect()]
    assert [c for c, _ in lines] == ["api_endpoint", "page_route", "internal_infra", "other"] or [c for c, _ in lines][-1] == "other"
    assert sum(n for _, n in lines) == results.count()


def test_files_of_a_run(spark, site):
    results = engine.extract(files.collect(spark, paths=[str(site / "z.js")], raw="r.open('POST', '/api/x?a=1')"))
    counts = sinks.write_files(results, str(site / "out"), methods=True)
    assert "POST /api/x?a=1" in (site / "out/api_endpoints.txt").read_text().splitlines()
    assert (site / "out/all_urls.txt").read_text().count("\n") == counts["all_urls.txt"] == results.count()
    full = json.loads((site / "out/results.json").read_text())
    assert len(full) == results.count() and {"url", "source_line", "category"} <= set(full[0])
    assert [r["url"] for r in full] == [r.url for r in results.collect()]
    sinks.write_files(results.limit(0), str(site / "none"))
    assert json.loads((site / "none/results.json").read_text()) == [] and (site / "none/all_urls.txt").read_text() == ""


def test_patterns_are_tested_by_the_engine_that_runs_them(spark, capsys):
    urls = spark.createDataFrame([("/a",)], "url string")
    assert relational.filtered(urls, exclude="(?P<x>a)").count() == 1 and "invalid exclude pattern" in capsys.readouterr().err
    assert relational.filtered(urls, include="(?d)a").count() == 1


class Pages(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page")
        elif self.path in ("/page", "/other"):
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
        else:
            self.send_response(404)
        self.end_headers()
        self.wfile.write(f'<a href="/from{self.path}">x</a><a href="/both">'.encode())

    def log_message(self, *args):
        pass


def test_fetched_urls_keep_their_order(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        (tmp_path / "list.txt").write_text(f"# list\n{base}/other\n\n{base}/page\n{base}/gone\n")
        inputs = files.read_inputs(spark, urls=[f"{base}/moved"], lists=[str(tmp_path / "list.txt")])
        docs = inputs.docs.orderBy("doc_ord").collect()
        assert [(d.file_name.rsplit("/", 1)[-1], d.file_type) for d in docs] == [("moved", "html"), ("other", "html"), ("page", "html")]
        assert [r.file_name for r in inputs.rejected.collect()] == [f"{base}/gone"]
        found = {r.url: r.source_file for r in engine.extract(inputs.docs, techniques=(2,)).collect()}
        assert found["/both"] == f"{base}/moved" and found["/from/other"] == f"{base}/other"
    finally:
        server.shutdown()


def test_layers_are_timed(tmp_path, capsys):
    (tmp_path / "a.js").write_text("fetch('/a/b'); // see https://c.example.com/d\n" * 10)
    assert layers.main([str(tmp_path / "a.js")]) == 0 and layers.main([]) == 1
    said = capsys.readouterr().out
    assert said.count("layer") == 7 and "total" in said


def test_text_inside_text_elements_is_no_markup():
    text = "<title><a href='/no/1'></title><textarea><a href='/no/2'></textarea><iframe src='/yes/1'><a href='/no/3'></iframe><xmp><a href='/no/4'></xmp><a href='/yes/2'>"
    assert [r["url"] for r in parsers.html_rows(text)] == ["/yes/1", "/yes/2"]


def test_parsers_run_in_the_stream_too(spark, tmp_path):
    from weblode.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<img srcset='s1.png 1x'><link href='css/no-slash.css'>")
    found = incremental.new_results(incremental.watch_folder(spark, str(tmp_path / "in")), techniques=(2,))
    query = found.writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.url for r in spark.table("parsed").collect()) == ["css/no-slash.css", "s1.png"]


def test_sql_runs_all_techniques(spark):
    from weblode.functions import sql, urls as U

    sql.register(spark)
    spark.createDataFrame([("// see https://a.example.com/x\nr.open('GET', '/y/z')", "a.js", "js")], "content string, n string, t string").createOrReplaceTempView("some_contents")
    found = spark.sql("SELECT url, technique_id FROM some_contents, LATERAL extract_urls(content, n, t)").collect()
    assert {("/y/z", 16), ("https://a.example.com/x", 1), ("https://a.example.com/x", 54)} <= {tuple(r) for r in found}
    urls = ["a.", "a).", "f(x)", "f(x)).", "((a)", "", "a'\"`", "f(x),", "a) ."]
    spark.createDataFrame([(u,) for u in urls], "url string").createOrReplaceTempView("some_urls")
    assert {r.url: r.c for r in spark.sql("SELECT url, clean_url(url) AS c FROM some_urls").collect()} == {u: U.clean(u) for u in urls}


def test_category_twins_agree(spark):
    from pyspark.sql import functions as F

    from weblode.functions import urls as U

    urls = ["wss://a", "ws:", "a.map", ".map", "data:x", "mailto:a", "intent://x", "https://b.s3.amazonaws.com/k", "http://x.internal/", "/API/x", "/v2/x", "a.js", ".js", "x/é.png", "http://", "https://e.com", "/about", ""]
    native = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.categorize_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in native} == {u: U.category_of(u) for u in urls}


def test_boxes():
    assert cli.boxed("ab", ["long", "x"]) == ["┌──────┐", "│  ab  │", "├──────┤", "│ long │", "│ x    │", "└──────┘"]


@pytest.mark.parametrize("text", ["<!--" * 30_000, "<!--" * 30_000 + ">", "<a " * 30_000, '<a href="' * 15_000, "<" * 60_000 + ">", "<script>" * 20_000, "</" * 30_000, "<?" * 30_000 + ">"])
def test_hostile_pages_end(text):
    import time

    began = time.perf_counter()
    parsers.html_rows(text)
    assert time.perf_counter() - began < 10
    assert [r["url"] for r in parsers.html_rows('<a href="/first">' + text)] == ["/first"]
