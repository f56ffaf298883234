from weblode import cli
from weblode.functions import sql


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT categorize_url('/api/x') AS c, is_valid_url('/a') AS v, is_valid_url('a b') AS w, query_params('/a?x=1&y#z') AS q").first()
    assert (row.c, row.v, row.w, row.q) == ("api_endpoint", True, False, ["x", "y"])
    spark.createDataFrame([('<a href="/l">', "a.html", "html"), ("fetch('/f/1')", "b.js", "js"), (None, "c", "js")], "content string, n string, t string").createOrReplaceTempView("contents")
    found = spark.sql("SELECT n, url FROM contents, LATERAL extract_urls(content, n, t)").collect()
    assert {(r.n, r.url) for r in found} == {("a.html", "/l"), ("b.js", "/f/1")}


def test_sql_functions_are_inlined(spark):
    sql.register(spark)
    plan = spark.sql("SELECT categorize_url(CAST(id AS STRING)) FROM range(3)")._jdf.queryExecution().optimizedPlan().toString()
    assert "categorize_url" not in plan.split("AS")[0] and "CASE WHEN" in plan


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.js").write_text("r.open('GET', '/x/y?a=1'); s('/z/w')")
    assert cli.main(["-f", str(tmp_path / "a.js"), "--urls-only"], spark) == 0
    assert {"/x/y?a=1", "/z/w"} <= set(capsys.readouterr().out.split())
    assert cli.main(["-f", str(tmp_path / "a.js"), "--csv"], spark) == 0
    assert "xmlhttprequest" in capsys.readouterr().out
    assert cli.main(["-d", str(tmp_path), "--output-dir", str(tmp_path / "out")], spark) == 0
    assert "page_route" in capsys.readouterr().out
    assert cli.main(["--list-techniques"], spark) == 0 and "url_constructor" in capsys.readouterr().out
