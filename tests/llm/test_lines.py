from rowlens.llm import lines


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_lines_of_a_page(spark):
    html = "<!DOCTYPE html><head><title>T</title><script>var x='</p>';</script></head><p>one <b>bold</b>\t word</p><!-- no --><div>two<br>three</div><style>p{}</style>"
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(lines.html_lines(df["h"])).collect()] == [["T", "one bold word", "two", "three"], [], []]


def test_share_of_the_pages_of_a_host(spark):
    rows = [(i, f"https://Site.example/{i}", f"<p>menu</p><p>body {i}</p>" + "<p>often</p>" * (2 if i < 4 else 0)) for i in range(10)]
    rows += [(100, "http://alone.example/", "<p>menu</p><p>menu</p>"), (200, "no url", "<p>menu</p>"), (201, None, None)]
    found = {r["page_id"]: r for r in lines.drop_boilerplate(pages(spark, rows)).collect()}
    assert all(found[i]["text"] == f"body {i}" for i in range(10))
    assert (found[0]["n_lines"], found[0]["n_dropped"], found[0]["host"]) == (4, 3, "site.example")
    assert (found[100]["text"], found[200]["text"]) == ("menu\nmenu", "menu") and found[201]["text"] == "" and found[201]["host"] is None


def test_hosts_of_few_pages_lose_their_boilerplate(spark):
    """Two to four pages with a menu and a footer on each, and a line that only one of them has."""
    rows = [(10 * n + i, f"http://user@few{n}.example:80/{i}", f"<p>menu</p><p>body {i}</p><p>footer</p>") for n in (2, 3, 4) for i in range(n)]
    found = {r["page_id"]: r for r in lines.drop_boilerplate(pages(spark, rows)).collect()}
    assert all((r["n_dropped"], r["text"]) == (2, f"body {i % 10}") for i, r in found.items())


def test_columns_of_the_same_names(spark):
    rows = [(i, "http://a.example/", f"<p>menu</p><p>{i}</p>") for i in range(4)]
    held = pages(spark, rows).selectExpr("*", "'x' AS host", "1 AS lines", "2 AS frequent", "3 AS kept", "4 AS key", "5 AS line", "6 AS n")
    assert {r["text"] for r in lines.drop_boilerplate(held).collect()} == {"0", "1", "2", "3"}


def test_a_share_equal_to_the_ratio_stays(spark):
    rows = [(i, "http://a.example/", f"<p>{'x' if i < 3 else i}</p>") for i in range(10)]
    assert {r["n_dropped"] for r in lines.drop_boilerplate(pages(spark, rows)).collect()} == {0}


def test_awkward_rows(spark, awkward):
    held = awkward.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    assert lines.drop_boilerplate(held).count() == 10
    assert lines.drop_boilerplate(pages(spark, [])).count() == 0
