"""Links with their row, item and heading, on pages made by hand."""

from __future__ import annotations

from factloom.operators import links as L

PAGE = """<title>x</title><h1>Board</h1><a href="/home">Home</a>
<h2>Notices <i>2024</i></h2>
<table><tr><td>33/2022 - Professors</td><td><a href="n33.pdf">Notification</a></td><td><a href="#">Addendum</a> <a>no address</a>
  <table><tr><td>annex</td><td><A HREF='a&amp;b.pdf'>Form <b>A</b></A></td></tr></table>after</td></tr>
<tr><td>only text</td></tr></table>
<script>document.write('<a href="no">no</a>')</script><!-- <a href="no2">no</a> -->
<h3></h3><ul><li>2019: <a href="p19.pdf">Paper</a> <a href="k19.pdf">Key</a></li><li><a href="mailto:a@b">mail</a></li></ul>
<a href="one"><a href="two">two</a> <a href="three">never ended"""


def read(spark, html, url="https://h.example.org/d/p"):
    got = L.links_in_rows(spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")).collect()
    return [(r["text"], r["target"], r["heading"], r["label"], r["row"], r["table_heading"], r["context"], r["unlinked"]) for r in sorted(got, key=lambda r: r["pos"])]


def test_links_have_their_row_item_and_heading(spark):
    base, head = "https://h.example.org/d/", "Notices 2024"
    row = "33/2022 - Professors Notification Addendum no address after"
    assert read(spark, PAGE) == [
        ("Home", "https://h.example.org/home", "Board", None, None, None, "Board", False),
        ("Notification", base + "n33.pdf", head, None, row, head, row, False),
        ("Addendum", None, head, None, row, head, row, True),
        ("Form A", base + "a&b.pdf", head, None, "annex Form A", head, "annex Form A", False),
        ("Paper", base + "p19.pdf", head, "2019:", None, None, "2019:", False),
        ("Key", base + "k19.pdf", head, "2019:", None, None, "2019:", False),
        ("two", base + "two", head, None, None, None, head, False),
    ]


def test_menus_and_layouts_name_no_row(spark):
    menu = "<table><tr><td>menu</td>" + "".join(f'<td><a href="m{i}">m{i}</a></td>' for i in range(L.ROW_LINKS + 1)) + "</tr></table>"
    layout = f'<table><tr><td>{"long " * 200}</td><td><a href="x">x</a></td></tr></table>'
    assert all(r[4] is None and r[6] == "" for r in read(spark, menu)) and len(read(spark, menu)) == L.ROW_LINKS + 1
    assert read(spark, layout)[0][4] is None
    assert read(spark, "") == [] and read(spark, None) == [] and read(spark, "<a href=x>open") == []
    assert [r[0] for r in read(spark, "<tr><td><a href='#top'>t</a></td></tr><a href='#'>outside</a>")] == ["t"]
