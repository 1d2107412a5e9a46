"""The reader of HTML on what regular expressions get wrong, and what the tables of filings give."""

import time

from filingscope.operators import exposure as X, html as H, offerings as O


def cells(html):
    return [[[c for c, _ in row] for row in t.rows] for t in H.read_html(html)[1]]


def test_nested_quoted_and_coded():
    page = """<TABLE a="1 > 0"><tr><td>outer<table><tr><th>in&#x41;</th><td>b&amp;b</td></tr></table>after</td><td title='x>y'>&#8364;5&nbsp;m</td></tr></TABLE>"""
    assert cells(page) == [[["outer after", "€5 m"]], [["inA", "b&b"]]]
    assert H.read_html(page)[0] == "outer inA b&b after €5 m" and [t.depth for t in H.read_html(page)[1]] == [0, 1]


def test_unclosed_and_hidden():
    page = "<p>a<table><tr><td>1<td>2<tr><td>3<script>if (a < b) '<td>'</script><!-- <td>no --><style>td > p {}</style></table>b<noscript>no</noscript> 1 < 2 &lt;p&gt;"
    assert cells(page) == [[["1", "2"], ["3"]]]
    assert H.read_html(page)[0] == "a 1 2 3 b 1 < 2 <p>"
    assert H.read_html(None) == ("", []) == H.read_html("") and cells("<table><td>x") == [[["x"]]] and cells("</table></td><tr><td>y") == []


def test_time_is_linear_in_broken_pages():
    for piece in ("<p title='it's>", '<a href="x>', "<!-- ", "<table><tr><td>", "<", "<script>"):
        began = time.time()
        H.read_html(piece * 20_000)
        assert time.time() - began < 10


def test_statement_inside_a_layout_table():
    page = "<table><tr><td><p>(in millions)</p><table><tr><th>Year</th><th>2025</th></tr><tr><td>Net sales</td><td>$</td><td>1,200.5</td></tr><tr><td>Net loss</td><td>(3)</td></tr></table></td></tr></table>"
    assert O.table_financials(page) == {"revenue": 1200.5e6, "net_income": -3e6, "total_assets": None}


def test_exposure_rows_of_nested_tables_and_coded_signs(spark):
    page = """<table><tr><td>Schedule<table><tr><td title="a > b">Acme &#82;ocket Corp preferred shares</td><td>&#36;1,234,567 fair value 037833100</td></tr><tr><td>short</td></tr></table></td></tr></table>"""
    docs = spark.createDataFrame([("a", page), ("b", "<p>A launch contract with Acme&nbsp;Rocket Corp.</p>"), ("c", None)], "accession string, html string")
    got = [tuple(r) for r in X.exposure_parse_documents(docs, ["accession"], ["Acme Rocket"]).select("accession", "snippet", "is_row", "relation", "security_name", "cusip", "amount", "confidence").orderBy("accession").collect()]
    assert got == [
        ("a", "Acme Rocket Corp preferred shares $1,234,567 fair value 037833100", True, "portfolio_schedule_holding", "Acme Rocket", "037833100", 1234567.0, 0.74),
        ("b", "A launch contract with Acme Rocket Corp.", False, "commercial_context", "Acme Rocket", None, None, 0.62),
    ]
