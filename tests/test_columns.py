from datetime import date

import pytest
from pyspark.sql import functions as F

from filingscope.functions import columns as C


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("raw,want", [("0000012", "12"), (" A ", "A"), ("000", "000"), ("CIK 0042", "42")])
def test_normalize_cik(spark, raw, want):
    assert one(spark, C.normalize_cik(F.lit(raw)))[0] == want


def test_issuers(spark):
    x = F.lit("  Johnson & Johnson, Inc. ")
    assert list(one(spark, C.normalize_issuer(x), C.compact_issuer(x), C.storage_issuer(F.lit("  a  b ")), C.storage_issuer(F.lit(" ")), C.security_key(F.lit(" abc "), F.lit("x")), C.security_key(F.lit(""), F.lit("x")))) == ["JOHNSON AND JOHNSON INC", "JOHNSONANDJOHNSONINC", "A B", "UNKNOWN", "ABC|X", "NO_CUSIP|X"]


def test_quarters(spark):
    q = F.lit("2026-Q1")
    row = one(spark, C.quarter_sort_key(q), C.quarter_sort_key(F.lit("x")), C.quarter_end(q), C.quarter_previous(q), C.filing_deadline(q), C.filing_index_quarter(q), C.latest_completed_quarter(F.lit(date(2026, 2, 1))), C.quarter_from_dmy(F.lit("31-MAR-2026")), C.quarter_from_dmy(F.lit("31-JAN-2026")), C.normalize_sec_date(F.lit("20260331")), C.normalize_sec_date(F.lit("soon")))
    assert list(row) == [2026 * 4 + 1, -1, date(2026, 3, 31), "2025-Q4", date(2026, 5, 15), "2026-Q2", "2025-Q4", "2026-Q1", None, "2026-03-31", "soon"]


@pytest.mark.parametrize("p,c,want", [(0, 0, "absent"), (0, 1, "initiated"), (1, 0, "liquidated"), (1, 2, "increased"), (2, 1, "decreased"), (1, 1, "unchanged")])
def test_movement(spark, p, c, want):
    assert one(spark, C.classify_movement(F.lit(p), F.lit(c)))[0] == want


def test_reverse_movement(spark):
    none = F.lit(None).cast("double")
    assert list(one(spark, C.classify_reverse_movement(none, F.lit(1)), C.classify_reverse_movement(none, F.lit(0)), C.classify_reverse_movement(F.lit(0), F.lit(1)))) == ["no_prior", "absent", "initiated"]


def test_values(spark):
    nan = F.lit(float("nan"))
    assert list(one(spark, C.estimate_actual_value(F.lit(50.0), F.lit(10.0)), C.estimate_actual_value(F.lit(40.0), F.lit(10.0)), C.estimate_actual_value(F.lit(7.0), F.lit(0.0)), C.estimate_actual_value(nan, F.lit(1.0)), C.pct1(F.lit(1), F.lit(3)), C.pct1(F.lit(1), F.lit(0)), C.percent_change_tracker(F.lit(0.0), F.lit(5.0)), C.percent_change_tracker(F.lit(4.0), F.lit(0.0)), C.share_pct_change(F.lit(0.0), F.lit(5.0)))) == [50.0, 40_000.0, 7.0, 0.0, 33.3, 0.0, 100.0, -100.0, float("inf")]


@pytest.mark.parametrize("cik,name,want", [("0001067983", "anything", "Asset Manager"), ("1", "Teachers Retirement Fund", "Pension / Public Fund"), ("1", "Oak Partners LP", "Hedge Fund"), ("1", "First Bank", "Bank"), ("1", "Riabank", "Other"), ("1", "State University Bank", "University / Endowment")])
def test_filer_types(spark, cik, name, want):
    assert one(spark, C.classify_filer(F.lit(cik), F.lit(name)))[0] == want


def test_forms_and_text(spark):
    row = one(spark, C.form_matches(F.lit("NT 10-K"), "10-K"), C.form_matches(F.lit("10-K/A"), "10-K"), C.strip_amendment(F.lit("13f-hr/a")), C.split_delimited(F.lit("a, b;;c\nd")), C.format_money(F.lit(2.5e9)), C.format_money(F.lit(1234.0)), C.format_money(F.lit(None)), C.format_accession(F.lit("000119312526000001")), C.parse_number(F.lit("$1,234.5")), C.parse_number(F.lit("N/A"), 0), C.company_search_terms(F.lit("Apple Inc.")), C.hhi_label(F.lit(1500)))
    assert list(row) == [False, True, "13F-HR", ["a", "b", "c", "d"], "$2.5B", "$1,234", "N/A", "0001193125-26-000001", 1234.5, 0.0, ["APPLE INC", "APPLE"], "Moderately concentrated"]
