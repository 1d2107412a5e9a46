import pytest

from filingscope.operators import portfolio as P
from filingscope.operators.matching import alias_table, issuer_watchlist_match, sector_of
from filingscope.operators.radar import Radar

FILINGS = "cik string, fund_name string, accession string, filing_date string, quarter string"
HOLDINGS = "row_id long, cik string, accession string, quarter string, issuer string, cusip string, value double, shares double"
NOW, OLD = "2026-Q1", "2025-Q4"


@pytest.fixture(scope="module")
def radar(spark):
    filings = [("0001", "A Bank", "a1", "2026-05-01", NOW), ("1", "A Bank", "a2", "2026-05-10", NOW), ("1", "A Bank", "a0", "2026-02-01", OLD), ("2", "B Pension", "b1", "2026-05-01", NOW), ("2", "B Pension", "b0", "2026-02-01", OLD), ("3", "C", "c1", "2026-05-01", NOW), ("3", "C", "c0", "2026-02-01", OLD), ("4", "D", "d1", "2026-05-01", NOW)]
    rows = [(1, "1", "a2", NOW, "Red Hat Software", "x1", 100.0, 10.0), (2, "1", "a1", NOW, "Red Hat Software", "x1", 900.0, 90.0), (3, "1", "a0", OLD, "Red Hat Software", "x1", 50.0, 5.0), (4, "2", "b0", OLD, "Blue Software Corp", None, 5.0, 5.0), (5, "3", "c1", NOW, "Alphabet Inc Cl A", None, 50.0, 5.0), (6, "4", "d1", NOW, "Red Hat Software", "x1", 10.0, 1.0)]
    lists = {"software": [("RHT", "Red Hat", []), ("BLU", "Blue Software", []), ("GOOGL", "Alphabet A", ["ALPHABET"]), ("GOOG", "Alphabet C", ["ALPHABET"])], "empty": [("ZZZ", "Nobody Knows", [])]}
    return Radar(spark.createDataFrame(filings, FILINGS), spark.createDataFrame(rows, HOLDINGS), alias_table(spark, lists), NOW, OLD)


def test_summary(radar):
    got = {r["category"]: r for r in radar.category_summary().collect()}
    s = got["software"]
    assert (s["comparable"], s["exposed"], s["buyers"], s["sellers"], s["initiated"], s["liquidated"]) == (3, 3, 2, 1, 1, 1)
    assert s["exposed_pct"] == 100.0 and s["sellers_pct_exposed"] == 33.3
    assert got["empty"]["exposed"] == 0 and got["empty"]["comparable"] == 3


def test_invariants(radar):
    for r in radar.category_summary().collect():
        assert r["buyers"] + r["sellers"] + r["unchanged"] == r["exposed"]
    states = sum(r["current_shares"] for r in radar.security_positions().collect())
    assert states == sum(r["current_shares"] for r in radar.filer_category_positions().collect())


def test_amended_filing_and_padded_cik_count_once(radar):
    rows = {r["cik"]: r for r in radar.filer_category_positions().collect()}
    assert set(rows) == {"1", "2", "3"} and rows["1"]["current_shares"] == 10.0


def test_current_holders_include_new_filers(radar):
    got = {r["cik"]: r["action"] for r in radar.current_holders_by_category().collect()}
    assert got == {"1": "increased", "3": "initiated", "4": "initiated"}


def test_share_classes_and_short_aliases(spark):
    issuers = spark.createDataFrame([("Alphabet Inc Class A",), ("Alphabet Inc Class C",), ("Alphabet Inc",), ("IBM Corp",)], "issuer string")
    aliases = alias_table(spark, {"t": [("GOOGL", "Alphabet A", []), ("GOOG", "Alphabet C", []), ("IBM", "IBM", [])]})
    assert {(r["issuer"], r["ticker"]) for r in issuer_watchlist_match(issuers, aliases).collect()} == {("Alphabet Inc Class A", "GOOGL"), ("Alphabet Inc Class C", "GOOG"), ("Alphabet Inc", "GOOG")}


def test_sectors_match_both_ways(spark):
    issuers = spark.createDataFrame([("APPLE INC.",), ("APPLE",), ("Acme Pharma",), ("Nobody",)], "issuer string")
    got = {r["issuer"]: r["sector"] for r in sector_of(issuers, [("APPLE INC", "Technology"), ("APPLE", "Fruit")]).collect()}
    assert got == {"APPLE INC.": "Technology", "APPLE": "Fruit", "Acme Pharma": "Healthcare", "Nobody": "Other"}


def test_upper_median(spark):
    rows = [("1", "a", "q", s, "i", v, 1.0) for s, v in (("s1", 1.0), ("s2", 2.0), ("s3", 5.0), ("s4", 9.0))]
    own = spark.createDataFrame(rows, "cik string, accession string, quarter string, security string, issuer string, value double, shares double")
    assert {r["value"] for r in P.unit_normalize_by_median(own).collect()} == {0.001, 0.002, 0.005, 0.009}


def test_reverse_lookup_actions(spark):
    filings, rows, want = [], [], {}
    for i, (p, c, action) in enumerate([(0.0, 5.0, "initiated"), (5.0, 0.0, "liquidated"), (5.0, 9.0, "increased"), (9.0, 5.0, "decreased"), (5.0, 5.0, "unchanged"), (None, 5.0, "no_prior"), (0.0, 0.0, None)], 1):
        filings.append((str(i), f"F{i}", f"n{i}", "2026-05-01", NOW))
        rows.append((i, str(i), f"n{i}", NOW, "X", None, 10 * c, c))
        if p is not None:
            filings.append((str(i), f"F{i}", f"o{i}", "2025-08-01", "2025-Q2"))
            rows.append((100 + i, str(i), f"o{i}", "2025-Q2", "X", None, 10 * p, p))
        if action:
            want[str(i)] = action
    found = P.reverse_lookup(spark.createDataFrame(filings, FILINGS), spark.createDataFrame(rows, HOLDINGS))
    assert {r["cik"]: r["action"] for r in found.collect()} == want
    assert {r["action"]: r["n"] for r in P.reverse_action_counts(found).collect()}["all"] == 6


def test_difference_of_quarters_equals_the_outer_join(spark, sf):
    from filingscope.operators import portfolio as P
    from filingscope.plans.fixtures import CURRENT, PREVIOUS
    from filingscope.plans.portfolio_queries import latest_portfolio

    now, before = latest_portfolio(spark, sf, CURRENT), latest_portfolio(spark, sf, PREVIOUS)
    join, one = P.portfolio_diff(now, before), P.quarter_diff(now.unionByName(before), CURRENT, PREVIOUS)
    assert sorted(map(tuple, join.collect()), key=str) == sorted(map(tuple, one.select(join.columns).collect()), key=str)


def test_all_sheets_are_the_outputs_in_order(spark, sf):
    from filingscope.operators.audit import audit_export_tables
    from filingscope.plans.fixtures import SECTORS, radar

    r = radar(spark, sf).materialise()
    sheets = audit_export_tables(r, SECTORS, "metal", 40)
    raw = r.raw_matched_holdings()
    details = [(m.cik, m.category, *d) for m in r.top_filer_moves(40).collect() for d in m.details]
    whole = {
        "Coverage": (r.radar_coverage(), []), "Category Trends": (r.category_summary(), ["category"]), "Sector Movers": (r.sector_movers(SECTORS), ["sector"]), "Filer Type Trends": (r.filer_type_summary(), ["filer_type", "category"]),
        "Private Credit Institutions": (r.institution_category_summary("metal"), ["cik"]), "Filer Security Audit": (r.audit_rows(), ["cik", "category", "security"]), "Security Movements": (r.top_security_movements(40), []),
        "Raw Current": (raw.filter("period = 'current'"), ["row_id"]), "Raw Previous": (raw.filter("period = 'previous'"), ["row_id"]),
    }
    plain = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in rows]
    for name, (rows, keys) in whole.items():
        want = sorted(rows.collect(), key=lambda x: tuple(x[k] for k in keys)) if keys else rows.collect()
        assert plain(sheets[name].collect()) == plain(want[:40]), name
    assert sheets["Read Me"].count() == 4 and len(sheets) == 11
    got = [(x.cik, x.category, *x[3:]) for x in sheets["Top Filer Move Details"].collect()]
    assert sorted(plain(got), key=str) == sorted(plain(sorted(details, key=lambda x: x[:4])[:40]), key=str)
    r.drop()
