"""Scalar rules as column expressions, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """Nulls, NaN and infinities count as 0."""
    x = _c(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def normalize_cik(x) -> Column:
    """Digits without leading zeros; the trimmed text if none are left."""
    x = F.trim(_c(x))
    digits = F.regexp_replace(F.regexp_replace(x, r"\D", ""), "^0+", "")
    return F.when(digits == "", x).otherwise(digits)


def pad_cik(x) -> Column:
    return F.lpad(_c(x).cast("string"), 10, "0")


def normalize_issuer(x) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(_c(x)), "&", " AND "), "[^A-Z0-9]+", " "))


def compact_issuer(x) -> Column:
    return F.regexp_replace(normalize_issuer(x), " ", "")


def storage_issuer(x) -> Column:
    clean = F.upper(F.regexp_replace(F.trim(_c(x)), r"\s+", " "))
    return F.when(F.coalesce(clean, F.lit("")) == "", "UNKNOWN").otherwise(clean)


def security_key(cusip, issuer) -> Column:
    own = F.upper(F.trim(_c(cusip)))
    return F.concat_ws("|", F.coalesce(F.nullif(own, F.lit("")), F.lit("NO_CUSIP")), storage_issuer(issuer))


def security_of(cusip, issuer) -> Column:
    """What a position is summed by: the CUSIP, else the compact issuer."""
    return F.coalesce(F.nullif(F.upper(F.trim(_c(cusip))), F.lit("")), compact_issuer(issuer))


def quarter_valid(x) -> Column:
    return F.coalesce(_c(x).rlike(r"^\d{4}-Q[1-4]$"), F.lit(False))


def quarter_sort_key(x) -> Column:
    """year * 4 + quarter; what is no quarter sorts first."""
    x = _c(x)
    return F.when(quarter_valid(x), F.substring(x, 1, 4).cast("int") * 4 + F.substring(x, 7, 1).cast("int")).otherwise(F.lit(-1))


def quarter_of_date(x) -> Column:
    x = _c(x)
    return F.concat(F.year(x).cast("string"), F.lit("-Q"), F.quarter(x).cast("string"))


def date_of_dmy(x) -> Column:
    """31-MAR-2026 -> date."""
    return F.try_to_date(F.initcap(F.trim(_c(x))), "dd-MMM-yyyy")


def quarter_from_dmy(x) -> Column:
    """A quarter for dates in March, June, September and December only."""
    month = F.upper(F.regexp_extract(_c(x), r"^\s*\d{1,2}-([A-Za-z]{3})-(\d{4})\s*$", 1))
    year = F.regexp_extract(_c(x), r"^\s*\d{1,2}-([A-Za-z]{3})-(\d{4})\s*$", 2)
    q = F.when(month == "MAR", "1").when(month == "JUN", "2").when(month == "SEP", "3").when(month == "DEC", "4")
    return F.concat(year, F.lit("-Q"), q)


def normalize_sec_date(x) -> Column:
    """yyyymmdd or another date that parses as an ISO date, else the text."""
    x = F.trim(_c(x))
    found = F.coalesce(F.when(x.rlike(r"^\d{8}$"), F.try_to_date(x, "yyyyMMdd")), F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "MM-dd-yyyy"), F.try_to_date(x, "MM/dd/yyyy"), date_of_dmy(x))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), x)


def quarter_end(x) -> Column:
    x = _c(x)
    year, q = F.substring(x, 1, 4).cast("int"), F.substring(x, 7, 1).cast("int")
    return F.when(quarter_valid(x), F.last_day(F.make_date(year, q * 3, F.lit(1))))


def quarter_previous(x) -> Column:
    return quarter_of_date(F.add_months(quarter_end(x), -3))


def filing_deadline(x) -> Column:
    return F.date_add(quarter_end(x), 45)


def filing_index_quarter(x) -> Column:
    """The quarter in which filings for a report quarter are due."""
    return quarter_of_date(F.date_add(quarter_end(x), 1))


def latest_completed_quarter(x) -> Column:
    return quarter_of_date(F.date_sub(F.trunc(_c(x), "quarter"), 1))


def classify_movement(previous, current) -> Column:
    p, c = _c(previous), _c(current)
    return F.when((p <= 0) & (c <= 0), "absent").when(p <= 0, "initiated").when(c <= 0, "liquidated").when(c > p, "increased").when(c < p, "decreased").otherwise("unchanged")


def classify_reverse_movement(previous, current) -> Column:
    """previous is null where no quarter was filed before."""
    p, c = _c(previous), _c(current)
    return F.when(p.isNull(), F.when(c > 0, "no_prior").otherwise("absent")).otherwise(classify_movement(p, c))


def estimate_actual_value(value, shares) -> Column:
    """Values of at most 4 a share are in thousands; decided row by row."""
    v, s = finite(value), finite(shares)
    return F.when(v <= 0, 0.0).when(s <= 0, v).when(F.abs(v / s) > 4, v).otherwise(v * 1000)


def pct1(numerator, denominator) -> Column:
    n, d = _c(numerator).cast("double"), _c(denominator).cast("double")
    return F.when(d > 0, F.round(n / d * 100, 1)).otherwise(0.0)


def round_double(x, places: int) -> Column:
    """round() of doubles as the SQL computes it, by their product with a power of ten; F.round() goes by their shortest decimals."""
    x, by = _c(x), 10.0**places
    near = F.rint(x * by)
    r = F.when(F.abs(x * by - near) == 0.5, x * by + F.signum(x) * 0.5).otherwise(near) / by
    return F.when(F.abs(r) < float("inf"), r).otherwise(x)


def share_pct_change(previous, current) -> Column:
    p, c = _c(previous), _c(current)
    return F.when(p > 0, (c - p) / p * 100).when(c > 0, F.lit(float("inf"))).otherwise(0.0)


def percent_change_tracker(previous, current) -> Column:
    p, c = _c(previous), _c(current)
    return F.when(p > 0, F.when(c <= 0, -100.0).otherwise((c - p) / p * 100)).when(c - p > 0, 100.0).otherwise(0.0)


#: Filer types of single CIKs, and name rules of which the first that matches counts.
FILER_OVERRIDES = {"1067983": "Asset Manager", "1350694": "Hedge Fund", "1423053": "Hedge Fund"}
FILER_RULES = [
    ("Pension / Public Fund", ["PENSION", "RETIREMENT", "RETIREMENT SYSTEM", "PUBLIC EMPLOYEES", "TEACHERS RETIREMENT", "STATE BOARD", "CALPERS", "CALSTRS", "SUPERANNUATION"]),
    ("University / Endowment", ["UNIVERSITY", "COLLEGE", "ENDOWMENT", "FOUNDATION", "REGENTS"]),
    ("Hedge Fund", ["HEDGE", "CAPITAL MANAGEMENT", "CAPITAL ADVISORS", "PARTNERS", "LP", "L P", "MASTER FUND", "CITADEL", "MILLENNIUM", "TWO SIGMA", "POINT72", "SCULPTOR"]),
    ("Asset Manager", ["ASSET MANAGEMENT", "GLOBAL INVESTORS", "INVESTMENT MANAGEMENT", "MANAGEMENT CO", "ADVISERS", "ADVISORS", "VANGUARD", "BLACKROCK", "STATE STREET", "FIDELITY", "T ROWE PRICE", "INVESCO"]),
    ("Investment Adviser", ["INVESTMENT ADVISER", "INVESTMENT ADVISOR", "WEALTH", "FINANCIAL ADVISORS", "RIA"]),
    ("Insurance", ["INSURANCE", "ASSURANCE", "REINSURANCE", "LIFE INS", "MUTUAL INS", "PRUDENTIAL", "METLIFE", "AIG"]),
    ("Bank", ["BANK", "BANCORP", "TRUST CO", "TRUST COMPANY", "NATIONAL ASSOCIATION", "JPMORGAN", "MORGAN STANLEY", "GOLDMAN SACHS", "CITIGROUP", "WELLS FARGO"]),
]


def classify_filer(cik, name) -> Column:
    """A type by CIK, else by the first rule with one of its words in the name, else Other."""
    own, out = normalize_cik(cik), None
    for key, kind in FILER_OVERRIDES.items():
        out = F.when(own == key, kind) if out is None else out.when(own == key, kind)
    for kind, words in FILER_RULES:
        out = out.when(_c(name).rlike(rf"(?i)\b({'|'.join(words)})\b"), kind)
    return out.otherwise("Other")


#: Sectors by words in a name, for issuers that a sector map doesn't have; the first counts.
SECTOR_RULES = [
    ("ETF", ["ETF", "ISHARES", "VANGUARD", "SPDR", "TRUST"]),
    ("Healthcare", ["PHARMA", "THERAPEUTICS", "MEDICAL", "HEALTH"]),
    ("Information Technology", ["TECHNOLOGIES", "SYSTEMS", "SOFTWARE", "SEMICONDUCTOR"]),
    ("Energy", ["ENERGY", "OIL", "GAS", "PETROLEUM"]),
    ("Financial Services", ["BANK", "FINANCIAL", "CAPITAL", "INVESTMENT"]),
    ("Utilities", ["UTILITY", "ELECTRIC", "POWER"]),
    ("Real Estate", ["REALTY", "REIT"]),
    ("Consumer Discretionary", ["AIRLINES", "MOTORS", "AUTOMOTIVE"]),
]


def clean_sector_name(issuer) -> Column:
    return F.trim(F.regexp_replace(F.upper(_c(issuer)), "[.,]", ""))


def sector_by_words(issuer) -> Column:
    name, out = clean_sector_name(issuer), None
    for sector, words in SECTOR_RULES:
        hit = name.rlike("|".join(words))
        out = F.when(hit, sector) if out is None else out.when(hit, sector)
    return out.otherwise("Other")


def sec_folder_url(cik, accession) -> Column:
    digits = F.regexp_replace(F.regexp_replace(_c(cik), r"\D", ""), "^0+", "")
    return F.when(digits != "", F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), digits, F.lit("/"), F.regexp_replace(_c(accession), "-", ""), F.lit("/")))


def sec_submission_url(cik, accession) -> Column:
    return F.concat(sec_folder_url(cik, accession), _c(accession), F.lit(".txt"))


def sec_index_url(cik, accession) -> Column:
    return F.concat(sec_folder_url(cik, accession), _c(accession), F.lit("-index.html"))


def sec_document_url(cik, accession, document) -> Column:
    return F.concat(sec_folder_url(cik, accession), _c(document))


def format_accession(x) -> Column:
    """18 digits -> 10-2-6."""
    return F.regexp_replace(_c(x), r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3")


def parse_number(x, default=None) -> Column:
    """Digits with , $ or % -> double; anything else the default."""
    found = F.regexp_replace(F.trim(_c(x)), "[,$%]", "").try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def form_matches(form, wanted: str) -> Column:
    form, wanted = F.upper(_c(form)), wanted.strip().upper()
    if wanted in ("", "ALL"):
        return F.lit(True)
    hit = form.contains(wanted)
    return hit & ~form.startswith("NT") if wanted in ("10-K", "10-Q") else hit


def strip_amendment(x) -> Column:
    return F.regexp_replace(F.upper(F.trim(_c(x))), "/A$", "")


def distinct_forms(forms) -> Column:
    """An array of forms without amendments' endings and blanks, each once."""
    return F.array_distinct(F.filter(F.transform(_c(forms), strip_amendment), lambda x: x != ""))


def form_fetch_rank(form) -> Column:
    form = F.upper(_c(form))
    return F.when(form.contains("NPORT") | form.contains("N-PORT"), 0).when(form.isin("N-CSR", "N-CSRS"), 1).when(form.startswith("13F"), 2).when(form.isin("497", "485BPOS", "N-2"), 3).otherwise(4)


def split_delimited(x) -> Column:
    return F.filter(F.transform(F.split(_c(x), "[\n,;]"), lambda y: F.trim(y)), lambda y: y != "")


def format_money(x) -> Column:
    x = _c(x).cast("double")
    return F.when(x.isNull(), "N/A").when(F.abs(x) >= 1e9, F.format_string("$%.1fB", x / 1e9)).when(F.abs(x) >= 1e6, F.format_string("$%.1fM", x / 1e6)).otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))


#: Endings that a company's search terms leave out.
NAME_ENDINGS = ["INC", "CORP", "CORPORATION", "CO", "LTD", "PLC", "LLC", "LP", "COMPANY", "HOLDINGS", "GROUP"]


def company_search_terms(x) -> Column:
    """The upper-case name, the name without one ending, its first word: those long enough, each once."""
    name = F.trim(F.regexp_replace(F.upper(_c(x)), "[.,]", ""))
    short = F.trim(F.regexp_replace(name, rf"\s+({'|'.join(NAME_ENDINGS)})$", ""))
    first = F.split(name, r"\s+")[0]
    return F.array_distinct(F.array_compact(F.array(F.nullif(name, F.lit("")), F.when(F.length(short) > 3, short), F.when((F.length(first) > 4) & ~first.isin("THE", "AND", "INC"), first))))


def chunk_id(path, position) -> Column:
    return F.concat(F.substring(F.md5(_c(path)), 1, 8), F.lit("_chunk_"), _c(position).cast("string"))


def hhi_label(x) -> Column:
    return F.when(_c(x) >= 2500, "Highly concentrated").when(_c(x) >= 1500, "Moderately concentrated").otherwise("Unconcentrated")


def normalize_text(x) -> Column:
    """One space for white space, no signs but . , ; : ' \" -, lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(_c(x), r"(?U)\s+", " "), r"(?U)[^\w\s.,;:'\"-]", "")))


def split_sentences(x) -> Column:
    return F.filter(F.transform(F.split(_c(x), "[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)
