"""Whole queries that SQL can't express, against plain Python over the same tables."""

import hashlib
import re

from filingscope.operators import documents as D, exposure as X
from filingscope.operators.html import read_html
from filingscope.plans.registry import QUERIES
from tests.test_documents import brute_context


def test_context_windows_of_all_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n, r.context_md5) for r in QUERIES["filing_context_windows"](spark, sf).collect()}
    want = {i: brute_context(t, D.HEADINGS, 70_000, 22_000, 2_000, 7_000) for i, t in docs.items()}
    assert got == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in want.items()}


def chunks(text, size=500, overlap=100, slack=50):
    """A chunk ends after the last ". " (else "! ", else "? ") that begins within the slack of its size."""
    text, out, start = " ".join(text.split()), [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for sign in (". ", "! ", "? "):
                ends = [i for i in range(max(end - slack, start), min(end + slack, len(text)) - 1) if text[i : i + 2] == sign]
                if ends:
                    end = ends[-1] + 1
                    break
        if text[start:end].strip():
            out.append((len(out), start, min(end, len(text)), text[start:end].strip()))
        start = len(text) if end >= len(text) else max(end - overlap, start + 1)
    return out


def test_chunks_of_all_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted((r.doc_id, r.position, r.char_start, r.char_end, r.chunk) for r in QUERIES["chunk_text"](spark, sf).collect())
    assert got == sorted((i, *c) for i, t in docs.items() for c in chunks(t))


TERMS, CONTEXT = ["the", "de la"], ["und"]


def terms_of(text, terms):
    clean = re.sub("[^a-z0-9]+", " ", text.lower()).strip()
    return [t for t in terms if t in clean]


def relation(text):
    if not terms_of(text, TERMS) and terms_of(text, CONTEXT):
        return "commercial_context"
    found = {name: bool(re.search(getattr(X, name), text, re.ASCII)) for name in ("HOLDING", "VALUE", "COMMERCIAL", "FUND")}
    if found["HOLDING"] and found["VALUE"]:
        return "portfolio_schedule_holding"
    return "commercial_context" if found["COMMERCIAL"] else "spv_or_fund_name" if found["FUND"] else "ambiguous_review"


def exposure_rows(html):
    text, tables = read_html(html)
    rows = list(dict.fromkeys(r[:1000] for r in (" ".join(c for c, _ in row) for t in tables for row in t.rows) if len(r) > 30 and terms_of(r, TERMS + CONTEXT)))[:8]
    found = [(r, True) for r in rows]
    if not rows:
        first = terms_of(text, TERMS + CONTEXT)[:1]
        if not first:
            return
        at = text.lower().find(first[0])
        lo, hi = max(0, at - 150), min(len(text), at + len(first[0]) + 180)
        found = [(("..." if lo else "") + text[lo:hi] + ("..." if hi < len(text) else "") if at >= 0 else text[:360], False)]
    for snippet, is_row in found:
        kind = relation(snippet)
        confidence = (0.74 if kind == "portfolio_schedule_holding" else 0.55) if is_row else (0.62 if kind == "commercial_context" else 0.5)
        cusip = re.search(r"\b[0-9A-Z]{9}\b", snippet, re.ASCII)
        yield snippet, is_row, kind, terms_of(snippet, TERMS + CONTEXT), next(iter(terms_of(snippet, TERMS)), None), cusip and cusip[0], confidence


def test_exposure_rows_of_all_pages(spark, sf):
    pages = {str(r.page_id): r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    fields = ("snippet", "is_row", "relation", "matched_terms", "security_name", "cusip", "confidence")
    got = sorted((r.accession, *(r[f] for f in fields)) for r in QUERIES["exposure_parse_documents"](spark, sf).select("accession", *fields).collect())
    assert got == sorted((i, *row) for i, html in pages.items() for row in exposure_rows(html)) and len(got) > 20


def test_exposure_radar_keeps_the_best_row_of_each_hit(spark, sf):
    """The radar's rows are those of the documents that were hit, one for each row's key, ranked."""
    rows = QUERIES["exposure_radar"](spark, sf).collect()
    own = {(r.accession, r.snippet): r for r in QUERIES["exposure_parse_documents"](spark, sf).collect()}
    assert rows and all((r.accession, r.snippet) in own and own[r.accession, r.snippet].relation == r.relation for r in rows)
