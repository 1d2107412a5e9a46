"""Exposure to one entity: find and classify its mentions in filing documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.columns import form_fetch_rank, parse_number
from filingscope.operators.automaton import contained
from filingscope.operators.html import parse_html

#: Word patterns of a commercial, a holding, a value and a fund context.
COMMERCIAL = r"(?i)\b(customer|supplier|contract|launch|satellite|license|licensing|agreement|service|services|network|terminal|antenna|rocket|payload|reseller|manufactur|partner|strategic relationship)\b"
HOLDING = r"(?i)\b(portfolio|investment|security|securities|holding|holdings|schedule of investments|fair value|preferred|common stock|class [a-z]|shares|balance|cost|value|principal amount|units)\b"
VALUE = r"(?i)(\$|usd|valusd|fair value|value|pctval|percent|shares|balance|units|cusip|\d{1,3}(,\d{3})+|\d+\.\d+)"
FUND = r"(?i)\b(spv|fund|partners|capital|venture|private shares|select fund|growth fund|portfolio company)\b"
RELATIONS = ("direct_holding", "portfolio_schedule_holding", "ambiguous_review", "spv_or_fund_name", "commercial_context", "false_positive")


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, case and signs ignored."""
    clean = plain(text)
    return F.array_compact(F.array(*[F.when(clean.contains(plain(F.lit(t))), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def exposure_term_match(docs: DataFrame, aliases: list[str], contextual: list[str] = (), text_col: str = "text") -> DataFrame:
    """Documents with a term, and which."""
    return docs.withColumn("matched_terms", matched_terms(F.col(text_col), [*aliases, *contextual])).filter(F.size("matched_terms") > 0)


def exposure_terms(docs: DataFrame, terms: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, term) for each of a table of any number of terms (column term) that a document contains, case and signs
    ignored; each document is read once. Terms of signs alone match nothing."""
    clean = terms.select("term", plain(F.col("term")).alias("pattern")).distinct()
    found = contained(docs.select(*keys, plain(F.col(text_col)).alias("_clean")), clean, keys, "_clean")
    return found.join(clean, "pattern").select(*keys, "term")


def exposure_classify(text: Column, aliases: list[str], contextual: list[str] = ()) -> Column:
    """Contextual terms alone are commercial; then holding with value, commercial, fund name, else to be reviewed."""
    alone = (F.size(matched_terms(text, list(aliases))) == 0) & (F.size(matched_terms(text, list(contextual))) > 0)
    return F.when(alone, "commercial_context").when(text.rlike(HOLDING) & text.rlike(VALUE), "portfolio_schedule_holding").when(text.rlike(COMMERCIAL), "commercial_context").when(text.rlike(FUND), "spv_or_fund_name").otherwise("ambiguous_review")


def compact_snippet(text: Column, needle: Column) -> Column:
    """150 characters before and 180 after a needle; the beginning where it isn't found."""
    at = F.instr(F.lower(text), F.lower(needle))
    begin, end = F.greatest(F.lit(1), at - 150), F.least(F.length(text) + 1, at + F.length(needle) + 180)
    cut = F.concat(F.when(begin > 1, "...").otherwise(""), F.substr(text, begin, end - begin), F.when(end <= F.length(text), "...").otherwise(""))
    return F.when(F.coalesce(at, F.lit(0)) > 0, cut).otherwise(F.substring(text, 1, 360))


def exposure_parse_documents(docs: DataFrame, keys: list[str], aliases: list[str], contextual: list[str] = (), html_col: str = "html") -> DataFrame:
    """Candidates of a document: table rows of over 30 characters with a term, at most eight, else one from its text.

    Confidence: rows .74 as holdings and .55 else; text .62 as commercial context and .5 else. The security is
    the first alias, a nine-character CUSIP and a $ amount are inferred.
    """
    terms = [*aliases, *contextual]
    pages = parse_html(docs, keys, html_col)
    cells = F.transform("rows", lambda r: F.concat_ws(" ", r["cells"]))
    rows = F.slice(F.array_distinct(F.transform(F.filter(cells, lambda r: (F.length(r) > 30) & (F.size(matched_terms(r, terms)) > 0)), lambda r: F.substring(r, 1, 1000))), 1, 8)
    base = pages.select(*keys, F.col("text").alias("_text"), rows.alias("_rows"))
    found = base.withColumn("_m", matched_terms(F.col("_text"), terms)).filter((F.size("_rows") > 0) | (F.size("_m") > 0))
    narrative = compact_snippet(F.col("_text"), F.get("_m", F.lit(0)))
    out = found.withColumn("candidate", F.explode(F.when(F.size("_rows") > 0, F.transform("_rows", lambda r: F.struct(r.alias("snippet"), F.lit(True).alias("is_row")))).otherwise(F.array(F.struct(narrative.alias("snippet"), F.lit(False).alias("is_row"))))))
    out = out.select(*keys, "candidate.snippet", "candidate.is_row")
    text = F.col("snippet")
    out = out.withColumns({"relation": exposure_classify(text, aliases, contextual), "matched_terms": matched_terms(text, terms), "security_name": F.get(matched_terms(text, list(aliases)), F.lit(0)), "cusip": F.nullif(F.regexp_extract(text, r"\b[0-9A-Z]{9}\b", 0), F.lit("")), "amount": parse_number(F.regexp_extract(text, r"\$\s?([0-9][0-9,]*(?:\.\d+)?)", 1))})
    return out.withColumn("confidence", F.when(F.col("is_row"), F.when(F.col("relation") == "portfolio_schedule_holding", 0.74).otherwise(0.55)).otherwise(F.when(F.col("relation") == "commercial_context", 0.62).otherwise(0.5)))


def exposure_parse_13f(holdings: DataFrame, aliases: list[str]) -> DataFrame:
    """Holdings rows of the entity: confidence .9, values always in thousands."""
    terms = matched_terms(F.col("issuer"), aliases)
    rows = holdings.withColumn("matched_terms", terms).filter(F.size("matched_terms") > 0)
    return rows.withColumns({"value": F.col("value") * 1000, "relation": F.lit("direct_holding"), "confidence": F.lit(0.9), "security_name": F.col("issuer")})


def dedupe_search_hits(hits: DataFrame) -> DataFrame:
    """One row per accession and document, terms united."""
    rest = [c for c in hits.columns if c not in ("accession", "document", "matched_terms")]
    return hits.groupBy("accession", "document").agg(*[F.min(c).alias(c) for c in rest], F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("matched_terms"))


def search_hits_ranked(hits: DataFrame, n: int | None = None) -> DataFrame:
    out = dedupe_search_hits(hits).orderBy(form_fetch_rank("form"), F.desc("filing_date"), "filer", "document")
    return out.limit(n) if n else out


def dedupe_exposure_rows(rows: DataFrame) -> DataFrame:
    """One row per accession, document, relation and evidence (security, issuer or the snippet's first 90 characters)."""
    evidence = F.coalesce(F.nullif("security_name", F.lit("")), F.substring("snippet", 1, 90))
    keys = ["accession", "document", "relation"]
    rest = [c for c in rows.columns if c not in (*keys, "matched_terms", "confidence")]
    out = rows.withColumn("evidence", evidence).groupBy(*keys, "evidence").agg(*[F.min(c).alias(c) for c in rest], F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("matched_terms"))
    return out.drop("evidence")


def relation_rank(relation: str = "relation") -> Column:
    return F.array_position(F.array(*map(F.lit, RELATIONS)), F.col(relation))


def exposure_ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy(relation_rank(), F.desc("filing_date"), F.desc("confidence"), "filer")


def exposure_subset_filters(rows: DataFrame) -> dict[str, DataFrame]:
    """Holdings, rows to review, commercial ones, 13F ones."""
    review = F.col("relation").isin("ambiguous_review", "spv_or_fund_name") | F.coalesce(F.col("status").isin("review", "error"), F.lit(False))
    return {"holdings": rows.filter(F.col("relation").isin("direct_holding", "portfolio_schedule_holding")), "review": rows.filter(review), "commercial": rows.filter("relation = 'commercial_context'"), "13f": rows.filter(F.upper("form").startswith("13F"))}


def exposure_export_tables(rows: DataFrame) -> dict[str, DataFrame]:
    sets = exposure_subset_filters(rows)
    narrative = rows.filter(~F.col("relation").isin("direct_holding", "portfolio_schedule_holding"))
    return {"Holdings": sets["holdings"], "Narrative": narrative, "13F Check": sets["13f"], "Reviewed": rows.filter("status is not null")}


def exposure_summary(rows: DataFrame) -> DataFrame:
    n = lambda *a: F.count_if(F.col("relation").isin(*a))
    return rows.agg(F.count(F.lit(1)).alias("rows"), n("direct_holding", "portfolio_schedule_holding").alias("holdings"), n("commercial_context").alias("commercial"), n("ambiguous_review", "spv_or_fund_name").alias("review"), F.countDistinct("filer").alias("filers"))


def exposure_coverage(rows: DataFrame, by: str = "form") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def exposure_radar(hits: DataFrame, documents: DataFrame, aliases: list[str], contextual: list[str] = (), n: int | None = None) -> DataFrame:
    """Hits joined with their landed documents, parsed, deduplicated and ranked."""
    chosen = search_hits_ranked(hits, n).drop("matched_terms")
    parsed = exposure_parse_documents(documents.join(chosen.select("accession", "document"), ["accession", "document"], "left_semi"), ["accession", "document"], aliases, contextual)
    return exposure_ranked(dedupe_exposure_rows(parsed.join(chosen, ["accession", "document"])))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
