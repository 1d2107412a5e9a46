"""Queries over documents, pages, vectors and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.operators import alignment as A, documents as D, keyword_index as K, signals as S, vector_index as V
from filingscope.plans.fixtures import read
from filingscope.tables import write_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SEN = r"""sen AS (SELECT DISTINCT doc_id, source, trim(s) AS sentence FROM (SELECT doc_id, source, unnest(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s.,;:''"-]', '', 'g'))), '[.!?]+')) AS s FROM documents) WHERE length(trim(s)) > 20)"""
_CHG = (
    "WITH "
    + _SEN
    + """, prev AS (SELECT doc_id, source, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
a AS (SELECT prev.source, prev.doc_id, sentence, 'added' AS change FROM prev JOIN sen ON sen.doc_id = prev.doc_id WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sen o WHERE o.doc_id = p AND o.sentence = sen.sentence)),
r AS (SELECT prev.source, prev.doc_id, sentence, 'removed' AS change FROM prev JOIN sen ON sen.doc_id = p WHERE NOT EXISTS (SELECT 1 FROM sen o WHERE o.doc_id = prev.doc_id AND o.sentence = sen.sentence)),
chg AS (SELECT * FROM a UNION ALL SELECT * FROM r)"""
)


def changes(s, d):
    return D.sentence_changes(read(s, d, "documents"), "source", "doc_id")


@query(f"WITH {_SEN} SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS characters FROM sen GROUP BY 1")
def split_sentences(s, d):
    return D.sentences(read(s, d, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("characters"))


@query(_CHG + " SELECT source, doc_id, md5(sentence) AS sentence FROM chg WHERE change = 'added'")
def sentences_added(s, d):
    return changes(s, d).filter("change = 'added'").select("source", "doc_id", F.md5("sentence").alias("sentence"))


@query(_CHG + " SELECT source, doc_id, md5(sentence) AS sentence FROM chg WHERE change = 'removed'")
def sentences_removed(s, d):
    return changes(s, d).filter("change = 'removed'").select("source", "doc_id", F.md5("sentence").alias("sentence"))


@query(_CHG + " SELECT source, doc_id, change, count(*) AS n FROM chg GROUP BY 1, 2, 3")
def section_change_by_sentence(s, d):
    return changes(s, d).groupBy("source", "doc_id", "change").agg(F.count(F.lit(1)).alias("n"))


@query()
def section_alignment(s, d):
    """A longest common subsequence: no SQL; tests/test_alignment.py has a brute-force version."""
    return A.section_alignment(read(s, d, "documents"), "source", "doc_id")


@query("SELECT source, doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS previous FROM documents")
def sections_pair_join(s, d):
    return D.sections_pair_join(read(s, d, "documents"), "source", "doc_id").select("source", "doc_id", "previous")


_WORDS = ["disgusting", "moron", "license"]


_KEY = "CASE WHEN contains(sentence, 'disgusting') THEN 'disgusting' WHEN contains(sentence, 'moron') THEN 'moron' WHEN contains(sentence, 'license') THEN 'license' END"
_SAMPLE = "coalesce(array_to_string(list_sort(list(keyword || ' ' || substr(sentence, 1, 200)) FILTER (change = '{}' AND keyword IS NOT NULL))[1:10], '; '), '')"


@query(_CHG + f" SELECT source, doc_id, count(*) FILTER (change = 'added') AS added_count, count(*) FILTER (change = 'removed') AS removed_count, count(*) FILTER (change = 'added' AND keyword IS NOT NULL) AS n_escalations, count(*) FILTER (change = 'removed' AND keyword IS NOT NULL) AS n_deletions, 2 * count(*) FILTER (change = 'added' AND keyword IS NOT NULL) + count(*) FILTER (change = 'removed' AND keyword IS NOT NULL) AS risk_score, {_SAMPLE.format('added')} AS escalations, {_SAMPLE.format('removed')} AS silent_deletions FROM (SELECT *, {_KEY} AS keyword FROM chg) GROUP BY 1, 2")
def risk_language_change(s, d):
    shown = lambda c: F.concat_ws("; ", F.transform(c, lambda x: F.concat_ws(" ", x["keyword"], x["text"]))).alias(c)
    out = D.risk_language_change(changes(s, d), "source", "doc_id", _WORDS)
    return out.select("source", "doc_id", "added_count", "removed_count", "n_escalations", "n_deletions", "risk_score", shown("escalations"), shown("silent_deletions"))


_KW = ["the", "disgusting", "apache license"]
_CNT = lambda w: f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}"


def _snip(w: str) -> str:
    pos, n = f"instr(lower(o), '{w}')", len(w)
    return f"CASE WHEN {pos} > 0 THEN CASE WHEN {pos} > 91 THEN '...' ELSE '' END || substr(o, greatest(1, {pos} - 90), least(length(o) + 1, {pos} + {n + 90}) - greatest(1, {pos} - 90)) || CASE WHEN {pos} + {n + 90} <= length(o) THEN '...' ELSE '' END END"


@query("SELECT doc_id, matched, hits, snippets FROM (SELECT doc_id, concat_ws('; ', " + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in _KW) + "), " + " + ".join(map(_CNT, _KW)) + ", concat_ws(' | ', " + ", ".join(map(_snip, _KW)) + r") FROM (SELECT doc_id, o, lower(o) AS t FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS o FROM documents))) x(doc_id, matched, hits, snippets) WHERE hits > 0")
def keyword_search(s, d):
    return D.keyword_search(read(s, d, "documents"), _KW, ["doc_id"]).select("doc_id", F.concat_ws("; ", "matched").alias("matched"), "hits", F.concat_ws(" | ", "snippets").alias("snippets"))


_LISTS = r"SELECT item_id AS list, unnest([w[1], w[2] || ' ' || w[3], left(w[4], 3)]) AS keyword FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM benchmark)"


@query(f"WITH k AS (SELECT DISTINCT list, keyword FROM ({_LISTS}) WHERE keyword <> ''), t AS (SELECT conv_id, turn, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT list, conv_id, turn, string_agg(keyword, '; ' ORDER BY keyword) AS matched, CAST(sum((length(t) - length(replace(t, keyword, ''))) // length(keyword)) AS BIGINT) AS hits FROM t JOIN k ON contains(t, keyword) GROUP BY 1, 2, 3")
def keyword_lists_search(s, d):
    """A list of each test item: its first word, its second and third, the beginning of its fourth, in all turns of all conversations."""
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")
    lists = read(s, d, "benchmark").select(F.col("item_id").alias("list"), F.explode(F.array(F.get(w, F.lit(0)), F.concat(F.get(w, F.lit(1)), F.lit(" "), F.get(w, F.lit(2))), F.left(F.get(w, F.lit(3)), F.lit(3)))).alias("keyword")).filter("keyword is not null")
    index = write_table(K.postings(read(s, d, "conversations"), ["conv_id", "turn"]), "postings")
    return K.keyword_lists_search(index, lists, ["conv_id", "turn"]).select("list", "conv_id", "turn", F.concat_ws("; ", "matched").alias("matched"), "hits")


@query(r"SELECT doc_id, CASE WHEN pos > 91 THEN '...' ELSE '' END || substr(t, greatest(1, pos - 90), least(length(t) + 1, pos + 100) - greatest(1, pos - 90)) || CASE WHEN pos + 100 <= length(t) THEN '...' ELSE '' END AS snippet FROM (SELECT doc_id, t, instr(lower(t), 'disgusting') AS pos FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents)) WHERE pos > 0")
def snippets(s, d):
    text = F.regexp_replace("text", r"\s+", " ")
    return read(s, d, "documents").select("doc_id", D.snippet(text, F.lit("disgusting")).alias("snippet")).filter("snippet is not null")


@query(r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_to_text(s, d):
    return read(s, d, "pages").select("page_id", F.md5(D.html_to_text(F.col("html"))).alias("text_md5"))


def filed(s, d):
    """Documents as filings: some with an item 1A in one of two forms (or one too short), some with an item 7, some with neither."""
    k, body = F.col("doc_id") % 4, F.col("text")
    one = F.when(k == 0, F.concat(F.lit("Part I\nItem 1A. Risk  Factors We may fail. "), F.repeat(F.lit("It is hard to tell. "), F.lit(30)), body, F.lit(" Item 1B. None. ")))
    one = one.when(k == 1, F.concat(F.lit("ITEM 1A - "), F.repeat(F.lit("Much can happen. "), F.lit(40)), F.lit(" ITEM 2 Properties "), body)).when(k == 2, F.concat(F.lit("Item 1A. Risk Factors none. Item 1B. "), body)).otherwise(body)
    seven = F.when(F.col("doc_id") % 3 == 0, " Item 7. Management discusses  sales. Item 8. Statements").when(F.col("doc_id") % 3 == 1, " Item 7 Management ends with this").otherwise("")
    return read(s, d, "documents").select("doc_id", F.concat(one, seven).alias("text"))


_FILED = r"""filed AS (SELECT doc_id, regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'Part I' || chr(10) || 'Item 1A. Risk  Factors We may fail. ' || repeat('It is hard to tell. ', 30) || text || ' Item 1B. None. ' WHEN 1 THEN 'ITEM 1A - ' || repeat('Much can happen. ', 40) || ' ITEM 2 Properties ' || text WHEN 2 THEN 'Item 1A. Risk Factors none. Item 1B. ' || text ELSE text END
 || CASE doc_id % 3 WHEN 0 THEN ' Item 7. Management discusses  sales. Item 8. Statements' WHEN 1 THEN ' Item 7 Management ends with this' ELSE '' END, '\s+', ' ', 'g') AS t FROM documents)"""


def _part(begin: str, end: str) -> str:
    rest = f"substr(t, nullif(strpos(t, regexp_extract(t, '{begin}')), 0))"
    return f"CASE WHEN regexp_matches(t, '{begin}') THEN CASE WHEN regexp_matches({rest}, '{end}') THEN substr({rest}, 1, strpos({rest}, regexp_extract({rest}, '{end}')) - 1) ELSE substr({rest}, 1, 50000) END END"


@query(f"WITH {_FILED} SELECT doc_id, md5({_part('(?i)Item +1A[.]? +Risk +Factors', '(?i)Item +(1B|2)[.]? +')}) AS risk_factors, md5({_part('(?i)Item +7[.]? +Management', '(?i)Item +(7A|8)[.]? +')}) AS mda FROM filed")
def extract_sections(s, d):
    return D.extract_sections(filed(s, d)).select("doc_id", F.md5("risk_factors").alias("risk_factors"), F.md5("mda").alias("mda"))


_ITEM = r"regexp_extract(t, '(?is)Item\s+1A[\.\s]+Risk\s+Factors(.*?)(?:Item\s+1B|Item\s+2[\.\s])', 1)", r"regexp_extract(t, '(?is)ITEM\s+1A(.*?)(?:ITEM\s+1B|ITEM\s+2)', 1)"


@query(f"WITH {_FILED} SELECT doc_id, md5(CASE WHEN length({_ITEM[0]}) > 500 THEN substr(trim({_ITEM[0]}), 1, 25000) WHEN length({_ITEM[1]}) > 500 THEN substr(trim({_ITEM[1]}), 1, 25000) WHEN instr(lower(t), 'risk factors') > 1 THEN substr(t, instr(lower(t), 'risk factors'), 25000) ELSE substr(t, 1, 15000) END) AS item FROM filed")
def extract_item_1a(s, d):
    return filed(s, d).select("doc_id", F.md5(D.extract_item_1a(F.col("text"))).alias("item"))


@query()
def chunk_text(s, d):
    return D.chunk_text(read(s, d, "documents"), ["doc_id"])


@query("SELECT source AS company, count(*) AS n FROM documents GROUP BY 1")
def add_new_chunks(s, d):
    rows = read(s, d, "documents").select(F.concat_ws("_", F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("company"))
    return D.add_new_chunks(rows.filter("company < 'src2'"), rows).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS companies FROM documents")
def corpus_stats(s, d):
    return D.corpus_stats(read(s, d, "documents"), "source")


_SIM = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_DOT = lambda a, b: _SIM.format(a=a, b=b)


@query(f"SELECT query_id, id, similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT('v.embedding', 'q.embedding')} / sqrt({_DOT('v.embedding', 'v.embedding')}) / sqrt({_DOT('q.embedding', 'q.embedding')}), 3) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT('v.embedding', 'q.embedding')} / sqrt({_DOT('v.embedding', 'v.embedding')}) / sqrt({_DOT('q.embedding', 'q.embedding')}), 3) DESC, v.vec_id) AS rank FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON q.label = v.label) WHERE rank <= 10")
def vector_top_k(s, d):
    return similar(s, d, "vec_id % 100 = 0")


@query(ORACLES["vector_top_k"])
def vector_top_k_all(s, d):
    """Another name of vector_top_k."""
    return similar(s, d, "vec_id % 100 = 0")


@query()
def vector_top_k_ivf(s, d):
    """vector_top_k by an inverted file; its recall against vector_top_k is tested."""
    rows = read(s, d, "embeddings").withColumn("company", F.col("label").cast("string"))
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "company")
    centroids = V.fit_centroids(rows, 64)
    index = write_table(V.assign(rows, centroids, company_col="company"), "vector-lists")
    measured = rows.filter("vec_id % 100 = 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "company")
    return V.search(index, queries, centroids, V.probes_for(rows, index, measured, centroids, 0.97, company_col="company"))


def similar(s, d, asked):
    rows = read(s, d, "embeddings").withColumn("company", F.col("label").cast("string"))
    queries = rows.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "company")
    return D.vector_top_k(rows, queries, company_col="company")


def themed(s, d):
    theme = F.struct(F.concat(F.lit(" "), "event_type").alias("theme"), F.when(F.col("value") > 50, "positive").otherwise("Negative").alias("sentiment"), F.col("props").alias("context"))
    return read(s, d, "events").select(F.col("event_id").cast("string").alias("accession"), F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("filing_date"), F.to_json(F.array(theme)).alias("themes"))


@query("SELECT CAST(event_id AS VARCHAR) || '_0' AS id, event_type AS theme, CASE WHEN value > 50 THEN 'positive' ELSE 'Negative' END AS sentiment, props AS context FROM events")
def theme_index(s, d):
    return D.theme_index(themed(s, d)).select("id", F.trim("theme").alias("theme"), "sentiment", "context")


@query("SELECT event_type AS name, count(*) AS n, CASE WHEN sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) > 0 THEN 'Positive' WHEN sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment, array_to_string(list_sort(list(user_id || ': ' || props))[1:3], ' | ') AS examples FROM (SELECT * FROM events ORDER BY CAST(ts AS DATE) DESC, CAST(event_id AS VARCHAR) DESC LIMIT 100) GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def theme_trends(s, d):
    return D.theme_trends(themed(s, d)).select("name", "n", "sentiment", F.concat_ws(" | ", "examples").alias("examples"))


def companies(s, d):
    return read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("cik"), F.concat(F.lit("S-"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title"), F.col("s_suppkey").alias("position"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS cik, s_name AS title FROM supplier WHERE regexp_matches(lower('S-' || s_suppkey || ' ' || s_name), '(^|[^a-z0-9_])supp') ORDER BY length(s_name), s_name, cik LIMIT 10")
def ticker_autocomplete(s, d):
    return D.ticker_autocomplete(companies(s, d), "supp").select("cik", "title")


_HOSTS = "SELECT CAST(page_id AS VARCHAR) AS cik, 'p' || page_id AS ticker, lower(url) AS title, list_distinct(list_filter(regexp_split_to_array('p' || page_id || ' ' || lower(url), '[^a-z0-9_]+'), lambda w: w <> '')) AS words FROM pages"


@query(f"WITH c AS ({_HOSTS}), t AS (SELECT DISTINCT unnest([w[1], substr(w[2], 1, 3) || ' ' || substr(w[3], 1, 2)]) AS term FROM (SELECT regexp_split_to_array(lower(url), '[^a-z0-9_]+') AS w FROM pages WHERE page_id % 100 = 0) WHERE len(w) > 2), a AS (SELECT term, cik, title, row_number() OVER (PARTITION BY term ORDER BY ticker <> term, length(title), title, cik) AS rank FROM c JOIN t ON len(list_filter(string_split(term, ' '), lambda p: p <> '' AND len(list_filter(words, lambda w: starts_with(w, p))) = 0)) = 0) SELECT term, rank, cik, title FROM a WHERE rank <= 10")
def autocomplete_terms(s, d):
    """Pages as companies named by their addresses; the terms are taken from every hundredth address."""
    rows = read(s, d, "pages").select(F.col("page_id").cast("string").alias("cik"), F.concat(F.lit("p"), "page_id").alias("ticker"), F.lower("url").alias("title"), F.col("page_id").alias("position"))
    w = F.split("title", "[^a-z0-9_]+")
    terms = rows.filter("position % 100 = 0").filter(F.size(w) > 2).select(F.explode(F.array(F.get(w, F.lit(0)), F.concat(F.substring(F.get(w, F.lit(1)), 1, 3), F.lit(" "), F.substring(F.get(w, F.lit(2)), 1, 2)))).alias("term"))
    return D.autocomplete_terms(rows, terms).select("term", "rank", "cik", "title")


def orders(s, d):
    return read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("company"), F.col("o_custkey").cast("string").alias("cik"), F.col("o_orderkey").cast("string").alias("accession"), F.col("o_orderpriority").alias("form"), F.to_date("o_orderdate").alias("filing_date"), F.lit("doc.htm").alias("document"))


@query("SELECT company, form, accession, filing_date, previous_accession, previous_date, days_off FROM (SELECT a.*, b.accession AS previous_accession, b.filing_date AS previous_date, abs(date_diff('day', b.filing_date, a.wanted)) AS days_off, row_number() OVER (PARTITION BY a.accession ORDER BY abs(date_diff('day', b.filing_date, a.wanted)), b.filing_date, b.accession) AS rn FROM (SELECT CAST(o_custkey AS VARCHAR) AS company, o_orderpriority AS form, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filing_date, CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS wanted FROM orders) a JOIN (SELECT CAST(o_custkey AS VARCHAR) AS company, o_orderpriority AS form, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filing_date FROM orders) b ON a.company = b.company AND a.form = b.form AND abs(date_diff('day', b.filing_date, a.wanted)) <= 30) WHERE rn = 1")
def nearest_date_join(s, d):
    return S.nearest_date_join(orders(s, d))


@query("SELECT CAST(o_custkey AS VARCHAR) AS company, o_orderpriority AS form, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filing_date FROM orders ORDER BY filing_date DESC, company, form, accession LIMIT 200")
def filings_ranked(s, d):
    return S.filings_ranked(orders(s, d), 200).select("company", "form", "accession", "filing_date")


def queried(s, d):
    """Every supplier is looked up four ways."""
    rows = companies(s, d)
    forms = F.array(F.concat(F.lit("000"), "cik"), F.translate("ticker", "-", "."), F.lower("title"), F.substring("title", 4, 20))
    return rows.select(F.explode(forms).alias("query"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_orderkey AS VARCHAR) AS accession FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 0) AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND contains(o_orderpriority, 'HIGH')")
def filings_search(s, d):
    return searched(s, d, "position > 0")


@query(ORACLES["filings_search"])
def filings_search_all(s, d):
    """Another name of filings_search."""
    return searched(s, d, "position > 0")


def searched(s, d, asked):
    rows = companies(s, d).filter(asked).select(F.concat(F.lit("00"), "cik").alias("query"))
    return S.filings_search(rows, companies(s, d), orders(s, d), "1996-01-01", "1997-12-31", "HIGH")[0].select("cik", "accession")


@query("SELECT '00' || s_suppkey AS query, ltrim('00' || s_suppkey, '0') AS cik, 'cik' AS by FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT 's.' || s_suppkey, CAST(s_suppkey AS VARCHAR), 'ticker' FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT lower(s_name), CAST(s_suppkey AS VARCHAR), 'title' FROM supplier WHERE s_suppkey > 0")
def entity_resolve(s, d):
    rows = companies(s, d).filter("position > 0")
    q = rows.select(F.explode(F.array(F.concat(F.lit("00"), "cik"), F.lower(F.translate("ticker", "-", ".")), F.lower("title"))).alias("query"))
    return S.entity_resolve(q, companies(s, d))


@query("SELECT CAST(user_id AS VARCHAR) AS insider, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END), 2) AS net FROM events GROUP BY 1 ORDER BY abs(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END)) DESC, insider LIMIT 10")
def insider_net_value(s, d):
    rows = read(s, d, "events").select(F.col("user_id").cast("string").alias("insider"), F.when(F.col("event_type") == "purchase", "A").otherwise("D").alias("code"), "value")
    return S.insider_net_value(rows).select("insider", F.round("net", 2).alias("net"))


def facts(s, d):
    concept = F.element_at(F.array(F.lit("AssetsCurrent"), F.lit("LiabilitiesCurrent"), F.lit("CashAndCashEquivalentsAtCarryingValue")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    unit = F.when(F.col("o_custkey") % 10 == 0, "shares").otherwise("USD")
    return read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("cik"), concept.alias("concept"), unit.alias("unit"), F.to_date("o_orderdate").alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("position"))


_FACT = "WITH fa AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, ['AssetsCurrent', 'LiabilitiesCurrent', 'CashAndCashEquivalentsAtCarryingValue'][o_orderkey % 3 + 1] AS concept, CAST(o_orderdate AS DATE) AS end_, o_totalprice AS val, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS recency FROM orders)"


@query(_FACT + " SELECT cik, concept, end_ AS \"end\", val FROM fa WHERE recency = 1")
def latest_fact(s, d):
    return S.latest_fact(facts(s, d)).select("cik", "concept", "end", "val")


@query(_FACT + " SELECT cik, concept, end_ AS \"end\", val, recency FROM fa WHERE recency <= 2 AND val <> 0")
def fact_history(s, d):
    return S.fact_history(facts(s, d)).select("cik", "concept", "end", "val", "recency")


@query(_FACT + """, x AS (SELECT cik, max(val) FILTER (concept = 'AssetsCurrent' AND recency = 1) AS a, max(val) FILTER (concept = 'LiabilitiesCurrent' AND recency = 1) AS l, max(val) FILTER (concept LIKE 'Cash%' AND recency = 1) AS c1, max(val) FILTER (concept LIKE 'Cash%' AND recency = 2) AS c2 FROM fa WHERE recency <= 2 GROUP BY 1),
y AS (SELECT cik, round(a / l, 2) AS current_ratio, round((c1 - c2) / abs(c2) * 100, 1) AS cash_change FROM x) SELECT *, concat_ws('; ', CASE WHEN current_ratio < 1 THEN 'Current ratio below 1.0' END, CASE WHEN cash_change < -30 THEN 'Cash fell by more than 30%' END) AS alerts, 10 - 3 * (CASE WHEN current_ratio < 1 THEN 1 ELSE 0 END + CASE WHEN cash_change < -30 THEN 1 ELSE 0 END) AS score FROM y""")
def financial_health(s, d):
    return S.financial_health(facts(s, d)).withColumn("alerts", F.concat_ws("; ", "alerts"))


@query()
def filing_context_windows(s, d):
    out = D.filing_context_windows(read(s, d, "documents"), ["doc_id"])
    return out.select("doc_id", F.length("context").alias("n"), F.md5("context").alias("context_md5"))
