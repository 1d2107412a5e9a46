"""Company signals: facts and ratios, insider trades, nearest earlier filings, entity lookup, search over filings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.columns import form_matches, sec_document_url


def filing_date_form_filter(filings: DataFrame, start: str, end: str, form: str) -> DataFrame:
    return filings.filter(F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & form_matches("form", form))


def filings_ranked(filings: DataFrame, n: int | None = None) -> DataFrame:
    out = filings.orderBy(F.desc("filing_date"), "company", "form", "accession")
    return out.limit(n) if n else out


def nearest_date_join(filings: DataFrame, years: int = 1, days: int = 30) -> DataFrame:
    """Each filing with the filing of its company and form nearest to a year before, within some days.

    Both sides are keyed by blocks of days as wide as the tolerance, so a filing meets three blocks, not
    its company's whole past. Of two equally near ones the earlier counts.
    """
    wanted = filings.withColumn("wanted", F.add_months("filing_date", -12 * years))
    mine = wanted.withColumn("block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.unix_date("wanted") / days) + i)))
    theirs = filings.select("company", "form", F.floor(F.unix_date("filing_date") / days).alias("block"), F.col("accession").alias("previous_accession"), F.col("filing_date").alias("previous_date"))
    away = F.abs(F.datediff("previous_date", "wanted"))
    near = mine.join(theirs, ["company", "form", "block"]).withColumn("days_off", away).filter(F.col("days_off") <= days)
    w = Window.partitionBy("accession").orderBy("days_off", "previous_date", "previous_accession")
    return near.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("company", "form", "accession", "filing_date", "previous_accession", "previous_date", "days_off")


UNITS = ("USD", "shares", "pure")


def fact_history(facts: DataFrame, n: int = 2) -> DataFrame:
    """Per company and concept: of its first unit (USD, shares, pure) the newest n facts by end and place; then zeros and nulls go."""
    rank = F.array_position(F.array(*map(F.lit, UNITS)), F.col("unit"))
    rows = facts.withColumn("unit_rank", rank).filter("unit_rank > 0")
    own = rows.withColumn("best", F.min("unit_rank").over(Window.partitionBy("cik", "concept"))).filter("unit_rank = best")
    w = Window.partitionBy("cik", "concept").orderBy(F.desc("end"), "position")
    return own.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n).filter("val is not null and val <> 0").drop("unit_rank", "best")


def latest_fact(facts: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, UNITS)), F.col("unit"))
    rows = facts.withColumn("unit_rank", rank).filter("unit_rank > 0")
    w = Window.partitionBy("cik", "concept").orderBy("unit_rank", F.desc("end"), "position")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "unit_rank")


def financial_health(facts: DataFrame, assets: str = "AssetsCurrent", liabilities: str = "LiabilitiesCurrent", cash: str = "CashAndCashEquivalentsAtCarryingValue") -> DataFrame:
    """Per company: current ratio, change of cash in percent, alerts (below 1; below -30), score 10 - 3 per alert."""
    now = latest_fact(facts).groupBy("cik").pivot("concept", [assets, liabilities]).agg(F.first("val"))
    was = fact_history(facts).filter(F.col("concept") == cash).groupBy("cik").agg(F.max(F.when(F.col("recency") == 1, F.col("val"))).alias("c1"), F.max(F.when(F.col("recency") == 2, F.col("val"))).alias("c2"))
    ratio = F.round(F.when(F.col(liabilities) != 0, F.col(assets) / F.col(liabilities)), 2)
    change = F.round((F.col("c1") - F.col("c2")) / F.abs("c2") * 100, 1)
    alerts = F.array_compact(F.array(F.when(F.col("current_ratio") < 1.0, "Current ratio below 1.0"), F.when(F.col("cash_change") < -30, "Cash fell by more than 30%")))
    out = now.join(was, "cik", "full_outer").select("cik", ratio.alias("current_ratio"), change.alias("cash_change")).withColumn("alerts", alerts)
    return out.withColumn("score", 10 - 3 * F.size("alerts"))


def insider_net_value(trades: DataFrame, n: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Net value per insider (A adds, others subtract); the n largest by size."""
    value = F.when(F.col("code") == "A", F.col("value")).otherwise(-F.col("value"))
    return trades.groupBy(*keys, "insider").agg(F.sum(value).alias("net")).orderBy(F.abs("net").desc(), "insider").limit(n)


#: Letters of the pieces by which queries and titles meet, and the short queries that are broadcast.
GRAM, MOST_SHORT = 8, 100_000


def pieces(text, n: int = GRAM):
    """The distinct parts of n letters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, n)))


def _containing(rest: DataFrame, titles: DataFrame) -> DataFrame:
    """(query, cik, n) of titles that contain a query q, the shortest among them.

    A query of up to GRAM letters is a piece itself: of the titles' pieces only those that are asked for go on, each with its
    shortest title. Companies are dealt out first, since a small file of them is one task's. A longer query meets the titles
    by that of its pieces which fewest titles have, so no common ending or word brings many together; a query with a piece
    that no title has meets none.
    """
    titles = titles.repartition(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cik")
    short, long = rest.filter(F.length("q") <= GRAM), rest.filter(F.length("q") > GRAM)
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("title") - n + 1)), lambda i: F.substring(F.col("title"), i, n))))
    asked = short.select("q").distinct()
    if asked.limit(MOST_SHORT + 1).count() <= MOST_SHORT:
        asked = F.broadcast(asked)
    parts = titles.select(F.explode(F.array_distinct(every)).alias("q"), F.struct(F.length("title").alias("n"), "cik").alias("own"))
    least = parts.join(asked, "q", "left_semi").groupBy("q").agg(F.min("own").alias("own"))
    few = short.join(least, "q").select("query", "own.cik", "own.n")
    parts = titles.filter(F.length("title") > GRAM).select("cik", "title", F.explode(pieces(F.col("title"))).alias("piece"))
    times = parts.groupBy("piece").agg(F.count(F.lit(1)).alias("times"))
    asked = long.select("query", "q", F.explode(pieces(F.col("q"))).alias("piece")).join(times, "piece", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    rarest = asked.groupBy("query", "q").agg(F.min(F.struct("times", "piece")).alias("own")).filter("own.times > 0").select("query", "q", "own.piece")
    many = parts.join(rarest, "piece").filter(F.col("title").contains(F.col("q"))).select("query", "cik", F.length("title").alias("n"))
    return few.unionByName(many)


def entity_resolve(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """(query) -> cik by the first of: a number, a ticker (. as -), a title, the shortest title that contains it.

    Titles are searched only for what the equi-joins leave, by their pieces, for any number of queries.
    """
    q = queries.select("query", F.upper(F.trim("query")).alias("q")).distinct()
    c = companies.select("cik", F.upper("ticker").alias("ticker"), F.upper("title").alias("title"))
    number = q.filter(F.col("q").rlike(r"^\d+$")).select("query", F.regexp_replace("q", "^0+", "").alias("cik"), F.lit(0).alias("rank"), F.lit(0).alias("n"))
    ticker = q.join(c, F.translate("q", ".", "-") == F.col("ticker")).select("query", "cik", F.lit(1).alias("rank"), F.lit(0).alias("n"))
    title = q.join(c, F.col("q") == F.col("title")).select("query", "cik", F.lit(2).alias("rank"), F.lit(0).alias("n"))
    exact = reduce(DataFrame.unionByName, (number, ticker, title))
    rest = q.filter("q <> ''").join(exact.select("query").distinct(), "query", "left_anti")
    part = _containing(rest, c.filter("title <> ''").select("cik", "title")).select("query", "cik", F.lit(3).alias("rank"), "n")
    best = exact.unionByName(part).groupBy("query").agg(F.min(F.struct("rank", "n", "cik")).alias("b"))
    return best.select("query", "b.cik", F.element_at(F.array(F.lit("cik"), F.lit("ticker"), F.lit("title"), F.lit("contains")), F.col("b.rank") + 1).alias("by"))


def filings_search(queries: DataFrame, companies: DataFrame, filings: DataFrame, start: str, end: str, form: str = "ALL") -> tuple[DataFrame, DataFrame]:
    """Filings of the resolved entities in a period and form with their URLs; and a warning for each entity not found."""
    found = entity_resolve(queries, companies)
    rows = filing_date_form_filter(filings, start, end, form).join(found, "cik").withColumn("url", sec_document_url("cik", "accession", "document"))
    lost = queries.join(found, "query", "left_anti").select("query", F.concat(F.lit("not found: "), "query").alias("warning"))
    return rows, lost
