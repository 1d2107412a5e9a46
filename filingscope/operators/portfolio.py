"""One filer's or all filers' portfolios: differences, overlaps, histories, and who holds an issuer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.columns import classify_reverse_movement, compact_issuer, estimate_actual_value, finite, normalize_cik, normalize_issuer, percent_change_tracker, quarter_sort_key, security_of
from filingscope.operators.radar import first_names, latest_filing_per_filer
from filingscope.tables import write_table


def portfolio_aggregate(holdings: DataFrame) -> DataFrame:
    """Per filing and security (CUSIP, else issuer): value and shares."""
    rows = holdings.withColumns({"cik": normalize_cik("cik"), "security": security_of("cusip", "issuer")})
    return rows.groupBy("cik", "accession", "quarter", "security").agg(F.min("issuer").alias("issuer"), F.sum(finite("value")).alias("value"), F.sum(finite("shares")).alias("shares"))


def unit_normalize_by_median(portfolio: DataFrame) -> DataFrame:
    """Values in thousands: a filing whose upper median of value per share is over 4 is divided by 1000."""
    # a filing's ratios are one array: as many as it has securities
    ratios = portfolio.filter("value > 0 and shares > 0").groupBy("accession").agg(F.array_sort(F.collect_list(F.col("value") / F.col("shares"))).alias("r"))
    middle = ratios.select("accession", F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int")).alias("median_ratio"))
    return portfolio.join(middle, "accession", "left").withColumn("value", F.when(F.col("median_ratio") > 4, F.col("value") / 1000).otherwise(F.col("value")))


def portfolio_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Full outer difference per filer and security, unchanged rows kept: change, percent, new, added to, exited."""
    old = previous.select("cik", "security", F.col("issuer").alias("old_issuer"), F.col("shares").alias("previous_shares"), F.col("value").alias("previous_value"))
    both = current.select("cik", "security", "issuer", "shares", "value").join(old, ["cik", "security"], "full_outer")
    out = both.select("cik", "security", F.coalesce("issuer", "old_issuer").alias("issuer"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("shares", "value", "previous_shares", "previous_value")])
    return _changes(out)


def quarter_diff(portfolios: DataFrame, current: str, previous: str) -> DataFrame:
    """portfolio_diff() of two quarters of one table that has a filing per filer and quarter: both are read and summed at once."""
    now = F.col("quarter") == current
    of = lambda column, on: F.coalesce(F.sum(F.when(on, F.col(column))), F.lit(0.0))
    out = portfolios.filter(F.col("quarter").isin(current, previous)).groupBy("cik", "security").agg(
        F.coalesce(F.max(F.when(now, F.col("issuer"))), F.max("issuer")).alias("issuer"), of("shares", now).alias("shares"), of("value", now).alias("value"), of("shares", ~now).alias("previous_shares"), of("value", ~now).alias("previous_value")
    )
    return _changes(out)


def _changes(out: DataFrame) -> DataFrame:
    change = F.col("shares") - F.col("previous_shares")
    is_new, is_add_on, is_exit = (F.col("previous_shares") <= 0) & (F.col("shares") > 0), (F.col("previous_shares") > 0) & (change > 0), (F.col("previous_shares") > 0) & (F.col("shares") <= 0)
    return out.withColumns({"change": change, "percent": percent_change_tracker("previous_shares", "shares"), "is_new": is_new, "is_add_on": is_add_on, "is_exit": is_exit})


def portfolio_diff_by_cusip(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The form that ignores rows without a security, lets the last duplicate (by row_id) win and drops unchanged rows."""

    def last(df):
        return df.filter("cusip is not null and cusip <> ''").groupBy("cik", "cusip").agg(F.max_by("issuer", "row_id").alias("issuer"), F.max_by("shares", "row_id").alias("shares"), F.max_by("value", "row_id").alias("value"))

    old = last(previous).select("cik", "cusip", F.col("issuer").alias("old_issuer"), F.col("shares").alias("previous_shares"))
    both = last(current).join(old, ["cik", "cusip"], "full_outer")
    out = both.select("cik", "cusip", F.coalesce("issuer", "old_issuer", F.lit("Unknown")).alias("issuer"), F.coalesce("shares", F.lit(0.0)).alias("shares"), F.coalesce("previous_shares", F.lit(0.0)).alias("previous_shares"), F.coalesce("value", F.lit(0.0)).alias("value"))
    out = out.withColumn("delta", F.col("shares") - F.col("previous_shares")).filter("delta <> 0")
    return out.withColumns({"delta_pct": F.when(F.col("previous_shares") != 0, F.round(F.col("delta") / F.col("previous_shares") * 100, 1)).otherwise(100.0), "action": F.when(F.col("delta") > 0, "BUY").otherwise("SELL")})


def portfolio_conviction(diff: DataFrame) -> DataFrame:
    """Per filer: shares bought and sold, what that says, and counts."""
    d = F.col("delta")
    out = diff.groupBy("cik").agg(F.sum(F.when(d > 0, d).otherwise(0.0)).alias("bought"), F.sum(F.when(d < 0, -d).otherwise(0.0)).alias("sold"), F.count(F.lit(1)).alias("changes"), F.count_if(F.col("previous_shares") == 0).alias("new_positions"), F.count_if(F.col("shares") == 0).alias("exits"))
    net = F.col("bought") - F.col("sold")
    return out.withColumns({"net_conviction": net, "signal": F.when(net > 0, "BULLISH").when(net < 0, "BEARISH").otherwise("NEUTRAL")})


def top_rows(rows: DataFrame, by, n: int = 5, keys=("cik",)) -> DataFrame:
    """The first n rows of each key, in an order."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_holdings(portfolio: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(portfolio, [F.desc("value"), "security"], n)


def top_buys(diff: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(diff.filter("change > 0"), [F.desc("change"), "security"], n)


def top_sells(diff: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(diff.filter("change < 0"), ["change", "security"], n)


def ranked_changes(diff: DataFrame) -> DataFrame:
    """New positions first, ended ones next, then by size of change and value."""
    order = F.when(F.col("is_new"), 0).when(F.col("is_exit"), 1).otherwise(2)
    return top_rows(diff.filter("change <> 0"), [order, F.abs("change").desc(), F.desc("value"), "security"], 1 << 30)


#: Holders of a security that one block has: a task's share of a widely held security is pairs of blocks.
BLOCK_HOLDERS = 2000


def portfolio_overlap_all_pairs(portfolio: DataFrame, top: int | None = None, block: int = BLOCK_HOLDERS) -> DataFrame:
    """Common securities of all pairs of filers, by security: an equi-join, not all pairs of filers.

    Holders of a security, in the order of their ciks, are cut into blocks, and a block i meets those from i on, so that no task gets
    all pairs of a widely held security. Blocks travel as one row each and in the order of values: a filer's rows stand together, as
    do equal values, and files of the result stay small.
    """
    one, n = Window.partitionBy("security"), int(portfolio.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = portfolio.withColumns({"at": F.row_number().over(one.orderBy("cik")) - 1, "holders": F.count(F.lit(1)).over(one)}).filter("holders > 1")
    number = lambda at: F.floor(at / block).cast("int")
    held = rows.groupBy("security", number(F.col("at")).alias("own"), number(F.col("holders") - 1).alias("last")).agg(F.array_sort(F.collect_list(F.struct("value", "cik", "shares"))).alias("held"))

    def side(name, i, j):
        dealt = held.select("security", i.alias("i"), "held", j.alias("j")).repartition(n, "security", "i", "j")
        return dealt.select("security", "i", "j", F.inline("held")).withColumnsRenamed({c: f"{c}_{name}" for c in ("value", "cik", "shares")})

    a = side("a", F.col("own"), F.explode(F.sequence("own", "last")))
    b = side("b", F.explode(F.sequence(F.lit(0), "own")), F.col("own"))
    both = a.join(b.hint("merge"), ["security", "i", "j"]).filter("cik_a < cik_b").withColumn("combined", F.col("value_a") + F.col("value_b"))
    both = both.select("security", "cik_a", "shares_a", "value_a", "cik_b", "shares_b", "value_b", "combined")
    return top_rows(both, [F.desc("combined"), "security"], top, ("cik_a", "cik_b")) if top else both


def portfolio_overlap(portfolio: DataFrame, a: str, b: str, top: int = 50) -> DataFrame:
    """Two filers' common securities with both sides' values and shares, largest first."""
    return portfolio_overlap_all_pairs(portfolio.filter(F.col("cik").isin(a, b)), top)


def closest_pair(portfolio: DataFrame) -> tuple[str, str] | None:
    """The two filers with the most securities in common (of several pairs the first by cik), without counting all pairs.

    Two filers with t in common share one of the first n - t + 1 of each one's n securities, put in one order, rarest first. So a
    number t that is high at first, and lowered until a pair reaches it, leaves few pairs to be counted.
    """
    own = portfolio.select("cik", "security").distinct()
    shared = own.groupBy("security").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    w = Window.partitionBy("cik")
    rows = own.join(shared, "security").withColumns({"n": F.count(F.lit(1)).over(w), "at": F.row_number().over(w.orderBy("holders", "security"))})
    rows = write_table(rows.select("cik", "security", "n", "at"), "closest")
    largest = [r["n"] for r in rows.filter("at = 1").select("n").orderBy(F.desc("n")).limit(2).collect()]
    t = largest[-1] if len(largest) == 2 else 0
    while t > 0:
        few = rows.filter(F.col("n") >= t)
        first = few.filter(F.col("at") <= F.col("n") - t + 1)
        pairs = first.select("security", F.col("cik").alias("cik_a")).join(first.select("security", F.col("cik").alias("cik_b")), "security").filter("cik_a < cik_b").select("cik_a", "cik_b").distinct()
        sets = few.groupBy("cik").agg(F.collect_list("security").alias("s"))
        both = pairs.join(sets.select(F.col("cik").alias("cik_a"), F.col("s").alias("a")), "cik_a").join(sets.select(F.col("cik").alias("cik_b"), F.col("s").alias("b")), "cik_b")
        most = both.select("cik_a", "cik_b", F.size(F.array_intersect("a", "b")).alias("common")).filter(F.col("common") >= t).orderBy(F.desc("common"), "cik_a", "cik_b").first()
        if most:
            return most["cik_a"], most["cik_b"]
        t = min(t - 1, t * 9 // 10)
    return None


def overlap_summary(portfolio: DataFrame, a: str, b: str) -> DataFrame:
    """One row: securities in common and of one filer alone, and each filer's value in common."""
    sides = portfolio.filter(F.col("cik").isin(a, b)).groupBy("security").agg(F.max(F.when(F.col("cik") == a, F.col("value"))).alias("va"), F.max(F.when(F.col("cik") == b, F.col("value"))).alias("vb"))
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return sides.agg(F.count_if(both).alias("n_common"), F.count_if(F.col("vb").isNull()).alias("n_only_a"), F.count_if(F.col("va").isNull()).alias("n_only_b"), F.sum(F.when(both, F.col("va")).otherwise(0.0)).alias("value_a"), F.sum(F.when(both, F.col("vb")).otherwise(0.0)).alias("value_b"))


def sector_allocation(portfolio: DataFrame, sectors: DataFrame, top: int = 50) -> DataFrame:
    return top_holdings(portfolio, top).join(sectors, "issuer").groupBy("cik", "sector").agg(F.sum("value").alias("value"))


def issuer_prefix_filter(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.filter(F.upper("issuer").startswith(prefix.upper()))


def issuer_prefix(company: str) -> str:
    """A company name's first word, letters and digits only."""
    return "".join(c for c in (company.strip().split() or [""])[0].upper() if c.isalnum())


def issuer_prefix_lookup(holdings: DataFrame, filings: DataFrame, prefix: str, n: int = 10_000) -> DataFrame:
    rows = issuer_prefix_filter(holdings, prefix).withColumn("cik", normalize_cik("cik"))
    return rows.join(filings.withColumn("cik", normalize_cik("cik")).select("cik", "accession", "filing_date", "fund_name"), ["cik", "accession"]).orderBy(F.desc("filing_date"), "accession", "row_id").limit(n)


def filings_of_matching_filers(filings: DataFrame, holdings: DataFrame, prefix: str) -> DataFrame:
    """All filings of those who ever held an issuer."""
    own = issuer_prefix_filter(holdings, prefix).select(normalize_cik("cik").alias("cik")).distinct()
    return filings.withColumn("cik", normalize_cik("cik")).join(own, "cik", "left_semi").distinct()


def share_type_filter(holdings: DataFrame) -> DataFrame:
    """Rows that count shares or principal (null: shares)."""
    if "share_type" not in holdings.columns:
        return holdings
    return holdings.filter(F.coalesce(F.upper("share_type"), F.lit("SH")).isin("SH", "PRN"))


def position_by_filing(rows: DataFrame) -> DataFrame:
    return rows.groupBy("accession").agg(F.sum(finite("shares")).alias("shares"), F.sum(estimate_actual_value("value", "shares")).alias("value"), first_names("issuer", 3).alias("issuers"), first_names("cusip", 5).alias("cusips"))


def position_series(filings: DataFrame, rows: DataFrame) -> DataFrame:
    """Per filer and filed quarter: the position of the quarter's latest filing, 0 if it has none."""
    latest = latest_filing_per_filer(filings).withColumn("quarter_key", quarter_sort_key("quarter"))
    return latest.join(position_by_filing(rows), "accession", "left").na.fill(0.0, ["shares", "value"])


def reverse_lookup(filings: DataFrame, rows: DataFrame) -> DataFrame:
    """Per filer the last filed quarter against the filed quarter before it; filers who never held are left out."""
    w = Window.partitionBy("cik").orderBy("quarter_key")
    every = Window.partitionBy("cik")
    series = position_series(filings, rows).withColumns({"previous_shares": F.lag("shares").over(w), "previous_value": F.lag("value").over(w), "previous_quarter": F.lag("quarter").over(w), "held": F.max("shares").over(every), "sample": F.max_by("issuers", F.when(F.col("issuers").isNotNull(), F.col("quarter_key"))).over(every), "rn": F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("quarter_key")))})
    last = series.filter("rn = 1 and held > 0").withColumn("action", classify_reverse_movement("previous_shares", "shares")).filter("action <> 'absent'")
    delta = F.col("shares") - F.coalesce("previous_shares", F.lit(0.0))
    pct = F.when(F.col("previous_shares") > 0, delta / F.col("previous_shares") * 100)
    return last.withColumns({"delta": delta, "delta_pct": pct}).select("cik", "fund_name", "quarter", "previous_quarter", "filing_date", "accession", "shares", "value", "previous_shares", "previous_value", "delta", "delta_pct", "action", F.col("sample").alias("issuers"))


def position_history(filings: DataFrame, rows: DataFrame) -> DataFrame:
    """Series from the quarter before the first one held."""
    ahead = Window.partitionBy("cik").orderBy("quarter_key").rowsBetween(Window.unboundedPreceding, 1)
    return position_series(filings, rows).withColumn("begun", F.max(F.col("shares") > 0).over(ahead)).filter("begun").drop("begun")


REVERSE_ACTIONS = ("initiated", "liquidated", "increased", "decreased", "unchanged", "no_prior")


def reverse_lookup_ranked(found: DataFrame, n: int = 1000) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, REVERSE_ACTIONS)), F.col("action"))
    return found.orderBy(F.desc("filing_date"), rank, F.abs("delta").desc(), "fund_name", "cik").limit(min(n, 1000))


def reverse_action_counts(found: DataFrame) -> DataFrame:
    return found.rollup("action").agg(F.count(F.lit(1)).alias("n")).withColumn("action", F.coalesce("action", F.lit("all")))


def last_n_filings(filings: DataFrame, n: int = 2, form_col: str | None = None) -> DataFrame:
    keys = ["cik", form_col] if form_col else ["cik"]
    w = Window.partitionBy(*keys).orderBy(F.desc("filing_date"), F.desc("accession"))
    return filings.withColumn("cik", normalize_cik("cik")).withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def holding_history(filings: DataFrame, holdings: DataFrame, issuer_word: str | None = None, cusip: str | None = None, n: int = 8) -> DataFrame:
    """The last n filings of every filer with its position in one security: shares, value, implied price; zeros if absent."""
    hit = F.lit(False)
    if issuer_word:
        hit = hit | normalize_issuer("issuer").contains(issuer_word.upper())
    if cusip:
        hit = hit | F.coalesce(F.upper("cusip") == cusip.upper(), F.lit(False))
    own = share_type_filter(holdings).filter(hit).groupBy("accession").agg(F.sum(finite("shares")).alias("shares"), F.sum(finite("value")).alias("value"))
    out = last_n_filings(filings, n).join(own, "accession", "left").na.fill(0.0, ["shares", "value"])
    return out.withColumn("implied_price", F.when(F.col("shares") > 0, F.col("value") * 1000 / F.col("shares")).otherwise(0.0))


def live_holder_positions(hits: DataFrame, rows: DataFrame, terms: list[str]) -> DataFrame:
    """Filers found by a search (the first hit per CIK) with their rows of the issuer: shares and value * 1000, or zeros."""
    first = hits.withColumn("cik", normalize_cik("cik")).withColumn("rn", F.row_number().over(Window.partitionBy("cik").orderBy("position"))).filter("rn = 1").drop("rn")
    hit = F.lit(False)
    for term in terms:
        hit = hit | compact_issuer("issuer").contains(term.upper().replace(" ", ""))
    own = rows.filter(hit).groupBy("accession").agg(F.sum(finite("shares")).alias("shares"), (F.sum(finite("value")) * 1000).alias("value"))
    return first.join(own, "accession", "left").na.fill(0.0, ["shares", "value"])
