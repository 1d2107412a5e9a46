"""Quarter-over-quarter movement of institutional holdings by watchlist category."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.columns import classify_filer, classify_movement, estimate_actual_value, finite, hhi_label, normalize_cik, pct1, quarter_sort_key, quarter_valid, sec_folder_url, sec_submission_url, security_of
from filingscope.operators.matching import bounded, issuer_watchlist_match, sector_of
from filingscope.tables import drop_table, write_table

SAMPLES = 5


def first_names(names, n: int = SAMPLES):
    """The first n distinct names, alphabetically."""
    return F.slice(F.array_sort(F.collect_set(names)), 1, n)


def latest_filing_per_filer(filings: DataFrame) -> DataFrame:
    """Per normalised CIK and quarter the newest filing, by date and then accession."""
    w = Window.partitionBy("cik", "quarter").orderBy(F.col("filing_date").desc(), F.col("accession").desc())
    return filings.withColumn("cik", normalize_cik("cik")).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def filing_pairs(filings: DataFrame, current: str, previous: str) -> DataFrame:
    """Per CIK its newest filing of either quarter: now and before (filing_date, accession, fund_name), null if there is none."""
    newest = lambda q: F.max(F.when(F.col("quarter") == q, F.struct("filing_date", "accession", "fund_name")))
    return filings.filter(F.col("quarter").isin(current, previous)).groupBy(normalize_cik("cik").alias("cik")).agg(newest(current).alias("now"), newest(previous).alias("before"))


def _comparable(pairs: DataFrame) -> DataFrame:
    both = pairs.filter("now is not null and before is not null")
    return both.select("cik", "now.fund_name", F.col("now.accession").alias("current_accession"), F.col("now.filing_date").alias("current_date"), F.col("before.accession").alias("previous_accession"), F.col("before.filing_date").alias("previous_date"))


def comparable_filers(filings: DataFrame, current: str, previous: str) -> DataFrame:
    """CIKs with a filing in both quarters, and the accession and date of each."""
    return _comparable(filing_pairs(filings, current, previous))


def exclude_options(holdings: DataFrame) -> DataFrame:
    """Rows whose put/call is null or blank; all rows where there is no such column."""
    if "putcall" not in holdings.columns:
        return holdings
    return holdings.filter(F.coalesce(F.trim("putcall"), F.lit("")) == "")


def _assigned(holdings: DataFrame, pairs: DataFrame, current: str, previous: str) -> DataFrame:
    own = holdings.filter(F.col("quarter").isin(current, previous)).withColumn("cik", normalize_cik("cik")).drop("fund_name", "filing_date")
    now = F.col("quarter") == current
    rows = own.join(pairs, "cik").withColumn("_filing", F.when(now, F.col("now")).otherwise(F.col("before"))).filter(F.col("accession") == F.col("_filing.accession"))
    made = {"fund_name": F.col("_filing.fund_name"), "filing_date": F.col("_filing.filing_date"), "period": F.when(now, "current").otherwise("previous"), "comparable": F.col("now").isNotNull() & F.col("before").isNotNull()}
    return rows.withColumns(made).drop("_filing", "now", "before")


def period_assignment(holdings: DataFrame, filings: DataFrame, current: str, previous: str) -> DataFrame:
    """Holdings of the latest filings of both quarters, with period 'current' or 'previous' and the filing's columns."""
    return _assigned(holdings, filing_pairs(filings, current, previous), current, previous).drop("comparable")


def holdings_of_filings(holdings: DataFrame, filings: DataFrame) -> DataFrame:
    """The holdings of any set of filings, with each filing's fund name and date."""
    own = filings.select(normalize_cik("cik").alias("cik"), "accession", "fund_name", "filing_date").dropDuplicates(["cik", "accession"])
    return holdings.withColumn("cik", normalize_cik("cik")).drop("fund_name", "filing_date").join(own, ["cik", "accession"])


def _positions(rows: DataFrame, keys: list[str], more: list) -> DataFrame:
    now = F.col("period") == "current"
    value = estimate_actual_value("value", "shares")
    total = lambda x, on: F.sum(F.when(on, x).otherwise(0.0))
    return rows.groupBy(*keys).agg(
        total(finite("shares"), ~now).alias("previous_shares"), total(finite("shares"), now).alias("current_shares"), total(value, ~now).alias("previous_value"), total(value, now).alias("current_value"), *more
    )


@dataclass
class Radar:
    """One comparison of two quarters.

    Outputs are plans over the given tables. For several outputs of one comparison, materialise() first writes what
    they share (the filings' pairs, the issuers' matches, the matched holdings) to the shared folder.
    """

    filings: DataFrame
    holdings: DataFrame
    aliases: DataFrame
    current: str
    previous: str

    @cached_property
    def pairs(self) -> DataFrame:
        return filing_pairs(self.filings, self.current, self.previous)

    @cached_property
    def matches(self) -> DataFrame:
        """Of the issuers held in either quarter."""
        return issuer_watchlist_match(self.holdings.filter(F.col("quarter").isin(self.current, self.previous)), self.aliases)

    @cached_property
    def watched(self) -> DataFrame:
        per_category = self.matches.groupBy("issuer", "category").agg(F.collect_set(F.struct("item_key", "label")).alias("items"))
        assigned = _assigned(exclude_options(self.holdings), self.pairs, self.current, self.previous)
        return assigned.join(per_category, "issuer").withColumn("security", security_of("cusip", "issuer"))

    def materialise(self) -> Radar:
        """The same radar over three written tables; drop() deletes them when its outputs have been read."""
        out = Radar(self.filings, self.holdings, self.aliases, self.current, self.previous)
        for name in ("pairs", "matches", "watched"):  # each is made from those before it
            out.__dict__[name] = write_table(getattr(out, name), f"radar-{name}")
        return out

    def drop(self) -> None:
        drop_table(*(self.__dict__[name] for name in ("pairs", "matches", "watched")))

    @property
    def comparable(self) -> DataFrame:
        return _comparable(self.pairs)

    @property
    def categories(self) -> DataFrame:
        return self.aliases.select("category").distinct()

    def compared(self) -> DataFrame:
        return self.watched.filter("comparable")

    def security_positions(self) -> DataFrame:
        """Per filer, category and security: shares, estimated and raw values of both quarters, the movement and the items."""
        now = F.col("period") == "current"
        raw = [F.sum(F.when(now, finite("value")).otherwise(0.0)).alias("current_raw_value"), F.sum(F.when(now, 0.0).otherwise(finite("value"))).alias("previous_raw_value")]
        more = [*raw, F.flatten(F.collect_set("items")).alias("items"), F.min_by("issuer", F.struct("cik", "accession")).alias("issuer"), first_names("issuer").alias("issuers"), first_names("cusip").alias("cusips"), F.max("fund_name").alias("fund_name")]
        out = _positions(self.compared(), ["cik", "category", "security"], more)
        return out.withColumn("items", F.array_distinct("items")).withColumn("action", classify_movement("previous_shares", "current_shares"))

    def security_movements(self) -> DataFrame:
        rows = self.security_positions()
        n = lambda *a: F.count_if(F.col("action").isin(*a))
        names = lambda *a: first_names(F.when(F.col("action").isin(*a), F.col("fund_name")))
        return rows.groupBy("category", "security").agg(
            F.min_by("issuer", "cik").alias("issuer"), F.count_if(F.col("current_shares") > 0).alias("holders_now"), F.count_if(F.col("previous_shares") > 0).alias("holders_before"),
            n("initiated", "increased").alias("buyers"), n("liquidated", "decreased").alias("sellers"), n("initiated").alias("initiated"), n("liquidated").alias("liquidated"),
            F.sum("previous_value").alias("previous_value"), F.sum("current_value").alias("current_value"),
            names("initiated", "increased").alias("buyer_names"), names("liquidated", "decreased").alias("seller_names"), names("initiated").alias("initiated_names"), names("liquidated").alias("liquidated_names"),
        ).withColumn("net", F.col("buyers") - F.col("sellers"))

    def top_security_movements(self, n: int = 100) -> DataFrame:
        return self.security_movements().orderBy((F.col("initiated") + F.col("liquidated")).desc(), (F.col("previous_value") + F.col("current_value")).desc(), "category", "security").limit(n)

    def top_initiations(self, n: int = 50) -> DataFrame:
        return self.security_movements().filter("initiated > 0").orderBy(F.desc("initiated"), F.desc("current_value"), "category", "security").limit(n)

    def top_liquidations(self, n: int = 50) -> DataFrame:
        return self.security_movements().filter("liquidated > 0").orderBy(F.desc("liquidated"), F.desc("previous_value"), "category", "security").limit(n)

    def filer_category_positions(self) -> DataFrame:
        """Per filer and category, the sums of its positions that are not absent, and the movement of their total."""
        rows = self.security_positions().filter("action <> 'absent'")
        out = rows.groupBy("cik", "category").agg(F.max("fund_name").alias("fund_name"), *[F.sum(c).alias(c) for c in ("previous_shares", "current_shares", "previous_value", "current_value")], F.count(F.lit(1)).alias("n_securities"))
        return out.withColumn("action", classify_movement("previous_shares", "current_shares"))

    def filer_item_details(self) -> DataFrame:
        """Per filer, category and item. Each matched item takes the whole position of a security, so one that matches two counts in both."""
        rows = self.security_positions().filter("action <> 'absent'").withColumn("item", F.explode("items"))
        out = rows.groupBy("cik", "category", F.col("item.item_key").alias("item_key"), F.col("item.label").alias("label")).agg(*[F.sum(c).alias(c) for c in ("previous_shares", "current_shares", "previous_value", "current_value")], F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issuers")))), 1, SAMPLES).alias("issuers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cusips")))).alias("cusips"))
        return out.withColumn("action", classify_movement("previous_shares", "current_shares"))

    def category_summary(self) -> DataFrame:
        """Per category, those without holders too: holders and movements, their shares, and values."""
        rows = self.filer_category_positions()
        n = lambda *a: F.count_if(F.col("action").isin(*a))
        per = rows.groupBy("category").agg(
            F.count_if(F.col("current_shares") > 0).alias("holders_now"), F.count_if(F.col("previous_shares") > 0).alias("holders_before"), F.count(F.lit(1)).alias("exposed"),
            n("initiated", "increased").alias("buyers"), n("liquidated", "decreased").alias("sellers"), n("initiated").alias("initiated"), n("liquidated").alias("liquidated"), n("increased").alias("increased"), n("decreased").alias("decreased"), n("unchanged").alias("unchanged"),
            F.sum("previous_value").alias("previous_value"), F.sum("current_value").alias("current_value"),
        )
        total = self.comparable.agg(F.count(F.lit(1)).alias("comparable"))  # one row
        out = self.categories.join(per, "category", "left").crossJoin(total).na.fill(0)
        share = {f"{c}_pct": pct1(c, "comparable") for c in ("exposed", "holders_now", "holders_before", "buyers", "sellers", "initiated", "liquidated")}
        return out.withColumns(share | {"buyers_pct_exposed": pct1("buyers", "exposed"), "sellers_pct_exposed": pct1("sellers", "exposed"), "initiated_pct_exposed": pct1("initiated", "exposed"), "liquidated_pct_exposed": pct1("liquidated", "exposed")})

    def filer_moves(self) -> DataFrame:
        """Per filer and category that moved, with its items' details nested.

        One pass: each security counts under each of its items and once more under no item, for the total.
        """
        sums = ("previous_shares", "current_shares", "previous_value", "current_value")
        none = F.array(F.lit(None).cast("struct<item_key:string,label:string>"))
        rows = self.security_positions().filter("action <> 'absent'").withColumn("item", F.explode(F.concat("items", none)))
        per = rows.groupBy("cik", "category", F.col("item.item_key").alias("item_key"), F.col("item.label").alias("label")).agg(
            F.max("fund_name").alias("fund_name"), *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_securities"),
            F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issuers")))), 1, SAMPLES).alias("issuers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cusips")))).alias("cusips"),
        ).withColumn("action", classify_movement("previous_shares", "current_shares"))
        whole = F.col("item_key").isNull()
        detail = F.when(~whole & ~F.col("action").isin("absent", "unchanged"), F.struct("item_key", "label", "action", *sums, "issuers", "cusips"))
        totals = [F.max(F.when(whole, F.col(c))).alias(c) for c in ("fund_name", *sums, "n_securities", "action")]
        moved = per.groupBy("cik", "category").agg(*totals, F.array_sort(F.collect_list(detail)).alias("details")).filter("action not in ('absent', 'unchanged')")
        count = lambda a: F.size(F.filter("details", lambda d: d["action"] == a))
        return moved.withColumns({"value_delta": F.col("current_value") - F.col("previous_value"), "n_initiated": count("initiated"), "n_liquidated": count("liquidated")})

    def top_filer_moves(self, n: int = 100) -> DataFrame:
        return self.filer_moves().orderBy(F.abs("value_delta").desc(), "cik", "category").limit(n)

    def sector_movers(self, sector_map: list[tuple[str, str]]) -> DataFrame:
        """Per sector, over filers' totals in it; a security counts once per filer, not once per category."""
        per = _positions(self.compared().dropDuplicates(["cik", "period", "accession", "issuer", "cusip", "shares", "value", "row_id"]), ["cik", "security"], [F.min("issuer").alias("issuer")])
        sector = per.join(sector_of(per, sector_map), "issuer").groupBy("cik", "sector").agg(*[F.sum(c).alias(c) for c in ("previous_shares", "current_shares", "previous_value", "current_value")]).withColumn("action", classify_movement("previous_shares", "current_shares"))
        n = lambda *a: F.count_if(F.col("action").isin(*a))
        return sector.groupBy("sector").agg(n("initiated", "increased").alias("buyers"), n("liquidated", "decreased").alias("sellers"), n("initiated").alias("initiated"), n("liquidated").alias("liquidated"), F.sum("previous_value").alias("previous_value"), F.sum("current_value").alias("current_value")).withColumn("net", F.col("buyers") - F.col("sellers"))

    def filer_type_summary(self) -> DataFrame:
        rows = self.filer_category_positions().withColumn("filer_type", classify_filer("cik", "fund_name"))
        n = lambda *a: F.count_if(F.col("action").isin(*a))
        return rows.groupBy("filer_type", "category").agg(F.count_if(F.col("current_shares") > 0).alias("holders_now"), n("initiated", "increased").alias("buyers"), n("liquidated", "decreased").alias("sellers"), n("initiated").alias("initiated"), n("liquidated").alias("liquidated"), F.sum("previous_value").alias("previous_value"), F.sum("current_value").alias("current_value"))

    def institution_category_summary(self, category: str, types=("Pension / Public Fund", "University / Endowment")) -> DataFrame:
        """Filers of some types in one category, with the labels of their items held, held before, begun and ended."""
        rows = self.filer_item_details().filter(F.col("category") == category)
        names = self.filer_category_positions().select("cik", "category", "fund_name").withColumn("filer_type", classify_filer("cik", "fund_name")).filter(F.col("filer_type").isin(*types))
        labels = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("label"))))
        return rows.join(names, ["cik", "category"]).groupBy("cik", "fund_name", "filer_type").agg(labels(F.col("current_shares") > 0).alias("current_items"), labels(F.col("previous_shares") > 0).alias("previous_items"), labels(F.col("action") == "initiated").alias("initiated_items"), labels(F.col("action") == "liquidated").alias("liquidated_items"), F.sum("previous_value").alias("previous_value"), F.sum("current_value").alias("current_value"))

    def current_holders_by_category(self) -> DataFrame:
        """All holders of the current quarter, comparable or not; one that did not file before counts as initiated."""
        now = self.watched.filter("period = 'current'").groupBy("cik", "category").agg(F.max("fund_name").alias("fund_name"), F.sum(finite("shares")).alias("shares"), F.sum(estimate_actual_value("value", "shares")).alias("value")).filter("shares > 0")
        prior = self.filer_category_positions().select("cik", "category", "previous_shares", "previous_value")
        out = now.join(prior, ["cik", "category"], "left").na.fill(0.0, ["previous_shares", "previous_value"])
        w = Window.partitionBy("category").orderBy(F.desc("shares"), "cik")
        return out.withColumns({"action": classify_movement("previous_shares", "shares"), "category_rank": F.row_number().over(w)})

    prior_for_current_holders = current_holders_by_category

    def radar_coverage(self) -> DataFrame:
        filers = self.pairs.agg(F.count("now").alias("current_filers"), F.count("before").alias("previous_filers"), F.count_if(F.col("now").isNotNull() & F.col("before").isNotNull()).alias("comparable_filers"))
        seen = self.compared().agg(F.countDistinct("cik").alias("watched_filers"), F.countDistinct("row_id").alias("watched_rows"))
        return filers.crossJoin(seen)  # each has one row

    def audit_rows(self) -> DataFrame:
        """Per filer, category and security: raw and estimated values, both filings and their URLs."""
        out = self.security_positions().drop("fund_name", "items").join(self.comparable, "cik")
        return out.withColumns({"current_url": sec_submission_url("cik", "current_accession"), "previous_url": sec_submission_url("cik", "previous_accession"), "current_folder": sec_folder_url("cik", "current_accession")})

    def raw_matched_holdings(self) -> DataFrame:
        rows = self.watched.groupBy("row_id", "cik", "accession", "quarter", "period", "issuer", "cusip", "value", "shares")
        labels = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("items.label")))))
        return rows.agg(F.array_sort(F.collect_set("category")).alias("categories"), labels.alias("labels"))


def top_sector_mover(movers: DataFrame, side: str = "buyers") -> DataFrame:
    return movers.orderBy(F.desc(side), F.abs("net").desc(), "sector").limit(1)


def ownership_concentration(holders: DataFrame) -> DataFrame:
    """Per category: HHI of holders' shares in percent, its label, the share of the largest 1 to 100 holders, totals."""
    by = Window.partitionBy("category")
    ranked = holders.withColumns({"pct": F.col("shares") / F.sum("shares").over(by) * 100, "rn": F.row_number().over(by.orderBy(F.desc("shares"), "cik"))})
    top = [F.round(F.sum(F.when(F.col("rn") <= n, F.col("pct")).otherwise(0.0)), 2).alias(f"top_{n}_pct") for n in (1, 5, 10, 25, 50, 100)]
    out = ranked.groupBy("category").agg(F.round(F.sum(F.col("pct") * F.col("pct"))).cast("long").alias("hhi"), *top, F.count(F.lit(1)).alias("holders"), F.sum("shares").alias("shares"), F.sum("value").alias("value"))
    return out.withColumn("label", hhi_label("hhi"))


def peer_hhi(holders: DataFrame) -> DataFrame:
    """Categories from the most to the least concentrated."""
    return ownership_concentration(holders).select("category", "hhi", "label", "holders").orderBy(F.desc("hhi"), "category")


def ownership_by_filer_type(holders: DataFrame) -> DataFrame:
    rows = holders.withColumn("filer_type", classify_filer("cik", "fund_name")).groupBy("category", "filer_type").agg(F.count(F.lit(1)).alias("holders"), F.sum("shares").alias("shares"), F.sum("value").alias("value"))
    return rows.withColumn("pct", pct1("shares", F.sum("shares").over(Window.partitionBy("category"))))


def holders_story_order(rows: DataFrame) -> DataFrame:
    """Holders by action, then shares (those before for liquidated)."""
    rank = F.array_position(F.array(*map(F.lit, ("initiated", "increased", "decreased", "liquidated", "unchanged"))), F.col("action"))
    return rows.orderBy("category", rank, F.when(F.col("action") == "liquidated", F.col("previous_shares")).otherwise(F.col("shares")).desc(), "cik")


def fund_pattern_filter(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows whose fund name contains a pattern of a watched fund (label, pattern); distinct funds meet the small table."""
    funds = rows.select("fund_name").distinct()
    hit = F.lower("fund_name").contains(F.lower("pattern"))
    return rows.join(funds.join(bounded(patterns), hit).select("fund_name", "label").distinct(), "fund_name")


def watched_fund_summary(holders: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per watched fund: its holders found, their shares, prior value and categories, and whether there is any."""
    found = fund_pattern_filter(holders, patterns).groupBy("label").agg(F.count(F.lit(1)).alias("matches"), F.sum("shares").alias("shares"), F.sum("previous_value").alias("previous_value"), F.countDistinct("category").alias("categories"))
    return patterns.select("label").distinct().join(found, "label", "left").na.fill(0).withColumn("found", F.col("matches") > 0)


def available_quarters(filings: DataFrame) -> DataFrame:
    """Distinct quarters, newest first, the first two marked as current and previous."""
    rows = filings.select("quarter").filter(F.coalesce(F.trim("quarter"), F.lit("")) != "").distinct().withColumns({"valid": quarter_valid("quarter"), "key": quarter_sort_key("quarter")})
    rn = F.row_number().over(Window.orderBy(F.desc("key"), F.desc("quarter")))  # a row per quarter: a few hundred at most
    return rows.withColumn("position", rn).select("quarter", "position", F.when(F.col("position") == 1, "current").when(F.col("position") == 2, "previous").alias("role"))


def filer_side_matches(funds: DataFrame, filings: DataFrame, aliases: DataFrame, current: str, previous: str, n: int = 30) -> DataFrame:
    """Funds whose own name matches a watchlist: newest filing, filings in each quarter."""
    matched = issuer_watchlist_match(funds, aliases, "fund_name").groupBy(F.col("issuer").alias("fund_name")).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    own = filings.withColumn("cik", normalize_cik("cik")).drop("fund_name")
    rows = funds.withColumn("cik", normalize_cik("cik")).join(matched, "fund_name").join(own, "cik", "left").groupBy("cik", "fund_name", "categories").agg(F.max("filing_date").alias("latest"), F.count_if(F.col("quarter") == current).alias("current_filings"), F.count_if(F.col("quarter") == previous).alias("previous_filings"))
    return rows.orderBy(F.col("latest").desc_nulls_last(), "cik").limit(n)
