"""Tables kept up to date: upserts, replacement, retention, snapshots, verification. All return new tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingscope.functions.columns import normalize_cik, normalize_issuer, quarter_end, quarter_of_date, quarter_sort_key, security_key
from filingscope.operators.radar import latest_filing_per_filer


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the last in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_wins_dedupe(entries: DataFrame) -> DataFrame:
    """One entry per accession: from the live feed, else a daily index, else a master index."""
    rank = F.coalesce(F.array_position(F.array(F.lit("feed"), F.lit("daily"), F.lit("master")), F.col("source")), F.lit(0))
    return last_wins(entries, ["accession"], [F.when(rank == 0, 9).otherwise(rank), "filing_date"])


def union_index_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return first_wins_dedupe(out)


def missing_accessions(entries: DataFrame, stored: DataFrame) -> DataFrame:
    return entries.join(stored.select("accession").distinct(), "accession", "left_anti")


def eligible_submissions(rows: DataFrame, quarter: str) -> DataFrame:
    """Holdings reports and their amendments whose period is the quarter's last day."""
    return rows.filter(F.col("form").isin("13F-HR", "13F-HR/A") & (F.col("period") == quarter_end(F.lit(quarter))))


def manager_name_lookup(rows: DataFrame, cover: DataFrame) -> DataFrame:
    names = cover.select("accession", F.nullif(F.trim("manager_name"), F.lit("")).alias("_name")).groupBy("accession").agg(F.min("_name").alias("_name"))
    return rows.join(names, "accession", "left").withColumn("manager_name", F.coalesce("_name", "cik")).drop("_name")


def filings_with_fund_name(filings: DataFrame, funds: DataFrame) -> DataFrame:
    names = funds.select(normalize_cik("cik").alias("cik"), F.col("fund_name").alias("_name"))
    return filings.drop("fund_name").withColumn("cik", normalize_cik("cik")).join(names, "cik", "left").withColumn("fund_name", F.coalesce("_name", "cik")).drop("_name")


def securities(holdings: DataFrame) -> DataFrame:
    """The dimension of securities: key, issuer, search form, CUSIP."""
    rows = holdings.select(security_key("cusip", "issuer").alias("security_key"), "issuer", "cusip")
    return rows.groupBy("security_key").agg(F.min("issuer").alias("issuer"), F.min("cusip").alias("cusip")).withColumn("issuer_search", normalize_issuer("issuer"))


def holdings_with_security(holdings: DataFrame, dimension: DataFrame) -> DataFrame:
    return holdings.withColumn("security_key", security_key("cusip", "issuer")).drop("issuer", "cusip").join(dimension, "security_key")


def _upsert(stored: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """New values replace stored ones; columns in keep only where nothing is stored."""
    cols = [c for c in stored.columns if c != key]
    old, fresh = stored.alias("o"), new.alias("n")
    pick = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in cols]
    return old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[p.alias(c) for p, c in zip(pick, cols)])


def upsert_funds(stored: DataFrame, new: DataFrame) -> DataFrame:
    """By CIK: names are replaced, a ticker that is set stays; of several new rows the last by position counts."""
    return _upsert(stored, last_wins(new, ["cik"], [F.desc("position")]).drop("position"), "cik", ("ticker",))


def upsert_filings(stored: DataFrame, new: DataFrame) -> DataFrame:
    return _upsert(stored, last_wins(new, ["accession"], [F.desc("position")]).drop("position"), "accession", ())


def upsert_securities(stored: DataFrame, new: DataFrame) -> DataFrame:
    return _upsert(stored, last_wins(new, ["security_key"], [F.desc("position")]).drop("position"), "security_key", ("cusip",))


def replace_holdings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the new rows' accessions are replaced; doing it twice changes nothing."""
    return stored.join(new.select("accession").distinct(), "accession", "left_anti").unionByName(new.select(stored.columns))


def orphan_rows(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    return dimension.join(facts.select(key).distinct(), key, "left_anti")


def retain_quarters(filings: DataFrame, holdings: DataFrame, dimension: DataFrame, quarters: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filings of some quarters, their holdings, and the securities that those have."""
    kept = filings.filter(F.col("quarter").isin(*quarters))
    rows = holdings.join(kept.select("accession").distinct(), "accession", "left_semi")
    return kept, rows, dimension.join(rows.select("security_key").distinct(), "security_key", "left_semi")


def trim_quarter(filings: DataFrame, holdings: DataFrame, funds: DataFrame, quarter: str) -> DataFrame:
    """One row: what removing a quarter deletes, orphaned funds included."""
    gone = filings.filter(F.col("quarter") == quarter)
    rows = holdings.join(gone.select("accession").distinct(), "accession", "left_semi")
    left = filings.filter(F.col("quarter") != quarter).select(normalize_cik("cik").alias("cik"))
    orphans = orphan_rows(funds.withColumn("cik", normalize_cik("cik")), left, "cik")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(gone, "filings").crossJoin(one(rows, "holdings")).crossJoin(one(orphans, "orphan_funds"))  # each has one row


def latest_only_migration(filings: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    latest = latest_filing_per_filer(filings)
    return latest, holdings.join(latest.select("accession").distinct(), "accession", "left_semi")


def snapshot_dedupe(holdings: DataFrame) -> DataFrame:
    keys = {"cusip": F.coalesce(F.nullif(F.upper(F.trim("cusip")), F.lit("")), F.lit("NO_CUSIP")), "issuer": normalize_issuer("issuer")}
    return holdings.withColumns(keys).groupBy("accession", "cusip", "issuer").agg(F.sum("value").alias("value"), F.sum("shares").alias("shares"))


def snapshot_union(snapshots: DataFrame) -> DataFrame:
    """Holdings of all snapshots, one per accession, CUSIP and issuer: the latest snapshot's."""
    return last_wins(snapshots, ["accession", "cusip", "issuer"], [F.desc("generated_at")])


def snapshot_merge_new(stored: DataFrame, new: DataFrame, keys: list[str], quarter: str | None = None) -> DataFrame:
    fresh = new.join(stored.select(*keys).distinct(), keys, "left_anti")
    fresh = fresh.withColumn("quarter", F.lit(quarter)) if quarter else fresh
    return stored.unionByName(fresh, allowMissingColumns=True)


def snapshot_write(rows: DataFrame, path: str, current: str, previous: str, watchlist_hash: str, categories: list[str], generated_at: datetime | None = None) -> None:
    """Matched rows of a pair of quarters as Parquet by pair, with a manifest row."""
    spark, at = rows.sparkSession, generated_at or datetime.now(timezone.utc).replace(tzinfo=None)
    rows.withColumns({"current_quarter": F.lit(current), "previous_quarter": F.lit(previous)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("current_quarter", "previous_quarter").parquet(f"{path}/rows")
    manifest = [(current, previous, at, watchlist_hash, categories)]
    spark.createDataFrame(manifest, "current_quarter string, previous_quarter string, generated_at timestamp, watchlist_hash string, categories array<string>").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def snapshot_list(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest row of each pair, newest quarters first."""
    rows = last_wins(spark.read.parquet(f"{path}/manifest"), ["current_quarter", "previous_quarter"], [F.desc("generated_at")])
    return rows.orderBy(quarter_sort_key("current_quarter").desc(), quarter_sort_key("previous_quarter").desc())


def snapshot_read(spark: SparkSession, path: str, current: str, previous: str, watchlist_hash: str, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows of a pair, and its manifest row with warnings: a stale hash or missing categories only warn."""
    rows = spark.read.parquet(f"{path}/rows").filter((F.col("current_quarter") == current) & (F.col("previous_quarter") == previous))
    valid = rows.filter("accession is not null and issuer is not null and not isnan(value) and not isnan(shares)")
    own = snapshot_list(spark, path).filter((F.col("current_quarter") == current) & (F.col("previous_quarter") == previous))
    lost = F.array_except(F.array(*map(F.lit, categories)), F.col("categories"))
    warnings = F.array_compact(F.array(F.when(F.col("watchlist_hash") != watchlist_hash, "watchlist has changed"), F.when(F.size(lost) > 0, F.concat(F.lit("categories missing: "), F.concat_ws(", ", lost)))))
    return valid, own.withColumn("warnings", warnings)


def feed_merge(live: DataFrame, stored: DataFrame, n: int = 250) -> DataFrame:
    """Live and stored entries by accession, stored fields first, newest n."""
    cols = [c for c in live.columns if c != "accession"]
    both = live.alias("l").join(stored.alias("s"), "accession", "full_outer").select("accession", *[F.coalesce(F.col(f"s.{c}"), F.col(f"l.{c}")).alias(c) for c in cols])
    return both.orderBy(F.desc("filing_date"), "accession").limit(n)


def ingestion_counters(entries: DataFrame) -> DataFrame:
    """Counts of seen, matched, skipped (by reason) and inserted entries."""
    by = F.col("outcome")
    return entries.agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(by == x).alias(x) for x in ("inserted", "skipped_existing", "skipped_wrong_quarter", "skipped_no_holdings", "skipped_error")], F.count_if(by.isin("inserted", "skipped_existing")).alias("matched"))


def latest_run_status(runs: DataFrame) -> DataFrame:
    """Per quarter and source: the newest run, whether any succeeded, and how the next one should run."""
    w = Window.partitionBy("quarter", "source")
    rows = runs.withColumns({"any_success": F.bool_or(F.col("status") == "completed").over(w), "rn": F.row_number().over(w.orderBy(F.desc("started_at"), F.desc("id")))})
    mode = F.when(~F.col("any_success"), "full").when(F.col("status") == "completed", "incremental").otherwise("refresh-existing")
    return rows.filter("rn = 1").drop("rn").withColumn("mode", mode)


def report_quarter_distribution(filings: DataFrame, date_col: str = "report_date") -> DataFrame:
    return filings.groupBy(F.coalesce(quarter_of_date(date_col), F.lit("missing")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


def verify_filings_breakdown(filings: DataFrame) -> DataFrame:
    return filings.groupBy("quarter", F.coalesce("source", F.lit("unknown")).alias("source"), "form", "report_date").agg(F.count(F.lit(1)).alias("n"))


def verify_quarter_totals(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """Per quarter: filings, filers and holdings; quarters without holdings too. Holdings are counted before they are joined."""
    per = holdings.groupBy("accession").agg(F.count(F.lit(1)).alias("n"))
    return filings.withColumn("cik", normalize_cik("cik")).join(per, "accession", "left").groupBy("quarter").agg(F.countDistinct("accession").alias("filings"), F.countDistinct("cik").alias("filers"), F.sum(F.coalesce("n", F.lit(0))).alias("holdings"))


def filing_year_distribution(filings: DataFrame) -> DataFrame:
    return filings.groupBy(F.substring(F.col("filing_date").cast("string"), 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))
