"""Issuers matched to watchlists and sectors: distinct issuers against small tables, never holding rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.functions.columns import clean_sector_name, compact_issuer, normalize_issuer, sector_by_words
from filingscope.operators.automaton import contained

#: Rows of a sector map or of a table of patterns that may be broadcast.
MOST_ALIASES = 50_000

#: Aliases up to which a nested loop over the distinct issuers is the cheaper way.
FEW_ALIASES = 500

ALIAS_SCHEMA = "category string, ticker string, label string, alias string"


def bounded(table: DataFrame, most: int = MOST_ALIASES) -> DataFrame:
    """A table to broadcast; an error if it has more rows than `most`."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"a table of over {most} rows is not broadcast")
    return F.broadcast(table)


def alias_table(spark: SparkSession, watchlists: dict[str, list[tuple[str, str, list[str]]]]) -> DataFrame:
    """{category: [(ticker, label, aliases)]} -> one row per alias, the ticker and label being aliases too."""
    rows = [(key, ticker, label, alias) for key, items in watchlists.items() for ticker, label, aliases in items for alias in dict.fromkeys([label, ticker, *aliases])]
    table = spark.createDataFrame(rows, ALIAS_SCHEMA)
    return table.withColumns({"item_key": F.concat_ws("|", "category", F.upper("ticker"), compact_issuer("label")), "alias_norm": normalize_issuer("alias"), "alias_compact": compact_issuer("alias")})


def share_class_match(ticker, norm):
    """Alphabet's two tickers go by the share class; null for other tickers."""
    a, c = norm.rlike(r"\b(CL|CLASS)\s+A\b"), norm.rlike(r"\b(CL|CLASS)\s+C\b")
    own = norm.rlike(r"\b(ALPHABET|GOOGLE)\b")
    return F.when(F.upper(ticker) == "GOOGL", own & a).when(F.upper(ticker) == "GOOG", own & (c | (~a & ~c)))


def issuer_watchlist_match(issuers: DataFrame, aliases: DataFrame, issuer_col: str = "issuer", few: int = FEW_ALIASES) -> DataFrame:
    """(issuer, category, item_key, ticker, label) of the distinct issuers that an alias of 4 letters or more is part of.

    A watchlist of a few aliases meets the distinct issuers in a nested loop inside the JVM; with more, each name
    is read once by an automaton of all aliases (any number of them). Both give the same rows.
    """
    names = issuers.select(F.col(issuer_col).alias("issuer")).filter("issuer is not null").distinct().withColumns({"norm": normalize_issuer("issuer"), "compact": compact_issuer("issuer")})
    if aliases.limit(few + 1).count() > few:
        return _match_many(names, aliases)
    by_class = share_class_match(F.col("ticker"), F.col("norm"))
    by_alias = (F.length("alias_compact") >= 4) & (F.col("norm").contains(F.col("alias_norm")) | F.col("compact").contains(F.col("alias_compact")))
    return names.join(F.broadcast(aliases), F.coalesce(by_class, by_alias)).select("issuer", "category", "item_key", "ticker", "label").distinct()


def _match_many(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases found by the automaton, joined back by their text; share classes are found by the names that have them."""
    shared = F.coalesce(F.upper("ticker").isin("GOOG", "GOOGL"), F.lit(False))
    items = ["category", "item_key", "ticker", "label"]
    usual = aliases.filter(~shared & (F.length("alias_compact") >= 4))
    found = [contained(names, usual.select(F.col(f"alias_{form}").alias("pattern")), ["issuer"], form).join(usual.select(F.col(f"alias_{form}").alias("pattern"), *items), "pattern").select("issuer", *items) for form in ("norm", "compact")]
    tickers = F.array_compact(F.array(*[F.when(share_class_match(F.lit(t), F.col("norm")), F.lit(t)) for t in ("GOOGL", "GOOG")]))
    classes = names.select("issuer", F.explode(tickers).alias("class")).join(aliases.filter(shared).select(F.upper("ticker").alias("class"), *items).distinct(), "class").select("issuer", *items)
    return reduce(DataFrame.unionByName, [*found, classes]).distinct()


def watchlist_filter(holdings: DataFrame, matches: DataFrame) -> DataFrame:
    return holdings.join(matches.select("issuer").distinct(), "issuer", "left_semi")


#: Words that no LIKE pattern starts with.
STOP_WORDS = ["A", "AN", "AND", "CLASS", "CO", "COM", "COMMON", "CORP", "CORPORATION", "GROUP", "HLDG", "HLDGS", "HOLDING", "HOLDINGS", "INC", "LTD", "NEW", "PLC", "THE"]


def like_patterns(aliases: DataFrame) -> DataFrame:
    """LIKE patterns that hold for every issuer an alias matches: its first word, and its first two."""
    words = F.filter(F.split("alias_norm", " "), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    safe = F.transform(words, lambda w: F.regexp_replace(w, r"([\\%_])", r"\\$1"))
    one, two = F.concat(F.lit("%"), F.get("w", F.lit(0)), F.lit("%")), F.concat(F.lit("%"), F.get("w", F.lit(0)), F.lit("%"), F.get("w", F.lit(1)), F.lit("%"))
    return aliases.select(safe.alias("w")).filter(F.size("w") > 0).select(F.explode(F.array_compact(F.array(one, two))).alias("pattern")).distinct()


def like_prefilter(holdings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows whose issuer has an alias's first word: one alternation, made from the bounded table."""
    words = [r[0].strip("%").split("%")[0] for r in like_patterns(aliases).collect()]
    return holdings.filter(normalize_issuer("issuer").rlike("|".join(sorted(set(words))) or "(?!)"))


def sector_of(issuers: DataFrame, sector_map: list[tuple[str, str]], issuer_col: str = "issuer") -> DataFrame:
    """(issuer, sector): the map's exact name, else its first name that contains the issuer or is contained, else word rules."""
    spark = issuers.sparkSession
    names = issuers.select(F.col(issuer_col).alias("issuer")).distinct().withColumn("clean", clean_sector_name("issuer"))
    if len(sector_map) > MOST_ALIASES:
        raise ValueError("the sector map is too large to broadcast")
    table = F.broadcast(spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(sector_map)], "ordinal int, key string, mapped string"))
    hit = F.col("clean").contains(F.col("key")) | F.col("key").contains(F.col("clean"))
    best = names.join(table, hit, "left").withColumn("rank", F.when(F.col("clean") == F.col("key"), -1).otherwise(F.col("ordinal")))
    return best.groupBy("issuer").agg(F.min_by("mapped", "rank").alias("mapped")).select("issuer", F.coalesce("mapped", sector_by_words("issuer")).alias("sector"))
