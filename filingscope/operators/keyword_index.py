"""A positional inverted index of documents, and searches of many keyword lists at once by joins with it.

The index is a table of postings (word, document, places), sorted by word in ranges, so that Parquet's
statistics let a search read only its words' row groups and a very common word lies in several files. The
answers are those of a scan: a keyword is found anywhere in the text, also inside words. So the vocabulary,
not the text, is searched for the keyword's parts (one pass by an automaton), and places put phrases together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.operators.automaton import contained
from filingscope.tables import write_table

SPACES = r"\s+"
#: A task that counts hits gets those of about so many postings, however many there are.
POSTINGS = 100_000


def postings(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(word, keys, places): the places of each word (in lower case, parted by white space) in each document, sorted by word.

    Write it where it is to be kept; documents of one key are one. Null texts have no words.
    """
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def index(batches):
        for b in batches:
            words, at, places = [], [], []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                own: dict[str, list[int]] = {}
                for place, word in enumerate((text or "").split(" ")):
                    if word:
                        own.setdefault(word, []).append(place)
                words += own.keys()
                places += own.values()
                at += [i] * len(own)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(b.column(j).take(rows) for j in range(len(keys))), pa.array(places, pa.list_(pa.int32()))], names=["word", *keys, "places"])

    rows = docs.select(*keys, F.lower(F.regexp_replace(text_col, SPACES, " ")).alias("_text")).mapInArrow(index, f"word string, {kinds}, places array<int>")
    return rows.repartitionByRange("word", *keys).sortWithinPartitions("word", *keys)


def _pieces(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, keyword, part, times): words of the vocabulary that can be a keyword's part: hold it (one part), end with it (the
    first of several), begin with it (the last), or are it (the others); times counts it in the word."""
    parts = wanted.select("keyword", "n", F.posexplode("parts").alias("part", "pattern")).filter("pattern <> ''")
    inner = (F.col("part") > 0) & (F.col("part") < F.col("n") - 1)
    equal = words.join(parts.filter(inner), F.col("word") == F.col("pattern")).select("word", "keyword", "part", F.lit(1).alias("times"))
    outer = parts.filter(~inner)
    held = contained(words, outer.select("pattern"), ["word"], "word").join(outer, "pattern")
    fits = (F.col("n") == 1) | F.when(F.col("part") == 0, F.endswith("word", "pattern")).otherwise(F.startswith("word", "pattern"))
    times = ((F.length("word") - F.length(F.replace("word", "pattern", F.lit("")))) / F.length("pattern")).cast("int")
    return equal.unionByName(held.filter(fits).select("word", "keyword", "part", times.alias("times")))


def keyword_hits(index: DataFrame, keywords: DataFrame, keys: list[str]) -> DataFrame:
    """(keyword, keys, hits): how often each distinct keyword (column keyword) is in each document, without overlaps, if it is."""
    clean = F.lower(F.trim("keyword"))
    wanted = keywords.select(clean.alias("keyword")).filter("keyword <> ''").distinct().withColumn("parts", F.split("keyword", " ")).withColumn("n", F.size("parts"))
    # a keyword with two spaces in a row is in no text, whose spaces are single
    wanted = wanted.filter(~F.array_contains("parts", ""))
    # the words that matter, found once; what reads the postings meets this small table
    pieces = _pieces(index.select("word").distinct(), wanted).join(wanted.select("keyword", "n", F.length(F.get("parts", F.lit(0))).alias("first"), F.length(F.element_at("parts", -1)).alias("last")), "keyword")
    pieces = write_table(pieces, "keyword-words")
    found = index.join(pieces, "word")
    # a keyword's words in a document come from many tasks: they are dealt out first, as grouping them before saves nothing
    tasks = index.count() // POSTINGS + 1
    deal = lambda df: df.repartition(tasks, "keyword", *keys)
    single = deal(found.filter("n = 1").select("keyword", *keys, (F.size("places") * F.col("times")).alias("times"))).groupBy("keyword", *keys).agg(F.sum("times").cast("long").alias("hits"))
    parts = deal(found.filter("n > 1").select("keyword", *keys, "n", "first", "last", "part", F.when(F.col("part") == 0, F.length("word")).alias("size"), "places"))
    begins = parts.withColumn("place", F.explode("places")).drop("places")
    starts = begins.groupBy("keyword", *keys, "n", "first", "last", (F.col("place") - F.col("part")).alias("start")).agg(F.count(F.lit(1)).alias("there"), F.max("size").alias("size")).filter("there = n")
    # a hit may begin in the word in which the one before ends, if there is room for both parts
    room = F.col("first") + F.col("last")
    free = lambda acc, x: (x["start"] > acc["end"]) | ((x["start"] == acc["end"]) & (x["size"] >= room))
    step = lambda acc, x: F.when(free(acc, x), F.struct((x["start"] + F.col("n") - 1).alias("end"), (acc["hits"] + 1).alias("hits"))).otherwise(acc)
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("hits"))
    lists = starts.groupBy("keyword", *keys, "n", "first", "last").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("starts"))
    several = lists.select("keyword", *keys, F.aggregate("starts", start, step, lambda acc: acc["hits"]).alias("hits"))
    return single.unionByName(several)


def keyword_lists_search(index: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """(list, keys, matched, hits) for each list of keywords (list, keyword) and document that has one of them: the keywords in
    alphabetical order and their hits, as keyword_search() has them for one list. Keywords that repeat count once."""
    own = lists.select("list", F.lower(F.trim("keyword")).alias("keyword")).distinct()
    found = keyword_hits(index, own, keys).join(own, "keyword")
    return found.groupBy("list", *keys).agg(F.array_sort(F.collect_list("keyword")).alias("matched"), F.sum("hits").alias("hits"))
