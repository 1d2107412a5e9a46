"""Many patterns looked up in one pass over each text, by an automaton that every task builds from a table of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all patterns that are sent to the tasks at once; more patterns take further passes over the texts.
MOST_CHARACTERS = 20_000_000


def slices(patterns: DataFrame, most: int = MOST_CHARACTERS) -> Iterator[list[str]]:
    """The distinct patterns in lists of at most `most` characters (a longer one is alone); the driver holds one list at a time."""
    held, size = [], 0
    for (pattern,) in patterns.select("pattern").filter("pattern <> ''").distinct().toLocalIterator():
        if held and size + len(pattern) > most:
            yield held
            held, size = [], 0
        held.append(pattern)
        size += len(pattern)
    if held:
        yield held


def automaton(patterns: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for pattern in patterns:
        machine.add_word(pattern, pattern)
    machine.make_automaton()
    return machine


def contained(texts: DataFrame, patterns: DataFrame, keys: list[str], text_col: str, most: int = MOST_CHARACTERS) -> DataFrame:
    """(keys, pattern) for each pattern that is part of a text, once; patterns has a column pattern (string).

    A text is read once, whatever the number of patterns: the work is the texts' length and the matches, not
    texts times patterns. Null and empty texts and patterns match nothing; equal patterns are one.
    """
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    rows = texts.select(*keys, F.col(text_col).cast("string").alias("_text")).filter("_text <> ''")

    def lookup(part: list[str]) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(part)

        def find(batches):
            machine = automaton(sent.value)
            for b in batches:
                at, found = [], []
                for i, text in enumerate(b.column(len(keys)).to_pylist()):
                    own = {pattern for _, pattern in machine.iter(text)}
                    at += [i] * len(own)
                    found += own
                own = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(own) for j in range(len(keys))), pa.array(found, pa.string())], names=[*keys, "pattern"])

        return rows.mapInArrow(find, f"{kinds}, pattern string")

    found = [lookup(part) for part in slices(patterns, most)]
    return reduce(DataFrame.unionByName, found) if found else rows.select(*keys, F.lit("").alias("pattern")).filter("false")
