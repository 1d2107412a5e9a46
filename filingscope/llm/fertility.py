"""Quality rules from public vocabularies: characters per token, byte fallback and token entropy, in bands per language or script."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.llm.common import WordHashes, shingles, texts_of, write_table
from filingscope.llm.tokens import ByteBpe, Pieces, opened

#: The vocabulary with byte fallback, and a byte-level one.
VOCABULARY, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_50k.json"
WINDOW = 256
#: A band reaches this many interquartile ranges beyond the quartiles. It is wider for texts under STEADY
#: tokens, by the square root of what they lack, and the vocabulary doesn't judge the shortest texts.
REACH, LEAST_TOKENS, STEADY = 3.0, 64, 512
#: Metrics, the width of their histogram's bins, the least interquartile range counted, and which sides reject.
METRICS = {
    "chars_per_token": (0.01, 0.10, "both"), "byte_share": (0.001, 0.01, "high"), "token_entropy": (0.005, 0.02, "low"),
    "byte_level_chars_per_token": (0.01, 0.10, "both"), "byte_level_entropy": (0.005, 0.02, "low"),
}
BATCH = 256


def base_counts(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 8:
        _, first, inverse, n = np.unique(shingles(hashes.of(words), 8), return_index=True, return_inverse=True, return_counts=True)
        if len(first) < len(inverse):
            twice = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(n[inverse] > 1)
            np.add.at(twice, at, 1)
            np.add.at(twice, at + 8, -1)
            repeated = int((np.cumsum(twice)[:-1] > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def script_of(text: str) -> str:
    """The script of most letters, by their names (Latin, Cyrillic, Cjk, ...); none without letters."""
    found: Counter = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            found[unicodedata.name(char, "UNKNOWN").replace("-", " ").split()[0].capitalize()] += n
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


def token_metrics(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[int, float, float, float]:
    """n_tokens, characters per token, share of byte-fallback tokens, token entropy.

    The entropy is that of windows of 256 tokens on average, as a share of the largest possible; so a
    long text is not taken for a repetitive one. Tokens after the last full window are in one more
    window, which ends at the last token.
    """
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    size = min(n, WINDOW)
    windows = ids[: n // size * size].reshape(-1, size)
    if n % size:
        windows = np.concatenate([windows, ids[None, -size:]])
    windows = np.sort(windows, axis=1)
    new = np.ones(windows.shape, bool)
    new[:, 1:] = windows[:, 1:] != windows[:, :-1]
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, windows.size))
    share = runs / size
    entropy = float(-(share * np.log2(share)).sum() / len(windows) / max(np.log2(size), 1))
    return n, chars / n, float(is_byte[ids].mean()), entropy


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, byte_level: str = BYTE_LEVEL) -> DataFrame:
    """The counts and metrics of every whole text (null: empty), with its band's key: the language, or the script if there is none."""
    names = ["doc_id", "band", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *METRICS]
    kinds = [pa.int64(), pa.string()] + [pa.int64()] * 6 + [pa.float64()] * len(METRICS)

    def run(batches):
        encoder, second, hashes = opened(Pieces, vocabulary), opened(ByteBpe, byte_level), WordHashes()
        no_byte = np.zeros(len(second.lengths), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                raw = [x or b"" for x in texts_of(part.column(2))]
                texts = [x.decode("utf-8", "replace") for x in raw]
                rows = []
                for data, text, ids, others in zip(raw, texts, encoder.encode(texts), second.encode(texts)):
                    _, chars, _, entropy = token_metrics(np.frombuffer(others, "<u4"), len(text), no_byte)
                    rows.append((*base_counts(data, hashes), *token_metrics(np.frombuffer(ids, "<u4"), len(text), encoder.byte), chars, entropy))
                bands = [x or script_of(t) for x, t in zip(part.column(1).to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bands, pa.string()), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds[2:])]], names=names)

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("band"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long' if k == pa.int64() else 'double'}" for n, k in zip(names, kinds)))


def rejection_bands(measured: DataFrame, reach: float = REACH, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Per language and metric: low and high ends and the margin in them, from the quartiles over all documents of that language.

    Quartiles come from histograms with fixed bins, so their size does not grow with the input.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) / w).alias("bin"), F.lit(w).alias("width"), F.lit(least).alias("least"), F.lit(side).alias("side")) for m, (w, least, side) in METRICS.items()]))
    bins = measured.filter(F.col("n_tokens") >= least_tokens).select("band", each.alias("m")).groupBy("band", "m.metric", "m.bin", "m.width", "m.least", "m.side").agg(F.count(F.lit(1)).alias("n"))
    up_to = bins.withColumn("below", F.sum("n").over(Window.partitionBy("band", "metric").orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy("band", "metric")))
    quartile = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), (F.col("bin") + 0.5) * F.col("width")))
    q = up_to.groupBy("band", "metric", "side").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.first("least").alias("least"))
    margin = F.lit(reach) * F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    low = F.when(F.col("side") != "high", F.col("q1") - margin)
    high = F.when(F.col("side") != "low", F.col("q3") + margin)
    return q.select("band", "metric", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(margin, 6).alias("margin"))


def fertility_rules(docs: DataFrame, reach: float = REACH, least_tokens: int = LEAST_TOKENS, **columns) -> DataFrame:
    """Base counts, base verdict, metrics and kept of every row.

    A row is rejected if the base rules fail it or, with least_tokens tokens at least, if a metric is
    outside the band of its language, or of its script where it has no language. Null texts are empty (and
    fail for want of words); a language without texts long enough has no band and rejects nothing;
    repeated rows are judged alike, an empty table gives an empty result, and other columns are not read.
    """
    measured = write_table(measure(docs, **columns), "measured")
    bands = rejection_bands(measured, reach, least_tokens).groupBy("band").agg(*[F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{m}_{end}") for m in METRICS for end in ("low", "high", "margin")])
    outside, wider = F.lit(False), F.greatest(F.lit(0.0), F.sqrt(F.lit(STEADY) / F.greatest(F.col("n_tokens"), F.lit(1))) - 1)
    for m in METRICS:
        more = F.col(f"{m}_margin") * wider
        outside = outside | F.coalesce(F.col(m) < F.col(f"{m}_low") - more, F.lit(False)) | F.coalesce(F.col(m) > F.col(f"{m}_high") + more, F.lit(False))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.join(bands, "band", "left").withColumn("base_failed", failed).withColumn("band_failed", outside & (F.col("n_tokens") >= least_tokens))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("band_failed")).alias("kept"), "band", "n_tokens", *[F.round(m, 6).alias(m) for m in METRICS])
