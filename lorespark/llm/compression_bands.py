"""Quality rules by compression: zstandard ratios of the whole document and of fixed chunks, against length-specific bands.

Repetitive text compresses too well, random text hardly at all; what is usual depends on the length, since a
short text has little to refer back to. Each document is judged by itself, on its whole text.

Defined results: a null or empty text has no words, hence fails the base rules and has no ratio. Equal texts get
equal results; further columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Length classes end at these numbers of bytes.
EDGES = (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 1 << 62)
#: (bytes below which the band holds, least ratio, largest ratio), ratio = compressed / plain at level 3. By fit_bands on
#: documents of good quality outside the held-out fold, at sf0.1.
BANDS = ((128, 0.45, 9.0), (256, 0.586, 0.926), (512, 0.526, 0.758), (1024, 0.493, 0.702), (2048, 0.459, 0.59), (4096, 0.435, 0.539), (8192, 0.409, 0.492), (16384, 0.396, 0.469), (1 << 62, 0.336, 0.469))
#: Chunks have so many bytes; the last one ends with the text, so that every byte of a longer text is in a chunk.
CHUNK = 1024
CHUNK_BAND = (0.47, 0.625)
#: The share of chunks out of band at which a document is rejected.
CHUNK_SHARE = 0.1
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SCHEMA = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,ratio:double,n_chunks:int,n_bad_chunks:int>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur at least twice, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    if len(known) == len(words):
        return 0
    mixed = (ids + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = code * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    _, which, count = np.unique(code, return_inverse=True, return_counts=True)
    again = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[which] > 1)
    np.add.at(again, at, 1)
    np.add.at(again, at + window, -1)
    return int((np.cumsum(again)[:-1] > 0).sum())


def measure(text: str | None, compress) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # continuation bytes of UTF-8 are not code points of their own
    joined = b"".join(words)
    chars = len(joined.decode("utf-8"))
    ratio, bad, n = None, 0, 0
    if raw:
        ratio = len(compress(raw)) / len(raw)
        if len(raw) > CHUNK:
            for k in range(0, len(raw), CHUNK):
                low = min(k, len(raw) - CHUNK)
                part = len(compress(raw[low : low + CHUNK])) / CHUNK
                n, bad = n + 1, bad + (not CHUNK_BAND[0] <= part <= CHUNK_BAND[1])
    return len(words), chars, sum(map(raw.count, (bytes([c]) for c in SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words), ratio, n, bad


def _measured(texts: pd.Series) -> pd.DataFrame:
    compress = zstandard.ZstdCompressor(level=3).compress
    return pd.DataFrame([measure(t, compress) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "n_chunks", "n_bad_chunks"]).astype({"ratio": "float64"})


def screen(docs: DataFrame, bands: tuple = BANDS, share: float = CHUNK_SHARE) -> DataFrame:
    """docs with the measures, base_failed and kept (columns of these names are replaced)."""
    prepare(docs.sparkSession)
    m = F.col("_m")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    fits, ratio = F.lit(False), m.ratio
    for below, least, most in reversed(bands):
        fits = F.when(size < below, ratio.between(least, most)).otherwise(fits)
    base = (m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words)
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = (*added, "base_failed", "kept", "ratio", "n_bad_chunks")
    out = docs.withColumn("_m", F.pandas_udf(_measured, SCHEMA)("text"))
    kept = ~base & F.coalesce(fits, F.lit(False)) & (m.n_bad_chunks <= share * m.n_chunks)
    return out.select(*[c for c in docs.columns if c not in names], *[m[c].alias(c) for c in added], base.alias("base_failed"), kept.alias("kept"), m.ratio.alias("ratio"), m.n_bad_chunks.alias("n_bad_chunks"))


def fit_bands(docs: DataFrame, labels: DataFrame, tail: float = 0.002, margin: float = 0.02, least: int = 100) -> tuple:
    """Bands from labelled good documents that pass the base rules: the ratios at the tails of each length class, and a margin.

    A row per length class comes to the driver. A class of fewer than `least` documents has three times the margin, one
    of fewer than 20 the band of the class below and three times the margin, the first then any ratio above 0.45.
    Held-out documents take no part.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    rows = screen(docs.where(fold).join(good, "doc_id", "left_semi")).where("NOT base_failed")
    size, edge = F.octet_length("text"), F.lit(EDGES[-1])
    for below in reversed(EDGES):
        edge = F.when(size < below, F.lit(below)).otherwise(edge)
    found = {r.edge: r for r in rows.groupBy(edge.alias("edge")).agg(F.count("*").alias("n"), F.percentile("ratio", F.array(F.lit(tail), F.lit(1 - tail))).alias("at")).collect()}
    out = []
    for below in EDGES:
        r = found.get(below)
        room = margin if r and r.n >= least else 3 * margin
        if r and r.n >= 20:
            out.append((below, round(r.at[0] - room, 3), round(r.at[1] + room, 3)))
        else:
            out.append((below, round(out[-1][1] - room, 3), out[-1][2]) if out else (below, 0.45, 9.0))
    return tuple(out)
