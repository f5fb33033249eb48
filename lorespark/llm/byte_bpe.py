"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks of `chunk` code points that overlap, each pre-tokenised by itself; a match that ends before
its chunk does is what the whole text has there, once the scan runs in step with it. Neighbours are stitched at the
first pre-token boundary that both have in their overlap, from where they must agree, as the pattern looks forward only.
The stitched text is cut at such boundaries into pieces of about `chunk` code points, each encoded by itself. Where an overlap
has no common boundary, the scan goes on from the last sure one. Stitching looks at overlaps alone and is linear in
the boundaries. Decoding concatenates the bytes of the ids.

Chunks and pieces of a text of up to `far` code points stay in the task of its row. Those of a longer one, by the same
steps, are rows of their own, pre-tokenised and encoded wherever they land; the ids of a text meet again to be hashed in
order. Such rows are written once with a number, so that a lost executor cannot renumber them.

Defined results: a null text is the empty one: no ids. Equal texts get equal ids; rows may repeat; further columns
stay as they are. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, prepare

CHUNK, OVERLAP = 2_048, 256
#: Code points from which on a text's chunks are dealt out, and chunks that then make a row.
FAR, DEALT = 1 << 20, 16
ROWS = 256
#: Chunks or pieces of a text that a task holds at once.
AT_ONCE = 64
RESULT = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(maxsize=2)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def boundaries(chunk: str, pattern: str, last: bool) -> list[int]:
    """Ends of the matches that hold whatever follows the chunk."""
    return [m.end() for m in _pattern(pattern).finditer(chunk) if last or m.end() < len(chunk)]


def stitch(starts: list[int], ends: list[np.ndarray], text: str, pattern: str, limits: list[int]) -> np.ndarray:
    """Boundaries of the whole text from those of its chunks (positions in the text); limits: where the chunks end.

    Each pair of neighbours is stitched by their overlap alone; what lies before it is never looked at again.
    """
    out, now = [np.zeros(1, np.int64)], np.asarray(ends[0], np.int64)
    for at, own, limit in zip(starts[1:], ends[1:], limits[1:], strict=True):
        own = np.asarray(own, np.int64)
        low = int(np.searchsorted(now, at))
        known = np.concatenate(([at], own)) if not len(own) or own[0] > at else own
        both = np.intersect1d(now[low:], known[: int(np.searchsorted(known, now[-1], "right"))] if len(now) else known[:0], assume_unique=True)
        meet = int(both[0]) if len(both) else None
        if meet is None:  # out of step over the whole overlap: scan on from the last sure boundary
            p = int(now[-1]) if len(now) else int(out[-1][-1])
            more, sought, last = [], set(known[int(np.searchsorted(known, p)) :].tolist()), limit == len(text)
            while p < limit:
                m = _pattern(pattern).match(text, p, limit)
                if m is None or (m.end() == limit and not last):
                    break
                p = m.end()
                more.append(p)
                if p in sought:
                    meet = p
                    break
            now = np.concatenate((now, np.array(more, np.int64)))
            if meet is None:
                continue
        out.append(now[: int(np.searchsorted(now, meet, "right"))])
        now = own[int(np.searchsorted(own, meet, "right")) :]
    return np.concatenate([*out, now])


@functools.lru_cache(maxsize=1 << 16)
def _kind(char: str) -> str:
    """L, P and so on, where all versions of the Unicode tables agree; else empty."""
    now = unicodedata.category(char)
    return now[0] if char.isascii() or now == unicodedata.ucd_3_2_0.category(char) else ""


def _sure(text: str, p: int) -> bool:
    """A boundary that no version of the Unicode tables moves: a space between others, or a sign after a letter."""
    if not 0 < p < len(text) - 1:
        return False
    before, here, after = _kind(text[p - 1]), _kind(text[p]), _kind(text[p + 1])
    if text[p] == " ":
        return before in ("L", "N", "P", "S") and after in ("L", "N", "P", "S")
    return before == "L" and here in ("P", "S") and text[p] != "'"


def cuts_of(bounds: np.ndarray, text: str, chunk: int) -> list[int]:
    """Where the text is cut into pieces: at sure boundaries, `chunk` code points apart at least."""
    cuts = [0]
    for p in bounds.tolist():
        if p - cuts[-1] >= chunk and _sure(text, p):
            cuts.append(p)
    return [*cuts, len(text)]


def pieces_of(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """A text cut into pieces that are encoded by themselves, by way of overlapping chunks."""
    starts = list(range(0, max(1, len(text)), chunk))
    if len(starts) == 1:  # a chunk without a neighbour
        return [text]
    limits = [min(len(text), at + chunk + overlap) for at in starts]
    ends = [np.array(boundaries(text[a:b], pattern, b == len(text)), np.int64) + a for a, b in zip(starts, limits, strict=True)]
    cuts = cuts_of(stitch(starts, ends, text, pattern, limits), text, chunk)
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _result(parts: list[list[int]], codec: tiktoken.Encoding, with_ids: bool) -> tuple:
    ids, plain, held = hashlib.sha256(), hashlib.sha256(), []
    for part in parts:
        held.append(np.array(part, "<u4"))
        ids.update(held[-1].tobytes())
        plain.update(codec.decode_bytes(part))
    # four bytes an id: a batch of lists of Python integers would take ten times that
    every = np.concatenate(held).astype(np.int32) if held else np.empty(0, np.int32)
    return len(every), every if with_ids else None, ids.hexdigest(), plain.hexdigest()


def _packed(found: list[tuple], with_ids: bool) -> pa.StructArray:
    """Results as an Arrow column; ids go in as whole arrays, never as Python integers."""
    n = pa.array([r[0] for r in found], pa.int64())
    if with_ids:
        ends = np.concatenate([[0], np.cumsum([r[0] for r in found])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *(r[1] for r in found)])))
    else:
        ids = pa.nulls(len(found), pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([n, ids, pa.array([r[2] for r in found], pa.string()), pa.array([r[3] for r in found], pa.string())], ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP, far: int = FAR) -> DataFrame:
    """docs with `bpe`: n_tokens, ids (null unless with_ids), ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    work = Workspace(spark, "byte-bpe")
    with open(ranks_path, "rb") as f:  # a vocabulary file of the driver; under a megabyte
        ranks = spark.sparkContext.broadcast(f.read())

    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "bpe"), T.StructField("bpe", T.StructType.fromDDL(RESULT))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # few rows at a time go back: ids outweigh the text
                part = batch.slice(at, ROWS)
                found = [_result([codec.encode_ordinary(p) for p in pieces_of(t or "", pattern, chunk, overlap)], codec, with_ids) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in schema.names[:-1]), _packed(found, with_ids)], names=schema.names)

    docs = docs.select(*schema.names[:-1])
    size = F.char_length(F.coalesce("text", F.lit("")))
    short = docs.where(size <= far).mapInArrow(whole, schema)
    # own names cannot clash
    names = {c: c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)}
    long = work.table(docs.where(size > far).toDF(*names.values()).withColumn("_row", F.monotonically_increasing_id()))
    wide = chunk * DEALT  # a row's share of a long text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, text in zip(pdf["_row"], pdf["text"], strict=True):
                for low in range(0, len(text), wide * AT_ONCE):
                    at = list(range(low, min(len(text), low + wide * AT_ONCE), wide))
                    yield pd.DataFrame({"_row": row, "_k": [k // wide for k in at], "_at": at, "_size": len(text), "_part": [text[k : k + wide + overlap] for k in at]})

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = zip(pdf["_at"], pdf["_size"], pdf["_part"], strict=True)
            ends = [np.array(boundaries(part, pattern, at + len(part) >= n), np.int64) + at for at, n, part in spans]
            yield pdf.assign(_ends=[x.tobytes() for x in ends])

    parts = long.select("_row", "text").mapInPandas(cut, "_row long, _k int, _at long, _size long, _part string")
    parts = parts.repartition("_row", "_k").mapInPandas(scanned, "_row long, _k int, _at long, _size long, _part string, _ends binary")

    def stitched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        text = "".join(part[:wide] for part in pdf["_part"])
        at = pdf["_at"].tolist()
        limits = [a + len(p) for a, p in zip(at, pdf["_part"], strict=True)]
        cuts = cuts_of(stitch(at, [np.frombuffer(x, np.int64) for x in pdf["_ends"]], text, pattern, limits), text, wide)
        return pd.DataFrame({"_row": pdf["_row"].iloc[0], "_k": range(len(cuts) - 1), "_piece": [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]})

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks.value, pattern)
        for pdf in batches:
            for at in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[at : at + AT_ONCE]
                yield pd.DataFrame({"_row": part["_row"], "_k": part["_k"], "_ids": [np.array(codec.encode_ordinary(t), "<u4").tobytes() for t in part["_piece"]]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = [np.frombuffer(x, "<u4").tolist() for x in pdf.sort_values("_k")["_ids"]]
        return pd.DataFrame([(pdf["_row"].iloc[0], *_result(pieces, _codec(ranks.value, pattern), with_ids))], columns=["_row", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    pieces = parts.groupBy("_row").applyInPandas(stitched, "_row long, _k int, _piece string")
    ids = pieces.repartition("_row", "_k").mapInPandas(encoded, "_row long, _k int, _ids binary")
    found = ids.groupBy("_row").applyInPandas(joined, f"_row long, {RESULT}")
    found = found.select("_row", F.struct("n_tokens", "ids", "ids_sha256", "decoded_sha256").alias("bpe"))
    far_off = long.join(found, "_row")
    return short.unionByName(far_off.select(*[F.col(own).alias(c) for c, own in names.items()], "bpe"))


def decode(spark: SparkSession, ids: DataFrame, ranks_path: str, pattern: str, column: str = "ids") -> DataFrame:
    """ids with `bytes`: the bytes of each id, in turn."""
    prepare(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def each(lists: pd.Series) -> pd.Series:
        codec = _codec(ranks.value, pattern)
        return pd.Series([b"" if x is None else codec.decode_bytes(list(x)) for x in lists])

    return ids.withColumn("bytes", F.pandas_udf(each, "binary")(column))
