"""Chunking: one text to many rows, in column arithmetic."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import bounded

TRIM = " \t\n\r"


def window_chunks(text: Column, max_tokens: int | Column = 1024) -> Column:
    """An array of the windows of a text, four characters a token, stepping nine tenths of one; blank ones are empty.

    A window that is not the last is cut after the later of its last blank line and last '. ', if that lies beyond
    its half; the step does not follow the cut. Texts that fit stay whole. The text is cut once into steps, and a window
    is a step and the beginning of the next, so that work is linear in the text.
    """
    most = 4 * (F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens).cast("int")
    step, n = F.floor(most * 0.9).cast("int"), F.char_length(text)

    def last(w: Column, sep: str) -> Column:
        return F.char_length(w) - F.char_length(F.substring_index(w, sep, -1)) - len(sep)  # below 0 where there is none

    def cut(w: Column, at: Column, n: Column) -> Column:
        end = F.greatest(last(w, "\n\n"), last(w, ". "))
        return F.btrim(F.when((at * step + most < n) & (end > F.floor(most / 2)), F.left(w, end + 1)).otherwise(w), F.lit(TRIM))

    steps = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))
    # bound to variables, else each step would cut the text anew, and each window count all of its characters
    whole = lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda p, q: F.concat(p, F.left(F.coalesce(q, F.lit("")), most - step)))
    made = F.get(F.transform(F.array(F.struct(steps.alias("x"), n.alias("n"))), lambda b: F.transform(whole(b.x), lambda w, k: cut(w, k, b.n))), 0)
    return F.when(n <= most, F.array(text)).otherwise(made)


def windows(df: DataFrame, text: str = "text", max_tokens: int = 1024) -> DataFrame:
    """df with chunk_index and chunk, a row per window of the text."""
    return df.select("*", F.posexplode(window_chunks(F.col(text), max_tokens)).alias("chunk_index", "chunk")).where("chunk <> ''")


def paragraphs(df: DataFrame, text: str = "text", most: int = 800, carry: int = 160) -> DataFrame:
    """df with chunk_index and chunk: paragraphs packed to `most` characters, a short last one carried over.

    The pack is a fold over the paragraphs of one text, so it stays in its row.
    """
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\n\s*\n"), lambda p: F.btrim(p, F.lit(TRIM))), lambda p: p != "")
    empty = F.array().cast("array<string>")
    zero = F.struct(F.array().cast("array<string>").alias("chunks"), empty.alias("now"), F.lit(0).alias("size"))

    def fold(a: Column, p: Column) -> Column:
        full = (F.size(a.now) > 0) & (a["size"] + F.char_length(p) > most)
        last = F.get(a.now, F.size(a.now) - 1)
        kept = F.when(F.char_length(last) <= carry, F.array(last, p)).otherwise(F.array(p))
        kept_size = F.when(F.char_length(last) <= carry, F.char_length(last)).otherwise(0) + F.char_length(p)
        return F.struct(
            F.when(full, F.concat(a.chunks, F.array(F.array_join(a.now, "\n\n")))).otherwise(a.chunks).alias("chunks"),
            F.when(full, kept).otherwise(F.concat(a.now, F.array(p))).alias("now"),
            F.when(full, kept_size).otherwise(a["size"] + F.char_length(p)).alias("size"),
        )

    done = F.aggregate(parts, zero, fold, lambda a: F.when(F.size(a.now) > 0, F.concat(a.chunks, F.array(F.array_join(a.now, "\n\n")))).otherwise(a.chunks))
    return df.select("*", F.posexplode(done).alias("chunk_index", "chunk"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("section_index", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("section", T.StringType())])))
def _sections(bodies: pd.Series) -> pd.Series:
    out = []
    for body in bodies:
        path, fence, now, found = ["", "", ""], False, [], []
        for line in (body or "").split("\n"):
            fence ^= line.lstrip().startswith("```")
            m = None if fence else re.match(r"(#{1,3})\s+(.+)", line)
            if m:
                if "\n".join(now).strip():
                    found.append((" > ".join(p for p in path if p), "\n".join(now).strip()))
                level = len(m[1])
                path = [*path[: level - 1], m[2].strip(), "", ""][:3]
                now = []
            now.append(line)
        if "\n".join(now).strip():
            found.append((" > ".join(p for p in path if p), "\n".join(now).strip()))
        out.append([{"section_index": k, "heading_path": p, "section": s} for k, (p, s) in enumerate(found)])
    return pd.Series(out, dtype=object)


def sections(df: DataFrame, body: str = "body") -> DataFrame:
    """df with section_index, heading_path and section: split before headings of three levels, fences respected.

    The path holds the nearest heading of each level; a higher heading resets the lower ones. Only the bodies go to Python and
    only their sections come back, so that no text is there once a section.
    """
    bounded(df.sparkSession)
    return df.select("*", F.explode(_sections(body)).alias("_s")).select(*df.columns, "_s.section_index", "_s.heading_path", "_s.section")


def split_recursive(text: str, size: int = 1200, overlap: int = 120, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of up to `size` characters at the coarsest separator that serves, overlapping by up to `overlap`."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    parts = [text[k : k + 1] for k in range(len(text))] if sep == "" else text.split(sep)
    out: list[str] = []
    now: list[str] = []

    def joined() -> str:
        return sep.join(now).strip()

    for part in (p for p in parts if p):
        if len(part) > size and finer:
            if now:
                out.append(joined())
                now = []
            out += split_recursive(part, size, overlap, finer)
            continue
        if now and len(sep.join([*now, part])) > size:
            out.append(joined())
            while now and (len(sep.join(now)) > overlap or len(sep.join([*now, part])) > size):
                now.pop(0)
        now.append(part)
    if now:
        out.append(joined())
    return [x for x in out if x]


def children(df: DataFrame, section: str = "section", title: str = "title", size: int = 1200, overlap: int = 120) -> DataFrame:
    """df of sections with child_index, child, parent (its first 4096 characters) and embed_text (title > path: child)."""
    split = F.pandas_udf(lambda s: s.map(lambda t: split_recursive(t or "", size, overlap)), "array<string>")
    out = df.withColumn("_c", split(section)).select("*", F.posexplode("_c").alias("child_index", "child")).drop("_c")
    prefix = F.when(F.col("heading_path") == "", F.col(title)).otherwise(F.concat_ws(" > ", title, "heading_path"))
    return out.withColumns({"parent": F.left(section, F.lit(4096)), "embed_text": F.concat(prefix, F.lit(": "), F.col("child"))})


def sentences(text: Column) -> Column:
    """Sentences of more than 15 characters; the look-behind split as a marker and a plain one."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: F.char_length(s) > 15)
