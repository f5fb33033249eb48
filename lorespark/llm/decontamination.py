"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are lower-cased in A-Z and read as words, runs of digits, letters and non-ASCII characters. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window. The words of every text stream
through the automaton, which tracks the length of the longest match that ends at each word: where it reaches `window`,
the last `window` words occur in an item; whole short items are found along the suffix links. The state of that length
names the items, each window once for an item, so that an automaton grows with the items' words and no further.

Automata are built in tasks, from blocks of about `BLOCK_BYTES`: longer items are cut into pieces that overlap by
`window` - 1 words, which keeps every window, and pieces are dealt to blocks by hash. A pass over the documents takes
`PASS_BLOCKS` automata, the only data that goes to every executor; a larger benchmark takes further passes, with the
documents written in between. Documents are never shuffled.

Defined results: a null or empty text has no words and no hits; items that are null, or hold no words, have no windows;
rows without item_id take no part; rows that share an item_id are one item. Repeated documents are rows of their own.
Other columns stay as they are, but for those of the result's names, which are replaced. An empty benchmark hits nothing.
`longest` is the longest match within an item, in an item of more than `PIECE_WORDS` words within a piece of it.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, prepare

#: Words in lower-cased UTF-8: all bytes of characters beyond ASCII are 0x80 or more.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a piece of an item; bytes of a block of pieces, at COST a word and its own bytes; blocks of a pass.
PIECE_WORDS, BLOCK_BYTES, COST, PASS_BLOCKS = 5000, 16 << 20, 64, 4
RESULT = "n_words long, longest int, spans array<struct<a:int,b:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return WORD_BYTES.findall(text.lower()) if text else []


class Automaton:
    """Every run of words of the given (item, words) pieces, with the items of each window."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary, self.items = window, {}, []
        self.link, self.length, after = [-1], [0], [{}]

        def state(length: int, link: int, moves: dict[int, int]) -> int:
            self.length.append(length)
            self.link.append(link)
            after.append(moves)
            return len(after) - 1

        def split(p: int, q: int, w: int) -> int:
            clone = state(self.length[p] + 1, self.link[q], dict(after[q]))
            while p >= 0 and after[p].get(w) == q:
                after[p][w] = clone
                p = self.link[p]
            self.link[q] = clone
            return clone

        def extend(last: int, w: int) -> int:
            if (q := after[last].get(w)) is not None:
                return q if self.length[q] == self.length[last] + 1 else split(last, q, w)
            new, p = state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in after[p]:
                after[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = after[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else split(p, q, w)
            return new

        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in pieces if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = extend(last, w)
        n = max(1, len(self.vocabulary))
        self.moves = {s * n + w: t for s, each in enumerate(after) for w, t in each.items()}
        self._name(coded)

    def _name(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which items each window's state stands for, and the ways up the suffix links to windows and whole short items."""
        number = {item: k for k, item in enumerate(dict.fromkeys(item for item, _ in coded))}
        self.items, self.at_window, self.at_short = list(number), {}, {}
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: of a state that long: the state of its last `window` words
        self.up = [0] * len(self.length)
        for s in order:
            if self.length[s] >= self.window:
                self.up[s] = s if self.length[self.link[s]] < self.window else self.up[self.link[s]]
        n = max(1, len(self.vocabulary))
        for item, ids in coded:
            s = 0
            for k, w in enumerate(ids, 1):
                s = self.moves[s * n + w]
                if k >= self.window:
                    self.at_window.setdefault(self.up[s], set()).add(number[item])
            if len(ids) < self.window:
                self.at_short.setdefault(s, set()).add((len(ids), number[item]))
        self.at_window = {s: tuple(own) for s, own in self.at_window.items()}
        #: the nearest state up the links, itself included, where a short item ends; 0 for none
        self.short = [0] * len(self.length)
        for s in order:
            self.short[s] = s if s in self.at_short else self.short[self.link[s]]
        self.least = min([self.window, *(k for at in self.at_short.values() for k, _ in at)])

    def read(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The longest match, the words hit as disjoint ranges, and the items of the windows found."""
        known = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        # a match lies between unknown words: runs too short for any window are passed over
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        longest, found, spans, n = 0, set(), [], max(1, len(self.vocabulary))
        moves, link, length, window, windows = self.moves, self.link, self.length, self.window, set()
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start < self.least:
                longest = max(longest, self._reach(known[start:end].tolist()) if longest < end - start else 0)
                continue
            s = matched = 0
            for k, w in enumerate(known[start:end].tolist(), start + 1):
                while (t := moves.get(s * n + w)) is None and s:
                    s = link[s]
                    matched = length[s]
                if t is None:
                    continue
                s, matched = t, matched + 1
                longest = max(longest, matched)
                hit = 0
                if matched >= window:
                    windows.add(self.up[s])
                    hit = window
                u = self.short[s]
                while u:
                    for size, item in self.at_short[u]:
                        if size <= matched:
                            found.add(item)
                            hit = max(hit, size)
                    u = self.short[link[u]]
                if hit:
                    low = k - hit
                    while spans and low <= spans[-1][1]:
                        low = min(low, spans.pop()[0])
                    spans.append((low, k))
        for s in windows:
            found.update(self.at_window[s])
        return longest, spans, {self.items[k] for k in found}

    def _reach(self, ids: list[int]) -> int:
        s = matched = longest = 0
        n = max(1, len(self.vocabulary))
        for w in ids:
            while (t := self.moves.get(s * n + w)) is None and s:
                s = self.link[s]
                matched = self.length[s]
            if t is not None:
                s, matched = t, matched + 1
                longest = max(longest, matched)
        return longest


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that meet or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(spark: SparkSession, benchmark: DataFrame, window: int) -> DataFrame:
    """(block, automaton): a row per block of pieces of items."""
    prepare(spark)

    def cut(batches):
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS - window + 1):
                    if some := words[at : at + PIECE_WORDS]:
                        out.append((item, at, b" ".join(some), len(some)))
            yield pd.DataFrame(out, columns=["item", "at", "words", "n"])

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    pieces = Workspace(spark, "decontamination").table(rows.mapInPandas(cut, "item string, at long, words binary, n long"))
    size = pieces.select(F.sum(F.col("n") * COST + F.octet_length("words"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)

    def build(key, pdf):
        made = Automaton([(item, words.split(b" ")) for item, words in zip(pdf["item"], pdf["words"], strict=True)], window)
        return pd.DataFrame({"block": [key[0]], "automaton": [pickle.dumps(made, 5)]})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "at", "words"), F.lit(max(1, n_blocks))))
    return dealt.groupBy("block").applyInPandas(build, "block long, automaton binary")


def reader(spark: SparkSession, held: list[bytes]):
    """A UDF from texts, as binary, to what these automata find in them."""
    shared = spark.sparkContext.broadcast(held)
    made: list[Automaton] = []

    @F.pandas_udf(RESULT)
    def read(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.extend(pickle.loads(x) for x in shared.value)
        out = []
        for text in texts:
            words = words_of(text)
            each = [a.read(words) for a in made]
            spans = [s for _, own, _ in each for s in own]
            out.append((len(words), max((x for x, _, _ in each), default=0), joined(spans) if len(each) > 1 else spans, sorted(set().union(*(x for _, _, x in each)))))
        return pd.DataFrame(out, columns=["n_words", "longest", "spans", "items"]).assign(spans=lambda d: [[{"a": a, "b": b} for a, b in x] for x in d["spans"]])

    return read


def _together(found: list[Column]) -> Column:
    """What several passes found, as one."""
    if len(found) == 1:
        return found[0]
    every = F.array_sort(F.concat(*[f.spans for f in found]))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.a.alias("a"), F.greatest(last.b, s.b).alias("b"))))
        return F.when((F.size(acc) > 0) & (s.a <= last.b), grown).otherwise(F.concat(acc, F.array(s)))

    items = F.array_sort(F.array_distinct(F.concat(*[f["items"] for f in found])))
    return F.struct(found[0].n_words.alias("n_words"), F.greatest(*[f.longest for f in found]).alias("longest"), F.aggregate(every, none, add).alias("spans"), items.alias("items"))


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with a struct `leak`: n_words, longest (match, in words), spans (disjoint ranges [a, b) of words hit), items."""
    blocks = Workspace(spark, "decontamination").table(automata(spark, benchmark, window))
    n_blocks = blocks.count()
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # own names cannot clash
    out, work = docs.toDF(*names.values()), Workspace(spark, "decontamination")
    ids = sorted(r.block for r in blocks.select("block").collect())  # a number per block
    passes = [ids[k : k + PASS_BLOCKS] for k in range(0, n_blocks, PASS_BLOCKS)] or [[]]
    for k, own in enumerate(passes):
        held = [bytes(r.automaton) for r in blocks.where(F.col("block").isin(own)).collect()] if own else []
        out = out.withColumn(f"_leak{k}", reader(spark, held)(F.col(names["text"]).cast("binary")))
        if k + 1 < len(passes):
            out = work.table(out)
    leak = _together([F.col(f"_leak{k}") for k in range(len(passes))])
    return out.select(*[F.col(own).alias(c) for c, own in names.items() if c != "leak"], leak.alias("leak"))


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of the spans; what stands between two spans stays."""

    def cut(text: bytes, own) -> str:
        at = [m.span() for m in WORD_BYTES.finditer(text.lower())]
        out, end = [], 0
        for s in own:
            out.append(text[end : at[s["a"]][0]])
            end = at[s["b"] - 1][1]
        return b"".join([*out, text[end:]]).decode("utf-8", "replace")

    return pd.Series([cut(t, s) if t is not None else None for t, s in zip(texts, spans, strict=True)], dtype=object)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """docs with text freed of every span of more than `max_words` words, n_words, n_hit, n_items, longest and kept.

    kept is false where the hits cover more than `max_coverage` of a document's words. Spans of at most `max_words` words stay.
    """
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda acc, s: acc + s.b - s.a)
    found = matches(spark, docs, benchmark, window)
    long = F.filter("leak.spans", lambda s: s.b - s.a > max_words)
    cut = F.when(F.size(long) > 0, without(F.when(F.size(long) > 0, F.col("text").cast("binary")), long)).otherwise(F.col("text"))
    new = {"text": cut, "n_words": F.col("leak.n_words"), "n_hit": hit, "n_items": F.size("leak.items").cast("long"), "longest": F.col("leak.longest"), "kept": hit <= F.col("leak.n_words") * max_coverage}
    own = [c for c in docs.columns if c not in new or c == "text"]
    return found.select(*[cut.alias(c) if c == "text" else F.col(c) for c in own], *[v.alias(k) for k, v in new.items() if k != "text"])


def digest(found: DataFrame) -> DataFrame:
    """matches() as counts and digests: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda acc, s: acc + s.b - s.a)
    return found.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("leak.spans") > 0).alias("contaminated"),
    )
