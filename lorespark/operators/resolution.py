"""Which known entity a name stands for: exact, fuzzy, by embedding, by a judge, or none."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knowledge import find_entities
from .ranking import covering_keys, ratio, token_key

# From which score a name is taken for its best candidate, or is left to the later tiers.
FUZZY_ACCEPT, FUZZY_BORDERLINE, COSINE_ACCEPT, JUDGE_SCORE = 92.0, 70.0, 0.85, 0.75
#: Keys of a block that is searched, and names that search it together.
KNOWN_BLOCK, NAME_BLOCK = 16384, 1024
_BINS, _PAIRS = 64, 128
_SMALL = "abcdefghijklmnopqrstuvwxyz0123456789 "
_BIN = np.array([_SMALL.find(chr(k)) if chr(k) in _SMALL else 37 + k % 27 for k in range(128)])


def _counts(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, counts of characters and counts of character pairs of each key, in bins."""
    length = np.array([len(k) for k in keys], np.int64)
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    bins = np.where(codes < 128, _BIN[np.minimum(codes, 127)], 37 + codes % 27)
    row = np.repeat(np.arange(len(keys)), length)
    single = np.bincount(row * _BINS + bins, minlength=len(keys) * _BINS).reshape(-1, _BINS)
    same = row[1:] == row[:-1]
    pairs = row[:-1][same] * _PAIRS + (bins[:-1][same] * 31 + bins[1:][same] * 17) % _PAIRS
    double = np.bincount(pairs, minlength=len(keys) * _PAIRS).reshape(-1, _PAIRS)
    return length, np.minimum(single, 32767).astype(np.int16), np.minimum(double, 32767).astype(np.int16)


class Catalogue:
    """Keys, shortest first, each with the order it takes among equals; finds a name's best key best-first."""

    def __init__(self, keys: list[str], order: list[tuple]):
        at = sorted(range(len(keys)), key=lambda k: len(keys[k]))
        self.keys, self.order = [keys[k] for k in at], [order[k] for k in at]
        self.length, self.single, self.double = _counts(self.keys)

    def best(self, key: str, least: float) -> tuple[float, tuple] | None:
        """The best ratio from `least` on, with the first key that has it.

        No ratio exceeds its bounds: the length of the shorter key, the characters that both have, and a third of the
        pairs that only one has, as a character put in or left out changes three pairs at most. Keys are scored by
        descending bound, until no bound reaches the best score found.
        """
        n, low = len(key), max(least, 1e-9)
        # a key of m characters has a ratio of 200 min(n, m) / (n + m) at most
        a, b = np.searchsorted(self.length, [n * low / (200 - low) - 1e-6, n * (200 - low) / low + 1e-6])
        if a == b:
            return None
        _, single, double = _counts([key])
        total = self.length[a:b] + n
        bound = 200.0 * np.minimum(self.single[a:b], single).sum(1) / total
        some = np.flatnonzero(bound >= low - 1e-9)
        apart = np.abs(self.double[a:b][some] - double).sum(1)
        bound = np.minimum(bound[some], 100.0 - 100.0 * np.ceil(apart / 3) / total[some])
        found: tuple[float, tuple] | None = None
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < (found[0] if found else low) - 1e-9:
                break
            at = a + some[k]
            score = ratio(key, self.keys[at])
            if score >= low and (found is None or (-score, self.order[at]) < (-found[0], found[1])):
                found = score, self.order[at]
        return found


def best_keys(names: DataFrame, known: DataFrame, least: float = 0.0) -> DataFrame:
    """(name, canonical, entity_id, score): for each of names (name, key) the known (key, canonical, entity_id) of the best ratio.

    Of equal ratios the first by canonical, then id, counts; scores below `least`, or of 0, are left out. Known keys are
    dealt into blocks, and so are names; a pair of blocks meets in a task.
    """
    spark = names.sparkSession
    n_known, n_names = known.count(), names.count()
    k = max(1, -(-n_known // KNOWN_BLOCK))
    n = max(-(-n_names // NAME_BLOCK), min(n_names, int(spark.conf.get("spark.sql.shuffle.partitions")))) or 1
    left = names.select("name", "key", F.pmod(F.xxhash64("name"), F.lit(n)).cast("long").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_k"))
    right = known.select("key", "canonical", F.col("entity_id").cast("long").alias("entity_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_n"), F.pmod(F.xxhash64("key", "canonical", "entity_id"), F.lit(k)).cast("int").alias("_k"))

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            made = Catalogue(y["key"].tolist(), list(zip(y["canonical"], y["entity_id"].astype("int64"), strict=True)))
            for name, key in zip(x["name"], x["key"], strict=True):
                if got := made.best(key, least):
                    out.append((name, *got[1], got[0]))
        return pd.DataFrame(out, columns=["name", "canonical", "entity_id", "score"]).astype({"entity_id": "int64", "score": "float64"})

    found = left.groupBy("_n", "_k").cogroup(right.groupBy("_n", "_k")).applyInPandas(search, "name string, canonical string, entity_id long, score double")
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "canonical", "entity_id")).alias("b"))
    return best.select("name", "b.canonical", "b.entity_id", (-F.col("b.s")).alias("score"))


def known_keys(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, canonical, entity_id): what each entity is called, by sorted tokens; of equal keys the first entity by name, then id."""
    own = entities.select("entity_id", "canonical")
    texts = own.withColumn("text", F.col("canonical")).unionByName(aliases.select("entity_id", F.col("alias").alias("text")).join(own, "entity_id"))
    first = texts.withColumn("key", token_key("text")).where("key <> ''").groupBy("key").agg(F.min(F.struct("canonical", "entity_id")).alias("f"))
    return first.select("key", "f.canonical", "f.entity_id")


def best_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.0) -> DataFrame:
    """(name, canonical, entity_id, score): the best entity over names and aliases, from `least` on, for every name that has one.

    Names of two tokens or more score 100 with what covers them or is covered; of the others none is lost down to `least`.
    """
    known = known_keys(entities, aliases)
    ours = names.select("name", token_key("name").alias("key")).where("key <> ''")
    covered = covering_keys(ours.select("key").distinct(), known).join(known.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min(F.struct("canonical", "entity_id")).alias("f"))
    sure = ours.join(covered, F.col("key") == F.col("a")).select("name", "f.canonical", "f.entity_id", F.lit(100.0).alias("score"))
    return sure.unionByName(best_keys(ours.join(covered, F.col("key") == F.col("a"), "left_anti"), known, least))


def judge_prompt(rows: pd.DataFrame) -> str:
    """Two lines a pair, as the judge is shown them."""
    # The form of a pair.
    pair = "- NAME: {} ({}; {})\n  CANDIDATE: {} ({}; {})"
    none = "no description"
    return "\n".join(pair.format(r.name, r.type, r.description or none, r.canonical, r.c_type, r.c_description or none) for r in rows.itertuples(index=False))


def judged(reply: str) -> dict[str, str | None]:
    """What a judge's reply says: a match or none by lower-cased name; nothing if it is no JSON array."""
    text = re.sub(r"<think>.*?</think>", "", reply or "", flags=re.DOTALL).strip()
    text = re.sub(r"\A```(?:json)?\s*|\s*```\Z", "", text)
    try:
        items = json.loads(text)
    except ValueError:
        return {}
    said = [x for x in items if isinstance(x, dict) and isinstance(x.get("name"), str)] if isinstance(items, list) else []
    return {x["name"].lower(): x.get("match") if isinstance(x.get("match"), str) else None for x in said}


def resolve(
    names: DataFrame, entities: DataFrame, aliases: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, judge: Callable[[str], str] | None = None
) -> DataFrame:
    """(name, entity_id, tier, score) for each of names (name, type, description), names being distinct.

    Tiers: exact, by name or alias; fuzzy, from 92 on; for the borderline, from 70 on, embedding, where the cosine of name
    and candidate reaches 0.85, then llm, where the judge confirms the candidate; else new. embed and judge are called once
    for all borderline names of a batch, the judge for those that embedding left; without either its tier is passed over.
    """
    exact = find_entities(names.select("name"), entities, aliases).withColumnRenamed("entity_id", "_exact")
    best = best_entities(exact.where("_exact IS NULL").select("name"), entities, aliases, FUZZY_BORDERLINE)
    about = entities.select("entity_id", F.col("type").alias("c_type"), F.coalesce("description", F.lit("")).alias("c_description"))
    found = names.join(exact, "name").join(best.join(about, "entity_id"), "name", "left")
    tier = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("score") >= FUZZY_ACCEPT, "fuzzy").when(F.col("score") >= FUZZY_BORDERLINE, "borderline").otherwise("new")
    score = F.when(F.col("_exact").isNotNull(), 1.0).otherwise(F.coalesce(F.col("score") / 100, F.lit(0.0)))
    rows = found.select("name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("_exact", "entity_id").alias("entity_id"), tier.alias("tier"), score.alias("score"), "canonical", "c_type", "c_description")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            left = pdf.index[pdf["tier"] == "borderline"]
            if len(left) and embed is not None:
                some = pdf.loc[left]
                both = np.array(embed([*some["name"], *some["canonical"]]), float)
                a, b = both[: len(left)], both[len(left) :]
                size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
                cosine = np.where(size > 0, (a * b).sum(1) / np.where(size > 0, size, 1), 0.0)
                near = cosine >= COSINE_ACCEPT
                pdf.loc[left[near], "tier"] = "embedding"
                pdf.loc[left[near], "score"] = cosine[near]
                left = left[~near]
            if len(left) and judge is not None:
                some = pdf.loc[left]
                said = judged(judge(judge_prompt(some)))
                yes = np.array([(said.get(n.lower()) or "").lower() == c.lower() for n, c in zip(some["name"], some["canonical"], strict=True)])
                pdf.loc[left[yes], "tier"] = "llm"
                pdf.loc[left[yes], "score"] = JUDGE_SCORE
                left = left[~yes]
            pdf.loc[left, "tier"] = "new"
            new = pdf["tier"] == "new"
            pdf.loc[new, "score"] = 0.0
            pdf["entity_id"] = pdf["entity_id"].astype("Int64").mask(new)
            yield pdf[["name", "entity_id", "tier", "score"]]

    return rows.mapInPandas(settle, "name string, entity_id long, tier string, score double")
