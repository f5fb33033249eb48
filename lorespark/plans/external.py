"""Calls to models and embedders, injected: what is deterministic around them stays in columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Ask = Callable[[str], str]


@lru_cache(65536)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def hash_embedder(dim: int = 64) -> Embed:
    """A stand-in for tests: words hashed to signs."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = _hash(w)
                out[k, h % dim] += 1 if h >> 63 else -1
        return out.tolist()

    return embed


def embedded(df: DataFrame, text: str, embed: Embed, batch: int = 32, name: str = "embedding") -> DataFrame:
    """df with the embedding of text, asked for in batches; empty texts get zeroes of the same length, or nothing."""

    def each(texts: pd.Series) -> pd.Series:
        got: list = []
        for k in range(0, len(texts), batch):
            got += embed([t or "" for t in texts.iloc[k : k + batch]])
        return pd.Series(got)

    return df.withColumn(name, F.pandas_udf(each, "array<double>")(text))


def answered(df: DataFrame, prompt: str, attempts: list[tuple[str, Ask]], name: str = "reply") -> DataFrame:
    """df with reply and model: the first of the ordered attempts that does not raise; null if all do."""
    import pyspark.sql.types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType()), T.StructField("model", T.StringType())])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf[prompt]:
                for model, ask in attempts:
                    try:
                        out.append((ask(p), model))
                        break
                    except Exception:  # noqa: BLE001  an attempt may fail in any way; the next one is tried
                        continue
                else:
                    out.append((None, None))
            yield pdf.assign(**{name: [r for r, _ in out], "model": [m for _, m in out]})

    return df.mapInPandas(each, schema)


@dataclass(frozen=True)
class Provider:
    """A source of model calls: its name, whether it serves a model, and how it is asked; what it cannot serve it passes on."""

    name: str
    serves: Callable[[str], bool]
    call: Callable[[str, str], str]

    def ask(self, model: str) -> Ask:
        return lambda prompt: self.call(model, prompt)


def attempts_of(models: list[str], providers: list[Provider]) -> list[tuple[str, Ask]]:
    """For `answered`: each model in order, by the first provider that serves it; models that none serves are left out."""
    found = ((m, next((p for p in providers if p.serves(m)), None)) for m in models)
    return [(m, p.ask(m)) for m, p in found if p is not None]


def attempt_order(tasks: DataFrame, routes: DataFrame, models: DataFrame, reserve: int = 2048) -> DataFrame:
    """(task_id, nth, model): usable models of each task in order: keyed, and with room for the prompt."""
    from pyspark.sql import Window

    fit = tasks.join(routes, "task").join(models, "model").where(F.col("has_key") & (F.col("n_tokens") + reserve <= F.col("context")))
    return fit.select("task_id", F.row_number().over(Window.partitionBy("task_id").orderBy("prio", "model")).alias("nth"), "model")


#: A registry of models: room for tokens, and what a million tokens cost that go in and that come out.
MODELS = "model string, context long, input_per_1m double, output_per_1m double"


def costs(calls: DataFrame, models: DataFrame) -> DataFrame:
    """calls (model, prompt, reply, ...) with input_tokens, output_tokens and cost_usd by the registry; unknown models, and calls without a reply, cost nothing."""
    from ..functions.text import estimate_tokens

    rates = models.select("model", "input_per_1m", "output_per_1m")
    out = calls.withColumns({"input_tokens": estimate_tokens(F.coalesce("prompt", F.lit(""))).cast("long"), "output_tokens": F.when(F.col("reply").isNotNull(), estimate_tokens(F.col("reply"))).otherwise(0).cast("long")}).join(rates, "model", "left")
    cost = F.col("input_tokens") / 1_000_000 * F.col("input_per_1m") + F.col("output_tokens") / 1_000_000 * F.col("output_per_1m")
    return out.withColumn("cost_usd", F.when(F.col("reply").isNotNull(), F.coalesce(cost, F.lit(0.0))).otherwise(0.0)).drop("input_per_1m", "output_per_1m")


def ledger(calls: DataFrame, alert: float = 1.0, by: str = "run_id") -> DataFrame:
    """(by, calls, cost_usd, alert): what each run's calls cost, and whether that reaches the threshold."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd")).withColumn("alert", F.col("cost_usd") >= alert)


def attempted(df: DataFrame, prompt: str, attempts: list[tuple[str, Ask]], models: DataFrame, run_id: str, alert: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """df with reply, model and cost, by the first attempt that does not raise, and the runs' ledger. Costs are columns of the rows, not a tally kept aside."""
    done = costs(answered(df, prompt, attempts).withColumn("prompt", F.col(prompt)), models)
    return done, ledger(done, alert, run_id)
