"""Model calls: prompts, cache keys, a cache table, usage and cost.  Without a provider the stages pass their input through."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.sources.tables import materialise

#: Price of a million tokens.
PROMPT_PRICE, COMPLETION_PRICE = 0.75, 4.50
CACHE = "key string, parsed string, prompt_tokens long, completion_tokens long, model string"


class ProviderDisabled(RuntimeError):
    """No provider is configured."""


def render(template: str, variables: Mapping[str, Column]) -> Column:
    """Fill ``<<name>>`` places of the whole template, one variable after another; null values are empty."""
    out = F.lit(template)
    for name, value in variables.items():
        out = F.replace(out, F.lit(f"<<{name}>>"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def cache_key(template: str, model: str, rendered: Column, image_sha: Column | None = None) -> Column:
    parts = [F.lit(hashlib.sha256(template.encode()).hexdigest()), F.lit(model)]
    if image_sha is not None:
        parts += [F.lit("vision"), image_sha]
    return F.sha2(F.concat_ws(":", *parts, rendered).cast("binary"), 256)


def complete(requests: DataFrame, cache: DataFrame, call: Callable[..., tuple[str, int, int]] | None, model: str, retries: int = 2, pause: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Answers for requests (key, prompt, and image for vision) and the new cache rows; equal requests are sent once, cached ones never.

    ``call`` takes the prompt, and the image if there is one, and returns (text, prompt tokens, completion tokens).  An answer to
    a text that is not JSON is asked for once more, an error of the connection ``retries`` times.
    """
    if call is None:
        raise ProviderDisabled("no provider")
    vision = "image" in requests.columns
    asked = ["key", "prompt", "image"] if vision else ["key", "prompt"]
    due = requests.select(*asked).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def ask(*what) -> tuple[str, int, int]:
        for attempt in range(retries + 1):
            try:
                return call(*what)
            except (ConnectionError, TimeoutError):
                if attempt == retries:
                    raise
                time.sleep(pause * (attempt + 1))
        raise AssertionError

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, *what in pdf[asked].itertuples(index=False):
                text, p, c = ask(*what)
                try:
                    json.loads(text)
                except ValueError:
                    if vision:
                        raise
                    text, p2, c2 = ask(*what)
                    json.loads(text)
                    p, c = p + p2, c + c2
                out.append((key, text, p, c, model))
            yield pd.DataFrame(out, columns=["key", "parsed", "prompt_tokens", "completion_tokens", "model"])

    new = due.mapInPandas(run, CACHE)
    return requests.join(cache.unionByName(new), "key", "left"), new


def answered(requests: DataFrame, path: str, call: Callable[..., tuple[str, int, int]], model: str, **how) -> tuple[DataFrame, DataFrame]:
    """Requests with their answers, and the calls (key, cached, tokens), over a cache table at ``path``.

    New answers are appended to the table before they are read, so no model is asked again for them, whatever is lost later.
    """
    spark = requests.sparkSession
    try:
        cache = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        cache = spark.createDataFrame([], CACHE)
    known = materialise(cache.select("key"), "cached-keys")
    _, new = complete(requests, cache, call, model, **how)
    new.write.mode("append").parquet(path)
    whole = spark.read.schema(CACHE).parquet(path).dropDuplicates(["key"])
    rows = requests.join(whole, "key", "left")
    calls = requests.select("key").distinct().join(whole, "key").join(known.withColumn("cached", F.lit(True)).distinct(), "key", "left")
    return rows, calls.select("key", F.coalesce("cached", F.lit(False)).alias("cached"), "prompt_tokens", "completion_tokens")


def data_uri(image: Column, kind: str = "image/png") -> Column:
    """An image as a base64 data URI, as services take it."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(image))


def usage(calls: DataFrame) -> DataFrame:
    """stage, calls, cache_hits and tokens; cached calls cost nothing."""
    paid = ~F.col("cached")
    total = lambda c: F.sum(F.when(paid, F.col(c)).otherwise(F.lit(0))).cast("long")
    return calls.groupBy("stage").agg(F.sum(paid.cast("long")).alias("calls"), F.sum(F.col("cached").cast("long")).alias("cache_hits"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"))


def cost(per_stage: DataFrame) -> DataFrame:
    total = per_stage.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return total.withColumn("cost", F.round(F.col("prompt_tokens") / 1e6 * PROMPT_PRICE + F.col("completion_tokens") / 1e6 * COMPLETION_PRICE, 4))
