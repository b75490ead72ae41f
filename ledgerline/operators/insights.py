"""Texts about establishments from a language model, through a provider that callers supply."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused
from ..schemas import INSIGHTS
from .store import Table, scratch_table

#: Takes prompts, gives a text or None for each. Runs on the executors, a batch at a time.
Provider = Callable[[list[str], "ModelOptions"], list[str | None]]

# The end of every prompt, the default start and the model's parameters.
PROMPT_END = ". Use the results from Google Search and do not infer based on other knowledge."
DEFAULT_PROMPT = "Be succint and tell me what cuisine and dishes this specific London restaurant serve. Do not infer from the name of the restaurant. Instead base your answer on what you find in Google Search. Here is the Restaurant information: "


@dataclass(frozen=True)
class ModelOptions:
    connection: str = "eu.gemini"
    endpoint: str = "gemini-2.0-flash-001"
    temperature: float = 0.2
    max_output_tokens: int = 8192
    top_p: float = 1
    seed: int = 0
    search: bool = True


def needs_insight(df: DataFrame) -> DataFrame:
    return df.where("gemini_insights is null or gemini_insights = ''")


def has_insight(df: DataFrame) -> DataFrame:
    return df.where("gemini_insights is not null and gemini_insights != ''")


def build_prompt(base: str, name: Column, line1: Column, line2: Column, line3: Column, postcode: Column) -> Column:
    """base, the name, ' in ', the address parts with blanks between them, and the fixed end; null counts as ''."""
    name, line1, line2, line3, postcode = (F.coalesce(c.cast("string"), F.lit("")) for c in (name, line1, line2, line3, postcode))
    return F.concat(F.lit(base), name, F.lit(" in "), line1, F.lit(" "), line2, F.lit(" "), line3, F.lit(" "), postcode, F.lit(PROMPT_END))


def offline(prompts: list[str], options: ModelOptions) -> list[str | None]:
    """Stands in for a model: the same text for the same prompt, without a network."""
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


#: Takes an address, headers and a body, gives the status and the answer. Must be picklable; tests supply their own.
Post = Callable[[str, dict, bytes], tuple[int, str]]


def post(url: str, headers: dict, body: bytes) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=120) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


@dataclass(frozen=True)
class Service:
    """A provider that asks a service: one JSON call for each prompt, with a few more tries.

    The call holds prompt, model and the options; `field` names the text in the answer, as a path of keys.
    headers() is called on the executors, so that secrets stay out of plans. A prompt whose calls all fail
    gets no text.
    """

    address: str
    field: tuple[str, ...] = ("text",)
    headers: Callable[[], dict] = dict
    post: Post = post
    tries: int = 3
    pause: float = 1.0

    def __call__(self, prompts: list[str], options: ModelOptions) -> list[str | None]:
        return [self.one(p, options) for p in prompts]

    def one(self, prompt: str, options: ModelOptions) -> str | None:
        call = {"prompt": prompt, "model": options.endpoint, "temperature": options.temperature, "max_output_tokens": options.max_output_tokens}
        call |= {"top_p": options.top_p, "seed": options.seed, "search": options.search}
        headers = {"Content-Type": "application/json", **self.headers()}
        for turn in range(self.tries):
            try:
                status, answer = self.post(self.address, headers, json.dumps(call).encode())
                if status == 200:
                    found = json.loads(answer)
                    for key in self.field:
                        found = found[key]
                    return found if isinstance(found, str) else None
                if status < 500 and status != 429:
                    return None
            except (OSError, ValueError, LookupError, TypeError):
                pass
            if turn + 1 < self.tries:
                time.sleep(self.pause * 2**turn)
        return None


def generate(df: DataFrame, prompt: Column, provider: Provider = offline, options: ModelOptions = ModelOptions()) -> DataFrame:
    """df with gemini_insights from the provider."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(provider(prompts.tolist(), options), dtype=object)

    # Else Spark may move a condition on the text below this step and ask twice.
    return df.withColumn("gemini_insights", answer.asNondeterministic()(prompt))


def generate_once(
    df: DataFrame, prompt: Column, answers: Table, provider: Provider = offline, options: ModelOptions = ModelOptions(), batches: int = 16,
) -> DataFrame:
    """df with gemini_insights, asking each different prompt once, and never again for one whose answer is in `answers`.

    answers: a table of digest (of prompt and options) and text, which this call creates and adds to. New prompts are asked in
    `batches` parts by digest, and each part's answers are committed before the next one goes out: a run that fails
    loses the part it was at, and a second run asks what is missing. Prompts without an answer aren't kept, so they are asked
    again then. Rows with equal prompts get the same text.
    """
    spark = df.sparkSession
    digest, text = unused("digest", df), unused("gemini_insights", df.drop("gemini_insights"))
    asked = df.withColumn(digest, F.sha2(F.concat(F.lit(f"{options}\n"), prompt), 256))
    prompts = asked.select(F.col(digest).alias("digest"), prompt.alias("prompt")).where("prompt is not null").groupBy("digest").agg(F.first("prompt").alias("prompt"))
    if answers.exists():
        prompts = prompts.join(answers.read(), "digest", "left_anti")
    else:
        answers.append(spark.createDataFrame([], "digest string, text string"))
    part = F.pmod(F.xxhash64("digest"), F.lit(batches)).cast("int")
    waiting = scratch_table(spark, "prompts")
    prompts.withColumn("part", part).write.partitionBy("part").parquet(waiting.folder)
    todo = spark.read.schema("digest string, prompt string, part int").parquet(waiting.folder)
    for k in sorted(r.part for r in todo.select("part").distinct().collect()):
        told = generate(todo.where(F.col("part") == k), F.col("prompt"), provider, options)
        answers.append(told.where("gemini_insights is not null").select("digest", F.col("gemini_insights").alias("text")))
    waiting.drop()
    known = answers.read().groupBy(F.col("digest").alias(digest)).agg(F.max("text").alias(text))
    return asked.drop("gemini_insights").join(known, digest, "left").drop(digest)


def insight_pipeline(
    staged: DataFrame, results: Table, base_prompt: str = DEFAULT_PROMPT, provider: Provider = offline, options: ModelOptions = ModelOptions(), answers: Table | None = None,
) -> DataFrame:
    """Generates texts for staged rows that lack one, writes them over the results table, reads those with a text.

    With a table of answers, equal prompts are asked once and a repeated run asks only what is missing (`generate_once`).
    """
    prompt = build_prompt(base_prompt, *(F.col(c) for c in INSIGHTS[1:6]))
    rows = needs_insight(staged)
    answered = generate(rows, prompt, provider, options) if answers is None else generate_once(rows, prompt, answers, provider, options)
    results.overwrite(answered.select("fhrsid", "gemini_insights", *INSIGHTS[1:6]))
    return has_insight(results.read()).select(INSIGHTS)
