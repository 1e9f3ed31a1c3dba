"""Review requests for a batch model run: three per file, as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom import fixed_values as fv


def _prompt(template: tuple[str, str], content: Column, path: Column, language: Column) -> Column:
    intro, tail = template
    before, after = intro.split("{language}")
    file_label, fence = fv.PROMPT_FRAME
    return F.concat(
        F.lit("\n" + before), language, F.lit(after + "\n\n" + file_label), path,
        F.lit("\n\n" + fence), language, F.lit("\n"), content, F.lit("\n" + fence + "\n\n" + tail),
    )


def quality_prompt(content: Column, path: Column, language: Column) -> Column:
    return _prompt(fv.QUALITY_TEMPLATE, content, path, language)


def security_prompt(content: Column, path: Column, language: Column) -> Column:
    return _prompt(fv.SECURITY_TEMPLATE, content, path, language)


def suggestions_prompt(content: Column, path: Column, language: Column) -> Column:
    return _prompt(fv.SUGGESTIONS_TEMPLATE, content, path, language)


def request_table(files: DataFrame) -> DataFrame:
    """Three requests per file: quality, security, suggestions. Narrow: nothing is shuffled."""
    given = (F.col("content"), F.col("path"), F.col("language"))

    def request(operation: str, system: str, prompt: Column) -> Column:
        return F.struct(
            F.lit(operation).alias("operation"), F.lit(system).alias("system"), prompt.alias("prompt")
        )

    requests = F.array(
        request("analyze_code_quality", fv.QUALITY_SYSTEM, quality_prompt(*given)),
        request("analyze_security", fv.SECURITY_SYSTEM, security_prompt(*given)),
        request("generate_suggestions", fv.SUGGESTIONS_SYSTEM, suggestions_prompt(*given)),
    )
    return files.select("file_id", F.explode(requests).alias("r")).select(
        "file_id", "r.*", F.lit(fv.TEMPERATURE).alias("temperature"), F.lit(fv.MAX_TOKENS).alias("max_tokens")
    )


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON object per line, for a batch service."""
    requests.write.mode("errorifexists").json(path)


def run_reviewer(requests: DataFrame, review: Callable[[list[str], list[str]], list[str | None]] | None = None) -> DataFrame:
    """Adds ``answer`` by a user function over batches of (system texts, prompts).

    Without a function every answer is null, which the parsers read as "model
    unavailable". A batch that fails is retried row by row; a row that fails has a null answer.
    """
    if review is None:
        return requests.withColumn("answer", F.lit(None).cast("string"))

    def call(systems: list[str], prompts: list[str]) -> list[str | None]:
        try:
            return list(review(systems, prompts))
        except Exception:
            if len(prompts) == 1:
                return [None]
            return [call([s], [p])[0] for s, p in zip(systems, prompts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["answer"] = call(list(batch["system"]), list(batch["prompt"]))
            yield batch

    schema = requests.withColumn("answer", F.lit(None).cast("string")).schema
    return requests.mapInPandas(run, schema)
