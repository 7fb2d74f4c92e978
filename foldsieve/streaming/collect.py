"""Batched collection of model verdicts: providers, retries, resumable idempotent sinks, logs.

Responses are written before they are parsed, so parsing can be repeated without
asking again. A batch already in the sink is not asked for again; batches run as
tasks, one provider call at a time each.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsieve.functions.verdicts import parse_response
from foldsieve.sources.tables import append_once

BATCH = 10
INNER_RETRIES, OUTER_RETRIES, WAIT_S = 3, 3, 2.0
INSTRUCTION = (
    "You get {n} screenshots. Give a verdict on every one of them, O or X, from the picture alone, "
    "one line each and nothing else:\nfilename: [name] judgment: [O or X]\nThe files are:\n{files}"
)


class Provider(Protocol):
    """One model behind an API; made on the executor that uses it."""

    name: str

    def ask(self, prompt: str, files: list[str], images: list[bytes]) -> str: ...


def prompt_for(files: list[str], size: int = BATCH) -> str:
    """The instruction; it names the full batch size, for a short last batch too."""
    return INSTRUCTION.format(n=size, files="\n".join(files))


def complete(response: str, files: list[str]) -> bool:
    return all(f in (response or "") for f in files)


def ask_until_complete(provider: Provider, files: list[str], images: list[bytes], wait: float = WAIT_S) -> tuple[str, int, str]:
    """(response, calls, error). Up to INNER_RETRIES calls for a response that names every file, the last one counts
    even so; that again up to OUTER_RETRIES times while it does not parse into as many verdicts as files."""
    response, calls, error = "", 0, ""
    for _ in range(OUTER_RETRIES):
        for attempt in range(INNER_RETRIES):
            calls += 1
            try:
                response, error = provider.ask(prompt_for(files), files, images), ""
            except Exception as e:  # a provider may fail in any way; it is logged and tried again
                error = f"{type(e).__name__}: {e}"
            if not error and complete(response, files):
                break
            if attempt + 1 < INNER_RETRIES:
                time.sleep(wait)
        try:
            if len(parse_response(response, files)) == len(files):
                break
        except IndexError as e:
            error = f"IndexError: {e}"
    return response, calls, error


def batched(files: DataFrame, size: int = BATCH, start: int = 1) -> DataFrame:
    """batch, files, images (from 0, by row_idx) of files (row_idx, filename, content), from the batch that holds row `start` on."""
    rows = files.where(F.col("row_idx") >= (start - 1) // size * size).withColumn("batch", F.floor(F.col("row_idx") / size).cast("long"))
    grouped = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("row_idx", "filename", "content"))).alias("e"))
    return grouped.select("batch", F.col("e.filename").alias("files"), F.col("e.content").alias("images"))


def collect_responses(batches: DataFrame, make: dict, wait: float = WAIT_S) -> DataFrame:
    """batch, files, provider, response, calls, error; make: name -> provider factory."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        providers = {name: f() for name, f in make.items()}
        for frame in frames:
            rows = []
            for batch, files, images in zip(frame["batch"], frame["files"], frame["images"]):
                for name, provider in providers.items():
                    rows.append((batch, list(files), name, *ask_until_complete(provider, list(files), list(images), wait)))
            yield pd.DataFrame(rows, columns=["batch", "files", "provider", "response", "calls", "error"])

    return batches.mapInPandas(run, "batch long, files array<string>, provider string, response string, calls int, error string")


def collect_verdicts(spark: SparkSession, files: DataFrame, make: dict, folder: str, size: int = BATCH, start: int = 1, wait: float = WAIT_S) -> DataFrame:
    """Ask for every batch that the sink lacks, then verdicts of all: filename and one column per provider ('' for none)."""
    sink = f"{folder}/responses"
    todo = batched(files, size, start)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        todo = todo.join(spark.read.parquet(sink).select("batch").distinct(), "batch", "left_anti")
    append_once(collect_responses(todo, make, wait), sink, "batch")
    return verdict_table(spark.read.parquet(sink), list(make))


def verdict_table(responses: DataFrame, providers: list[str]) -> DataFrame:
    """filename and the verdict of each provider."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for files, name, text in zip(frame["files"], frame["provider"], frame["response"]):
                try:
                    found = parse_response(text, list(files))
                except IndexError:
                    found = {}
                rows += [(f, name, found.get(f, ("", 0))[0]) for f in files]
            yield pd.DataFrame(rows, columns=["filename", "provider", "verdict"])

    parsed = responses.mapInPandas(run, "filename string, provider string, verdict string")
    return parsed.groupBy("filename").pivot("provider", providers).agg(F.first("verdict")).na.fill("", providers)


def batch_log(responses: DataFrame) -> DataFrame:
    """batch, provider, calls, error, response, missing files."""
    missing = F.filter("files", lambda f: ~F.contains(F.coalesce("response", F.lit("")), f))
    return responses.select("batch", "provider", "calls", "error", "response", missing.alias("missing"))


def collect_stream(spark: SparkSession, source: str, make: dict, folder: str, size: int = BATCH):
    """A streaming query over new image files of a folder: each micro-batch is one idempotent append, known by its number."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)

    def sink(frame: DataFrame, number: int) -> None:
        from foldsieve.plans.samples import contiguous_index

        rows = frame.select(F.substring_index("path", "/", -1).alias("filename"), "content")
        found = collect_responses(batched(contiguous_index(rows, "filename"), size), make)
        key = F.concat(F.lit(f"{number}/"), F.col("batch").cast("string"))
        append_once(found.withColumn("key", key), f"{folder}/responses", "key")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
