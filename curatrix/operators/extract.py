"""Extraction by a caller's client, and what follows from its responses.

The client is any callable from a list of messages (role, content) to a dict with `text` and, if known,
`request_id`, `input_tokens` and `output_tokens`. A request cannot be a column expression, so calls run in Python tasks.
Write the result before using it twice, or keep the answers in a folder; else calls are repeated.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from curatrix.functions import text as T
from curatrix.sources.json_object import located
from curatrix.sources.readers import extraction_rows, extractions_of
from curatrix.sources.shared import stored

USAGE = "struct<request_id:string,input_tokens:int,output_tokens:int>"
SCHEMA = f"pmid string, error string, round1_analysis string, round1_usage {USAGE}, round2_raw string, round2_usage {USAGE}"


class RateLimited(Exception):
    """Raised by a client that is asked to slow down; the call is tried again."""


def with_retry(client: Callable, messages: list[dict], delays=(1, 2, 4), sleep=time.sleep) -> dict | None:
    """The client's answer; None if it is rate-limited after every delay. Other errors pass."""
    for delay in delays:
        try:
            return client(messages)
        except RateLimited:
            sleep(delay)
    return None


def _usage(answer: dict) -> dict:
    number = lambda k: None if answer.get(k) is None else int(answer[k])
    return {"request_id": answer.get("request_id"), "input_tokens": number("input_tokens"), "output_tokens": number("output_tokens")}


ANSWER = "pmid string, round int, asked string, answer struct<text:string,request_id:string,input_tokens:long,output_tokens:long>"


def kept_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """pmid, kept (JSON array) of the answers that earlier runs have left in a folder; None if there is no such folder."""
    try:
        df = spark.read.schema(ANSWER).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)
        return df.groupBy("pmid").agg(F.to_json(F.collect_list(F.struct("round", "asked", "answer"))).alias("kept"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


class Answers:
    """Answers by (document, round), kept in a shared folder as they come: a line for each, in a file of the task attempt that got it.

    An attempt first reads what earlier attempts of its run have left for its part. A line that a lost task has not finished doesn't count.
    """

    def __init__(self, path: str, part: int):
        self.fs, self.root = located(path)
        self.folder = f"{self.root}/part-{part}"
        self.fs.create_dir(self.folder, recursive=True)
        self.known: dict[tuple[str, int], dict] = {}
        for info in self.fs.get_file_info(pa.fs.FileSelector(self.folder)):
            with self.fs.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n")[:-1]:
                    item = json.loads(line)
                    self.known[item["pmid"], item["round"]] = item
        self.out = None

    def get(self, pmid: str, n: int, asked: str, earlier: list[dict], call: Callable[[], dict | None]) -> dict | None:
        """The kept answer to what is asked (earlier: those of other runs), or else the answer of a call, which is then kept unless it is None."""
        for item in [*filter(None, [self.known.get((pmid, n))]), *earlier]:
            if item["round"] == n and item["asked"] == asked:
                return item["answer"]
        answer = call()
        if answer is not None:
            self.out = self.out or self.fs.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}", buffer_size=None)
            self.out.write((json.dumps({"pmid": pmid, "round": n, "asked": asked, "answer": answer}) + "\n").encode())
            self.out.flush()
        return answer

    def close(self) -> None:
        if self.out:
            self.out.close()


def extract(df: DataFrame, client: Callable, first: str, second: str, workers: int | None = None, delays=(1, 2, 4), answers: str | None = None) -> DataFrame:
    """Two rounds for each document (pmid, text); a failure becomes the error of its row, and never fails the job.

    There are as many calls at once as tasks, over all executors: `workers` where a service takes no more, else those of df. With
    `answers`, a shared folder, an answer is kept as soon as it is there, and no task or later run asks for it again: a lost task costs
    the call that it was waiting for. What earlier runs have left is joined to the documents; within a run they are dealt by their id
    to as many parts as there are tasks, and a repeated task reads its part. What was asked is part of an answer's key, so that other
    texts or templates are asked anew.
    """
    own = f"{answers}/{uuid.uuid4().hex}" if answers else None

    def one(pmid: str, text: str | None, kept: Answers | None, earlier: str | None) -> dict:
        row = dict.fromkeys(("error", "round1_analysis", "round1_usage", "round2_raw", "round2_usage")) | {"pmid": pmid}

        def ask(n: int, messages: list[dict]) -> dict | None:
            call = lambda: with_retry(client, messages, delays)
            return kept.get(pmid, n, hashlib.sha256(json.dumps(messages).encode()).hexdigest(), json.loads(earlier or "[]"), call) if kept and pmid is not None else call()

        try:
            messages = [{"role": "user", "content": f"{text or ''}\n\n{first}"}]
            answer = ask(1, messages)
            if answer is None:
                return row | {"error": "Round1_API_Error: rate_limit_exhausted"}
            row |= {"round1_analysis": answer.get("text", ""), "round1_usage": _usage(answer)}
            answer = ask(2, [*messages, {"role": "assistant", "content": answer.get("text", "")}, {"role": "user", "content": second}])
            if answer is None:
                return row | {"error": "Round2_API_Error: rate_limit_exhausted"}
            return row | {"round2_raw": answer.get("text", ""), "round2_usage": _usage(answer)}
        except Exception as e:  # noqa: BLE001  it is the row's result
            return row | {"error": str(e)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Answers(own, TaskContext.get().partitionId()) if own else None
        try:
            for frame in frames:
                yield pd.DataFrame([one(p, t, kept, k) for p, t, k in zip(frame["pmid"], frame["text"], frame["kept"])], columns=["pmid", "error", "round1_analysis", "round1_usage", "round2_raw", "round2_usage"])
        finally:
            if kept:
                kept.close()

    earlier = kept_answers(df.sparkSession, answers) if answers else None
    asked = df.select("pmid", "text")
    asked = asked.withColumn("kept", F.lit(None).cast("string")) if earlier is None else asked.join(earlier, "pmid", "left")
    if answers:
        asked = asked.repartition(workers or df.rdd.getNumPartitions(), "pmid")
    elif workers:
        asked = asked.repartition(workers)
    return asked.mapInPandas(run, SCHEMA)


def parse_json_edges(df: DataFrame, column: str = "round2_raw") -> tuple[DataFrame, DataFrame]:
    """Edges and documents of responses (pmid, error, raw text): text that is no JSON gives the error parse_fail. Each response is parsed once, and its edges are stored."""
    parsed = df.select("pmid", F.nullif("error", F.lit("")).alias("error"), F.try_parse_json(T.clean_json(column)).alias("v"))
    failed = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("v").isNull(), F.lit("parse_fail"))
    return extractions_of(stored(extraction_rows(parsed, failed)))


def postprocess(edges: DataFrame, overrides: DataFrame, official: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with normalised names, and the log of changed names by document. Edges are worked out once, and so is each distinct name."""
    from . import aliases as A

    edges = stored(edges)
    roles = F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.lit(c).alias("role")) for c in ("tf", "target")]))
    known = stored(A.normalize_genes(edges.select(roles.alias("n")).select("n.*"), overrides, official, candidates))
    out = edges
    for column in ("tf", "target"):
        own = known.where(F.col("role") == column)
        out = out.join(own.select(F.col("name").alias(column), F.col("normalized").alias(f"_{column}")), column, "left").withColumn(column, F.coalesce(f"_{column}", column)).drop(f"_{column}")
    changed = A.normalization_log(known.withColumn("_name", F.col("name")), "_name")
    logs = edges.select("pmid", roles.alias("n")).join(changed, (F.col("n.name") == F.col("_name")) & (F.col("n.role") == F.col("type")))
    return out.select(*edges.columns), logs.select("pmid", "original", "normalized", "type", "status", "source", "matched_key")


def token_usage(debug: DataFrame) -> DataFrame:
    """Tokens of both rounds and their sums by document."""
    n = lambda r, k: F.coalesce(F.col(f"round{r}_usage.{k}"), F.lit(0))
    return debug.select("pmid", n(1, "input_tokens").alias("round1_in"), n(1, "output_tokens").alias("round1_out"), n(2, "input_tokens").alias("round2_in"), n(2, "output_tokens").alias("round2_out"), (n(1, "input_tokens") + n(2, "input_tokens")).alias("total_in"), (n(1, "output_tokens") + n(2, "output_tokens")).alias("total_out"))
