"""Asking providers for analyses: credentials in turn, two forms of request, and a ledger of replies.

A prompt is asked once however many findings share it. Replies are kept by the hash of their prompt: a task puts each into
the ledger as it arrives, so a task that is repeated after a lost executor, or a scan that is begun again, asks for none
twice. Prompts are dealt to a stated number of tasks, each of which asks one after another: that many calls are in flight
at most.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from itertools import zip_longest
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.report import ANALYSIS, analysis_row, parsed_reply, text_of_reply

Ask = Callable[[str, str], str]


class Refused(Exception):
    """A provider's refusal; `status` is the HTTP status. 429 and 503 pass to the next credential, others end its turn."""

    def __init__(self, status: int):
        super().__init__(str(status))
        self.status = status


def in_turn(*providers: tuple[Ask, list[str]]) -> list[tuple[Ask, str]]:
    """The providers' credentials, one of each provider after the other; blank ones and repeats go."""
    own = [[(ask, c) for c in dict.fromkeys(keys) if c and c.strip()] for ask, keys in providers]
    return [x for turn in zip_longest(*own) for x in turn if x is not None]


def attempts(usable: list[tuple[Ask, str]], passes: int = 5, wait: float = 3.0, rotate: bool = False) -> Callable[[str], str | None]:
    """A function from a prompt to its first reply with a cause and a solution, or null.

    Every credential is asked in turn, in up to `passes` passes with a longer wait before each; one that is rejected (401,
    403) is not asked again. A call that fails in any other way, or a reply that cannot be read, passes to the next. With
    `rotate`, prompts begin at different credentials."""
    usable = list(usable)

    def answer(prompt: str) -> str | None:
        first = zlib.crc32(prompt.encode("utf-8", "replace")) if rotate else 0
        for turn in range(passes):
            if not usable:
                break
            if turn:
                time.sleep(wait * turn)
            at = first % len(usable)
            for pair in usable[at:] + usable[:at]:
                try:
                    reply = pair[0](prompt, pair[1])
                    if parsed_reply(reply) is not None:
                        return reply
                except Refused as e:
                    if e.status in (401, 403):
                        usable.remove(pair)
                except Exception:  # a provider's fault is no fault of the scan
                    continue
        return None

    return answer


def retrying(ask: Ask, credentials: list[str], passes: int = 5, wait: float = 3.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """An analyzer (see report.analyzed) that asks one provider for every finding, without a ledger."""

    def analyzer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = attempts(in_turn((ask, credentials)), passes, wait)
        for frame in frames:
            rows = [analysis_row(i, parsed_reply(answer(p))) for i, p in zip(frame.finding_id, frame.prompt, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANALYSIS.split(", ")])

    return analyzer


def _post(address: str, body: dict, headers: dict[str, str], seconds: float) -> dict:
    request = urllib.request.Request(address, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        raise Refused(e.code) from e


def chat_provider(address: str, model: str, seconds: float = 120, system: str = "") -> Ask:
    """Asks a chat completion endpoint. A message without content is read from the braces in its `reasoning`."""

    def ask(prompt: str, credential: str) -> str:
        said = [{"role": "system", "content": system}] if system else []
        body = {"model": model, "messages": [*said, {"role": "user", "content": prompt}], "response_format": {"type": "json_object"}}
        found = _post(address, body, {"Authorization": f"Bearer {credential}"}, seconds)
        message = found["choices"][0]["message"]
        return text_of_reply(message.get("content")) or text_of_reply(message.get("reasoning"))

    return ask


def parts_provider(address: str, seconds: float = 90, system: str = "") -> Ask:
    """Asks an endpoint that takes contents of parts, with the credential in the address, and gives candidates of parts."""

    def ask(prompt: str, credential: str) -> str:
        body: dict = {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"response_mime_type": "application/json"}}
        if system:
            body["system_instruction"] = {"parts": [{"text": system}]}
        found = _post(f"{address}{'&' if '?' in address else '?'}key={urllib.parse.quote(credential, safe='')}", body, {}, seconds)
        return text_of_reply(found["candidates"][0]["content"]["parts"][0]["text"])

    return ask


class Ledger:
    """Replies by the hash of their prompt, in a folder that driver and executors share.

    `loose` holds a file for each reply, put there by the task that got it; `settled` is a table of those that scans have
    taken over. A file is written under another name and moved, so a reply is there whole or not at all."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self, key: str) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, f"{root}/loose/{key[:2]}/{key}"

    def get(self, key: str) -> str | None:
        store, at = self._at(key)
        if store.get_file_info(at).type != fs.FileType.File:
            return None
        with store.open_input_stream(at) as f:
            return f.read().decode()

    def put(self, key: str, reply: str) -> None:
        store, at = self._at(key)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        part = f"{at}.{uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(reply.encode())
        store.move(part, at)

    def settled(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema("prompt_key string, reply string").parquet(f"{self.path}/settled").dropDuplicates(["prompt_key"])
        except AnalysisException:  # nothing yet
            return spark.createDataFrame([], "prompt_key string, reply string")


def asked_once(findings: DataFrame, answer: Callable[[], Callable[[str], str | None]], ledger: Ledger, in_flight: int = 8) -> DataFrame:
    """The findings (finding_id, prompt) with ANALYSIS rows, as report.analyzed gives them; those without a usable reply are
    unavailable, and are asked again by the next call. `answer` makes a task's function from prompts to replies."""
    spark = findings.sparkSession
    keyed = findings.select("finding_id", "prompt", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt_key"))
    open_ = keyed.groupBy("prompt_key").agg(F.min("prompt").alias("prompt")).join(ledger.settled(spark).select("prompt_key"), "prompt_key", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reply_to = answer()
        for batch in batches:
            for key, prompt in zip(batch.column("prompt_key").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                reply = ledger.get(key)
                if reply is None and (reply := reply_to(prompt or "")) is not None:
                    ledger.put(key, reply)
                if reply is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([reply])], names=["prompt_key", "reply"])

    fresh = open_.repartition(in_flight, "prompt_key").mapInArrow(ask, "prompt_key string, reply string")
    fresh.write.mode("append").parquet(f"{ledger.path}/settled")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [analysis_row(i, parsed_reply(r)) for i, r in zip(frame.finding_id, frame.reply, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANALYSIS.split(", ")])

    return keyed.join(ledger.settled(spark), "prompt_key", "left").select("finding_id", "reply").mapInPandas(parse, ANALYSIS)
