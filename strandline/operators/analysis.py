"""Calls of a model, one for each manifest with all its images, through a client that is passed in.

A client has ``describe(model, prompt, images) -> str`` and is pickled to the executors, so that keys
and addresses stay with it.  A call that fails is a row of its own and stops no other.  A task that
runs again calls again: clients should tell equal requests by ``request_key``.
"""

from __future__ import annotations

import hashlib
import shutil
import subprocess
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prompt with this in it is refused by the stand-in.
REFUSED = "\n[refuse this]"


class Client(Protocol):
    def describe(self, model: str, prompt: str, images: list[str]) -> str: ...


class StandIn:
    """A model's stand-in: its answer is a digest of what it was asked."""

    def describe(self, model: str, prompt: str, images: list[str]) -> str:
        if prompt.endswith(REFUSED):
            raise ValueError("refused")
        return f"{len(images)} images, {hashlib.md5(f'{model}\n{prompt}'.encode()).hexdigest()}"


def run_command(words: list[str], what: str) -> bytes:
    """What a command prints; one that is not there or ends with an error raises RuntimeError."""
    try:
        done = subprocess.run(words, check=False, capture_output=True)
    except FileNotFoundError as error:
        raise RuntimeError(f"{what}: no such command: {words[0]}") from error
    if done.returncode:
        raise RuntimeError(f"{what} ended with {done.returncode}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def locate(command: str | None, name: str) -> str:
    """The command given, else the one of that name on the path."""
    found = command or shutil.which(name)
    if not found:
        raise RuntimeError(f"no command {name} on the path: name one")
    return found


class CommandClient:
    """A model behind a command line: ``words``, then model, prompt and images after their flags."""

    def __init__(self, words: list[str], model: str = "--model", text: str = "--text", image: str = "--image") -> None:
        self.words, self.flags = words, (model, text, image)

    def describe(self, model: str, prompt: str, images: list[str]) -> str:
        m, t, i = self.flags
        return run_command([*self.words, m, model, t, prompt, *(x for path in images for x in (i, path))], "model call").decode().strip()


def request_key() -> Column:
    """What tells equal requests: a digest of model, prompt and images."""
    return F.sha2(F.concat_ws("\n", "model", "prompt_text", F.array_join("images", "\n")), 256)


def outcomes(requests: DataFrame, client: Client) -> DataFrame:
    """``requests`` (model, prompt_text, images, ...) with status ``ok`` or ``failed``, error and
    analysis."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", status string, error string, analysis string"

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for model, prompt, images in zip(batch["model"], batch["prompt_text"], batch["images"], strict=True):
                try:
                    said.append(("ok", None, client.describe(model.as_py(), prompt.as_py(), images.as_py())))
                except Exception as error:  # noqa: BLE001  told in the row
                    said.append(("failed", str(error), None))
            more = [pa.array([x[k] for x in said], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "status", "error", "analysis"])

    return requests.mapInArrow(call, shape)


def require_all(results: DataFrame) -> None:
    """Raise if any outcome, read from where it was written, has failed: n of m."""
    failed, total = results.agg(F.count_if(F.col("status") == "failed"), F.count("*")).first()
    if failed:
        raise RuntimeError(f"{failed}/{total} analyses failed")
