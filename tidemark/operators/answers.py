"""Answers of a model to rows: several requests in flight, paced, tried again, and kept so that none is asked twice."""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows whose answers are kept together.
CHUNK = 32


class Later(Exception):
    """Raised by a provider that is not to be asked before so many seconds."""

    def __init__(self, seconds: float):
        super().__init__(seconds)
        self.seconds = seconds


class Bucket:
    """Lets `per_second` requests through, and up to `burst` at once; safe to share between threads."""

    def __init__(self, per_second: float, burst: int, clock: Callable[[], float] = time.monotonic):
        import threading

        self.per_second, self.burst, self.clock = per_second, burst, clock
        self.tokens, self.at, self.lock = float(burst), clock(), threading.Lock()

    def wait(self) -> float:
        """Takes a token, and returns the seconds until it is there."""
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.per_second)
            self.at = now
            self.tokens -= 1
            return max(0.0, -self.tokens / self.per_second)


def tried(ask: Callable[[str, str], str | None], title: str, text: str, bucket: Bucket, tries: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The answer, or None where all tries fail; each waits twice as long as the one before, and as long as the provider says."""
    for n in range(tries):
        sleep(bucket.wait())
        try:
            return ask(title, text)
        except Later as e:
            wait = e.seconds
        except Exception:
            wait = 0.0
        if n + 1 < tries:
            sleep(max(wait, pause * 2**n * random.uniform(0.5, 1.0)))
    return None


class Kept:
    """Answers in files of a folder that all machines share, one for each chunk of rows, by a digest of what was asked."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.root, recursive=True)

    def _at(self, asked: list[list[str]]) -> str:
        return f"{self.root}/{hashlib.sha256(json.dumps(asked).encode()).hexdigest()}.json"

    def get(self, asked: list[list[str]]) -> list[str | None] | None:
        from pyarrow import fs

        at = self._at(asked)
        if self.system.get_file_info(at).type != fs.FileType.File:
            return None
        with self.system.open_input_stream(at) as f:
            return json.loads(f.readall())

    def put(self, asked: list[list[str]], answers: list[str | None]) -> None:
        """Written beside its place and moved there, so that a file is never half there."""
        at = self._at(asked)
        beside = f"{at}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(beside) as f:
            f.write(json.dumps(answers).encode())
        self.system.move(beside, at)


def with_kept_answers(
    rows: DataFrame, ask: Callable[[str, str], str | None], folder: str, title: str = "title", text: str = "desc", into: str = "answer",
    in_flight: int = 8, per_second: float = 5.0, burst: int = 5, tries: int = 3, pause: float = 0.5,
) -> DataFrame:
    """The rows with a model's answer to title and text, null where all tries fail.

    `ask` runs on the workers, `in_flight` requests of a task at a time and `per_second` of them; it may raise `Later`.
    The answers of CHUNK rows are kept in `folder` before the next are asked for: a task that is lost and runs again,
    or a later run over the same rows, asks nothing that was answered. Failures are kept as well; remove the folder to
    ask again. The pace is that of one task: the provider sees so many times the number of tasks that run.
    """
    at = [rows.columns.index(title), rows.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, bucket = Kept(folder), Bucket(per_second, burst)
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(start, CHUNK)
                    asked = [[a or "", b or ""] for a, b in zip(part.column(at[0]).to_pylist(), part.column(at[1]).to_pylist(), strict=True)]
                    answers = kept.get(asked)
                    if answers is None:
                        answers = list(pool.map(lambda x: tried(ask, *x, bucket, tries, pause), asked))
                        kept.put(asked, answers)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], [*part.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{into}` string")
