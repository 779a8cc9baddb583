"""Requests: work on tables of files with a time limit that can be called off.

A request is a thread whose Spark jobs carry its id as their tag, so stopping it cancels its tasks and no others. Its result is written
to the path that it names, and lost executors cost recomputed tasks, not the request. A request that is called off or runs out of time
leaves an error row for every file of its table (``rows``).
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.functions.limits import ImageError
from lumaspark.sources import files

from . import convert

#: Seconds that a request may take unless it says otherwise; None waits for ever.
TIMEOUT = 60.0

#: What a request may ask for.
KINDS: dict[str, Callable[[DataFrame, convert.Options], DataFrame]] = {
    "detect": lambda table, chosen: files.detect(table),
    "probe": lambda table, chosen: files.metadata(table, chosen.limits),
    "inspect": lambda table, chosen: files.inspect(table, chosen.limits),
    "convert": convert.convert,
    "decode": convert.raw_pixels,
}


class Signal:
    """Calls off every request that listens to it, once."""

    def __init__(self):
        self._off, self._listeners, self._lock = False, [], threading.Lock()

    @property
    def aborted(self) -> bool:
        return self._off

    def abort(self) -> None:
        with self._lock:
            self._off, told = True, self._listeners
            self._listeners = []
        for tell in told:
            tell()

    def check(self) -> None:
        """Raise OPERATION_ABORTED if it has been given."""
        if self._off:
            raise ImageError("OPERATION_ABORTED", "aborted")

    def listen(self, tell: Callable[[], None]) -> None:
        with self._lock:
            if not self._off:
                self._listeners.append(tell)
                return
        tell()


class Request:
    """One piece of work under way. ``result`` waits for it."""

    def __init__(self, spark: SparkSession, path: str, work: Callable[[], DataFrame]):
        self.id, self.path, self.error = f"request-{uuid.uuid4()}", path, None
        self._spark, self._work = spark, work
        self._ended, self._decided = threading.Event(), threading.Lock()
        self._thread = threading.Thread(target=self._run, name=self.id, daemon=True)

    def start(self) -> None:
        self._thread.start()

    def _run(self) -> None:
        context = self._spark.sparkContext
        context.addJobTag(self.id)
        context.setInterruptOnCancel(True)  # tasks that wait end at once
        try:
            self._work().write.parquet(self.path)
            self._end(None)
        except Exception as e:  # the request's own failure; a reason given before stays
            self._end(files.failure(e))

    def _end(self, error: dict | None) -> bool:
        with self._decided:
            if self._ended.is_set():
                return False
            self.error = error
            self._ended.set()
            return True

    def stop(self, code: str, message: str) -> None:
        """End with an error; jobs under way, and those that the thread may still begin, are cancelled."""
        if self._end({"code": code, "message": message}):
            threading.Thread(target=self._cancel, daemon=True).start()

    def _cancel(self) -> None:
        while self._thread.is_alive():
            self._spark.sparkContext.cancelJobsWithTag(self.id)
            self._thread.join(0.2)

    def wait(self) -> None:
        self._ended.wait()

    def result(self) -> DataFrame:
        """The written rows, or the error as an exception."""
        self.wait()
        if self.error is not None:
            raise ImageError(self.error["code"], self.error["message"])
        return self._spark.read.parquet(self.path)

    def rows(self, table: DataFrame) -> DataFrame:
        """The written rows, or ``(file_id, error)`` with this request's error for every file of a table."""
        self.wait()
        if self.error is None:
            return self._spark.read.parquet(self.path)
        return table.select("file_id", F.struct(F.lit(self.error["code"]).alias("code"), F.lit(self.error["message"]).alias("message")).alias("error"))


class Requests:
    """The requests of a session."""

    def __init__(self, spark: SparkSession, timeout: float | None = TIMEOUT):
        self._spark, self._timeout = spark, timeout
        self._sent: dict[str, Request] = {}

    def send(self, message: dict, timeout: float | None = None, signal: Signal | None = None) -> Request:
        """Start ``{"kind", "table", "path", "options"}``; see ``KINDS``. Unknown kinds and options raise INVALID_OPTIONS, a signal given
        before raises OPERATION_ABORTED."""
        if signal is not None:
            signal.check()
        if message.get("kind") not in KINDS:
            raise ImageError("INVALID_OPTIONS", f"request {message.get('kind')!r}")
        chosen, work, table = convert.Options.of(message.get("options")), KINDS[message["kind"]], message["table"]
        made = Request(self._spark, message["path"], lambda: work(table, chosen))
        self._sent = {k: r for k, r in self._sent.items() if not r._ended.is_set()} | {made.id: made}
        made.start()
        limit = self._timeout if timeout is None else timeout
        if limit is not None:
            threading.Thread(target=self._expire, args=(made, limit), daemon=True).start()
        if signal is not None:
            signal.listen(lambda: made.stop("OPERATION_ABORTED", "aborted"))
        return made

    @staticmethod
    def _expire(made: Request, limit: float) -> None:
        if not made._ended.wait(limit):
            made.stop("TIMEOUT", f"{made.id} took more than {limit} seconds")

    def abort(self, request_id: str) -> bool:
        """Call off one request by its id; False if it is not pending."""
        found = self._sent.get(request_id)
        if found is None or found._ended.is_set():
            return False
        found.stop("OPERATION_ABORTED", "aborted")
        return True

    def pending(self) -> list[str]:
        return [k for k, r in self._sent.items() if not r._ended.is_set()]

    def close(self) -> None:
        """Call off whatever is pending, and wait until nothing of it runs."""
        for made in [self._sent[k] for k in self.pending()]:
            self.abort(made.id)
            made._thread.join()


_SHARED: dict[str, Requests] = {}


def shared(spark: SparkSession) -> Requests:
    """The session's own ``Requests``."""
    return _SHARED.setdefault(spark.sparkContext.applicationId, Requests(spark))
