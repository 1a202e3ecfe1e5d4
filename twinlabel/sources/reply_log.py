"""Replies of paid calls, committed a few at a time.

A task that asks a client appends a file to the reply table after every few calls, under a
name made of the job, the task and the number of the batch.  If the task fails, its next
attempt finds the files of the one before and asks only for the rest, so at most one batch of
calls is made twice.  Files appear by a rename, and Spark's readers pass over unfinished ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..schemas import STORED_REPLY
from ..session import qualified

BATCH_CALLS = 16
_SCHEMA = pa.schema([(part.split()[0], pa.string()) for part in STORED_REPLY.split(", ")])


def ask(client: Callable, requests: list[dict]) -> list[tuple[str | None, str | None]]:
    """(reply, error) per request.  A client is a function of one request; if it has ``many``,
    that takes the list and gives replies or exceptions in its order."""

    def said(exc: BaseException) -> tuple[None, str]:
        return None, f"{type(exc).__name__}: {exc}"

    many = getattr(client, "many", None)
    if many is not None:
        try:
            replies = list(many(requests))
            if len(replies) != len(requests):
                raise ValueError(f"{len(replies)} replies to {len(requests)} requests")
        except Exception as exc:  # errors are data
            return [said(exc)] * len(requests)
        return [said(r) if isinstance(r, BaseException) else (r, None) for r in replies]
    out = []
    for request in requests:
        try:
            out.append((client(request), None))
        except Exception as exc:  # errors are data
            out.append(said(exc))
    return out


class Answerer:
    """Asks the clients of the providers, each made once per task."""

    def __init__(self, factories: Mapping[str, Callable], fixed: dict):
        self.factories, self.fixed = factories, fixed
        self.clients: dict[str, Callable] = {}

    def answers(self, requests: list[dict]) -> list[tuple]:
        """(call_key, provider, reply_text, error) per request."""
        out = []
        by_provider = lambda r: str(r["provider"])
        for provider, group in groupby(sorted(requests, key=by_provider), key=by_provider):
            part = list(group)
            try:
                if provider not in self.clients:
                    self.clients[provider] = self.factories[provider]()
                replies = ask(self.clients[provider], [{**r, **self.fixed} for r in part])
            except Exception as exc:  # a client that cannot be made
                replies = [(None, f"{type(exc).__name__}: {exc}")] * len(part)
            out += [(r["call_key"], r["provider"], *reply) for r, reply in zip(part, replies)]
        return out


def opened(spark, path: str) -> str | None:
    """The path as the tasks' own file system takes it; null if they have none for it."""
    uri = re.sub("^file:/(?!/)", "file:///", qualified(spark, path))
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return uri


def committed(store: fs.FileSystem, base: str, task: str) -> list[str]:
    """The files of earlier attempts of a task.  Their numbers have no gap, so the task asks for
    one after the other and does not list the files of all tasks."""
    found: list[str] = []
    while True:
        path = f"{base}/{task}{len(found):06d}.parquet"
        if store.get_file_info([path])[0].type == fs.FileType.NotFound:
            return found
        found.append(path)


def append_replies(calls: DataFrame, factories: Mapping[str, Callable], fixed: dict, path: str,
                   batch_calls: int = BATCH_CALLS, answered: str | None = None) -> DataFrame | None:
    """Ask for every row of ``calls`` and append the replies to the table at ``path``.

    With a folder ``answered`` the same replies are written there as well, a file per task, and
    returned: who goes on with them need not open the many small files of the log.
    """
    uri = opened(calls.sparkSession, path)
    factories = dict(factories)
    if uri is None:
        _append_by_task(calls, factories, fixed, path)
        return calls.sparkSession.read.schema(STORED_REPLY).parquet(path) if answered else None
    job = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        mine = f"{job}-{TaskContext.get().partitionId():06d}-"
        files = committed(store, base, mine)
        done: set[str] = set()
        for file in files:
            before = pq.read_table(file, filesystem=store, schema=_SCHEMA)
            done.update(before["call_key"].to_pylist())
            yield pd.DataFrame(before.to_pydict(), dtype=object)
        answerer, number = Answerer(factories, fixed), len(files)
        for batch in batches:
            waiting = [r for r in batch.to_dict("records") if r["call_key"] not in done]
            replies: list[tuple] = []
            for at in range(0, len(waiting), batch_calls):
                rows = answerer.answers(waiting[at : at + batch_calls])
                table = pa.Table.from_arrays(
                    [pa.array(c, pa.string()) for c in zip(*rows)], schema=_SCHEMA
                )
                name = f"{mine}{number:06d}.parquet"
                pq.write_table(table, f"{base}/.{name}", filesystem=store)
                store.move(f"{base}/.{name}", f"{base}/{name}")
                number += 1
                replies += rows
            yield pd.DataFrame(replies, columns=_SCHEMA.names, dtype=object)

    made = calls.mapInPandas(run, STORED_REPLY)
    if answered is None:
        made.write.format("noop").mode("overwrite").save()
        return None
    made.write.parquet(answered)
    return calls.sparkSession.read.schema(STORED_REPLY).parquet(answered)


def _append_by_task(calls: DataFrame, factories: dict, fixed: dict, path: str) -> None:
    """The same through Spark's own writer, which commits a task at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        answerer = Answerer(factories, fixed)
        for batch in batches:
            rows = answerer.answers(batch.to_dict("records"))
            yield pd.DataFrame(rows, columns=_SCHEMA.names, dtype=object)

    # Version 2 publishes the files of each task as it ends; a reply published twice settles
    # to one when it is read.
    calls.mapInPandas(run, STORED_REPLY).write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).parquet(path)
