"""Per-document work that no document can stop: failing rows go to a dead-letter table, and all others are done.

A task hands the rows of a batch, in order of their hash, to a child process, which answers row by row. An exception is an
answer. Where the child dies (a crash of native code, the kernel's memory killer), what it left unanswered is halved by hash range
and tried again in children of its own, until the row that kills its process stands alone; rows that do well then are kept,
whatever company they failed in. A row that takes longer than ``seconds`` is given up with its child. Neither the task nor
the job fails, so that nothing is computed again, and every other row is worked on once or twice, and by the depth of the
halving at most.

Results and dead letters are written in one pass and read from there.
"""

from __future__ import annotations

import os
import pickle
import select
import signal
import struct
import time
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..kernel import parse
from ..kernel.constructs import Constructs
from ..kernel.tree import Node
from ..plans.schema import NODES
from ..sources.store import stored
from .parse import MAX_DOC_BYTES, ROWS, flat

SECONDS = 600.0
#: Rows that a child process is given.
BATCH = 512
MESSAGE = 500

DEAD = "doc_id bigint, reason string, error string, message string, n_bytes bigint"
Work = Callable[[int | None, bytes], Iterable[tuple]]


class Guarded(NamedTuple):
    """``results``, and the ``dead`` letters: doc_id, reason (exception, memory, crash or timeout), error, message, n_bytes."""

    results: DataFrame
    dead: DataFrame


def _child(rows: list[tuple], work: Work, memory_mb: int | None) -> tuple[int, int]:
    """(process, pipe) of a child that writes a frame for each row."""
    out, into = os.pipe()
    pid = os.fork()
    if pid:
        os.close(into)
        return pid, out
    try:  # from here on in the child, which ends without any of its parent's cleaning up
        os.close(out)
        if memory_mb:
            import resource

            with open("/proc/self/statm") as f:
                now = int(f.read().split()[0]) * resource.getpagesize()
            resource.setrlimit(resource.RLIMIT_AS, (now + (memory_mb << 20),) * 2)
        for row in rows:
            try:
                answer = (list(work(*row)), None)
            except MemoryError as e:
                answer = (None, ("memory", type(e).__name__, str(e)[:MESSAGE]))
            except BaseException as e:  # whatever a row does, the next one has its turn
                answer = (None, ("exception", type(e).__name__, str(e)[:MESSAGE]))
            frame = pickle.dumps(answer, 5)
            frame = struct.pack("<q", len(frame)) + frame
            view = memoryview(frame)
            while view:
                view = view[os.write(into, view) :]
    finally:
        os._exit(0)


def _answers(pid: int, pipe: int, seconds: float) -> Iterator[tuple | None]:
    """The frames of a child; None if one takes too long. Ends where the child does."""
    held = bytearray()
    until = time.monotonic() + seconds
    while True:
        if not select.select([pipe], [], [], max(0.0, until - time.monotonic()))[0]:
            os.kill(pid, signal.SIGKILL)
            yield None
            return
        more = os.read(pipe, 1 << 20)
        if not more:
            return
        held += more
        while len(held) >= 8 and len(held) >= 8 + (size := struct.unpack_from("<q", held)[0]):
            frame = bytes(held[8 : 8 + size])
            del held[: 8 + size]
            yield pickle.loads(frame)
            until = time.monotonic() + seconds


def attempts(rows: list[tuple], work: Work, seconds: float = SECONDS, memory_mb: int | None = None) -> Iterator[tuple[tuple, list | None, tuple | None]]:
    """(row, its results or None, why it is dead or None) for every row, in any order."""
    todo = [rows]
    while todo:
        part = todo.pop()
        pid, pipe = _child(part, work, memory_mb)
        done, late = 0, False
        try:
            for answer in _answers(pid, pipe, seconds):
                if answer is None:
                    late = True
                    yield part[done], None, ("timeout", "TimeoutError", f"no answer in {seconds:g} s")
                else:
                    yield part[done], *answer
                done += 1
        finally:
            os.close(pipe)
            status = os.waitpid(pid, 0)[1]
        left = part[done:]
        if late or not left:
            todo += [left] * bool(left)
        elif len(left) == 1 and len(part) == 1:
            how = f"signal {os.WTERMSIG(status)}" if os.WIFSIGNALED(status) else f"exit {os.WEXITSTATUS(status)}"
            yield left[0], None, ("crash", "ChildProcessError", f"the process ended with {how}")
        elif len(left) == 1:
            todo.append(left)  # alone, to see whether it is this row
        else:
            todo += [left[len(left) // 2 :], left[: len(left) // 2]]


def guarded(docs: DataFrame, work: Work, schema: str, *, id_col: str = "doc_id", text_col: str = "text", seconds: float = SECONDS, memory_mb: int | None = None) -> Guarded:
    """``work(doc_id, source)`` of every row, as rows of ``schema``; what it fails on goes to the dead letters.

    ``memory_mb``: memory that a child may take beyond what its task had. Texts that are null count as empty.
    """
    fields = _parse_datatype_string(schema).fields
    dead = _parse_datatype_string(DEAD).fields
    kinds = to_arrow_schema(_parse_datatype_string(f"{schema}, dead struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in dead)}>"))

    def batch_of(held: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("hash")
            for at in range(0, table.num_rows, BATCH):
                piece = table.slice(at, BATCH)
                held: list[list] = []
                for (doc_id, source), rows, why in attempts(list(zip(piece["doc_id"].to_pylist(), piece["source"].to_pylist(), strict=True)), work, seconds, memory_mb):
                    if why:
                        held.append([None] * len(fields) + [dict(zip((f.name for f in dead), (doc_id, *why, len(source)), strict=True))])
                    else:
                        held += [[*r, None] for r in rows]
                    if len(held) >= ROWS:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("source"))
    both = stored(source.withColumn("hash", F.xxhash64("doc_id", "source")).mapInArrow(run, f"{schema}, dead struct<{DEAD.replace(' bigint', ': bigint').replace(' string', ': string')}>"), "guarded")
    return Guarded(both.where("dead IS NULL").drop("dead"), both.where("dead IS NOT NULL").select("dead.*"))


def node_rows(doc_id: int | None, source: bytes, constructs: Constructs | None = None, inlines: bool = True, max_doc_bytes: int = MAX_DOC_BYTES) -> list[list]:
    """The node table's rows of one document."""
    return flat(doc_id, parse(source, constructs, inlines)[0] if len(source) <= max_doc_bytes else Node("Root", 0, len(source)))


def parse_guarded(docs: DataFrame, constructs: Constructs | None = None, *, inlines: bool = True, max_doc_bytes: int = MAX_DOC_BYTES, **limits) -> Guarded:
    """The nodes of every document that parses, and the dead letters of those that do not."""
    return guarded(docs, lambda doc_id, source: node_rows(doc_id, source, constructs, inlines, max_doc_bytes), NODES, **limits)


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a doc_id of its own for every row, and the one given as source_id.

    Views join on doc_id. Where ids repeat or are null, this gives rows that they can tell apart; the numbers are written with
    the rows, so that no lost executor changes them. ``with_source_id`` leads back.
    """
    return stored(docs.withColumnRenamed(id_col, "source_id").withColumn("doc_id", F.monotonically_increasing_id()), "keyed")


def with_source_id(view: DataFrame, keyed_docs: DataFrame) -> DataFrame:
    return view.join(keyed_docs.select("doc_id", "source_id"), "doc_id")
