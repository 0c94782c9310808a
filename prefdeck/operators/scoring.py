"""Running user-supplied scorers and judges over a cluster."""

from __future__ import annotations

import sys
import time
import types
import uuid
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A scorer is a Column, or a factory that builds its state (a model) once per worker process and
# returns a function from a batch of rows to one reward per row. A judge factory does the same for
# raw text.
ScoreFactory = Callable[[], Callable[[pd.DataFrame], pd.Series]]
JudgeFactory = Callable[[], Callable[[pd.DataFrame], pd.Series]]

# States that one worker process keeps at a time; a further one puts out the longest unused.
MOST_STATES = 2
RAISE, NULL = "raise", "null"


@dataclass(frozen=True)
class Calls:
    """How a task calls a scorer or judge.

    ``in_flight``: batches under way at the same time in a task (threads, for calls that wait for a
    server). Results keep the order of the rows, and no more batches than these are held. A batch
    that raises is tried again row by row, each row up to ``retries`` times more after a pause that
    doubles; so one bad row costs its batch nothing. ``on_error``: a row that still fails raises, or
    has a NULL result.
    """

    in_flight: int = 1
    retries: int = 2
    pause: float = 0.5
    on_error: str = RAISE

    def __post_init__(self) -> None:
        if self.in_flight < 1 or self.retries < 0 or self.on_error not in (RAISE, NULL):
            raise ValueError(f"impossible calls: {self}")


def worker_state(key: str, make: Callable[[], Any], most: int = MOST_STATES) -> Any:
    """What ``make`` builds, once per worker process and ``key``.

    Held in a module that belongs to the process, not in the pickled function, which every task
    unpickles anew.
    """
    module = sys.modules.setdefault("_prefdeck_states", types.ModuleType("_prefdeck_states"))
    held = module.__dict__.setdefault("held", OrderedDict())
    if key not in held:
        while len(held) >= most:
            held.popitem(last=False)
        held[key] = make()
    held.move_to_end(key)
    return held[key]


def repartition_for_calls(df: DataFrame, waves: int = 4, partitions: int | None = None) -> DataFrame:
    """Even partitions, ``waves`` for each task slot of the session, so that slow calls overlap on all
    slots and a lost task repeats little. Nothing is counted, and the number does not grow with the
    rows; ``partitions`` states it instead."""
    n = partitions or waves * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, n))


def _one_result(call: Callable, row: pd.DataFrame, calls: Calls) -> Any:
    for attempt in range(calls.retries + 1):
        try:
            return list(call(row))[0]
        except Exception:
            if attempt == calls.retries:
                if calls.on_error == NULL:
                    return None
                raise
            time.sleep(calls.pause * 2**attempt)


def _results(call: Callable, part: pd.DataFrame, calls: Calls) -> list:
    try:
        found = list(call(part))
    except Exception:
        return [_one_result(call, part.iloc[i : i + 1], calls) for i in range(len(part))]
    if len(found) != len(part):
        raise ValueError(f"{len(found)} results for {len(part)} rows")
    return found


def run_calls(
    call: Callable, frames: Iterator[pd.DataFrame], batch_size: int | None, calls: Calls
) -> Iterator[tuple[pd.DataFrame, list]]:
    """Batches with their results, in order, with at most ``calls.in_flight`` batches under way."""
    parts = (
        frame.iloc[start : start + (batch_size or max(len(frame), 1))]
        for frame in frames
        for start in range(0, len(frame), batch_size or max(len(frame), 1))
    )
    if calls.in_flight == 1:
        for part in parts:
            yield part, _results(call, part, calls)
        return
    with ThreadPoolExecutor(calls.in_flight) as pool:
        window: deque = deque()
        for part in parts:
            window.append((part, pool.submit(_results, call, part, calls)))
            if len(window) == calls.in_flight:
                done, future = window.popleft()
                yield done, future.result()
        while window:
            done, future = window.popleft()
            yield done, future.result()


def map_batches(
    df: DataFrame,
    column: str,
    kind: T.DataType,
    factory: Callable,
    batch_size: int | None,
    keep: Sequence[str] | None,
    state: str | None,
    profile: ResourceProfile | None,
    calls: Calls | None,
) -> DataFrame:
    """The columns ``keep`` and, as ``column``, what the state that ``factory`` builds answers per row."""
    kept = df.columns if keep is None else list(keep)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(column, kind)])
    name, how = state or uuid.uuid4().hex, calls or Calls()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None

        def lazily(part: pd.DataFrame) -> Any:
            return call(part)

        for frame in frames:  # a task without rows needs no model
            if len(frame):
                call = worker_state(name, factory)
                for part, found in run_calls(lazily, _chained(frame, frames), batch_size, how):
                    yield part[kept].assign(**{column: pd.Series(found, index=part.index, dtype=object)})

    return df.mapInPandas(run, schema, profile=profile)


def _chained(first: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield first
    yield from rest


def score_responses(
    samples: DataFrame,
    scorer: Column | ScoreFactory,
    batch_size: int | None = None,
    keep: Sequence[str] | None = None,
    state: str | None = None,
    profile: ResourceProfile | None = None,
    calls: Calls | None = None,
) -> DataFrame:
    """Attach ``reward`` to each (input, output) row; ``keep`` names the columns that come back with
    it (all by default). Texts need not come back from Python.

    A factory is built once per worker process, for this call or for all with the same ``state``
    name. ``profile`` asks for executors of a kind (GPUs) for these tasks alone. ``calls``: see
    :class:`Calls`.
    """
    if isinstance(scorer, Column):
        return samples.select(*(samples.columns if keep is None else keep), scorer.cast("double").alias("reward"))
    return map_batches(samples, "reward", T.DoubleType(), scorer, batch_size, keep, state, profile, calls)


def judge_responses(
    pairs: DataFrame,
    judge: Column | JudgeFactory,
    batch_size: int = 64,
    keep: Sequence[str] | None = None,
    state: str | None = None,
    profile: ResourceProfile | None = None,
    calls: Calls | None = None,
) -> DataFrame:
    """Attach the raw ``judge_text``; always a column, also for a batch of one row. The others as in
    :func:`score_responses`."""
    if isinstance(judge, Column):
        return pairs.select(*(pairs.columns if keep is None else keep), judge.cast("string").alias("judge_text"))
    return map_batches(pairs, "judge_text", T.StringType(), judge, batch_size, keep, state, profile, calls)


def scores_to_samples(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach precomputed rewards by id; a sample without one has NULL."""
    key = ["origin", "input_id", "output_id"]
    return samples.join(scores.select(*key, "reward"), key, "left")


def missing_scores(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("reward").isNull())
