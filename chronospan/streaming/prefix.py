"""Scores of overlapping windows, emitted once nothing can change them; and requests served from a stream of frames.

A frame's score is the mean over all windows that hold it, so it is final when the
last of them is whole. ``final_scores`` says so of a table, ``FinalScores`` of a stream: the state of a
key is one window of values and the scores of the windows that still count.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from chronospan.operators.islands import ranked, same_key_join


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def final_scores(df: DataFrame, key: list[str], pos: str, x: str, window: int, stride: int, ended: bool = False, block: int = 1 << 16) -> DataFrame:
    """(key, pos, probability) of the frames that no later one can change: the sigmoid of the mean score of all windows that hold a frame.

    ``pos`` are whole places from 0; those after a missing one don't count. A window of ``window`` frames starts every
    ``stride`` of them and scores the mean of its x. Frames before the first window that isn't whole are final; with
    ``ended`` a last, shorter window is scored and all are.
    """
    places = ranked(df.select(*key, F.col(pos).cast("long").alias("pos"), F.col(x).cast("double").alias("x")), key, F.floor(F.col("pos") / block), ["pos"], "_rank")
    rows = places.where("pos = _rank - 1").drop("_rank")
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    whole = F.greatest(F.floor((F.col("_n") - window) / stride) + 1, F.lit(0))
    limits = n.select(*key, "_n", (whole * stride).alias("_next"))
    first = F.greatest(F.ceil((F.col("pos") - (window - 1)) / stride), F.lit(0))
    dealt = same_key_join(rows, limits, key).withColumn("win", F.explode(F.sequence(first, F.floor(F.col("pos") / stride))))
    last = (F.col("win") * stride == F.col("_next")) if ended else F.lit(False)
    counted = dealt.where((F.col("win") * stride < F.col("_next")) | last)
    scores = counted.groupBy(*key, "win").agg(F.avg("x").alias("score"))
    met = same_key_join(counted.select(*key, "pos", "win", "_next"), scores, [*key, "win"])
    final = met if ended else met.where("pos < _next")
    return final.groupBy(*key, "pos").agg((1 / (1 + F.exp(-F.avg("score")))).alias("probability"))


class FinalScores(StatefulProcessor):
    """``final_scores`` of a stream of (key, pos, x), whatever its batches; frames may come out of order.

    With ``close_after`` seconds, a key that has had no frame for as long, by the watermark, has ended: a timer has its last, shorter
    window scored and the rest emitted. Otherwise the tail is withheld.
    """

    def __init__(self, window: int, stride: int, close_after: float | None = None):
        self.window, self.stride, self.close_after = window, stride, close_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("json", StringType())]))

    def _state(self) -> dict:
        if self.held.exists():
            return json.loads(self.held.get()[0])
        # next: first frame of the next window; tail: values from there on; early: frames beyond a missing one; scores: of the last windows.
        return {"next": 0, "tail": [], "early": {}, "scores": [], "timer": None}

    def _scored(self, s: dict, n: int) -> list[tuple[int, float]]:
        """Score the window of the next n values; frames up to ``stride`` of them are final then, all if it is a short last one."""
        s["scores"] = [*s["scores"], sum(s["tail"][:n]) / n][-math.ceil(self.window / self.stride) :]
        out = []
        for f in range(s["next"], s["next"] + (self.stride if n == self.window else n)):
            # Windows that hold f, of those kept: the last one started at next, the one before a stride earlier.
            holds = [v for back, v in enumerate(reversed(s["scores"])) if s["next"] - back * self.stride + self.window > f]
            out.append((f, sigmoid(sum(holds) / len(holds))))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out, latest = self._state(), [], None
        for pdf in rows:
            for p, x in zip(pdf["pos"].tolist(), pdf["x"].tolist()):
                if p >= s["next"] + len(s["tail"]):
                    s["early"].setdefault(str(p), x)
            if self.close_after is not None:
                latest = max(filter(None, [latest, int(pdf["ts"].max().timestamp() * 1000)]))
        while (p := str(s["next"] + len(s["tail"]))) in s["early"]:
            s["tail"].append(s["early"].pop(p))
            if len(s["tail"]) == self.window:
                out += self._scored(s, self.window)
                s["next"] += self.stride
                s["tail"] = s["tail"][self.stride :]
        if latest is not None:
            due = latest + int(self.close_after * 1000)
            if s["timer"] is None or due > s["timer"]:
                if s["timer"] is not None:
                    self.handle.deleteTimer(s["timer"])
                self.handle.registerTimer(due)
                s["timer"] = due
        self.held.update((json.dumps(s),))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._state()
        out = self._scored(s, len(s["tail"])) if s["tail"] else []
        self.held.clear()
        if out:
            yield self._rows(key, out)

    def _rows(self, key, out: list[tuple[int, float]]) -> pd.DataFrame:
        # Keys as plain objects: Spark takes no chunked arrays, which strings may be.
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "pos": [p for p, _ in out], "probability": [v for _, v in out]})

    def close(self) -> None:
        pass


#: Keeps state on disk and logs changes; timers and value state need it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def final_scores_stream(stream: DataFrame, key: str, pos: str, x: str, window: int, stride: int, ts: str | None = None, late: str = "0 seconds", close_after: float | None = None) -> DataFrame:
    """(key, pos, probability) of a stream, each frame once, when it is final. The session's state store must be ``STATE_STORE``."""
    rows = stream.select(F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(x).cast("double").alias("x"), *([F.col(ts).alias("ts")] if ts else []))
    if close_after is not None:
        rows = rows.withWatermark("ts", late)
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("pos", LongType()), StructField("probability", DoubleType())])
    processor = FinalScores(window, stride, close_after)
    out = rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime" if close_after is not None else "None")
    return out.withColumnRenamed("key", key)


def served(requests: DataFrame, frames: DataFrame, key: str, id_: str, start: str, end: str, t: str, longest: str, late: str) -> DataFrame:
    """(key, id, start, end, t) of each request and every frame of its key from ``start`` to before ``end``; one row with null t if there is none.

    Of streams, a request waits in state till the frames' watermark, ``late`` behind the newest, has passed
    ``longest`` after its start, the longest that a request may be; then it goes, and without a frame it is
    unavailable. Frames wait as long for requests. Of tables, the same rows.
    """
    asked = requests.select(F.col(key), F.col(id_), F.col(start).alias("start"), F.col(end).alias("end")).withWatermark("start", late)
    seen = frames.select(F.col(key).alias("_key"), F.col(t).alias("t")).withWatermark("t", late)
    within = (F.col(key) == F.col("_key")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))
    bounded: Column = F.col("t") <= F.col("start") + F.expr(f"INTERVAL {longest}")
    return asked.join(seen, within & bounded, "left_outer").select(key, id_, "start", "end", "t")
