"""Answers from a stream of fragments: keyed state, emitted at the end mark or when patience ends."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "held string, last long, done boolean"


def answer_stream(fragments: DataFrame, patience: str = "10 minutes") -> DataFrame:
    """``fragments(answer_id, seq, content, last, at)``, streaming -> ``answer_id, answer, complete``.

    Fragments are numbered from 0; the one with ``last`` is the end mark. An
    answer is emitted once, as soon as the mark and all fragments before it are
    there, whatever order they come in. Of fragments with one number the first
    to arrive counts. Missing content adds nothing. When event time has passed
    an answer's latest fragment by ``patience``, what is there is emitted as
    incomplete. Fragments of an emitted answer are ignored, and so are late
    ones, older than the watermark. A fragment without an id or number belongs
    to no answer.
    """
    timed = fragments.where("answer_id IS NOT NULL AND seq IS NOT NULL").withWatermark("at", patience)
    timed = timed.select("answer_id", F.col("seq").cast("long").alias("seq"), "content", "last", "at")
    out = T.StructType([timed.schema["answer_id"], T.StructField("answer", T.StringType()), T.StructField("complete", T.BooleanType())])

    def text(held: dict[str, str]) -> str:
        return "".join(held[k] for k in sorted(held, key=int))

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, done = ({}, -1, False) if not state.exists else state.get
        held = json.loads(held) if isinstance(held, str) else held
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"answer_id": [key[0]], "answer": [text(held)], "complete": [False]})
            return
        latest = 0
        for batch in batches:
            for seq, content, is_last, at in zip(batch["seq"], batch["content"], batch["last"], batch["at"]):
                latest = max(latest, int(at.timestamp() * 1000))
                if not done:
                    held.setdefault(str(int(seq)), content if isinstance(content, str) else "")
                    if is_last is not None and bool(is_last):
                        last = int(seq) if last < 0 else last
        if not done and last >= 0 and all(str(i) in held for i in range(last + 1)):
            yield pd.DataFrame({"answer_id": [key[0]], "answer": [text({k: v for k, v in held.items() if int(k) <= last})],
                                "complete": [True]})
            held, done = {}, True
        state.update((json.dumps(held), last, done))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    return timed.groupBy("answer_id").applyInPandasWithState(
        collect, out, T._parse_datatype_string(STATE), "append", GroupStateTimeout.EventTimeTimeout)


