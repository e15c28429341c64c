"""Incremental normalization: the chunks of a stream settle sentence by sentence, in the order of their numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import fold_text
from ..operators.sentences import MAX_SENTENCE, cuts, pieces

#: Code points at the end of a pending text whose folds the next chunk may still change: the longest unit and the character after it.
UNSTABLE = 8
#: The next number of a closed stream.
CLOSED = -1
SETTLED = "stream_id long, start long, sent string, pending_from long, missing long"
_STATE = "pending string, at long, seq long, early string, latest long"
_SPACES = "\t\n\x0b\f\r "


def settle(pending: str, at: int, final: bool = False) -> tuple[list[tuple[int, str]], str, int]:
    """The sentences of pending text that more text can't change, what stays pending and where it starts.

    Sentences are folded and cut as tables are. A cut is sure once a character that isn't white space follows the white
    space at it; blank sentences are left out. What is longer than a sentence may be settles in pieces, so no more than a
    sentence and the white space after it stays pending. Pending text stays as it came: a fold may need what comes next.
    """
    text = fold_text(pending)
    done, begin, whole = [], 0, len(text) if final else len(text.rstrip(_SPACES))

    def add(end: int) -> None:
        nonlocal begin
        for piece in pieces(text[begin:end]):
            if sent := piece.rstrip(_SPACES):
                done.append((at + begin, sent))
            begin += len(piece)

    for start, end in cuts(text):
        if not final and end >= whole:
            break
        add(start)
        begin = end
    if final:
        add(len(text))
    while not final and whole - begin > MAX_SENTENCE + UNSTABLE:
        add(begin + len(pieces(text[begin : begin + MAX_SENTENCE + 1])[0]))
    return done, pending[begin:], at + begin


def settled_sentences(chunks: DataFrame, patience: str | None = None) -> DataFrame:
    """stream_id, start, sent, pending_from and missing of a streaming DataFrame of chunks (stream_id, seq, text and, with
    patience, ts).

    Chunks are numbered from 0 in each stream and may come in any order and in any batch, also twice: those that are early wait
    in the state until the ones before them are there, those that were read already are passed over. The state of a stream is
    its pending text, how much has settled, the next number and the chunks that wait. `pending_from` never falls. A chunk with
    null text closes its stream: what is pending settles, and chunks that come after are passed over.

    patience (as `10 minutes`) bounds how long chunks may wait, by the watermark of ts: once it passes a stream's latest ts by
    that, the missing chunks are given up; the waiting ones follow each other in order, all settles and the stream is
    closed; `missing` says how many numbers were never seen. Without patience a stream waits as long as it takes.
    """
    waits = patience is not None
    if waits:
        chunks = chunks.withWatermark("ts", patience)
    rows = chunks.select("stream_id", "seq", "text", *(["ts"] if waits else []), (F.unix_millis("ts") if waits else F.lit(0)).cast("long").alias("ms"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, at, seq, waiting, latest = state.get if state.exists else ("", 0, 0, "{}", 0)
        if seq == CLOSED:
            if state.hasTimedOut:
                state.remove()
            return
        early = {int(k): v for k, v in json.loads(waiting).items()}
        done, closed, missing = [], state.hasTimedOut, 0
        if not closed:
            for batch in batches:
                for n, text, ms in zip(batch["seq"], batch["text"], batch["ms"], strict=True):
                    latest = max(latest, int(ms))
                    if n >= seq:
                        early.setdefault(int(n), None if pd.isna(text) else text)
        ready = []
        while not closed and seq in early:
            text = early.pop(seq)
            seq, closed = seq + 1, text is None
            ready.append(text or "")
        if closed:
            missing = max(early, default=seq - 1) + 1 - seq - len(early)
            ready += [early[n] or "" for n in sorted(early)]
        more, pending, at = settle(pending + "".join(ready), at, closed)
        done += more
        if closed and state.hasTimedOut:
            state.remove()
        else:
            state.update((pending, at, CLOSED if closed else seq, "{}" if closed else json.dumps(early), latest))
            if waits:
                state.setTimeoutTimestamp(max(latest + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"stream_id": key[0], "start": [s for s, _ in done], "sent": [t for _, t in done], "pending_from": at, "missing": missing}).astype({"start": "int64", "sent": "object"})

    timeout = GroupStateTimeout.EventTimeTimeout if waits else GroupStateTimeout.NoTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(run, SETTLED, _STATE, "append", timeout)
