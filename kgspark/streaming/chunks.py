"""Token chunks as a stream: think blocks lifted out, the rest handed on as section events.

Chunks come as (stream_id, seq, section, text); a chunk whose text is null ends its stream.
The text since the last event, which is none outside think blocks, is kept as state, in RocksDB, as
lists that are only appended to; give ``idle_ms`` where streams may end without saying so. What one stream brings in one micro-batch
meets in one task, to be put in order; the source limits how much that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.conversation import DONE, FENCES, THINKING

OPEN, CLOSE = "<think>", "</think>"

EVENTS = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("section", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


class Scan:
    """The text of one stream between events. Text is kept back only while a think block is open.

    ``plain`` and ``inside`` hold what this scan has added to the text before the open block and to
    the block; what earlier scans have kept is fetched by ``kept`` (plain, inside), and only when a
    block ends. ``tail`` is the end of the open block, where a closing tag may have begun.
    """

    def __init__(self, is_open: bool = False, tail: str = "", closes: bool = False, section: str | None = None, n: int = 0, kept=lambda: ("", "")):
        self.is_open, self.tail, self.closes, self.section, self.n, self.kept = is_open, tail, closes, section, n, kept
        self.plain, self.inside = "", []
        self.fetched = not is_open  # nothing is kept while no block is open

    def _fetch(self) -> None:
        if not self.fetched:
            plain, inside = self.kept()
            self.plain, self.inside, self.fetched = plain + self.plain, [inside, *self.inside], True

    def feed(self, chunk: str) -> list[tuple]:
        """The events (section, text, kept) a chunk sets free: closed blocks, then the text around them.

        One scan from left to right: outside a block the next opening tag counts, inside it the next
        closing tag, which may lie across chunks. A block that opens after a closing tag of its own
        text is closed where the chunk ends.
        """
        blocks, rest = [], chunk
        while True:
            if self.is_open:
                seen = self.tail + rest
                at = seen.find(CLOSE)
                if at < 0:
                    self.inside.append(rest)
                    self.tail = seen[1 - len(CLOSE) :]
                    break
                self._fetch()
                text = "".join(self.inside) + rest
                blocks.append(text[: len(text) - len(seen) + at])
                rest = seen[at + len(CLOSE) :]
                self.is_open, self.inside, self.tail = False, [], ""
            else:
                at = rest.find(OPEN)
                if at < 0:
                    self.plain += rest
                    break
                self.plain += rest[:at]
                rest = rest[at + len(OPEN) :]
                self.is_open, self.closes = True, CLOSE in self.plain
        if self.is_open and self.closes:
            self._fetch()
            blocks.append("".join(self.inside))
            self.is_open, self.inside, self.tail = False, [], ""
        events = [(THINKING, block.strip(), False) for block in blocks if block.strip()]
        if not self.is_open:
            events += self._text(self.plain)
            self.plain, self.closes = "", False
        return events

    def finish(self) -> list[tuple]:
        """An unclosed block is text in the end; the end marker follows."""
        self._fetch()
        rest = self.plain + OPEN + "".join(self.inside) if self.is_open else self.plain
        self.is_open, self.plain, self.inside, self.tail, self.closes = False, "", [], "", False
        return [*self._text(rest), (self.section, DONE, False)]

    def _text(self, text: str) -> list[tuple]:
        kept = self.section != THINKING and text != DONE and text not in FENCES
        return [(self.section, text, kept)] if text else []


class ChunkFold(StatefulProcessor):
    """``idle_ms``: a stream without chunks for so long is ended.

    The text that an open block keeps back lies in lists that a micro-batch only appends to, so what
    is written grows with the chunks and not with the block.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        fields = [("is_open", T.BooleanType()), ("tail", T.StringType()), ("closes", T.BooleanType()), ("section", T.StringType()), ("n", T.LongType())]
        text = T.StructType([T.StructField("text", T.StringType())])
        ttl = None if self.idle_ms is None else 4 * self.idle_ms  # should a timer get lost
        self.state = handle.getValueState("stream", T.StructType([T.StructField(*field) for field in fields]), ttl)
        self.plain = handle.getListState("plain", text, ttl)
        self.inside = handle.getListState("inside", text, ttl)

    def _kept(self) -> tuple[str, str]:
        return tuple("".join(x[0] for x in state.get()) if state.exists() else "" for state in (self.plain, self.inside))

    def _clear(self) -> None:
        for state in (self.state, self.plain, self.inside):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        scan = Scan(*self.state.get(), kept=self._kept) if self.state.exists() else Scan(kept=self._kept)
        was_open = scan.is_open
        chunks = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        first, events, ended = scan.n, [], False
        for section, text in zip(chunks["section"], chunks["text"]):
            scan.section = section if section is not None else scan.section
            ended = text is None
            events += scan.finish() if ended else scan.feed(text)
        if scan.fetched and was_open:  # the lists have been read: what is kept now begins anew
            self.plain.clear()
            self.inside.clear()
        if ended:
            self._clear()
        else:
            self.state.update((scan.is_open, scan.tail, scan.closes, scan.section, first + len(events)))
            for state, text in ((self.plain, scan.plain), (self.inside, "".join(scan.inside))):
                if scan.is_open and text:
                    state.appendValue((text,))
        self._watch(timerValues, ended)
        yield self._frame(key, first, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.state.exists():
            scan = Scan(*self.state.get(), kept=self._kept)
            events = scan.finish()
            self._clear()
            yield self._frame(key, scan.n, events)

    def close(self) -> None:
        pass

    def _watch(self, timer_values, ended: bool) -> None:
        if self.idle_ms is None:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not ended:
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    @staticmethod
    def _frame(key, n: int, events: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], n + i, *event) for i, event in enumerate(events, 1)]
        return pd.DataFrame(rows, columns=EVENTS.names)


def fold_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Section events of a stream of chunks: (stream_id, n, section, text, kept)."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=ChunkFold(idle_ms),
        outputStructType=EVENTS,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
