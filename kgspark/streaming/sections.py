"""Messages regrouped as they arrive: consecutive texts of a section become one.

Messages come as (conv_id, seq, role, section, text). Every message but the end markers is handed
on as a piece of its run; what is kept as state is the number, role and section of a conversation's
last run, whatever its length. The rule of a run is that of ``operators.conversation.section_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.conversation import DONE

LAST = [("run", T.LongType()), ("role", T.StringType()), ("section", T.StringType())]
PIECES = T.StructType([T.StructField(*f) for f in [("conv_id", T.LongType()), *LAST, ("seq", T.LongType()), ("text", T.StringType())]])


class SectionPieces(StatefulProcessor):
    def init(self, handle) -> None:
        self.state = handle.getValueState("run", T.StructType([T.StructField(*f) for f in LAST]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        run, *kind = self.state.get() if self.state.exists() else (0, None, None)
        messages = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        pieces = []
        for seq, role, section, text in zip(*(messages[c] for c in ("seq", "role", "section", "text"))):
            if text != DONE:
                run += role != "assistant" or kind != [role, section]
                kind = [role, section]
                pieces.append((key[0], run, role, section, seq, text or ""))
        if pieces:
            self.state.update((run, *kind))
        yield pd.DataFrame(pieces, columns=PIECES.names)

    def close(self) -> None:
        pass


def section_pieces(messages: DataFrame) -> DataFrame:
    """Each message with the run it belongs to: (conv_id, run, role, section, seq, text)."""
    return messages.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=SectionPieces(), outputStructType=PIECES, outputMode="Append", timeMode="None"
    )


def section_texts(pieces: DataFrame) -> DataFrame:
    """The pieces read so far as one text per run: (conv_id, run, role, section, n, text)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return pieces.groupBy("conv_id", "run", "role", "section").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
    )
