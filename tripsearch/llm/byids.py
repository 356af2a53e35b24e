"""Keep or drop documents by a table of ids, without moving their texts when the ids are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that may be sent to every task: 16 MB of them.
MOST_SENT = 2_000_000


def semi(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) the ids of ``ids``, a written table with one column.

    The table is counted: up to ``MOST_SENT`` ids are broadcast, more are joined by a shuffle of both sides.
    """
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    return docs.join(F.broadcast(ids) if few else ids, key, how)
