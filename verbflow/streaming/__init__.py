"""Streams: row-wise verbs work on a streaming DataFrame as they are.

``filter``, ``mutate``, ``select``, ``rename`` and ``relocate`` without summaries or window
functions keep a stream a stream; verbs that need a row order or a whole group raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..table import Table


def is_streaming(data: Table | DataFrame) -> bool:
    return (data.df if isinstance(data, Table) else data).isStreaming
