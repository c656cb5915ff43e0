"""Row-local lookup in a bounded table.

A dictionary of a few thousand entries travels with the plan as one folded
literal, so mapping every word of a message to its id needs neither a join nor
the shuffle that would put the words of a message back together.  Entries are
spread over buckets by CRC-32, because a Spark map is searched from front to back.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_lookup(entries: Mapping[str, object], value_type: str) -> Callable[[Column], Column]:
    """A function from a string column to the entry's value, null when absent."""
    n = max(1, len(entries) // 4)
    buckets: list[dict[str, object]] = [{} for _ in range(n)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode("utf-8")) % n][key] = value
    table = F.from_json(
        F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{value_type}>>"
    )

    def look_up(key: Column) -> Column:
        bucket = F.get(table, (F.crc32(key.cast("binary")) % n).cast("int"))
        return F.try_element_at(bucket, key)

    return look_up
