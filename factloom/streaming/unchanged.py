"""Work that hasn't changed is skipped, over time: a stream's keys with the last fingerprint of each as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed(planned: DataFrame, key: str = "module", fingerprint: str = "fingerprint", order: str = "planned_at") -> DataFrame:
    """(key, fingerprint, previous) of planned work whose fingerprint isn't the last one done for its key.

    Rows of one batch count in their order; of equal ones in a row the first is work
    and the others aren't. The state is one fingerprint a key. A batch that is
    replayed finds the state that was there before it, so that it says the same.
    A NULL fingerprint is a change always.
    """
    kind = planned.schema[key].dataType.simpleString()

    def work(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for value in rows[fingerprint].tolist():
            if value is None or value != last:
                out.append((name[0], value, last))
            last = value
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, fingerprint, "previous"])

    some = planned.select(key, fingerprint, order)
    return some.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, {fingerprint} string, previous string", "last string", "append", GroupStateTimeout.NoTimeout)
