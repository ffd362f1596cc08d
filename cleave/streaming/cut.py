"""The minimum cut of edge streams, kept as state by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from cleave.functions import kernels as K


def stream_cut(updates: DataFrame) -> DataFrame:
    """``graph, seq, cut_value`` over a stream of updates as :func:`cleave.plans.cuts.replay` takes: the state of each ``graph`` is its edges; a row for each batch of updates that reaches it."""
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        d = K.DynamicCut([tuple(x) for x in held])
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for r in rows.itertuples(index=False):
            d.insert(r.src, r.dst, r.delta) if r.delta > 0 else d.delete(r.src, r.dst)
        state.update((json.dumps([(u, v, w) for (u, v), ws in d.lists.items() for w in ws]),))
        yield pd.DataFrame([(key[0], int(rows["seq"].max()), d.value)], columns=["graph", "seq", "cut_value"])

    return updates.groupBy("graph").applyInPandasWithState(run, "graph long, seq long, cut_value long", "edges string", "update", GroupStateTimeout.NoTimeout)
