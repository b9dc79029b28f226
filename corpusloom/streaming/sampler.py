"""The balancing sampler as a stateful stream: counts per worker live in Spark's state store."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sampling import draw, hashed_uniform

STATE = "keys array<string>, counts array<long>"


def sampled_stream(stream: DataFrame, worker: str, order: str, candidates: str, target: dict[str, float], seed: int = 0) -> DataFrame:
    """worker, order, pick, key drawn for each sample of a stream (worker, order, candidates).

    Within a micro-batch a worker's samples are taken in order; counts carry over between batches.
    Samples without candidates or with one outside the policy are skipped.
    """
    kinds = dict(stream.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = defaultdict(int)
        if state.exists:
            keys, n = state.get
            counts |= dict(zip(keys, n, strict=True))
        rows = []
        for o, keys in sorted((o, list(k) if k is not None else []) for b in batches for o, k in zip(b[order], b[candidates], strict=True)):
            i = draw(counts, keys, target, hashed_uniform(seed, key[0], o))
            if i is not None:
                counts[keys[i]] += 1
                rows.append((key[0], o, i, keys[i]))
        state.update((list(counts), list(counts.values())))
        yield pd.DataFrame(rows, columns=[worker, order, "pick", "key"])

    out = f"{worker} {kinds[worker]}, {order} {kinds[order]}, pick int, key string"
    rows = stream.select(worker, order, candidates).groupBy(worker)
    return rows.applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)
