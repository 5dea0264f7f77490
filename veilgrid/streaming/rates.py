"""Streams of progress samples: only rising progress passes, state by job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rising_stream(samples: DataFrame) -> DataFrame:
    """Samples (``job_id, seq, t_ms, progress``) whose progress exceeds what their job has reached; late ones go."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (best,) = state.get if state.exists else (-(1 << 62),)
        rows = pd.concat(batches).sort_values(["t_ms", "seq"])
        before = rows["progress"].cummax().shift(fill_value=best).clip(lower=best)
        state.update((max(best, int(rows["progress"].max())),))
        yield rows[rows["progress"] > before]

    return samples.groupBy("job_id").applyInPandasWithState(keep, "job_id bigint, seq bigint, t_ms bigint, progress bigint", "best bigint", "append", GroupStateTimeout.NoTimeout)


def sliding_eta_stream(samples: DataFrame, total: int, window_ms: int = 10_000) -> DataFrame:
    """Remaining milliseconds of each sample at the rate over the last ten seconds, as ``operators.rates.sliding_eta`` gives them.

    The state of a job is its accepted samples of the last ten seconds; late ones and those without progress go.
    """

    def estimate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, steps = map(list, state.get) if state.exists else ([], [])
        out = []
        for row in pd.concat(batches).sort_values(["t_ms", "seq"]).itertuples():
            if row.progress >= total:
                out.append((key[0], row.seq, None))
            elif row.progress > (steps[-1] if steps else 0):
                times.append(row.t_ms)
                steps.append(row.progress)
                while row.t_ms - times[0] > window_ms:
                    times.pop(0)
                    steps.pop(0)
                took, done = times[-1] - times[0], steps[-1] - steps[0]
                out.append((key[0], row.seq, int((total - row.progress) / (done / took)) if took and done else None))
        state.update((times, steps))
        yield pd.DataFrame(out, columns=["job_id", "seq", "eta_ms"]).astype({"job_id": "int64", "seq": "int64", "eta_ms": "Int64"})

    return samples.groupBy("job_id").applyInPandasWithState(estimate, "job_id bigint, seq bigint, eta_ms bigint", "times array<bigint>, steps array<bigint>", "append", GroupStateTimeout.NoTimeout)
