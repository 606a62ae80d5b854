"""The TTL answer cache as keyed streaming state.

State per key = the time of the last miss (when the live entry was set).
Within a micro-batch a key's requests are processed in (ts, id) order; a
request is a hit when ts < last_set + TTL.  An event-time timeout at
last_set + TTL drops the state once the watermark passes it, so state stays
bounded by the keys active within one TTL.  Requests later than the
watermark are dropped by Spark before they reach the state (late data);
``quarry.streaming.common.late_rows`` counts them.  On ordered input the
result equals the batch replay (H8)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.functions.time import ntz_micros, ntz_to_instant
from quarry.operators.cache import DEFAULT_TTL_SECONDS


def ttl_cache_stream(stream: DataFrame, key_col: str, ts_col: str, id_col: str,
                     ttl_seconds: int = DEFAULT_TTL_SECONDS, watermark: str = "2 hours") -> DataFrame:
    ttl_us = int(ttl_seconds) * 1_000_000
    ev = (stream.select(F.col(key_col).alias("k"), F.col(id_col).alias("id"),
                        ntz_micros(ts_col).alias("us"), ntz_to_instant(ts_col).alias("ts"))
          .withWatermark("ts", watermark))
    out_schema = T.StructType([T.StructField("k", stream.schema[key_col].dataType),
                               T.StructField("id", stream.schema[id_col].dataType),
                               T.StructField("hit", T.BooleanType())])
    state_schema = T.StructType([T.StructField("last_set_us", T.LongType())])

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        outs = []
        for pdf in pdfs:
            outs.append(pdf)
        if not outs:
            return
        pdf = pd.concat(outs, ignore_index=True)
        us = pdf["us"].to_numpy(np.int64)
        order = np.lexsort((pdf["id"].to_numpy(), us))
        times = us[order]
        hit = np.ones(len(us), dtype=bool)
        # from miss to miss: everything between is a hit
        i = 0 if last is None else int(np.searchsorted(times, last + ttl_us, side="left"))
        while i < len(times):
            hit[order[i]] = False
            last = int(times[i])
            i = int(np.searchsorted(times, last + ttl_us, side="left"))
        state.update((last,))
        state.setTimeoutTimestamp(int((last + ttl_us) // 1000))
        yield pd.DataFrame({"k": pdf["k"].to_numpy(), "id": pdf["id"].to_numpy(), "hit": hit})

    return ev.groupBy("k").applyInPandasWithState(step, out_schema, state_schema, "append",
                                                  GroupStateTimeout.EventTimeTimeout) \
        .select(F.col("id").alias(id_col), F.col("k").alias(key_col), "hit")
