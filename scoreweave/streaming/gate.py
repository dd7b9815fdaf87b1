"""A gate in a stream: a batch's rows wait until all its pages are there, and go on together.

The rows of a batch lie in state, with the pages seen. Once there are as many different pages as the
batch's total, its rows leave in one micro-batch, marked complete, and its state is cleared: the same
batch sent again is a new round. A batch that is still short when its time is over (counted from its
first row, in processing time) leaves as it is, marked incomplete, so no row is ever held back for good
and state holds open batches only. A page that comes twice before the batch is complete counts once;
both its rows go on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegralType, StructField, StructType

AT, PAGE = "arrived_ms", "page_text"  # columns of the gate's own: the arrival as a number, the page as text
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WholeBatches(StatefulProcessor):
    """Holds the rows of one batch; see the module."""

    def __init__(self, rows: StructType, total: str, wait_ms: int):
        self._schema, self._total, self._wait = rows, total, wait_ms  # rows: with AT and PAGE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", self._schema)
        self._pages = handle.getListState("pages", "page string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        new = pd.concat(list(rows), ignore_index=True)
        seen = {page for (page,) in self._pages.get()}
        more = set(new[PAGE].dropna()) - seen
        total = new[self._total].max()
        if pd.notna(total) and len(seen) + len(more) >= total:
            yield self._leave(new, True)
            return
        if not any(True for _ in self._handle.listTimers()):
            self._handle.registerTimer(int(new[AT].min()) + self._wait)
        whole = [isinstance(f.dataType, IntegralType) for f in self._schema.fields]  # with nulls these come as floats
        self._rows.appendList([tuple(_plain(v, i) for v, i in zip(r, whole, strict=True)) for r in new.itertuples(index=False, name=None)])
        if more:
            self._pages.appendList([(page,) for page in sorted(more)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        if self._rows.exists():
            yield self._leave(None, False)

    def _leave(self, new, complete: bool):
        import pandas as pd

        held = [tuple(r) for r in self._rows.get()]
        if held:
            out = pd.DataFrame(held, columns=self._schema.names)
            out = out if new is None else pd.concat([out, new[self._schema.names]], ignore_index=True)
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._rows.clear()
            self._pages.clear()
        else:
            out = new[self._schema.names].copy()
        out["complete"] = complete
        return out

    def close(self) -> None:
        pass


def _plain(v, whole: bool):
    """A cell of pandas as state takes it: missing values are None, numpy's numbers Python's, whole ones int."""
    import pandas as pd

    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if whole else v


def whole_batches(rows: DataFrame, batch: str = "batch_id", page: str = "result_id", total: str = "total_pages", at: str = "arrived_at",
        wait_ms: int = 3_600_000, delay: str = "1 day") -> DataFrame:
    """rows of a stream, with complete, once all `total` different pages of their batch are there, or wait_ms after its first row.

    at: when a row arrived, the column of the watermark with `delay`; its end is what ends the wait. A
    batch whose total is null waits for its time; one of total 0 leaves at once.
    """
    held = rows.withWatermark(at, delay).withColumns({AT: F.unix_millis(at), PAGE: F.col(page).cast("string")})
    out = StructType([*held.schema.fields, StructField("complete", BooleanType())])
    gate = WholeBatches(held.schema, total, wait_ms)
    return held.groupBy(F.col(batch)).transformWithStateInPandas(gate, out, "Append", "EventTime").drop(AT, PAGE)


class rocks_db:  # noqa: N801
    """While a stream starts: state in RocksDB, which state with timers needs; the session's setting comes back."""

    def __init__(self, spark: SparkSession):
        self._conf = spark.conf

    def __enter__(self):
        self._before = self._conf.get(STORE, None)
        self._conf.set(STORE, ROCKS_DB)

    def __exit__(self, *_):
        self._conf.unset(STORE) if self._before is None else self._conf.set(STORE, self._before)
