"""Fill progress as keyed state: each document keeps its fields and the last edit of each of their nodes.

State lies in the stream's state store (RocksDB), one map of fields, one of targets and two counts for each document, so its
size follows the documents and not the number of batches, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import patches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of field rows and of edit rows; rows of the stream have both, told apart by ``field``.
_ROW = "doc_key string, field string, box boolean, filled boolean, node string, ts timestamp, edit_id long"


def _filled(value: Column) -> Column:
    return F.coalesce(T.py_strip(value) != "", F.lit(False))


def field_rows(fields: DataFrame) -> DataFrame:
    """A row for each field and each node that its value comes from (null if there is none)."""
    box = F.col("type") == "checkbox"
    nodes = F.when(box, F.filter("node_ids", lambda x: x.startswith("sdt_"))).otherwise(F.array(T.value_target(F.col("node_ids"))))
    filled = _filled(F.col("value")) | (box & F.col("value").isNotNull())
    return fields.select("doc_key", F.col("field_ord").cast("string").alias("field"), F.coalesce(box, F.lit(False)).alias("box"), filled.alias("filled"), F.explode_outer(nodes).alias("node"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("edit_id"))


def edit_rows(edits: DataFrame) -> DataFrame:
    """A row for each edit of a person: its node and whether it leaves a value."""
    own = patches.echo_filter(edits)
    return own.select("doc_key", F.lit(None).cast("string").alias("field"), F.lit(None).cast("boolean").alias("box"), _filled(F.col("text")).alias("filled"), F.col("node_id").alias("node"), F.col("ts").cast("timestamp").alias("ts"), F.col("edit_id").cast("long").alias("edit_id"))


class FillProgress(StatefulProcessor):
    """doc_key, filled and total of the documents that a batch touches.

    A box counts as filled once one of its nodes was edited, another field if the last edit of its node left a value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "box boolean, filled boolean")
        self.targets = handle.getMapState("targets", "node string, field string", "ts timestamp, edit_id long")
        self.counts = handle.getValueState("counts", "filled long, total long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._add(initialState)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}
        for batch in rows:
            is_field = batch["field"].notna()
            self._add(batch[is_field])
            for node, ts, edit_id, filled in batch.loc[~is_field & batch["node"].notna(), ["node", "ts", "edit_id", "filled"]].itertuples(index=False):
                last[node] = max(last.get(node, (ts, edit_id, filled)), (ts, edit_id, filled))
        filled, total = self.counts.get() if self.counts.exists() else (0, 0)
        if last and total:
            for (node, field), (ts, edit_id) in list(self.targets.iterator()):
                new = last.get(node)
                if new is None or (edit_id is not None and not pd.isna(ts) and (pd.Timestamp(ts), edit_id) >= new[:2]):
                    continue
                self.targets.updateValue((node, field), (new[0].to_pydatetime(), int(new[1])))
                box, old = self.fields.getValue((field,))
                now = bool(box or new[2])
                if now != old:
                    self.fields.updateValue((field,), (box, now))
                    filled += 1 if now else -1
            self.counts.update((filled, total))
        if total:
            yield pd.DataFrame({"doc_key": [key[0]], "filled": [filled], "total": [total]})

    def _add(self, rows: pd.DataFrame) -> None:
        filled, total = self.counts.get() if self.counts.exists() else (0, 0)
        for field, box, has, node in rows[["field", "box", "filled", "node"]].itertuples(index=False):
            if not self.fields.containsKey((field,)):
                self.fields.updateValue((field,), (bool(box), bool(has)))
                filled, total = filled + bool(has), total + 1
            if isinstance(node, str) and not self.targets.containsKey((node, field)):
                self.targets.updateValue((node, field), (None, None))
        self.counts.update((filled, total))

    def close(self) -> None:
        pass


def fill_progress_stream(edits: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_key, filled and total of each document that was touched; run it in update mode.

    ``fields`` is the table of extracted fields that the stream starts with, or a stream of them, if documents come later.
    """
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows, known = edit_rows(edits), field_rows(fields)
    stream = rows.unionByName(known) if fields.isStreaming else rows
    start = None if fields.isStreaming else known.groupBy("doc_key")
    return stream.groupBy("doc_key").transformWithStateInPandas(FillProgress(), "doc_key string, filled long, total long", "Update", "None", start)
