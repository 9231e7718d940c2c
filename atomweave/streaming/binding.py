"""Binding state of molecules over a stream of contact rows.

The stream twin of :func:`atomweave.operators.binding.binding_states`: rows arrive in files of later
and later ticks, the state per molecule (partner and last tick) lives in the state store, so a lost
executor or a restart continues from the checkpoint.  The store has one entry for up to ``MOLECULES`` molecules of a
structure, as an entry costs a round trip and its key in every batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "structure_id bigint, mol_id bigint, tick bigint, bound boolean, bound_to bigint, late boolean"
STATE = "mol_id array<bigint>, bound_to array<bigint>, last_tick array<bigint>"
#: Molecules whose state is one entry: those with equal ``mol_id div MOLECULES``.
MOLECULES = 64
NOBODY = -1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BindingProcessor(StatefulProcessor):
    """Value state per group of molecules: of each, whom it is bound to and the last tick seen.

    Rows of one batch are put in order.  A row that comes in a later batch than a row of a later tick
    cannot be decided any more: it is returned with ``late`` set and no state, so no row is lost.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("binding", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {mol: (partner, tick) for mol, partner, tick in zip(*self.state.get(), strict=True)} if self.state.exists() else {}
        batch = pd.concat(list(rows)).sort_values("tick", kind="stable")
        out = []
        columns = [batch[c].tolist() for c in ("mol_id", "tick", "partner_id", "bind", "unbind")]
        for mol, tick, met, bind, unbind in zip(*columns, strict=True):
            partner, last_tick = known.get(mol, (NOBODY, -1))
            if tick <= last_tick:
                out.append((int(key[0]), mol, tick, None, None, True))
                continue
            if partner != NOBODY:
                partner = NOBODY if unbind else partner
            elif bind:
                partner = met
            known[mol] = partner, tick
            out.append((int(key[0]), mol, tick, partner != NOBODY, partner if partner != NOBODY else None, False))
        self.state.update((list(known), [partner for partner, _ in known.values()], [tick for _, tick in known.values()]))
        frame = pd.DataFrame(out, columns=["structure_id", "mol_id", "tick", "bound", "bound_to", "late"])
        frame["bound"] = frame["bound"].astype("boolean")
        frame["bound_to"] = frame["bound_to"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def bind_stream(decisions: DataFrame) -> DataFrame:
    """Binding states of a stream ``(structure_id, mol_id, tick, partner_id, bind, unbind)``."""
    return (decisions
            .select("structure_id", "mol_id", "tick", F.coalesce("partner_id", F.lit(NOBODY)).alias("partner_id"),
                    "bind", "unbind")
            .withColumn("_some", F.floor(F.col("mol_id") / MOLECULES))
            .groupBy("structure_id", "_some")
            .transformWithStateInPandas(statefulProcessor=BindingProcessor(), outputStructType=OUTPUT,
                                        outputMode="append", timeMode="none"))


def late_counts(states: DataFrame) -> DataFrame:
    """Rows per structure that came too late to be decided."""
    return states.where("late").groupBy("structure_id").agg(F.count(F.lit(1)).alias("num_late"))


def run_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str,
                  files_per_batch: int | None = None) -> int:
    """Process the contact files that have landed since the last call; returns the number of batches.

    Without ``files_per_batch`` all new files are one batch, so a call after each span of ticks keeps
    the order; with it, the files of one span have to fit into one batch.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        reader = spark.readStream.schema(schema)
        stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
        query = (bind_stream(stream).writeStream.format("parquet").outputMode("append")
                 .option("path", target).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


register_pickle_by_value(sys.modules[__name__])
