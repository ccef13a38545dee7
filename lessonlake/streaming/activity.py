"""The daily records and the wallets as streams. State is one small row a key; the source has no lateness rule, so no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from lessonlake.operators.activity import COUNTERS, activity_counters
from lessonlake.operators.ledger import BALANCES, DETAILS, STEP, detailed, known_students, ledger_rows, new_wallet, run_wallets, usage_rows, wallet_step
from lessonlake.streaming.sink import daily_sink, wallet_sink


def daily_study_stream(activity: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch's changed (student, day) rows with their sums so far go to daily_sink(path), whose read gives the table."""
    sums = activity_counters(activity).groupBy("student_key", "date_key").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(daily_sink(path).put)


def wallet_stream(intents: DataFrame, students: DataFrame | None = None, wallets: DataFrame | None = None) -> DataFrame:
    """The rows of wallet_steps as a stream: equal to those over all intents if batches come in time order. ledger_rows and usage_rows take them.

    students(student_key), not streamed, as in wallet_steps; wallets(student_key, *BALANCES) is the state that students begin with. State
    is five values a student, so its size doesn't grow with a ledger; a task holds one student's intents of one batch.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    names = ("at_micros", "event_id", "kind", "amount", "known", *DETAILS)
    out = [f.name for f in StructType.fromDDL(STEP)]

    class Wallet(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("wallet", ", ".join([*(f"{c} long" for c in BALANCES), "open boolean"]))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.state.update((*[int(initialState[c].iloc[0]) for c in BALANCES], True))

        def handleInputRows(self, key, rows, timerValues):
            wallet = list(self.state.get()) if self.state.exists() else new_wallet()
            batch = pd.concat([r[list(names)] for r in rows]).sort_values(["at_micros", "event_id"])
            done = []
            for at, event, kind, amount, known, *details in batch.itertuples(index=False, name=None):
                change = wallet_step(wallet, kind, None if pd.isna(amount) else amount, known)
                done.append((key[0], at, event, kind, *change, *wallet[:4], *[None if pd.isna(x) else x for x in details]))
            self.state.update(tuple(wallet))
            yield pd.DataFrame(done, columns=out).astype({"lesson_no": "Int32"})

        def close(self) -> None:
            pass

    rows = known_students(detailed(intents).withColumn("at_micros", F.unix_micros(F.col("ts").cast("timestamp"))), students)
    begin = None if wallets is None else wallets.select("student_key", *[F.col(c).cast("long").alias(c) for c in BALANCES]).groupBy("student_key")
    steps = rows.select("student_key", *names).groupBy("student_key").transformWithStateInPandas(Wallet(), STEP, "Append", "None", initialState=begin)
    return steps.withColumn("ts", F.timestamp_micros("at_micros")).drop("at_micros")


def wallet_tables(steps: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """wallet_stream -> the stored tables below path: wallets (wallet_sink's), ledger and usage (a folder a batch, which repeating it replaces)."""
    sink = wallet_sink(f"{path}/wallets")

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for name, made in (("ledger", ledger_rows(rows)), ("usage", usage_rows(rows))):
                made.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            sink.put(run_wallets(rows), number)
        finally:
            rows.unpersist()

    return steps.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
