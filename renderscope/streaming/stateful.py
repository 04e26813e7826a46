"""Keyed state inside the stream: save kinds that leave the stream tagged.

Needs the RocksDB state store; ``use_rocksdb`` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that all (reviewer, passage) are dealt over: a call costs milliseconds, so there are not more of them with more reviewers.
BUCKETS = 1024


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(STORE_CONF, ROCKSDB)


class RevisionTags(StatefulProcessor):
    """Per bucket: the lowest id seen of every (reviewer, passage), as three arrays in one value.

    A save is ``first`` when no lower id of its reviewer and passage has been
    seen, else ``revision``. A lower id that comes late takes the tag over: the
    save that held it goes out again as ``revision``. One read and one write of
    state a bucket and batch, whatever the number of its saves.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._firsts = handle.getValueState("firsts", "reviewers array<string>, passages array<bigint>, ids array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held: dict[tuple[str, int], int] = {}
        if self._firsts.exists():
            reviewers, passages, ids = self._firsts.get()
            held = dict(zip(zip(reviewers, passages, strict=True), ids, strict=True))
        before, saves = {}, []
        for part in rows:
            reviewers = part["reviewer"].astype(object).where(part["reviewer"].notna(), None)
            for reviewer, passage, save in zip(reviewers, part["passage_id"].tolist(), part["id"].tolist(), strict=True):
                saves.append((save, reviewer, passage))
                first = held.get((reviewer, passage))
                if first is None or save < first:
                    before.setdefault((reviewer, passage), first)
                    held[reviewer, passage] = save
        self._firsts.update(([r for r, _ in held], [p for _, p in held], list(held.values())))
        tags = [(*s, "first" if s[0] == held[s[1:]] else "revision") for s in saves]
        # Saves of earlier batches that lose their tag to a lower id.
        tags += [(i, *k, "revision") for k, i in before.items() if i is not None]
        yield pd.DataFrame(tags, columns=["id", "reviewer", "passage_id", "save_kind"])

    def close(self) -> None:
        pass


def tagged_saves(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """id, reviewer, passage_id, save_kind as a stream in update mode; the newest batch of an id holds.

    Saves without an id or a passage are no evaluations and are left out. A
    repeated save gets the tag it has.
    """
    keyed = log.where("id is not null and passage_id is not null").select(
        F.pmod(F.xxhash64("reviewer", "passage_id"), F.lit(buckets)).alias("bucket"), "reviewer", "passage_id", "id"
    )
    return keyed.groupBy("bucket").transformWithStateInPandas(
        RevisionTags(), "id long, reviewer string, passage_id long, save_kind string", "Update", "None"
    )
