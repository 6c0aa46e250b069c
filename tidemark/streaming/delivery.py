"""Delivery as a stream over the commits of a store.

The source is the manifests, so only committed events are seen, in the order of their commits. Events go out in batches of at most ``most``, oldest first; each batch is logged
after it was sent, and what the log has isn't sent again. A crash after sending repeats that one batch, and nothing is marked that wasn't sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import digest as G
from tidemark.streaming.store import EVENTS, Store

LOG = "event_id string, delivered_at timestamp"


def log(store: Store) -> DataFrame:
    """What was delivered; empty before anything was."""
    return store._frame(["deliveries"], LOG) if store._names("deliveries") else store.spark.createDataFrame([], LOG)


def send_all(store: Store, events: DataFrame, send: Callable[[DataFrame], None], most: int = 200) -> int:
    """Send what the log lacks, batch by batch; the number of batches."""
    n = 0
    while True:
        # the few rows of a batch are fixed before they are sent, so that what is logged is what was sent
        batch = store.spark.createDataFrame(G.pending(events, log(store), most).collect(), EVENTS)
        if batch.isEmpty():
            return n
        G.deliver(batch, send, f"{store.folder}/deliveries")
        n += 1


def start(store: Store, send: Callable[[DataFrame], None], checkpoint: str, most: int = 200):
    """Start the query. ``send`` gets a batch of events, for ``digest.split`` and what follows."""
    manifests = store.spark.readStream.schema("number bigint, events string").json(f"{store.folder}/manifests")

    def batch(rows: DataFrame, _: int) -> None:
        paths = [r["events"] for r in rows.where("events is not null").orderBy("number").collect()]  # one a commit
        if paths:
            send_all(store, store._frame(paths, EVENTS), send, most)

    return manifests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
