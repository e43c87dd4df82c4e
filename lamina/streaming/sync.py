"""Change feed between peers: payloads (route, o, r, c, t, seq, p), deduplicated, checked for gaps, acknowledged.

Batch forms work on logs; the streaming form keeps per-client state in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lamina.functions.ranking import greatest_before, numbered
from lamina.operators import history
from lamina.sources.store import Store

PAYLOAD = "route string, o string, r string, c string, t long, seq long, p array<string>"
DEDUP_SIZE, ACK_TIMEOUT_MS = 10_000, 10_000
#: Numbers of a gap that one row spells out.
GAP_RUN = 4096


def enrich(refs: DataFrame, origin: str, client: str | None = None, causal: bool = False) -> DataFrame:
    """refs (route, r, ord[, p]) -> payloads: origin and ref always, client and time if there is a client, sequence and predecessors if causal."""
    if causal:
        refs = numbered(refs, ["route"], [F.col("ord")], "number")
    previous = F.col("p") if "p" in refs.columns else F.lit(None).cast("array<string>")
    return refs.select(
        "route",
        F.lit(origin).alias("o"),
        "r",
        F.lit(client).cast("string").alias("c"),
        (F.unix_millis(F.current_timestamp()) if client else F.lit(None).cast("long")).alias("t"),
        (F.col("number") if causal else F.lit(None).cast("long")).alias("seq"),
        (previous if causal else F.lit(None).cast("array<string>")).alias("p"),
    )


def not_from(payloads: DataFrame, origin: str) -> DataFrame:
    """Payloads of other origins; unknown origins pass."""
    return payloads.where(F.col("o").isNull() | (F.col("o") != origin))


def first_seen(payloads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first payload of each key, over a whole log."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return payloads.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def outgoing(refs: DataFrame, order: list[str], *known: DataFrame) -> DataFrame:
    """refs (route, r) to be sent: each once, without what known payloads (route, r), sent or received, hold."""
    for held in known:
        refs = refs.join(held.select("route", "r"), ["route", "r"], "left_anti")
    return first_seen(refs, ["route", "r"], order)


def bootstrap(log: DataFrame, order: list[str]) -> DataFrame:
    """The latest payload of each route, for clients that join late."""
    own = log.groupBy("route").agg(F.max(F.struct(*order, *(c for c in log.columns if c not in order and c != "route"))).alias("x"))
    return own.select("route", "x.*").select(*log.columns)


def gaps(payloads: DataFrame, client: str, seq: str, order: list[str]) -> DataFrame:
    """(client, after_seq, upto_seq) for each jump of a client's sequence; the last number seen never goes back, and is 0 for a client not seen before."""
    known = greatest_before(payloads.select(client, seq, *(c for c in order if c not in (client, seq))), [client], [F.col(c) for c in order], seq, "before")
    marked = known.select(client, F.col(seq).alias("upto_seq"), F.coalesce("before", F.lit(0)).alias("after_seq"))
    return marked.where(F.col("upto_seq") > F.col("after_seq") + 1).select(client, "after_seq", "upto_seq")


def gap_fill(log: DataFrame, requests: DataFrame, client: str, seq: str) -> DataFrame:
    """Logged payloads that requests (client, after_seq, upto_seq) ask for, each once.

    Gaps are spelt out as numbers, in runs of GAP_RUN, so that client and number are both keys of the join.
    """
    runs = F.explode(F.sequence(F.col("after_seq") + 1, F.col("upto_seq") - 1, F.lit(GAP_RUN).cast("long")))
    asked = requests.where(F.col("upto_seq") > F.col("after_seq") + 1).select(F.col(client).alias("asked"), "upto_seq", runs.alias("at"))
    numbers = asked.select("asked", F.explode(F.sequence("at", F.least(F.col("at") + GAP_RUN, F.col("upto_seq")) - 1)).alias("number")).distinct()
    return log.join(numbers, (F.col(client) == F.col("asked")) & (F.col(seq) == F.col("number"))).select(*log.columns).distinct()


def unacked(sent: DataFrame, acks: DataFrame, key: str, sent_at: str, acked_at: str, timeout_ms: int = ACK_TIMEOUT_MS) -> DataFrame:
    """Sends without an ack of their key within the timeout."""
    got = acks.select(F.col(key).alias("acked"), F.col(acked_at).alias("at"))
    due = F.expr(f"INTERVAL {int(timeout_ms)} MILLISECONDS")
    return sent.join(got, (F.col(key) == F.col("acked")) & (F.col("at") >= F.col(sent_at)) & (F.col("at") <= F.col(sent_at) + due), "left_anti")


def predecessors(payloads: DataFrame, history: DataFrame, key: str, ref: str) -> DataFrame:
    """payloads (key, previous array of time ids) with `p`: the refs of the predecessors, in order, unknown ones left out."""
    spread = payloads.select(key, F.posexplode_outer("previous").alias("k", "before"))
    known = spread.join(history.select(F.col("timeId").alias("before"), F.col(ref).alias("ref")), "before", "left")
    return known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("k", "ref")))), lambda x: x["ref"]).alias("p"))


def incoming(refs: DataFrame, *others: DataFrame) -> DataFrame:
    """Payloads of one feed from several inputs: refs as they come, gap fills, the bootstrap's latest refs.

    What comes twice is dropped by the receiver, so a bootstrap may repeat any of it.
    """
    out = refs
    for more in others:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


class Receiver(StatefulProcessor):
    """One route's incoming payloads: each ref once, with two generations of memory, and gaps by client.

    Emits (route, kind, r, c, seq, after_seq): kind `ref` for a new ref, `gap` for a request to fill, `ack` for
    a new ref of a client; repeated refs are dropped before anything else. A generation holds `size` refs; when it is full it becomes the old one and the one before
    is forgotten. kind `forget` in the input's o column allows a ref again.
    """

    SCHEMA = "route string, kind string, r string, c string, seq long, after_seq long"

    def __init__(self, size: int = DEDUP_SIZE):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.new = handle.getMapState("new", "r string", "n int")
        self.old = handle.getMapState("old", "r string", "n int")
        self.held = handle.getValueState("held", "n int")
        self.last = handle.getMapState("last", "c string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            for x in batch.sort_values(["t", "seq"], kind="stable").itertuples():
                if x.o == "forget":
                    for state in (self.new, self.old):
                        if state.containsKey((x.r,)):
                            state.removeKey((x.r,))
                    continue
                if self.new.containsKey((x.r,)) or self.old.containsKey((x.r,)):
                    continue
                self._remember(x.r)
                seq = None if pd.isna(x.seq) else int(x.seq)
                if x.c is not None and seq is not None:
                    last = self.last.getValue((x.c,))[0] if self.last.containsKey((x.c,)) else 0
                    if seq > last + 1:
                        out.append((key[0], "gap", x.r, x.c, seq, last))
                    self.last.updateValue((x.c,), (max(seq, last),))
                out.append((key[0], "ack", x.r, x.c, seq, None))
                out.append((key[0], "ref", x.r, x.c, seq, None))
        yield pd.DataFrame(out, columns=["route", "kind", "r", "c", "seq", "after_seq"]).astype({"seq": "Int64", "after_seq": "Int64"})

    def _remember(self, ref: str) -> None:
        held = self.held.get()[0] if self.held.exists() else 0
        if held >= self.size:
            self.old.clear()
            for k, v in list(self.new.iterator()):
                self.old.updateValue(k, v)
            self.new.clear()
            held = 0
        self.new.updateValue((ref,), (1,))
        self.held.update((held + 1,))

    def close(self) -> None:
        pass


def receive(payloads: DataFrame, origin: str, size: int = DEDUP_SIZE) -> DataFrame:
    """A stream of payloads -> what the receiver makes of each: new refs, gap requests, acks. Own payloads are left out.

    Needs the RocksDB state store provider.
    """
    return not_from(payloads, origin).groupBy("route").transformWithStateInPandas(statefulProcessor=Receiver(size), outputStructType=Receiver.SCHEMA, outputMode="append", timeMode="none")


class Observers:
    """Callbacks per route on a stream of received refs; errors of one are kept, not raised."""

    def __init__(self) -> None:
        self.callbacks: dict[str, list[Callable]] = {}
        self.errors: list[Exception] = []
        self.missed: dict[str, str] = {}
        self.queries: list[StreamingQuery] = []
        self.ends: list[Callable[[], None]] = []

    def register(self, route: str, callback: Callable[[str], None]) -> None:
        """A ref that came before the first callback is delivered to it once."""
        self.callbacks.setdefault(route, []).append(callback)
        if route in self.missed:
            self.notify(route, self.missed.pop(route))

    def unregister(self, route: str, callback: Callable | None = None) -> None:
        left = [c for c in self.callbacks.get(route, []) if callback is not None and c is not callback]
        self.callbacks.pop(route, None)
        if left:
            self.callbacks[route] = left

    def notify(self, route: str, ref: str) -> None:
        if not self.callbacks.get(route):
            self.missed[route] = ref
        for callback in list(self.callbacks.get(route, [])):
            try:
                callback(ref)
            except Exception as error:  # noqa: BLE001  one observer must not stop the others
                self.errors.append(error)

    def watch(self, received: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start a query that notifies of every new ref; only routes that are observed leave the executors."""

        def batch(rows: DataFrame, _: int) -> None:
            for row in rows.where(F.col("kind") == "ref").where(F.col("route").isin(list(self.callbacks))).select("route", "r").toLocalIterator():
                self.notify(row.route, row.r)

        query = received.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        self.queries.append(query)
        return query

    def forward_conflicts(self, store: Store, table: str, callback: Callable[[dict], None]) -> None:
        """Conflicts of a table's history go to the callback until `tear_down`; its errors are kept, not raised."""

        def forward(found: dict) -> None:
            try:
                callback(found)
            except Exception as error:  # noqa: BLE001  a write must not fail for who watches it
                self.errors.append(error)

        history.observe_conflicts(store, table, forward)
        self.ends.append(lambda: history.unobserve_conflicts(store, table, forward))

    def tear_down(self) -> None:
        """Stop the queries, end the forwarding, forget callbacks and what they missed."""
        for query in self.queries:
            query.stop()
        for end in self.ends:
            end()
        for kept in (self.queries, self.ends, self.callbacks, self.missed):
            kept.clear()
