"""Orders as a Spark sink, for tables and for streams.

`df.write.format("orders")` and `df.writeStream.format("orders")` send a row
(symbol, ts, qty, and strategy if there is one) to a function `module:name`
(option `post`) as post(order_id, symbol, side, qty). The id follows from the
row, so a task that runs again, or a micro-batch that is replayed, sends the same
ids; the broker takes each once and says so by returning False. Quantities are cut
to the lot `step` towards zero, and what is left of less than `least` isn't sent.
"""

from __future__ import annotations

import hashlib
import importlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .market_api import with_retry


@dataclass
class Sent(WriterCommitMessage):
    """What a task did."""

    sent: int
    known: int
    small: int


def order_id(strategy: str, symbol: str, ts, qty: float) -> str:
    return hashlib.sha256(f"{strategy}|{symbol}|{ts.isoformat()}|{qty!r}".encode()).hexdigest()[:32]


def lots(qty: float, step: float) -> float:
    """The quantity in whole steps, towards zero."""
    return math.copysign(math.floor(abs(qty) / step + 1e-9) * step, qty) if step else qty


class _Writer:
    def __init__(self, options: dict):
        self.o = options

    def write(self, rows: Iterator) -> Sent:
        module, _, name = self.o["post"].partition(":")
        post = getattr(importlib.import_module(module), name)
        step, least = float(self.o.get("step", 0)), float(self.o.get("least", 0))
        count = Sent(0, 0, 0)
        for r in rows:
            row = r.asDict()
            qty = lots(row["qty"] or 0.0, step)
            if not qty or abs(qty) < least:
                count.small += 1
                continue
            key = order_id(row.get("strategy") or "", row["symbol"], row["ts"], qty)
            taken = with_retry(lambda k=key, w=row, q=qty: post(k, w["symbol"], "BUY" if q > 0 else "SELL", abs(q)), wait=float(self.o.get("wait", 60)))
            if taken is False:
                count.known += 1
            else:
                count.sent += 1
        return count

    def _report(self, messages: list[Sent | None], batch: int | None, failed: bool) -> None:
        """Tell `report` (a function like `post`) what came of a job or batch."""
        if name := self.o.get("report"):
            module, _, name = name.partition(":")
            done = [m for m in messages if m is not None]
            getattr(importlib.import_module(module), name)(batch, sum(m.sent for m in done), sum(m.known for m in done), sum(m.small for m in done), failed)


class OrderWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._report(messages, None, False)

    def abort(self, messages: list) -> None:
        self._report(messages, None, True)


class OrderStreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._report(messages, batchId, False)

    def abort(self, messages: list, batchId: int) -> None:
        self._report(messages, batchId, True)


class OrderSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orders"

    def writer(self, schema, overwrite: bool) -> OrderWriter:
        return OrderWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> OrderStreamWriter:
        return OrderStreamWriter(dict(self.options))


def send(orders: DataFrame, post: str, **options: str) -> None:
    """Send a table of orders."""
    orders.sparkSession.dataSource.register(OrderSink)
    orders.write.format("orders").mode("append").options(post=post, **options).save()


def send_stream(orders: DataFrame, post: str, checkpoint: str, every: str = "60 seconds", **options: str):
    """Send a stream of orders; the query."""
    orders.sparkSession.dataSource.register(OrderSink)
    return orders.writeStream.format("orders").options(post=post, **options).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
