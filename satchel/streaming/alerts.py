"""Threshold alerts on account balances: one alert each time a balance falls below the threshold.

Transactions come in any order. The processor holds an account's transactions until the watermark has passed their times,
then books them in the order of time and id, so that the stream gives what finance.crossings() gives for the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ALERTS = "account_id long, id long, at long, balance decimal(18,2)"


class BalanceAlerts(StatefulProcessor):
    """State of an account: its balance, whether it is below, and the transactions that wait for the watermark."""

    def __init__(self, threshold: Decimal):
        self.threshold = threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("account", "balance decimal(18,2), below boolean, timer long")
        self.waiting = handle.getListState("waiting", "ms long, id long, change decimal(18,2)")

    def _now(self, opening: Decimal | None) -> list:
        if self.state.exists():
            return list(self.state.get())
        return [opening, opening < self.threshold, None]

    def _book(self, account: int, rows: list[tuple], now: list) -> Iterator[Row]:
        for ms, number, change in sorted(rows):
            now[0] += change
            if now[0] < self.threshold and not now[1]:
                yield Row(account_id=account, id=number, at=ms, balance=now[0])
            now[1] = now[0] < self.threshold

    def _wait(self, rows: list[tuple], now: list) -> None:
        """Keeps ``rows`` and one timer, for the first of them."""
        first = min(rows)[0] if rows else None
        if now[2] is not None and now[2] != first:
            self.handle.deleteTimer(now[2])
        if first is not None and now[2] != first:
            self.handle.registerTimer(first)
        now[2] = first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        now = self._now(rows[0].opening)
        mark = timerValues.getCurrentWatermarkInMs()
        new = [(r.ms, r.id, r.change) for r in rows]
        # what comes behind the watermark is booked now
        yield from self._book(key[0], [r for r in new if r[0] <= mark], now)
        new = [r for r in new if r[0] > mark]
        if new:
            self.waiting.appendList(new)
            self._wait([min(new)] if now[2] is None or min(new)[0] < now[2] else [(now[2],)], now)
        self.state.update(tuple(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, mark = self._now(None), timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        yield from self._book(key[0], [r for r in rows if r[0] <= mark], now)
        rows = [r for r in rows if r[0] > mark]
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()
        now[2] = None  # this timer is gone
        self._wait(rows, now)
        self.state.update(tuple(now))

    def close(self) -> None:
        pass


def balance_alerts(transactions: DataFrame, accounts: DataFrame, threshold: str, late: str = "0 seconds") -> DataFrame:
    """Alerts on a stream of transactions (account_id, id, at as timestamp, change): the transaction and the balance after it.

    accounts: id and opening balance, a table. Transactions of unknown accounts, without time or change are left out."""
    opening = accounts.select(F.col("id").alias("account_id"), F.col("balance").cast("decimal(18,2)").alias("opening")).where("opening is not null")
    own = transactions.where("at is not null and change is not null and id is not null").select("account_id", "id", "at", F.expr("unix_millis(at)").alias("ms"), F.col("change").cast("decimal(18,2)").alias("change"))
    joined = own.withWatermark("at", late).join(opening, "account_id")
    return joined.groupBy("account_id").transformWithState(BalanceAlerts(Decimal(threshold)), ALERTS, "Append", "EventTime")
