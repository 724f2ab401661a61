"""Small logs and a step-by-step replay that the set-based policies are compared with."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from tidemark.sources.changelog import LOG_SCHEMA

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def row(event_id, sale_id, arrival, event=None, amount=1.0, quantity=1, deleted=False):
    """arrival and event are hours after START (None stays null)."""
    arrived = None if arrival is None else START + arrival * HOUR
    happened = arrived if event is None else START + event * HOUR
    return (event_id, sale_id, happened, arrived, "p", "c", "r", "x", quantity, float(amount), False, deleted)


def make_log(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def random_rows(seed, n=60, keys=8, hot=False, span=40, free=False, null_key=False):
    """Random changes with arrival ties; the first key may hold half of the rows, and be null.

    One event time per key, or with ``free`` one for each change.
    """
    rng = random.Random(seed)
    born = {k: rng.randrange(0, span) for k in range(keys)}
    rows = []
    for i in range(n):
        key = 0 if hot and rng.random() < 0.5 else rng.randrange(keys)
        arrival = rng.choice([rng.randrange(0, span), rng.randrange(0, span * 4) / 4, rng.random() * span])
        happened = rng.random() * span if free else born[key]
        key = None if null_key and key == 0 else key
        rows.append(row(i, key, arrival, happened, rng.randrange(1, 100), rng.randrange(1, 5), rng.random() < 0.25))
    return rows


class Naive:
    """Keeps a served table and applies a policy one step at a time."""

    def __init__(self, rows):
        self.rows = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0]))
        best = {}
        for r in self.rows:
            best[(r[1], r[3])] = r
        self.observed = sorted(best.values(), key=lambda r: (r[3], r[0]))
        self.loads = Counter()
        self.timeline = {}

    @staticmethod
    def newest(rows, keys=None):
        out = {}
        for r in rows:
            if keys is None or r[1] in keys:
                out[r[1]] = r
        return out

    @staticmethod
    def total(table):
        return sum(round(r[9] * r[8], 4) for r in table.values() if not r[11])

    def _record(self, at, count, table, cutoff):
        self.timeline[at] = (count, self.total(table), cutoff)

    def _load(self, rows):
        for r in rows:
            self.loads[r[0]] += 1

    def _boundaries(self, every):
        if not self.rows:
            return
        at, last = self.rows[0][3], self.rows[-1][3]
        while at <= last:
            yield at
            at += every * HOUR

    def _batches(self):
        for at in sorted({r[3] for r in self.observed}):
            yield at, [r for r in self.observed if r[3] == at]

    def immediate(self):
        table, count = {}, 0
        for at in sorted({r[3] for r in self.rows}):
            for r in (x for x in self.rows if x[3] == at):
                table[r[1]] = r
                self._load([r])
                count += 1
            self._record(at, count, table, at)
        return self

    def full_refresh(self, every):
        for at in self._boundaries(every):
            seen = [r for r in self.rows if r[3] <= at]
            table = {k: r for k, r in self.newest(seen).items() if not r[11]}
            self._load(table.values())
            self._record(at, len(seen), table, at)
        return self

    periodic_snapshot = full_refresh

    def hot_window(self, hot, every, full_every):
        table = {}
        first = self.rows[0][3] if self.rows else None
        due = None if first is None else first + full_every * HOUR
        for at in self._boundaries(every):
            low = max(first, at - hot * HOUR)
            if at >= due:
                low = first
                while at >= due:
                    due += full_every * HOUR
            changed = self.newest([r for r in self.rows if low <= r[3] <= at])
            for k, r in changed.items():
                table.pop(k, None)
                if not r[11]:
                    table[k] = r
                    self._load([r])
            self._record(at, sum(r[3] <= at for r in self.rows), table, at)
        return self

    def lagged_reconcile(self, every, lag):
        log, table, last, due, cutoff, count = [], {}, None, None, None, 0
        for at, batch in self._batches():
            log += batch
            self._load(batch)
            count += len(batch)
            visible = at - lag * HOUR
            due = at if due is None else due
            if at >= due and (last is None or visible > last):
                keys = {r[1] for r in log if r[3] <= visible and (last is None or r[3] > last)}
                news = self.newest([r for r in log if r[3] <= visible], keys)
                for k, r in news.items():
                    table.pop(k, None)
                    if not r[11]:
                        table[k] = r
                        self._load([r])
                last = cutoff = visible
                while due <= at:
                    due += every * HOUR
            self._record(at, count, table, cutoff)
        return self

    def window_gate(self, size, lateness):
        log, newest, count = [], None, 0
        for at, batch in self._batches():
            top = max(r[2] for r in batch)
            newest = top if newest is None else max(newest, top)
            mark = None if lateness < 0 else newest - lateness * HOUR
            for r in batch:
                seconds = (r[2] - datetime(1970, 1, 1)).total_seconds()
                end = datetime(1970, 1, 1) + timedelta(seconds=(seconds // (size * 3600) + 1) * size * 3600)
                if mark is None or end > mark:
                    log.append(r)
                    self._load([r])
            count += len(batch)
            self._record(at, count, self.newest(log), at)
        return self

    def commit_snapshot(self, every):
        log, due, cutoff, count = [], None, None, 0
        for at, batch in self._batches():
            log += batch
            self._load(batch)
            count += len(batch)
            if due is None or at >= due or every == 0:
                cutoff, due = at, at + every * HOUR
            self._record(at, count, self.newest([r for r in log if r[3] <= cutoff]), cutoff)
        return self
