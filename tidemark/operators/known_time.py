"""Attributes as known at event time (problem 7), by persistent search trees.

Method: per entity a search tree over the valid-time key is kept in all its versions by
path copying: inserting a version copies the O(log n) nodes on its path and shares the
rest, and leaves a new root.  The list of roots, ordered by known time, is searched for
the last root known at the event; that tree is searched for the greatest key at or below
the event's valid key.  Nothing that became known later is reachable from that root.

The trees are treaps whose priorities are a hash of the key: balanced in expectation for
any order of insertion, and the same after a task is run again.

Scale: versions and events of one entity meet in one stream sorted by entity, the versions
ahead (``mapInArrow``).  A task holds the trees of one Arrow batch and, beyond it, of the
one entity that goes on into the next.  Entities with more than EVENTS_PER_SALT events,
counted first, are spread over salts by the position of the event, whatever its columns
hold; only their own versions are repeated, once a salt.  At most HEAVY entities are
spread: any other has less than one HEAVY-th of all events.  Descent is vectorised over
the batch.  The trees of one entity must fit into a task (about 40 bytes x 2 log2 n a
version).  Positions are taken where the events are read: pass a stored table, or what is
derived from one without a shuffle, so that a task that runs again numbers them alike.

Defined results: of versions with equal known time and key the greatest value counts; an
event without entity or time gets no attribute (``NO_KEY``); ``UNKNOWN`` entity has no
version at all; ``EARLY`` no version known yet; ``GONE`` the version found is deleted;
``IN_FORCE`` otherwise.  Null values are values.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Entities that may be spread, and the events a salt is meant to hold.
HEAVY, EVENTS_PER_SALT = 4096, 250_000
#: Nodes above which trees no longer needed are dropped.
NODES = 1 << 15
TOP = 2**62
STATES = ("UNKNOWN", "EARLY", "GONE", "IN_FORCE")


class Forest:
    """Path-copied persistent treaps of one shard."""

    def __init__(self) -> None:
        # Plain 64-bit columns: 40 bytes a node, also for an entity of a million versions
        self.key, self.left, self.right, self.load = array("q"), array("q"), array("q"), array("q")
        self.prio = array("Q")
        self.roots: list[tuple[int, int, int]] = []  # entity number, known time, root

    def _node(self, key: int, prio: int, left: int, right: int, load: int) -> int:
        self.key.append(key)
        self.prio.append(prio)
        self.left.append(left)
        self.right.append(right)
        self.load.append(load)
        return len(self.key) - 1

    def _split(self, at: int, key: int) -> tuple[int, int]:
        """Copies of the parts below and above ``key``; a node with that key is left out."""
        lows, highs, equal = [], [], -1
        while at >= 0:
            if self.key[at] < key:
                lows.append(at)
                at = self.right[at]
            elif self.key[at] > key:
                highs.append(at)
                at = self.left[at]
            else:
                equal = at
                break
        low, high = (self.left[equal], self.right[equal]) if equal >= 0 else (-1, -1)
        for n in reversed(lows):
            low = self._node(self.key[n], self.prio[n], self.left[n], low, self.load[n])
        for n in reversed(highs):
            high = self._node(self.key[n], self.prio[n], high, self.right[n], self.load[n])
        return low, high

    def insert(self, root: int, key: int, load: int) -> int:
        """The root of a new tree with ``key``; the tree at ``root`` stays as it is."""
        prio = (key * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1)
        prio ^= prio >> 29
        path, at = [], root
        while at >= 0 and self.prio[at] > prio and self.key[at] != key:
            path.append(at)
            at = self.right[at] if self.key[at] < key else self.left[at]
        if at >= 0 and self.key[at] == key:
            made = self._node(key, self.prio[at], self.left[at], self.right[at], load)
        else:
            low, high = self._split(at, key)
            made = self._node(key, prio, low, high, load)
        for n in reversed(path):
            if self.key[n] < key:
                made = self._node(self.key[n], self.prio[n], self.left[n], made, self.load[n])
            else:
                made = self._node(self.key[n], self.prio[n], made, self.right[n], self.load[n])
        return made

    def add_entity(self, number: int, rows: list[tuple[int, int, int]], root: int = -1) -> int:
        """``rows``: known time, key, load, in the order of known time, after what ``root`` has; the last root."""
        for known, key, load in rows:
            root = self.insert(root, key, load)
            self.roots.append((number, known, root))
        return root

    def freeze(self) -> None:
        self.k, self.l, self.r, self.p = (np.array(x, dtype=np.int64) for x in (self.key, self.left, self.right, self.load))
        e, t, n = (np.array(x, dtype=np.int64) for x in zip(*self.roots, strict=True)) if self.roots else (np.zeros(0, np.int64),) * 3
        self.times = np.unique(t)
        self.span = len(self.times) + 1
        # One sorted list for all entities: (entity, rank of known time + 1)
        self.slots, self.root_at = e * self.span + np.searchsorted(self.times, t) + 1, n

    def find(self, entity: np.ndarray, known: np.ndarray, probe: np.ndarray) -> np.ndarray:
        """The load of the greatest key <= probe in the last root known by ``known``; -1 if there is none.

        Entity -1 is in no tree.
        """
        want = entity * self.span + np.searchsorted(self.times, known, side="right")
        slot = np.searchsorted(self.slots, want, side="right") - 1
        ok = (slot >= 0) & (entity >= 0)
        ok[ok] = self.slots[slot[ok]] // self.span == entity[ok]
        at = np.where(ok, self.root_at[np.maximum(slot, 0)] if len(self.root_at) else -1, -1)
        best = np.full(len(entity), -1, dtype=np.int64)
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            low = self.k[node] <= probe[live]
            best[live[low]] = self.p[node[low]]
            at[live] = np.where(low, self.r[node], self.l[node])
            live = live[at[live] >= 0]
        return best


class _Held:
    """The trees a task needs now: entities by number, in the order of the stream."""

    def __init__(self) -> None:
        self.forest, self.values, self.gone, self.rows, self.root = Forest(), [], [], {}, {}
        self.stale = True

    def add(self, number: int, known: list[int], key: list[int], value: list[str | None], gone: list[bool]) -> None:
        """Versions of an entity, in the order of known time; an entity's batches follow one another."""
        at = len(self.values)
        self.values += value
        self.gone += gone
        self.rows.setdefault(number, []).append((known, key, value, gone))
        self.root[number] = self.forest.add_entity(number, list(zip(known, key, range(at, at + len(known)), strict=True)), self.root.get(number, -1))
        self.stale = True

    def keep_only(self, number: int) -> None:
        """Drop all trees but those of one entity, once they have grown large."""
        if len(self.rows) > 1 and len(self.forest.key) > NODES:
            own = self.rows.get(number, [])
            self.__init__()
            for part in own:
                self.add(number, *part)

    def find(self, number: np.ndarray, known: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Codes of STATES and values."""
        if self.stale:
            self.forest.freeze()
            self.held = pa.array(self.values, pa.string())
            self.dead = np.array([*self.gone, False], dtype=bool)
            self.numbers = np.array(sorted(self.rows), dtype=np.int64)
            self.stale = False
        load = self.forest.find(number, known, probe)
        state = np.where(load < 0, np.where(np.isin(number, self.numbers), 1, 0), np.where(self.dead[load], 2, 3))
        return state, self.held.take(pa.array(load, mask=state != 3))


def _serve(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    """One partition: per entity and salt first its versions, in order, then its events."""
    held, number, last = _Held(), 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        entity, salt = batch["entity"], batch["salt"].to_numpy()
        fresh = np.ones(n, dtype=bool)
        fresh[0] = (entity[0].as_py(), int(salt[0])) != last
        fresh[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False) | (salt[1:] != salt[:-1])
        numbers = number + np.cumsum(fresh)
        if fresh[0]:
            held = _Held()
        else:
            held.keep_only(number)
        number, last = int(numbers[-1]), (entity[n - 1].as_py(), int(salt[n - 1]))
        is_event = batch["is_event"].to_numpy().astype(bool)
        at = np.flatnonzero(~is_event)
        if len(at):
            rows = batch.take(pa.array(at))
            columns = [rows[c].to_pylist() for c in ("known_us", "key", "value", "deleted")]
            of = numbers[at]
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                held.add(int(of[lo]), *[c[lo:hi] for c in columns])
        at = np.flatnonzero(is_event)
        if len(at):
            rows = batch.take(pa.array(at))
            state, value = held.find(numbers[at], rows["known_us"].to_numpy(), rows["key"].to_numpy())
            yield pa.record_batch([*[rows[c] for c in carry], pa.array(STATES).take(pa.array(state)), value], [*carry, "state", "value"])


def heavy(asked: DataFrame) -> dict[str, int]:
    """Salts of the entities with the most events, at most HEAVY of them."""
    counted = asked.groupBy("entity").count().filter(F.col("count") > EVENTS_PER_SALT)
    return {r[0]: -(-r[1] // EVENTS_PER_SALT) for r in counted.orderBy(F.col("count").desc(), "entity").limit(HEAVY).collect()}


def stream(asked: DataFrame, versions: DataFrame, carry: list[str]) -> DataFrame:
    """Versions and events in one shape: ``entity, salt, is_event``, what is searched, and the carried columns."""
    spread = heavy(asked)
    one = versions.filter("entity is not null and known_us is not null and key is not null").groupBy("entity", "known_us", "key").agg(F.max(F.struct("deleted", "value")).alias("v"))
    ahead, after = one.withColumn("salt", F.lit(0)), asked.withColumn("salt", F.lit(0))
    if spread:
        salts = F.broadcast(asked.sparkSession.createDataFrame(list(spread.items()), "entity string, salts int"))
        ahead = one.join(salts, "entity", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        place = F.xxhash64(F.monotonically_increasing_id())  # hashed: hot events may stand at every second place
        after = asked.withColumn("__place", place).join(salts, "entity", "left").withColumn("salt", F.coalesce(F.pmod("__place", F.col("salts")), F.lit(0)).cast("int"))
    typed = {"entity": "string", "known_us": "long", "key": "long"}
    kinds = dict(asked.select(*carry).dtypes)
    versioned = ahead.select(
        "salt", F.lit(0).alias("is_event"), *[F.col(c).cast(t).alias(c) for c, t in typed.items()], F.col("v.value").cast("string").alias("value"), F.coalesce("v.deleted", F.lit(False)).alias("deleted"),
        *[F.lit(None).cast(t).alias(f"c_{k}") for k, t in kinds.items()],
    )
    events = after.select(
        "salt", F.lit(1).alias("is_event"), *[F.col(c).cast(t).alias(c) for c, t in typed.items()], F.lit(None).cast("string").alias("value"), F.lit(False).alias("deleted"),
        *[F.col(k).alias(f"c_{k}") for k in kinds],
    )
    return versioned.unionByName(events)


def lookup(events: DataFrame, versions: DataFrame, carry: list[str]) -> DataFrame:
    """The attribute of each event: the columns ``carry``, ``state`` and ``value``.

    ``events``: entity, ``known_us``, ``key`` (valid-time probe; TOP for the last) and the
    columns to carry.  ``versions``: entity, ``known_us``, ``key``, ``value``, ``deleted``.
    Counting the events of each entity is a job of its own, run when this is called.
    """
    ship(events.sparkSession)
    usable = F.col("entity").isNotNull() & F.col("known_us").isNotNull() & F.col("key").isNotNull()
    none = events.filter(~usable).select(*carry, F.lit("NO_KEY").alias("state"), F.lit(None).cast("string").alias("value"))
    # Events are taken in any order; only the versions of an entity must come ahead and in order of known time.
    first = [F.when(F.col("is_event") == 0, F.col(c)) for c in ("known_us", "key")]
    ordered = stream(events.filter(usable), versions, carry).repartition("entity", "salt").sortWithinPartitions("entity", "salt", "is_event", *first)
    held = [f"c_{k}" for k in carry]
    kinds = dict(events.select(*carry).dtypes)
    schema = ", ".join([*[f"`c_{k}` {kinds[k]}" for k in carry], "state string", "value string"])
    found = ordered.mapInArrow(lambda it: _serve(it, held), schema)
    return found.select(*[F.col(f"c_{k}").alias(k) for k in carry], "state", "value").unionByName(none)
