"""Rooms in which two players meet: presence, one start for both, running scores and reactions, as keyed streaming state.

A room's first two players are its members; anyone else is refused. The start is set once, `COUNTDOWN` after the moment when
both are present, and whoever greets the room later gets that same moment and the rival's score. Answers count from the start on;
a player's reactions within `COOLDOWN` of their last one sent are dropped. All but joining needs a present member. A room without
an event for `IDLE` is closed: by an event-time timer, which drops its state, or by the next event if that comes before the timer
fires, so that it doesn't depend on the batches. What comes later opens the room anew.

State is one value (start, latest event) and one map by member, so a room costs the same whatever its history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds from both being present to the start, and between two reactions of a player.
COUNTDOWN, COOLDOWN = 5, 2
IDLE = 24 * 3600

MESSAGES = "room long, event_id long, player long, kind string, at long, score long"
FIELDS = [f.split()[0] for f in MESSAGES.split(", ")]


@dataclass
class Member:
    present: bool = False
    score: int = 0
    reacted: int | None = None


@dataclass
class Room:
    """A room between two events; times are milliseconds."""

    start: int | None = None
    members: dict[int, Member] = field(default_factory=dict)

    def messages(self, now: int, player: int, kind: str, points: int, countdown: int, cooldown: int) -> Iterator[tuple[str, int | None, int | None]]:
        """What the room sends on an event: (kind, moment, score)."""
        if kind == "join":
            if player not in self.members and len(self.members) == 2:
                yield "refused", None, None
                return
            member = self.members.setdefault(player, Member())
            if not member.present:
                member.present = True
                yield "join", None, None
            if self.start is None and sum(m.present for m in self.members.values()) == 2:
                self.start = now + countdown * 1000
                yield "start", self.start, None
            return
        member = self.members.get(player)
        if member is None or not member.present:
            return
        if kind == "leave":
            member.present = False
            yield "leave", None, None
        elif kind == "hello":
            yield "board", None, sum(m.score for p, m in self.members.items() if p != player)
            if self.start is not None:
                yield "start", self.start, None
        elif kind == "emoji":
            if member.reacted is None or now - member.reacted >= cooldown * 1000:
                member.reacted = now
                yield "emoji", None, None
        elif kind == "answer" and self.start is not None and now >= self.start:
            member.score += points
            yield "score", None, member.score


class Duel(StatefulProcessor):
    """Keeps rooms in the state store, reads a room's state once a batch and writes it back once."""

    def __init__(self, countdown: int, cooldown: int, idle: int) -> None:
        self.countdown, self.cooldown, self.idle = countdown, cooldown, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.room = handle.getValueState("room", "start long, latest long")
        self.members = handle.getMapState("members", "player long", "present boolean, score long, reacted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, latest = self.room.get() if self.room.exists() else (None, None)
        held = {p[0]: Member(*v) for p, v in self.members.iterator()} if self.members.exists() else {}
        room = Room(start, held)
        out = []
        found = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "event_id"])
        for e in found.itertuples(index=False):
            if latest is not None and e.ms - latest > self.idle * 1000:
                out.append((key[0], None, None, "closed", latest + self.idle * 1000, None))
                room = Room()
                self.members.clear()
            sent = room.messages(int(e.ms), int(e.player), e.kind, int(e.points), self.countdown, self.cooldown)
            out += [(key[0], int(e.event_id), int(e.player), *message) for message in sent]
            latest = max(int(e.ms), latest or 0)
        self.room.update((room.start, latest))
        for player, m in room.members.items():
            self.members.updateValue((player,), (m.present, m.score, m.reacted))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(max(latest + self.idle * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, latest = self.room.get()
        self.room.clear()
        self.members.clear()
        yield frame([(key[0], None, None, "closed", latest + self.idle * 1000, None)])

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=FIELDS)
    return out.astype({c: "object" if c == "kind" else "Int64" for c in FIELDS})


#: The state store that keyed state of several parts needs; set it before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def duel_messages(events: DataFrame, countdown: int = COUNTDOWN, cooldown: int = COOLDOWN, idle: int = IDLE) -> DataFrame:
    """MESSAGES of a stream of events (room, event_id, player, kind, points, ts) with a watermark on ts.

    kind is join, leave, hello, emoji or answer; other kinds send nothing. Events of one batch are taken in order of time."""
    slim = events.selectExpr("room", "ts", "event_id", "player", "kind", "coalesce(points, 0) as points", "unix_millis(ts) as ms")
    return slim.groupBy("room").transformWithStateInPandas(Duel(countdown, cooldown, idle), MESSAGES, "append", "eventTime")
