"""Stateful operators: alert re-fire limit, reliability averages, conversation context.

Each keeps a small state per key (a time, four numbers, the last ten turns) in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evigraph.functions import text as tx
from evigraph.operators.fusion import LEARNING_RATE, RELIABILITY
from evigraph.operators.monitoring import ALERT_RULES, REFIRE_SECONDS, alert_candidates

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TIME = "fired DOUBLE"
_ALERT = "name STRING, severity STRING, message STRING, ts TIMESTAMP"


class AlertGate(StatefulProcessor):
    """Lets a rule's hit through when its last alert is more than the limit ago."""

    def __init__(self, seconds: float = REFIRE_SECONDS):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", _TIME)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.fired.get()[0] if self.fired.exists() else None
        hits = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        keep = []
        for i, at in zip(hits.index, hits["ts"].map(lambda t: t.timestamp())):
            if last is None or at - last > self.seconds:
                keep.append(i)
                last = at
        if keep:
            self.fired.update((float(last),))
        yield hits.loc[keep, ["name", "severity", "message", "ts"]].reset_index(drop=True)

    def close(self) -> None:
        pass


def alerts(stats: DataFrame, rules: Sequence[tuple[str, str, str, str]] = ALERT_RULES, seconds: float = REFIRE_SECONDS) -> DataFrame:
    """Alerts from a stream (or batch) of statistics rows ``ts, error_rate, ...``."""
    hits = alert_candidates(stats, rules)
    return hits.groupBy("name").transformWithStateInPandas(AlertGate(seconds), _ALERT, "Append", "None")


def deliver(alert_rows: DataFrame, handlers: Sequence[Callable[[DataFrame, int], None]], checkpoint: str):
    """Start a query that hands every batch of alerts to the handlers; an empty batch goes unreported."""

    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # the check and every handler read one evaluation of the batch
        try:
            if not held.isEmpty():
                for handler in handlers:
                    handler(held, batch_id)
        finally:
            held.unpersist()

    return alert_rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).start()


_REL = "source_type STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, batches BIGINT"


def reliability(confusion: DataFrame, alpha: float = LEARNING_RATE) -> DataFrame:
    """Moving averages per source from a stream of ``source_type, batch, tp, fp, fn, tn`` rows (update mode)."""
    start = {name: (a, p, r) for name, a, p, r, _ in RELIABILITY}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, p, r, n = state.get if state.exists else (*start.get(key[0], (0.5, 0.5, 0.5)), 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values("batch", kind="stable")
        for tp, fp, fn, tn in rows[["tp", "fp", "fn", "tn"]].itertuples(index=False):
            if tp + fp + fn + tn == 0:
                continue
            a += alpha * ((tp + tn) / (tp + fp + fn + tn) - a)
            p += alpha * ((tp / (tp + fp) if tp + fp else 0.0) - p)
            r += alpha * ((tp / (tp + fn) if tp + fn else 0.0) - r)
            n += 1
        state.update((float(a), float(p), float(r), int(n)))
        yield pd.DataFrame({"source_type": [key[0]], "accuracy": [a], "precision": [p], "recall": [r], "batches": [n]})

    return confusion.groupBy("source_type").applyInPandasWithState(
        step, _REL, "accuracy DOUBLE, precision DOUBLE, recall DOUBLE, batches BIGINT", "update", GroupStateTimeout.NoTimeout)


_TURN = "turn INT, topics ARRAY<STRING>, entities ARRAY<STRING>"
_CONTEXT = "conv_id BIGINT, turn INT, kept_turns INT, recent_entities ARRAY<STRING>, topics ARRAY<STRING>, overlapping_turns ARRAY<INT>"


class ConversationContext(StatefulProcessor):
    """Keeps all topics and the last turns of a conversation and relates every new turn to the three before it."""

    def __init__(self, max_turns: int = 10, look_back: int = 3):
        self.max_turns, self.look_back = max_turns, look_back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", _TURN)
        self.topics = handle.getValueState("topics", "topics ARRAY<STRING>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(t[0]), list(t[1]), list(t[2])) for t in self.turns.get()] if self.turns.exists() else []
        told = set(self.topics.get()[0]) if self.topics.exists() else set()
        for frame in rows:
            out = []
            for turn, topics, entities in frame.sort_values("turn")[["turn", "topics", "entities"]].itertuples(index=False):
                names = set(entities)
                shared = [(t, len(names & set(e))) for t, _, e in kept[-self.look_back:]]
                best = [t for t, n in sorted(shared, key=lambda x: (-x[1], x[0])) if n]
                kept = (kept + [(int(turn), list(topics), list(entities))])[-self.max_turns:]
                told |= set(topics)
                recent = sorted({e for _, _, es in kept[-self.look_back:] for e in es})
                out.append((key[0], int(turn), len(kept), recent, sorted(told), best))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "kept_turns", "recent_entities", "topics", "overlapping_turns"])
        self.turns.put(kept)
        self.topics.update((sorted(told),))

    def close(self) -> None:
        pass


_SEEN = "mentions BIGINT, first INT, last INT, turns ARRAY<INT>, confidences ARRAY<DOUBLE>"
_TIMELINE = "conv_id BIGINT, entity STRING, mentions BIGINT, first_mention INT, last_mention INT, confidence_trend ARRAY<DOUBLE>"


class EntityTimeline(StatefulProcessor):
    """Keeps a map from entity to its mentions in a conversation; a batch reads and writes the entities it names only."""

    def __init__(self, trend: int = 3):
        self.trend = trend

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "entity STRING", _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        named: dict[str, list] = {}
        for frame in rows:
            for turn, entity, confidence in frame[["turn_no", "entity", "confidence"]].itertuples(index=False):
                if entity not in named:
                    held = self.seen.getValue((entity,)) if self.seen.containsKey((entity,)) else None
                    named[entity] = [held[0], held[1], held[2], list(zip(held[3], held[4]))] if held else [0, turn, turn, []]
                state = named[entity]
                last = sorted([*state[3], (int(turn), float(confidence))])[-self.trend:]
                named[entity] = [state[0] + 1, min(state[1], turn), max(state[2], turn), last]
        out = []
        for entity, (mentions, first, last, recent) in named.items():
            turns, confidences = [int(t) for t, _ in recent], [float(c) for _, c in recent]
            self.seen.updateValue((entity,), (int(mentions), int(first), int(last), turns, confidences))
            out.append((key[0], entity, int(mentions), int(first), int(last), confidences))
        yield pd.DataFrame(out, columns=["conv_id", "entity", "mentions", "first_mention", "last_mention", "confidence_trend"])

    def close(self) -> None:
        pass


def entity_timeline(entities: DataFrame, trend: int = 3) -> DataFrame:
    """Timelines of the entities that a batch of rows ``conv_id, turn_no, entity, confidence`` names (update mode).

    An entity's latest row equals that of the batch operator. Rows may come late and in any order; rows
    without an entity or confidence are left out.
    """
    rows = entities.where(F.col("entity").isNotNull() & F.col("confidence").isNotNull()).select(
        F.col("conv_id").cast("bigint"), F.col("turn_no").cast("int"), "entity", F.col("confidence").cast("double"))
    return rows.groupBy("conv_id").transformWithStateInPandas(EntityTimeline(trend), _TIMELINE, "Update", "None")


def conversation_context(turns: DataFrame, max_turns: int = 10) -> DataFrame:
    """Context per turn from a stream of turns ``conv_id, turn, user_query, entities``."""
    names = F.transform("entities", lambda e: e["concept_name"])
    kinds = F.transform("entities", lambda e: e["concept_type"])
    rows = turns.select("conv_id", "turn", tx.topics(F.col("user_query"), kinds).alias("topics"), names.alias("entities"))
    return rows.groupBy("conv_id").transformWithStateInPandas(ConversationContext(max_turns), _CONTEXT, "Append", "None")
