"""Incremental maintenance: file events, document versions, throttling; in batch form and as streams.

Event time, watermarks and exactly-once sinks are extensions: the reference applies events in the order they arrive.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import names
from ..operators.classpath import longest_root
from ..operators.store import put_resources


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key. max_by combines before the shuffle, so a key with many events is no hot spot."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in rest])


def applicable(events: DataFrame, roots: list[str], uri: str = "uri") -> DataFrame:
    """Events of .java files under a root, with the longest root that claims them and the path below it."""
    java = events.where(F.endswith(F.col(uri), F.lit(".java")) & ~names.is_skipped_file(uri) & ~names.is_module_info(uri))
    rooted = java.join(longest_root(java, uri, [r if r.endswith("/") else r + "/" for r in roots]).where("root is not null"), uri)
    return rooted.withColumn("resource_path", F.substr(F.col(uri), F.length("root") + 1))


def apply_events(types: DataFrame, events: DataFrame, order: list[str], parse: Callable[[DataFrame], DataFrame], key: str = "uri", change: str = "change_type", deleted: str = "Deleted") -> DataFrame:
    """types after a batch of events: each key's last event counts; a deletion removes its rows, anything else replaces
    them by what `parse` makes of the events. parse returns rows with the key; a file that is gone gives none."""
    last = latest(events, key, order)
    return put_resources(types, last, parse(last.where(F.col(change) != deleted)), [key])


def throttled(events: DataFrame, ts: str, seconds: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Refreshes by whole windows of `seconds`: the events of a window are absorbed by one. Micros of the window's start."""
    width = seconds * 1_000_000
    start = F.expr(f"unix_micros(cast({ts} as timestamp)) div {width}") * width
    return events.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("events"))


def latest_versions(versions: DataFrame, uri: str, version: str, text: str) -> DataFrame:
    """The text of each document's highest version; of equal ones the largest text."""
    return versions.groupBy(uri).agg(F.max_by(text, F.struct(version, text)).alias(text), F.max(version).alias(version))


def still_current(results: DataFrame, documents: DataFrame, uri: str, version: str) -> DataFrame:
    """Results whose document has not moved on."""
    return results.join(documents.select(uri, version), [uri, version], "left_semi")


# --- streams ----------------------------------------------------------------------------------------------------------


def event_stream(events: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, order: list[str], key: str = "uri", listeners: tuple[Callable[[int], None], ...] = (), once: bool = True) -> StreamingQuery:
    """Applies each micro-batch's last events by key, then tells the listeners; a listener's failure is its own."""

    def run(batch: DataFrame, number: int) -> None:
        apply(latest(batch, key, order))
        for tell in listeners:
            try:
                tell(number)
            except Exception:
                logging.getLogger(__name__).exception("a listener failed on batch %d", number)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def windowed_refreshes(events: DataFrame, ts: str = "ts", late: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Refreshes by event time: a window's count once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("events"))


def document_store(changes: DataFrame, uri: str = "uri", version: str = "version", text: str = "text", kind: str = "kind") -> DataFrame:
    """The documents after each micro-batch, with state: open and change keep the last full text, close drops it.

    A change without a version counts one up; of a batch's changes the last in order of `seq` wins, in whatever order they
    come. Of the texts only the last is held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None)
        steps, last = [], None
        for rows in batches:
            for r in rows.itertuples():
                steps.append((r.seq, getattr(r, kind), getattr(r, version)))
                if last is None or r.seq >= last[0]:
                    last = (r.seq, getattr(r, text))
        for _, what, known in sorted(steps, key=lambda s: s[0]):
            now = (None, None) if what == "close" else (int(known) if pd.notna(known) else (now[0] or 0) + 1, last[1])
        if now[0] is None:
            state.remove()
            yield pd.DataFrame({"uri": [key[0]], "version": [None], "text": [None]})
        else:
            state.update(now)
            yield pd.DataFrame({"uri": [key[0]], "version": [now[0]], "text": [now[1]]})

    return changes.groupBy(F.col(uri).alias("uri")).applyInPandasWithState(step, "uri string, version long, text string", "version long, text string", "update", GroupStateTimeout.NoTimeout)


def is_change(kind: Column) -> Column:
    return kind != "close"
