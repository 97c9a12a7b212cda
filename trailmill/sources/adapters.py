"""Sources of activities: what an adapter is, their registry, listings as DataFrames, and a stream over them.

An adapter lists what a user has recorded since an instant, fetches a payload,
says whether something is gone, and accepts notifications.  It is a small
picklable object; Spark calls it in tasks, one account a task at most, so
accounts are listed side by side and a source that fails is a row, not an end.

``ActivityStream`` is a streaming source over a registered adapter: offsets are
instants of listing, partitions are users, and a restarted query reads on from
the last committed instant.  It lists an overlap before that again, for what
arrived late under an earlier start; ``accepted`` lets each activity through once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LISTED = "user_id long, source string, external_id string, started_at timestamp, raw string, error string"
REAUTH = "reauth"


class UnknownSource(LookupError):
    """No adapter of this name is registered."""


class Reauth(RuntimeError):
    """The account must be connected again."""


class Adapter:
    """What a source must offer; ``id`` names it."""

    id: str

    def list_since(self, user_id: int, since: datetime) -> Iterator[tuple[str, datetime]]:
        """(external id, start) of the user's activities that start after ``since``."""
        raise NotImplementedError

    def fetch(self, user_id: int, external_id: str) -> str:
        """The payload as it came."""
        raise NotImplementedError

    def gone(self, user_id: int, external_id: str) -> bool:
        """Whether the source confirms that it has this no more."""
        raise NotImplementedError


@dataclass(frozen=True)
class FolderAdapter(Adapter):
    """Activities as lines {"id", "started_at", "payload"} of a file per user, in any store that Arrow reads."""

    id: str
    path: str

    def _lines(self, user_id: int) -> list[dict]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        name = f"{path.rstrip('/')}/{user_id}.jsonl"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            return []
        with store.open_input_stream(name) as f:
            lines = f.read().decode().splitlines()
        found = [json.loads(x) for x in lines if x.strip()]
        if any(x.get("reauth") for x in found):
            raise Reauth(f"{self.id} asks user {user_id} to connect again")
        return found

    def list_since(self, user_id: int, since: datetime) -> Iterator[tuple[str, datetime]]:
        for x in self._lines(user_id):
            at = datetime.fromisoformat(x["started_at"])
            if at > since:
                yield x["id"], at

    def fetch(self, user_id: int, external_id: str) -> str:
        return next(x for x in self._lines(user_id) if x["id"] == external_id)["payload"]

    def gone(self, user_id: int, external_id: str) -> bool:
        return all(x["id"] != external_id for x in self._lines(user_id))


class Registry:
    """Adapters by name."""

    def __init__(self, *adapters: Adapter):
        self._known = {a.id: a for a in adapters}
        if len(self._known) != len(adapters):
            raise ValueError("two adapters of one name")

    def ids(self) -> list[str]:
        return sorted(self._known)

    def of(self, source: str) -> Adapter:
        if source not in self._known:
            raise UnknownSource(f"no source {source!r}; there are {', '.join(self.ids()) or 'none'}")
        return self._known[source]


def listed_of(adapter: Adapter, user_id: int, since: datetime) -> Iterator[tuple]:
    """Rows of LISTED.  A payload that cannot be fetched is a row with its error; a listing that breaks off ends in a row without an id."""
    try:
        for external_id, at in adapter.list_since(user_id, since):
            try:
                raw, error = adapter.fetch(user_id, external_id), None
            except Exception as e:  # one activity fails, the others go on
                raw, error = None, type(e).__name__
            yield user_id, adapter.id, external_id, at, raw, error
    except Reauth:
        yield user_id, adapter.id, None, None, None, REAUTH
    except Exception as e:
        yield user_id, adapter.id, None, None, None, type(e).__name__


def listings(accounts: DataFrame, registry: Registry) -> DataFrame:
    """LISTED rows of (user_id, source, list_from); an unknown source is an error before anything is listed."""
    for r in accounts.select("source").distinct().collect():  # as many as there are kinds of sources
        registry.of(r["source"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in frame.itertuples(index=False):
                rows = list(listed_of(registry.of(a.source), int(a.user_id), a.list_from.to_pydatetime().replace(tzinfo=timezone.utc)))
                out = pd.DataFrame(rows, columns=["user_id", "source", "external_id", "started_at", "raw", "error"])
                out["started_at"] = pd.to_datetime(out["started_at"], utc=True)
                yield out

    return accounts.select("user_id", "source", F.col("list_from").cast("timestamp").alias("list_from")).repartition("user_id", "source").mapInPandas(each, LISTED)


class _Account(InputPartition):
    def __init__(self, user_id: int, start: str, end: str):
        super().__init__(user_id)
        self.user_id, self.start, self.end = user_id, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, adapter: Adapter, users: list[int], since: str, overlap_s: int):
        self.adapter, self.users, self.since, self.overlap = adapter, users, since, timedelta(seconds=overlap_s)

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def latestOffset(self) -> dict:
        return {"at": datetime.now(timezone.utc).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[_Account]:
        since = (datetime.fromisoformat(start["at"]) - self.overlap).isoformat()
        return [_Account(u, since, end["at"]) for u in self.users]

    def read(self, partition: _Account) -> Iterator[tuple]:
        end = datetime.fromisoformat(partition.end)
        for row in listed_of(self.adapter, partition.user_id, datetime.fromisoformat(partition.start)):
            if row[3] is None or row[3] <= end:
                yield row

    def commit(self, end: dict) -> None:
        """Nothing to give back: the source keeps what it has."""


def stream_source(registry: Registry) -> type[DataSource]:
    """A data source "activities" over these adapters, to be registered with a session.

    Options: source, users (comma-separated), since (an instant), overlap_s.
    """

    class ActivityStream(DataSource):
        @classmethod
        def name(cls) -> str:
            return "activities"

        def schema(self) -> str:
            return LISTED

        def streamReader(self, schema) -> DataSourceStreamReader:
            users = [int(u) for u in self.options["users"].split(",")]
            return _Reader(registry.of(self.options["source"]), users, self.options.get("since", "1970-01-01T00:00:00+00:00"), int(self.options.get("overlap_s", 0)))

    return ActivityStream


def accepted(stream: DataFrame, keep: str = "90 days") -> DataFrame:
    """Fetched activities of a stream, each once."""
    from trailmill.streaming.cells import accepted_once

    rows = stream.filter("external_id IS NOT NULL AND error IS NULL")
    return accepted_once(rows.withColumn("key", F.concat_ws(":", "source", F.col("user_id").cast("string"), "external_id")), "key", "started_at", keep)
