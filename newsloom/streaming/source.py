"""Feeds as a stream: each entry of each feed once, whatever is restarted.

An offset is the number of a poll. What a poll learned of a feed is spooled in a shared folder by the task that
fetched it: the new entries, and the feed's own position (ETag, date, the entries shown so far). A batch that runs
again, in a task or after a restart from the checkpoint, reads the spool and not the feed, so it gives the same rows
though the feed has changed; the next poll starts at the positions of the one before. Committed polls are removed but
for the last, which holds the positions.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from newsloom.sources.feeds import ENTRY, ERROR_CHARS, PAUSE_S, REQUEST, answer, entries_of

POLLED = f"{REQUEST}, error string, entries array<struct<{', '.join(f'{n}: string' for n in ENTRY)}>>"
#: An entry that a feed hasn't shown for that many polls comes again if it is shown then.
REMEMBERED_POLLS = 500


class Spool:
    """Records by poll and feed, in a folder that driver and executors share."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = arrow_fs.FileSystem.from_uri(uri)

    def polls(self) -> list[int]:
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def _place(self, poll: int, feed: str) -> str:
        return f"{self.root}/{poll}/{feed}.json"

    def read(self, poll: int, feed: str) -> dict | None:
        try:
            with self.fs.open_input_stream(self._place(poll, feed)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, poll: int, feed: str, record: dict) -> dict:
        """The record that counts: another attempt's, if it was there first."""
        if (there := self.read(poll, feed)) is not None:
            return there
        self.fs.create_dir(f"{self.root}/{poll}")
        new = f"{self._place(poll, feed)}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(new) as f:
            f.write(json.dumps(record).encode())
        self.fs.move(new, self._place(poll, feed))
        return record

    def forget_before(self, poll: int) -> None:
        for n in self.polls():
            if n < poll:
                self.fs.delete_dir(f"{self.root}/{n}")


def feed_id(request: dict) -> str:
    return hashlib.sha1(f"{request['kind']} {request['url']}".encode()).hexdigest()


def entry_id(entry: dict) -> str:
    return hashlib.sha1((entry["link"] or f"title {entry['title']}").encode()).hexdigest()


def poll_feed(request: dict, poll: int, before: dict | None, wait_s: float) -> dict:
    """The record of a feed after this poll: its position, and the entries that it hadn't shown."""
    position = before or {"etag": None, "modified": None, "shown": {}}
    record = {**position, "entries": [], "error": None}
    headers = {name: position[key] for name, key in (("If-None-Match", "etag"), ("If-Modified-Since", "modified")) if position[key]}
    try:
        body, told = answer(request["url"], headers, wait_s=wait_s)
        found = {entry_id(e): e for e in reversed(entries_of(body))}  # of equal ones the first
    except urllib.error.HTTPError as e:
        if e.code == 304:  # as it was: all that it showed is still shown
            latest = max(position["shown"].values(), default=poll)
            return record | {"shown": {k: poll if n == latest else n for k, n in position["shown"].items()}}
        return record | {"error": f"HTTPError: {e}"[:ERROR_CHARS]}
    except ET.ParseError as e:
        return record | {"error": f"ParseError: {e}"[:ERROR_CHARS]}
    except Exception as e:  # reported as this feed's status; its position stays
        return record | {"error": f"{type(e).__name__}: {e}"[:ERROR_CHARS]}
    shown = {k: n for k, n in position["shown"].items() if poll - n <= REMEMBERED_POLLS}
    new = [e for k, e in reversed(found.items()) if k not in shown]
    return {"etag": told.get("etag"), "modified": told.get("last-modified"), "shown": shown | dict.fromkeys(found, poll), "entries": new, "error": None}


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, requests: list[dict], spool: str, pause_s: float, wait_s: float) -> None:
        self.requests, self.spool, self.pause_s, self.wait_s = requests, spool, pause_s, wait_s

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        """One poll more than was begun: a poll is spooled only after its offset was logged."""
        return {"poll": max(Spool(self.spool).polls(), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        polls = list(range(start["poll"] + 1, end["poll"] + 1))
        slow = [r for r in self.requests if r["kind"] == "google"]
        groups = [[r] for r in self.requests if r["kind"] != "google"] + ([slow] if slow else [])
        return [InputPartition((polls, g)) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        polls, requests = partition.value
        spool, fetched = Spool(self.spool), 0
        for poll in polls:
            for r in requests:
                feed = feed_id(r)
                record = spool.read(poll, feed)
                if record is None:
                    if fetched:
                        time.sleep(self.pause_s)
                    fetched += 1
                    record = spool.write(poll, feed, poll_feed(r, poll, spool.read(poll - 1, feed), self.wait_s))
                entries = [tuple(e[n] for n in ENTRY) for e in record["entries"]]
                yield r["kind"], r["position"], r["label"], r["url"], r["name"], r["source_topics"], record["error"], entries

    def commit(self, end: dict) -> None:
        Spool(self.spool).forget_before(end["poll"])


class FeedStreamSource(DataSource):
    """Options: requests (JSON of requests_of), spool (a shared folder, one for each query), pause and wait as in a batch."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_feed_stream"

    def schema(self) -> str:
        return POLLED

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(json.loads(self.options["requests"]), self.options["spool"], float(self.options.get("pause", PAUSE_S)), float(self.options.get("wait", 2.0)))


def feed_stream(spark: SparkSession, requests: list[dict], spool: str, pause_s: float = PAUSE_S, wait_s: float = 2.0) -> DataFrame:
    """A stream of feeds with their new entries, as `items` and `statuses` take them; a micro-batch is a poll of all.

    A feed that is taken out of the list for a poll begins anew. Equal links in one feed are one entry; an entry
    without a link goes by its title.
    """
    spark.dataSource.register(FeedStreamSource)
    return spark.readStream.format("newsloom_feed_stream").options(requests=json.dumps(requests), spool=spool, pause=pause_s, wait=wait_s).load()
