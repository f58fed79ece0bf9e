"""A mailbox as a stream: messages by their numbers, marked as seen only after the sink has them.

``spark.readStream.format("mailbox")`` gives (uid, content). Offsets are message numbers, which a mailbox hands out in rising order
and never again, so that what a batch holds follows from its offsets: one that failed is read again, the same messages, and
those of a batch that was stored are not. Contents are fetched by the tasks, ``share`` messages each, without marking them; the driver
knows numbers only. Marks are set when Spark commits an offset, which is after the batch's sink has returned.

A mailbox is named by option ``store``, "module:name" of what makes one from the options: a ``Store``, here ``imap`` or ``folder``.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "mailbox"


class Store(Protocol):
    """What a mailbox can do."""

    def unseen(self, after: int) -> list[int]:
        """Numbers of messages above ``after`` without a mark, in order."""

    def fetch(self, uids: list[int]) -> Iterator[tuple[int, bytes]]:
        """Messages by number, unmarked; what is gone is passed over."""

    def mark(self, after: int, last: int) -> None:
        """Mark the messages above ``after`` up to ``last`` as seen."""


class folder:  # noqa: N801  # named as an option
    """Files <uid>.eml in a folder that driver and executors share; a mark is an empty file <uid>.seen."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _numbers(self, ending: str) -> set[int]:
        return {int(stem) for stem, dot, kind in (f.partition(".") for f in os.listdir(self.path)) if kind == ending and stem.isdigit()}

    def unseen(self, after: int) -> list[int]:
        return sorted(u for u in self._numbers("eml") - self._numbers("seen") if u > after)

    def fetch(self, uids: list[int]) -> Iterator[tuple[int, bytes]]:
        for uid in uids:
            try:
                with open(f"{self.path}/{uid}.eml", "rb") as f:
                    yield uid, f.read()
            except FileNotFoundError:
                continue

    def mark(self, after: int, last: int) -> None:
        for uid in self.unseen(after):
            if uid <= last:
                open(f"{self.path}/{uid}.seen", "wb").close()


class imap:  # noqa: N801  # named as an option
    """A folder of an IMAP server: options host, user, password, and mailbox (INBOX)."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _open(self, readonly: bool):
        import imaplib

        server = imaplib.IMAP4_SSL(self.options["host"], int(self.options.get("port", "993")))
        server.login(self.options["user"], self.options["password"])
        server.select(self.options.get("mailbox", "INBOX"), readonly=readonly)
        return server

    def unseen(self, after: int) -> list[int]:
        with self._open(True) as server:
            found = server.uid("SEARCH", None, f"(UNSEEN UID {after + 1}:*)")[1][0] or b""
        return sorted(u for u in map(int, found.split()) if u > after)  # a range that ends with * holds the last message in any case

    def fetch(self, uids: list[int]) -> Iterator[tuple[int, bytes]]:
        with self._open(True) as server:
            for uid in uids:
                got = server.uid("FETCH", str(uid), "(BODY.PEEK[])")[1]
                if got and isinstance(got[0], tuple):
                    yield uid, got[0][1]

    def mark(self, after: int, last: int) -> None:
        if last > after:
            with self._open(False) as server:
                server.uid("STORE", f"{after + 1}:{last}", "+FLAGS.SILENT", r"(\Seen)")


def opened(options: dict[str, str]) -> Store:
    module, _, name = options["store"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Some(InputPartition):
    uids: list[int]


class MailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.first = dict(options), int(options.get("after", "0"))
        self.marked = self.first  # all up to here is stored
        self.store, self.share = opened(self.options), int(options.get("share", "16"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"uid": self.first}  # a first batch that failed begins here again

    def latestOffset(self) -> dict:  # noqa: N802
        found = self.store.unseen(self.marked)
        return {"uid": found[-1] if found else self.marked}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        uids = [u for u in self.store.unseen(start["uid"]) if u <= end["uid"]]
        return [Some(uids[i : i + self.share]) for i in range(0, len(uids), self.share)]

    def read(self, partition: Some) -> Iterator[tuple[int, bytes]]:
        yield from self.store.fetch(partition.uids)

    def commit(self, end: dict) -> None:
        self.store.mark(self.first, end["uid"])
        self.marked = max(self.marked, end["uid"])


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "uid bigint, content binary"

    def streamReader(self, schema) -> MailReader:  # noqa: N802
        return MailReader({"store": "tallymark.sources.mail:folder", **self.options})
