"""A log of numbered commits in a folder: what makes a change of stored data visible, all of it or nothing.

A commit is a small JSON file that is put under the next number, and only if no file has that number: of two writers one gets it and the other reads what came
in between. Every ``CHECKPOINT_EVERY`` commits the state is written whole beside the log, so that a reader replays few files."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import SparkSession

CHECKPOINT_EVERY = 20
#: Named commits that are remembered, so that running one again changes nothing.
NAMES_KEPT = 10_000


class Conflict(RuntimeError):
    """Another writer changed what this change was worked out from."""


class Files:
    """Hadoop's file systems, for the few small files that a driver reads and writes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder, none if there is no such folder."""
        fs = self.system(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(self.path(folder))) if fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.system(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.system(name).create(self.path(name), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether ``name`` now holds ``text``; False if there was such a file. Readers never see a part of it.

        A local file is linked into place, elsewhere the rename of a file system that refuses an existing target is what decides (HDFS does)."""
        folder, last = name.rsplit("/", 1)
        part = f"{folder}/_{last}.{uuid.uuid4().hex}"
        self.write(part, text)
        try:
            if str(self.system(name).getUri().getScheme()) == "file":
                try:
                    os.link(urlparse(part).path, urlparse(name).path)
                except FileExistsError:
                    return False
                return True
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            how = self.spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.spark._jsc.hadoopConfiguration())
            try:
                context.rename(self.path(part), self.path(name), how)
            except Exception:
                if self.exists(name):
                    return False
                raise
            return True
        finally:
            self.delete(part)


@dataclass
class State:
    """What is live after ``version`` commits: folder -> what its commit said about it, with the commit's number as ``v``."""

    version: int = 0
    live: dict[str, dict] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    def applied(self, number: int, entry: dict) -> State:
        live = {k: v for k, v in self.live.items() if k not in set(entry.get("remove", []))}
        for folder, parts in entry.get("shrink", {}).items():
            left = [p for p in live[folder]["parts"] if p not in parts]
            live = {k: v for k, v in live.items() if k != folder} if not left else live | {folder: live[folder] | {"parts": left}}
        live |= {k: v | {"v": number} for k, v in entry.get("add", {}).items()}
        names = [*self.names, entry["name"]][-NAMES_KEPT:] if entry.get("name") else self.names
        return State(number, live, names, self.settings | entry.get("settings", {}))


class CommitLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.files, self.folder = Files(spark), f"{root.rstrip('/')}/_log"
        self._last = State()  # commits never change: what was read once need not be read again

    def _numbers(self) -> tuple[list[int], list[int]]:
        names = self.files.names(self.folder)
        return [int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n)], [int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.state", n)]

    def entry(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number:012d}.json"))

    def state(self, version: int | None = None) -> State:
        """The state after the latest commit, or after an earlier ``version``."""
        commits, whole = self._numbers()
        last = max(commits, default=0) if version is None else version
        base = max((n for n in whole if n <= last), default=0)
        if base <= self._last.version <= last:
            state = self._last
        else:
            state = State(**json.loads(self.files.read(f"{self.folder}/{base:012d}.state"))) if base else State()
        for number in range(state.version + 1, last + 1):
            state = state.applied(number, self.entry(number))
        if version is None:
            self._last = state
        return state

    def commit(self, entry: dict, base: State, disturbs) -> State:
        """Add ``entry``, worked out from ``base``, under the next free number; ``disturbs(entry)`` tells whether a commit that came in between spoils it."""
        state = base
        while True:
            if entry.get("name") and entry["name"] in state.names:
                return state
            number = state.version + 1
            if self.files.put_if_absent(f"{self.folder}/{number:012d}.json", json.dumps(entry, sort_keys=True)):
                state = state.applied(number, entry)
                if number % CHECKPOINT_EVERY == 0:
                    self.files.put_if_absent(f"{self.folder}/{number:012d}.state", json.dumps(vars(state)))
                return state
            other = self.entry(number)
            if disturbs(other):
                raise Conflict(f"commit {number} changed what this one was worked out from")
            state = state.applied(number, other)
