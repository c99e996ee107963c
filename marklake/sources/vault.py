"""Notes of a folder tree as a Spark data source, in batch and as a stream of changes.

Spark's own file readers leave out names that begin with ``_`` and know no change or
removal of a file, so the tree is listed here.  The folder must be visible to the
driver and to every executor.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import NOTES

CHUNK = 200  # files that one task reads


def walk(root: str, hidden: bool = False, any_case: bool = False) -> list[tuple[str, float, int]]:
    """``(path, mtime, size)`` of all ``.md`` files; names that begin with a dot are left out unless ``hidden``.

    ``any_case`` takes ``.MD`` and the like as well, as watching for changes does.
    """
    out, todo = [], [""]
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                if e.name.startswith(".") and not hidden:
                    continue
                rel = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    todo.append(rel)
                elif (e.name.lower() if any_case else e.name).endswith(".md") and e.is_file():
                    s = e.stat()
                    out.append((rel, s.st_mtime, s.st_size))
    return sorted(out)


def _text(root: str, rel: str) -> str:
    with open(os.path.join(root, rel), encoding="utf-8", errors="replace", newline="") as f:
        return f.read()


class _Part(InputPartition):
    def __init__(self, files):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, hidden: bool):
        self.root, self.hidden = root, hidden

    def partitions(self):
        files = walk(self.root, self.hidden)
        return [_Part(files[i : i + CHUNK]) for i in range(0, len(files), CHUNK)] or [_Part([])]

    def read(self, partition):
        for rel, mtime, _ in partition.files:
            yield rel, _text(self.root, rel), datetime.fromtimestamp(mtime, UTC)


class _Changes(DataSourceStreamReader):
    """Differences between numbered listings.  A file that is still being written waits for the next listing.

    Listings lie in the folder ``state``, so an offset is a number, a restarted query
    finds them again, and the driver reads names only: contents are read by the tasks.
    """

    def __init__(self, root: str, state: str):
        self.root, self.state = root, state

    def _load(self, turn: int) -> dict:
        if turn <= 0:
            return {"seen": {}, "waits": {}}
        with open(os.path.join(self.state, str(turn)), encoding="utf-8") as f:
            return json.load(f)

    def _turns(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.state) if n.isdigit()) if os.path.isdir(self.state) else []

    def initialOffset(self) -> dict:
        return {"turn": 0}

    def latestOffset(self) -> dict:
        turn = max(self._turns(), default=0)
        before = self._load(turn)
        old, waits = before["seen"], before["waits"]
        now = {p: [m, n] for p, m, n in walk(self.root, any_case=True)}
        settled = {p: s for p, s in now.items() if old.get(p) == s or waits.get(p) == s}
        after = {"seen": {p: s for p, s in old.items() if p in now} | settled, "waits": {p: s for p, s in now.items() if p not in settled}, "at": datetime.now(UTC).timestamp()}
        if after["seen"] == old and after["waits"] == waits:
            return {"turn": turn}
        os.makedirs(self.state, exist_ok=True)
        temp = os.path.join(self.state, f".{os.getpid()}-{turn + 1}")
        with open(temp, "w", encoding="utf-8") as f:
            json.dump(after, f)
        os.replace(temp, os.path.join(self.state, str(turn + 1)))
        return {"turn": turn + 1}

    def changes(self, start: dict, end: dict) -> list[tuple[str, str, float, int]]:
        """``(event, path, time, turn)`` between two offsets, listing by listing."""
        out, before = [], self._load(start["turn"])["seen"]
        for turn in range(start["turn"] + 1, end["turn"] + 1):
            listing = self._load(turn)
            after = listing["seen"]
            out += [("change" if p in before else "add", p, s[0], turn) for p, s in sorted(after.items()) if before.get(p) != s]
            out += [("unlink", p, listing["at"], turn) for p in sorted(set(before) - set(after))]
            before = after
        return out

    def partitions(self, start: dict, end: dict):
        rows = self.changes(start, end)
        return [_Part(rows[i : i + CHUNK]) for i in range(0, len(rows), CHUNK)]

    def read(self, partition):
        for event, path, at, turn in partition.files:
            content = None
            if event != "unlink":
                try:
                    content = _text(self.root, path)
                except FileNotFoundError:
                    continue  # gone since; a later listing says so
            yield event, path, content, datetime.fromtimestamp(at, UTC), turn

    def commit(self, end: dict) -> None:
        for turn in self._turns():
            if turn < end["turn"]:
                os.unlink(os.path.join(self.state, str(turn)))


class Vault(DataSource):
    """``spark.read.format("vault").load(folder)``; option ``hidden`` includes dot folders."""

    @classmethod
    def name(cls):
        return "vault"

    def schema(self):
        return NOTES

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("hidden", "false").lower() == "true")


class VaultChanges(DataSource):
    """``spark.readStream.format("vault_changes").load(folder)``; option ``state`` names the folder of its listings (default: ``.changes`` in the vault)."""

    @classmethod
    def name(cls):
        return "vault_changes"

    def schema(self):
        return "event string, path string, content string, ts timestamp, seq long"

    def streamReader(self, schema):
        root = self.options["path"]
        return _Changes(root, self.options.get("state") or os.path.join(root, ".changes"))


def register(spark) -> None:
    spark.dataSource.register(Vault)
    spark.dataSource.register(VaultChanges)
