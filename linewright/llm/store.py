"""Files in the folder that all executors share, reached through a file system by address, and what workers keep."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyarrow import fs


#: What ``held`` made last, and what it was asked for.
_HELD: list = []


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """A worker's table, kept between its tasks until another one is asked for.

    Workers outlive a stage and serve the next one. So an operator's table goes before another's is made, and a worker
    never holds those of two stages.
    """
    if not _HELD or _HELD[0] != key:
        _HELD.clear()
        _HELD[:] = key, make()
    return _HELD[1]


def open_store(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address such as ``file:///shared/x`` or a plain absolute path."""
    return fs.FileSystem.from_uri(address)


class AttemptFile:
    """A file that appears under its name only when it is complete.

    Each attempt of a task writes under a name of its own. A reader only ever opens names that
    a finished task has reported, so a lost or repeated attempt leaves nothing that is read.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.address = f"{folder.rstrip('/')}/{self.name}"
        self._fs, self._path = open_store(self.address)
        self._fs.create_dir(self._path.rsplit("/", 1)[0], recursive=True)
        self._stream = self._fs.open_output_stream(self._path + ".part")
        self.position = 0

    def write(self, data: bytes) -> None:
        self._stream.write(data)
        self.position += len(data)

    def finish(self) -> None:
        self._stream.close()
        self._fs.move(self._path + ".part", self._path)


def open_input(address: str):
    """A file for random reads."""
    file_system, path = open_store(address)
    return file_system.open_input_file(path)
