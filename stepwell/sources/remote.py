"""Folders kept in a store beside the run: opt-in, and never a reason to fail a run."""

from __future__ import annotations

import logging
import posixpath
from collections.abc import Mapping
from dataclasses import dataclass

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Remote:
    """A store's root (any URI that pyarrow reads, or a path) and the run's name in it."""

    root: str
    run: str

    @classmethod
    def of(cls, settings: Mapping[str, str]) -> Remote | None:
        """From STEPWELL_REMOTE and STEPWELL_RUN; None unless both are set."""
        root, run = (settings.get(k, "").strip() for k in ("STEPWELL_REMOTE", "STEPWELL_RUN"))
        return cls(root, run) if root and run else None

    def _place(self, *parts: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        return store, posixpath.join(path, self.run, *parts)

    def check(self) -> None:
        """Writes and deletes a marker; raises what stands in the way, before any work is done."""
        store, path = self._place("_probe")
        store.create_dir(posixpath.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:
            out.write(b"ok")
        store.delete_file(path)

    def push(self, folders: Mapping[str, str]) -> bool:
        """Copies local folders by name into the store; a failure is logged and gives False."""
        from pyarrow import fs

        try:
            for name, folder in folders.items():
                store, path = self._place(name)
                store.create_dir(path, recursive=True)
                fs.copy_files(folder, path, source_filesystem=fs.LocalFileSystem(), destination_filesystem=store)
        except OSError as e:
            log.warning("not pushed: %s", e)
            return False
        return True

    def restore(self, folders: Mapping[str, str]) -> bool:
        """The other way round; False, with a warning, where the store has no such run."""
        from pyarrow import fs

        try:
            for name, folder in folders.items():
                store, path = self._place(name)
                fs.LocalFileSystem().create_dir(folder, recursive=True)
                fs.copy_files(path, folder, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        except OSError as e:
            log.warning("not restored: %s", e)
            return False
        return True
