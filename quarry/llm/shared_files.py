"""Binary files in the shared folder, written and read by tasks.

Files appear under their final name only when whole, so a task that is
retried or run twice replaces its own file by an equal one.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """A stream to write a whole file through."""
    store, path = locate(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, path)
