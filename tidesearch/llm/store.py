"""Files in the shared folder, from tasks and driver alike: any store that an Arrow file system can open by its URI."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    """A stream that becomes the file ``uri`` when it is closed without an error: a task that is tried again replaces it."""
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part, compression=None) as out:
        yield out
    store.move(part, path)
