"""Byte streams of tasks in the shared folder."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it.

    Raises for schemes that pyarrow has no file system for: the shared folder must be
    one that tasks can write byte streams to.
    """
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


@contextmanager
def whole_file(uri: str):
    """A binary output stream that becomes the file ``uri`` only when all is written.

    Each attempt of a task writes under a name of its own and renames at the end, so
    that a lost or repeated attempt never leaves a partial file under the final name.
    """
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(draft) as out:
            yield out
    except BaseException:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
        raise
    store.move(draft, path)


def open_input(uri: str):
    store, path = open_store(uri)
    return store.open_input_file(path)


def open_stream(uri: str):
    store, path = open_store(uri)
    return store.open_input_stream(path, compression=None)
