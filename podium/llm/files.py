"""Files in the shared folder, written and read by tasks.

``pyarrow.fs`` opens them, so the folder may be mounted or be in any store that it knows. A task
writes under a name of its own and reports it; only files that a finished task has reported are
read. A task that is run again after an executor was lost therefore does no harm.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    if "://" not in folder:
        folder = folder.removeprefix("file:")
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


@contextmanager
def new_file(folder: str, kind: str):
    """A file that nothing else writes: gives its name in the folder and a stream."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.{kind}"
    with system.open_output_stream(f"{path}/{name}") as stream:
        yield name, stream


@contextmanager
def open_file(folder: str, name: str):
    system, path = place(folder)
    with system.open_input_stream(f"{path}/{name}") as stream:
        yield stream
