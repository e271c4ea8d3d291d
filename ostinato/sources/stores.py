"""Files in any store that executors reach: local paths, and addresses that pyarrow's file systems know."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import urlsplit

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if len(urlsplit(folder).scheme) > 1:
        store, root = fs.FileSystem.from_uri(folder)
        return store, root.rstrip("/")
    return fs.LocalFileSystem(), folder.rstrip("/")


def relative(name: object) -> str:
    """A name as a path below a folder: without scheme and leading slashes; a way out of the folder is an error."""
    path = str(name).split("://")[-1].removeprefix("file:")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"no file name: {name}")
    return "/".join(parts)


def put(store: fs.FileSystem, path: str, pieces: Iterable[bytes]) -> None:
    """Write a file under another name first, so that it is there whole or not at all."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as file:
        for piece in pieces:
            file.write(piece)
    store.move(part, path)
