"""Folders of files that appear all at once: a manifest names the files that count.

Tasks write files under names of their own; the driver then writes one small file that names them. Readers take what the
manifest names, so files of failed or repeated tasks, and of a run that broke off, are never read. Paths are local or
shared folders, or URIs that pyarrow opens (hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyarrow import fs

NAME = "_manifest.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. Spark writes file:/x where a URI is file:///x."""
    path = re.sub(r"^file:/(?!//)", "file:///", path.rstrip("/"))
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path) else (fs.LocalFileSystem(), path)


def new_name(suffix: str) -> str:
    return f"part-{uuid.uuid4().hex}{suffix}"


def listed(path: str) -> list[dict] | None:
    """Entries of the folder's manifest; None if it has none."""
    store, base = opened(path)
    if store.get_file_info(f"{base}/{NAME}").type == fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{base}/{NAME}") as f:
        return json.loads(f.read())


def files(path: str, suffixes: tuple[str, ...]) -> list[dict]:
    """What a reader takes: the entries of the manifest, or, in folders from elsewhere, every file with such a name. Each has
    "name" (its path in the file system) and "size". A single file is a folder of one."""
    store, base = opened(path)
    entries = listed(path)
    if entries is not None:
        return [{**e, "name": f"{base}/{e['name']}"} for e in entries]
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    return [{"name": f.path, "size": f.size} for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes)]


def refuse_existing(path: str) -> None:
    """An error if anything is at the path."""
    store, base = opened(path)
    if store.get_file_info(base).type != fs.FileType.NotFound:
        raise FileExistsError(path)


def commit(path: str, entries: list[dict]) -> None:
    """From now on ``entries`` (name below the path, size, and more) are the folder's files; those before them are deleted."""
    store, base = opened(path)
    store.create_dir(base, recursive=True)
    before = listed(path) or []
    temporary = f"{base}/_{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as f:
        f.write(json.dumps(entries).encode())
    store.move(temporary, f"{base}/{NAME}")
    kept = {e["name"] for e in entries}
    discard(path, [e["name"] for e in before if e["name"] not in kept])


def discard(path: str, names: Iterable[str]) -> None:
    store, base = opened(path)
    for name in names:
        if store.get_file_info(f"{base}/{name}").type == fs.FileType.File:
            store.delete_file(f"{base}/{name}")


def packed(entries: list[dict], most: int) -> list[list[dict]]:
    """Files dealt to partitions of about ``most`` bytes; a larger file is a partition."""
    out: list[list[dict]] = []
    size = most
    for e in sorted(entries, key=lambda e: (-e["size"], e["name"])):
        if size + e["size"] > most:
            out.append([])
            size = 0
        out[-1].append(e)
        size += e["size"]
    return out
