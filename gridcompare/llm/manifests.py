"""Lists of the files that belong to a folder, one for each finished write.

Only files that a manifest names are read, so files of lost or repeated attempts do no harm, and a later write adds
to an earlier one.
"""

from __future__ import annotations

import json
import os
import uuid

PREFIX = "_manifest"


def file_system(uri: str):
    """The file system of a location, and its path there. Any that Arrow knows (local, HDFS, object stores)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


def _names(system, root: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith(PREFIX) and f.base_name.endswith(".json"))


def _entries(system, root: str, names: list[str]) -> list[list]:
    entries = []
    for name in names:
        with system.open_input_stream(f"{root}/{name}") as manifest:
            entries += json.loads(manifest.read())
    return entries


def read_manifests(system, root: str) -> list[list] | None:
    """The entries of all writes, in their order; None if nothing was written with a manifest."""
    names = _names(system, root)
    return _entries(system, root, names) if names else None


def add_manifest(system, root: str, entries: list[list], overwrite: bool) -> None:
    """List the files of a write (an entry begins with the file's name); with ``overwrite`` those of earlier
    writes go."""
    earlier = _names(system, root)
    number = 1 + max((int(n.split("-")[1]) for n in earlier if "-" in n), default=0)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{PREFIX}-{number:09d}-{uuid.uuid4().hex}.json", compression=None) as out:
        out.write(json.dumps(entries).encode())
    if overwrite:
        gone = _entries(system, root, earlier)
        for name in earlier:  # readers that come now find the new files only
            system.delete_file(f"{root}/{name}")
        for name, *_ in gone:
            system.delete_file(f"{root}/{name}")
