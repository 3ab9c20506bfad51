"""Uploaded archives: checked, unpacked aside and swapped in whole."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile

ENTRIES, BYTES = 20_000, 2 << 30


def unpack(archive: str, target: str, entries: int = ENTRIES, most: int = BYTES) -> int:
    """Unpack a zip file to ``target``, replacing what is there; the number of files.

    Refused are files that are no zip archive, too many entries, too many bytes,
    and paths that leave the folder.
    """
    if not zipfile.is_zipfile(archive):
        raise ValueError("not a zip archive")
    staging = f"{target}.{uuid.uuid4().hex}"
    with zipfile.ZipFile(archive) as z:
        files = [i for i in z.infolist() if not i.is_dir()]
        if len(z.infolist()) > entries or sum(i.file_size for i in files) > most:
            raise ValueError("the archive is too large")
        for i in files:
            parts = i.filename.replace("\\", "/").split("/")
            if i.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                raise ValueError(f"the archive leaves its folder: {i.filename}")
        os.makedirs(staging)
        z.extractall(staging)
    old = f"{target}.{uuid.uuid4().hex}"
    if os.path.exists(target):
        os.rename(target, old)
    os.rename(staging, target)
    shutil.rmtree(old, ignore_errors=True)
    return len(files)
