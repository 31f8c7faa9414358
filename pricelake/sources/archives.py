"""Zip bundles: members as rows, nested archives expanded."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .formats import SUPPORTED

MEMBERS = "archive string, path string, content binary, error string"


def is_junk(name: str) -> bool:
    """Resource forks and finder files."""
    return any(p in ("__MACOSX", ".DS_Store") or p.startswith("._") for p in name.split("/"))


def member_name(info: zipfile.ZipInfo) -> str:
    """The real name: without the UTF-8 flag, its bytes are tried as UTF-8, then as cp866."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp866", "replace")


def members(content: bytes, within: str = "") -> list[tuple[str, bytes]]:
    """(path, bytes) of the supported documents, sorted; a path that leaves the archive refuses it as a whole. A nested
    archive that can't be read is passed over."""
    found = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            name = member_name(info).replace("\\", "/")
            if info.is_dir() or is_junk(name):
                continue
            if name.startswith("/") or posixpath.normpath(name).startswith(".."):
                raise ValueError(f"unsafe path in archive: {name!r}")
            suffix = posixpath.splitext(name)[1].lower().lstrip(".")
            if suffix == "zip":
                try:
                    found += members(z.read(info), f"{within}{posixpath.splitext(name)[0]}__unzipped/")
                except (zipfile.BadZipFile, ValueError, OSError):
                    continue
            elif suffix in SUPPORTED:
                found.append((within + name, z.read(info)))
    return sorted(found)


def documents(files: DataFrame) -> DataFrame:
    """Members of zip files (``path, content``): archive, path, content; an archive that is refused is a row with its
    error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, name, data, None) for name, data in members(content)]
                except Exception as e:  # noqa: BLE001  whatever is wrong with one archive
                    rows = [(path, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, MEMBERS)
