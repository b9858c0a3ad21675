"""ZIP archives as rows: packing members per archive and reading members back under limits."""

from __future__ import annotations

import io
import stat
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Suffixes of files that are compressed already.
STORED = (".7z", ".avi", ".gif", ".gz", ".jpeg", ".jpg", ".mp3", ".mp4", ".pdf", ".png", ".rar", ".webp", ".zip")
UNPACKED = "archive string, member string, size long, content binary, error string"


def _packed(members: pd.DataFrame) -> pd.DataFrame:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as made:
        for name, content in sorted(zip(members["member"], members["content"], strict=True)):
            kind = zipfile.ZIP_STORED if name.lower().endswith(STORED) else zipfile.ZIP_DEFLATED
            made.writestr(zipfile.ZipInfo(name), bytes(content), compress_type=kind)
    return pd.DataFrame({"archive": [members["archive"].iloc[0]], "zip": [held.getvalue()]})


def pack(members: DataFrame) -> DataFrame:
    """archive, zip from (archive, member, content); one archive is held by one task."""
    return members.select("archive", "member", "content").groupBy("archive").applyInPandas(_packed, "archive string, zip binary")


def _is_safe(name: str) -> bool:
    """Relative, without parent steps and drives."""
    plain = name.replace("\\", "/")
    return not (plain.startswith("/") or ".." in plain.split("/") or plain[1:2] == ":" and plain[0].isalpha())


def _members(data: bytes, most_files: int, most_bytes: int, suffixes: tuple[str, ...]) -> list[tuple[str, int, bytes]]:
    """Allowed members of one archive; raises ValueError where a rule is broken.

    The listing is judged before anything is inflated, and no more than the bytes allowed is read,
    whatever sizes the listing claims.
    """
    found, left = [], most_bytes
    with zipfile.ZipFile(io.BytesIO(data)) as opened:
        listed = opened.infolist()
        if len(listed) > most_files:
            raise ValueError("too many files")
        if any(not _is_safe(i.filename) or stat.S_ISLNK(i.external_attr >> 16) for i in listed):
            raise ValueError("an unsafe path")
        wanted = [i for i in listed if not i.is_dir() and i.filename.lower().endswith(suffixes)]
        if sum(i.file_size for i in wanted) > most_bytes:
            raise ValueError("over the extraction limit")
        for info in wanted:
            with opened.open(info) as member:
                content = member.read(left + 1)
            if len(content) > left:
                raise ValueError("over the extraction limit")
            left -= len(content)
            found.append((info.filename, len(content), content))
    return found


def unpacked(archives: DataFrame, most_files: int, most_bytes: int, suffixes: tuple[str, ...]) -> DataFrame:
    """archive, member, size, content of allowed members of (archive, zip), or one row with the error of an archive that breaks a rule.

    All members count towards the number of files, allowed suffixes towards the bytes; other members
    are left out in silence. A task holds one archive and at most ``most_bytes`` of its contents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in UNPACKED.split(", ")]
        for batch in batches:
            for archive, data in zip(batch["archive"], batch["zip"], strict=True):
                try:
                    rows = [(archive, *m, None) for m in _members(bytes(data), most_files, most_bytes, suffixes)]
                except ValueError as broken:
                    rows = [(archive, None, 0, None, str(broken))]
                except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError, TypeError):
                    rows = [(archive, None, 0, None, "not a valid archive")]
                yield pd.DataFrame(rows, columns=names)

    return archives.select("archive", "zip").mapInPandas(run, UNPACKED)
