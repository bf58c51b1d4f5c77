"""What lies in archives, also in archives inside them: a work list under one budget of bytes, entries and depth."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

#: Documents that are archives themselves, which a reader takes whole.
WHOLE = (".docx", ".xlsx", ".pptx", ".epub", ".odt", ".ods", ".odp", ".jar")


class Spent(ValueError):
    """The budget is used up: nothing more is expanded."""


@dataclass
class Budget:
    """What one message, or one file, may expand to in all."""

    total: int = 64 << 20
    each: int = 16 << 20
    entries: int = 1000
    depth: int = 3

    def taken(self, name: str, stream) -> bytes:
        """The bytes of one entry, charged whether or not anything reads them."""
        self.entries -= 1
        if self.entries < 0:
            raise Spent("too many entries")
        most = min(self.each, self.total)
        data = stream.read(most + 1)
        if len(data) > most:
            if self.total <= self.each:
                self.total = 0
                raise Spent(f"{name} exceeds the byte budget")
            self.total -= most
            raise ValueError(f"larger than {self.each} bytes")
        self.total -= len(data)
        return data


def _kind(name: str, data: bytes) -> str:
    if data[:4] == b"PK\x03\x04" and not name.lower().endswith(WHOLE):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    return "tar" if data[257:262] == b"ustar" else ""


def _entries(kind: str, name: str, data: bytes, budget: Budget) -> Iterator[tuple[str, bytes | str]]:
    """(name, bytes or what went wrong) of each entry."""

    def one(entry: str, opened) -> tuple[str, bytes | str]:
        try:
            with opened() as stream:
                return entry, budget.taken(entry, stream)
        except Spent:
            raise
        except (ValueError, OSError, RuntimeError, NotImplementedError, EOFError, zipfile.BadZipFile, zlib.error) as e:
            return entry, str(e) or type(e).__name__

    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield one(info.filename, lambda info=info: archive.open(info))
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as archive:
            for info in archive:
                if info.isfile():
                    yield one(info.name, lambda info=info: archive.extractfile(info))
    else:
        inner = name.rsplit("/", 1)[-1]
        yield one(inner[:-3] if inner.lower().endswith(".gz") else inner[:-4] + ".tar" if inner.lower().endswith(".tgz") else inner + ".out", lambda: gzip.GzipFile(fileobj=io.BytesIO(data)))


def expanded(name: str, data: bytes, budget: Budget) -> tuple[list[tuple[str, bytes]], list[str]]:
    """(files as (name, bytes), failures as texts): archives are replaced by what they hold, named by the way to it.

    An entry that is too large, locked or broken is a failure and the rest goes on; when the budget of bytes or entries is
    spent, what has been expanded stays and all else is one failure. An archive below ``depth`` others is a failure.
    """
    out, failures, work = [], [], deque([(name, data, 0)])
    while work:
        name, data, depth = work.popleft()
        kind = _kind(name, data)
        if not kind:
            out.append((name, data))
        elif depth >= budget.depth:
            failures.append(f"{name}: archives lie more than {budget.depth} deep")
        else:
            try:
                for entry, content in _entries(kind, name, data, budget):
                    if isinstance(content, str):
                        failures.append(f"{name}/{entry}: {content}")
                    else:
                        work.append((f"{name}/{entry}", content, depth + 1))
            except Spent as e:
                failures.append(f"{name}: {e}")
                out += [(n, d) for n, d, _ in work if not _kind(n, d)]
                failures += [f"{n}: not expanded" for n, d, _ in work if _kind(n, d)]
                break
            except (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error) as e:
                failures.append(f"{name}: {e}")
    return out, failures
