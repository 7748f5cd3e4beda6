"""The analyzer's version: a digest of the sources that decide what facts are derived."""

from __future__ import annotations

import hashlib
from pathlib import Path

SOURCES = ("functions", "operators", "sources", "schemas.py")


def digest(files: dict[str, bytes]) -> str:
    """SHA-256 over names and contents, by name, each ended by a zero byte."""
    return hashlib.sha256(b"".join(name.encode() + b"\0" + files[name] + b"\0" for name in sorted(files))).hexdigest()


def analyzer_version(root: Path | None = None) -> str:
    root = root or Path(__file__).resolve().parent.parent
    found = [f for s in SOURCES for f in ([root / s] if (root / s).is_file() else sorted((root / s).glob("*.py")))]
    return digest({str(f.relative_to(root)): f.read_bytes() for f in found})
