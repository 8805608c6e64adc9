"""A record of what ran where."""

from __future__ import annotations

import os
import platform
import subprocess
from collections.abc import Callable
from datetime import datetime, timezone

import pyspark


def _run(command: list[str]) -> str | None:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def capture(run: Callable[[list[str]], str | None] = _run, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> dict:
    """Commit, changes, versions, processor count and memory; what can't be read is None."""
    status = run(["git", "status", "--porcelain"])
    pages = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") if hasattr(os, "sysconf") else None
    return {"capturedAt": now().isoformat(), "commit": run(["git", "rev-parse", "HEAD"]), "dirty": None if status is None else bool(status), "python": platform.python_version(), "spark": pyspark.__version__, "java": run(["java", "--version"]), "system": platform.platform(), "processors": os.cpu_count(), "memoryBytes": pages}
