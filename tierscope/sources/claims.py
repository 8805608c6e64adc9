"""Claims: files that only one writer can create, so that what is checked before a write still holds when it is written."""

from __future__ import annotations

import getpass
import os
import random
import socket
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Claimed(TimeoutError):
    """Another writer holds a name for too long."""


class Claims:
    """Names claimed in a folder. Hadoop's create is atomic in shared stores, and a local folder has the operating system's."""

    def __init__(self, spark: SparkSession, folder: str, wait_s: float = 600.0):
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._folder, self.wait_s = self._new(folder), wait_s
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def take(self, name: str) -> bool:
        """Create the claim of a name; False if it is there."""
        self._files.mkdirs(self._folder)
        path = self._new(self._folder, name)
        owner = f"{getpass.getuser()}@{socket.gethostname()} {os.getpid()} {time.time():.0f}"
        if self._files.getScheme() == "file":
            try:
                with open(path.toUri().getPath(), "x") as f:
                    f.write(owner)
                return True
            except FileExistsError:
                return False
        try:
            out = self._files.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.writeBytes(owner)
        out.close()
        return True

    def release(self, name: str) -> bool:
        """Drop the claim of a name, for a writer that can't any more."""
        return self._files.delete(self._new(self._folder, name), False)

    @contextmanager
    def held(self, names: Iterable[str]) -> Iterator[None]:
        """The names, claimed in order, so that no two writers wait for each other."""
        have: list[str] = []
        until = time.monotonic() + self.wait_s
        try:
            for name in sorted(names):
                while not self.take(name):
                    if time.monotonic() > until:
                        raise Claimed(f"{name} is claimed by another writer; release() frees what one that is gone has claimed")
                    time.sleep(random.uniform(0.05, 0.25))
                have.append(name)
            yield
        finally:
            for name in have:
                self.release(name)
