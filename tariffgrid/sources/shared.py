"""Small files on the storage that Spark uses: exclusive creation, replacement in one step, a lock with a lease."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Seconds after which a lock is taken to be left behind; a run takes an hour at most.
LEASE_S = 7200
#: Bytes that are copied at a time.
BUFFER = 1 << 16


class SharedFiles:
    """Text files by path on any file system that Hadoop knows; one machine's disk is one of them."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self._conf), found

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def make_folder(self, path: str) -> None:
        """Make a new folder; FileExistsError if there is one."""
        fs, at = self._at(path)
        if fs.exists(at):
            raise FileExistsError(path)
        fs.mkdirs(at)

    def read(self, path: str) -> str | None:
        """The text of a file, None if there is none."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str, overwrite: bool) -> None:
        fs, at = self._at(path)
        stream = fs.create(at, overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file; FileExistsError if there is one already, also if another writer was first."""
        try:
            self._put(path, text, overwrite=False)
        except Exception as error:
            if "AlreadyExists" in str(error) or self.exists(path):
                raise FileExistsError(path) from error
            raise

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """Paths and sizes of the data files of a folder that a job wrote, in order of its partitions."""
        fs, at = self._at(folder)
        found = sorted((s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.isFile())
        return [(path, n) for name, path, n in found if name[0] not in "._" and n]

    def assemble(self, path: str, parts: list[str | list[tuple[str, int]]]) -> None:
        """Write a new file of texts and of files (path, bytes to take), one after the other; files are copied through a small buffer."""
        fs, at = self._at(path)
        out, copy, bounded = fs.create(at, False), self._jvm.org.apache.hadoop.io.IOUtils.copyBytes, self._jvm.org.apache.commons.io.input.BoundedInputStream
        try:
            for part in parts:
                if isinstance(part, str):
                    out.write(bytearray(part.encode("utf-8")))
                    continue
                for source, n in part:
                    of, source_at = self._at(source)
                    stream = of.open(source_at)
                    try:
                        copy(bounded(stream, n), out, BUFFER, False)
                    finally:
                        stream.close()
        finally:
            out.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside the target and rename over it: readers see the old file or the new one, and a failure leaves the old one."""
        self._renamed(path, lambda beside: self._put(beside, text, overwrite=False))

    def replace_by_copy(self, path: str, source: str) -> None:
        """As replace(), with the bytes of another file."""
        fs, at = self._at(source)
        self._renamed(path, lambda beside: self.assemble(beside, [[(source, fs.getFileStatus(at).getLen())]]))

    def _renamed(self, path: str, write) -> None:
        fs, target = self._at(path)
        fs.mkdirs(target.getParent())
        beside = self._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
        try:
            write(beside.toString())
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
            options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
            context.rename(beside, target, options)
        except BaseException:
            with contextlib.suppress(Exception):
                fs.delete(beside, False)
            raise

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


@contextlib.contextmanager
def single_writer(files: SharedFiles, path: str, lease_s: float = LEASE_S):
    """Only one run at a time, on whatever machine; a second one fails at once.

    The lock is a file that only one writer can create. It names its owner and the end of its lease; one that is
    past its lease is taken over, by deleting it and competing for it anew.
    """
    owner = uuid.uuid4().hex
    told = json.dumps({"owner": owner, "until": time.time() + lease_s})
    try:
        files.create(path, told)
    except FileExistsError:
        held = files.read(path)
        try:
            left = json.loads(held)["until"] < time.time()
        except (TypeError, ValueError, KeyError):
            left = False  # being written just now, or not ours
        if not left:
            raise RuntimeError(f"another run holds {path}") from None
        files.delete(path)
        try:
            files.create(path, told)
        except FileExistsError as error:
            raise RuntimeError(f"another run holds {path}") from error
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            if (held := files.read(path)) and json.loads(held).get("owner") == owner:
                files.delete(path)


def publish(files: SharedFiles, release_dir: str, public_path: str, write_document: Callable[[str], None], status: dict) -> None:
    """An immutable copy for the release first, then the public catalog, its status, and last the pointer to the release.

    write_document(path) writes the release's catalog as a new file. Whoever needs catalog and
    status of one release reads the pointer, a file of one line, and then the release's own
    copies, which never change.
    """
    files.make_folder(release_dir)
    told = json.dumps(status, ensure_ascii=False, sort_keys=True)
    write_document(f"{release_dir}/catalog.json")
    files.create(f"{release_dir}/status.json", told)
    beside = public_path.rpartition("/")[0] or "."
    files.replace_by_copy(public_path, f"{release_dir}/catalog.json")
    files.replace(f"{beside}/status.json", told)
    files.replace(f"{beside}/CURRENT", release_dir)
