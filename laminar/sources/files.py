"""Files of a shared folder, for data sources: any address that pyarrow's file systems open."""

from __future__ import annotations

import uuid

from pyarrow import fs

from laminar.sources.tables import with_retry


class Folder:
    """A folder by path or URI. Reads are tried again with doubling waits; pickles as its address."""

    def __init__(self, address: str, attempts: int = 6, wait: float = 0.5) -> None:
        self.address = "/" + address[5:].lstrip("/") if address.startswith("file:") else address
        self.attempts, self.wait = attempts, wait

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.address)

    def read(self, name: str) -> bytes | None:
        """Content of a file, None where there is none."""
        system, base = self._open()

        def once() -> bytes | None:
            try:
                with system.open_input_stream(f"{base}/{name}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        return with_retry(once, self.attempts, self.wait)

    def write(self, name: str, data: bytes) -> None:
        system, base = self._open()
        system.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{base}/{name}") as f:
            f.write(data)

    def names(self, folder: str = "") -> list[str]:
        """Names directly below ``folder``, sorted; none where it does not exist."""
        system, base = self._open()
        found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def move(self, old: str, new: str) -> None:
        system, base = self._open()
        system.create_dir(f"{base}/{new}".rpartition("/")[0], recursive=True)
        system.move(f"{base}/{old}", f"{base}/{new}")

    def remove(self, folder: str) -> None:
        system, base = self._open()
        if system.get_file_info(f"{base}/{folder}".rstrip("/")).type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{folder}".rstrip("/"))


def pending() -> str:
    """A new name for the files of one write that is not committed yet."""
    return f"_pending/{uuid.uuid4().hex}"
