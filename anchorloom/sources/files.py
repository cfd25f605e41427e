"""Files that workers read piece by piece: local paths, file: URIs and whatever stores Arrow's file systems know."""

from __future__ import annotations

from urllib.parse import urlparse

from pyarrow import NativeFile, fs


def opened(uri: str) -> NativeFile:
    """The file, open for reads at any place."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem().open_input_file("/" + path.lstrip("/") if scheme else path)
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_at(file: NativeFile, place: int, size: int) -> bytes:
    file.seek(place)
    return file.read(size)
