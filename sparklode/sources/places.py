"""Files in the store that a path names, opened by tasks and the driver alike: local, or any that Arrow knows by its URI."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_all(path: str) -> bytes:
    store, place = opened(path)
    with store.open_input_stream(place) as stream:
        return stream.read()


def write_all(path: str, data: bytes) -> None:
    store, place = opened(path)
    with store.open_output_stream(place) as stream:
        stream.write(data)


def listed(path: str, ending: str) -> list[str]:
    """The files of a folder with this ending, as paths of the same kind, in order; an absent folder has none."""
    store, place = opened(path)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.is_file and f.base_name.endswith(ending))


def moved(source: str, target: str) -> None:
    store, place = opened(source)
    store.move(place, opened(target)[1])


def removed(path: str) -> None:
    """Delete a folder with all in it; nothing happens if there is none."""
    store, place = opened(path)
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


def made(path: str) -> None:
    store, place = opened(path)
    store.create_dir(place, recursive=True)
