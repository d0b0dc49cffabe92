"""Files of data sources: where they are, how they are dealt to tasks, and how a commit shows them."""

from __future__ import annotations


def store_of(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def dealt(path: str, suffix: str, size: int) -> list[list[tuple[str, str]]]:
    """Path and name of the files below ``path`` (or the file that it is) with a suffix, in lots of about ``size`` bytes."""
    from pyarrow import fs

    store, root = store_of(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    # What starts with an underscore or a dot is being written, or none of ours.
    mine = (f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and not any(x[0] in "_." for x in f.path.removeprefix(root).split("/") if x))
    lots, held = [[]], 0
    for f in sorted(mine, key=lambda f: f.path):
        if lots[-1] and held + f.size > size:
            lots, held = [*lots, []], 0
        name = f.path.removeprefix(root).lstrip("/") or f.base_name
        lots[-1].append((f.path, name[: -len(suffix)]))
        held += f.size
    return lots


def move_in(path: str, folder: str, suffix: str, files: list[tuple[str, str]], replace: bool) -> None:
    """Moves files (where they are, name) to their names below ``path`` and removes the folder they were in.

    Without ``replace``, a name that is taken gets the first free of the suffixes -2, -3, ...
    """
    from pyarrow import fs

    store, root = store_of(path)
    there = set() if replace or not files else {f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))}
    for at, name in sorted(files, key=lambda x: x[1]):
        to, n = f"{root}/{name}{suffix}", 2
        while to in there:
            to, n = f"{root}/{name}-{n}{suffix}", n + 1
        if "/" in name:
            store.create_dir(to.rpartition("/")[0], recursive=True)
        store.move(at, to)
        if not replace:
            there.add(to)
    try:
        store.delete_dir(f"{root}/{folder}")
    except FileNotFoundError:
        pass  # no task has written
