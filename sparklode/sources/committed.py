"""What the file sinks share: a staging folder that only a commit makes visible."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import WriterCommitMessage

from sparklode.sources import places

MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: for each file its name and what the manifest says of it."""

    files: list[dict]


class Staged:
    """Tasks write below a staging folder of their job, one folder each try; the driver moves what successful tries name, then writes
    the manifest, without which readers see nothing. A failed job leaves no file but the staging folder's, and that is deleted."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        self.overwrite = overwrite

    def begin(self) -> str:
        """A folder for one try of a task."""
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        places.made(folder)
        return folder

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        if not self.overwrite and places.listed(self.path, MANIFEST):
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds a finished package")
        for old in places.listed(self.path, MANIFEST):
            store, place = places.opened(old)
            store.delete_file(place)
        places.made(self.path)
        for f in files:
            for ending in f["endings"]:
                places.moved(f"{f['at']}{ending}", f"{self.path}/{f['name']}{ending}")
        shown = [{k: v for k, v in f.items() if k not in ("at", "endings")} for f in files]
        # Written aside and moved, so that a manifest is whole or absent.
        aside = f"{self.staging}/{MANIFEST}"
        places.made(self.staging)
        places.write_all(aside, json.dumps({"files": shown}, ensure_ascii=False, indent=1, sort_keys=True).encode())
        places.moved(aside, f"{self.path}/{MANIFEST}")
        places.removed(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        places.removed(self.staging)


def manifest(path: str) -> list[dict]:
    """What a finished folder's manifest lists; nothing if it isn't finished."""
    found = places.listed(path, MANIFEST)
    return json.loads(places.read_all(found[0]))["files"] if found else []
