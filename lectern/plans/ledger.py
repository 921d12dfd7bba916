"""Replies kept as they arrive, so that a task that is lost, or a job that runs again, asks for none twice."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs


class Ledger:
    """Replies by the digest of what was asked, a small file each, in a folder that all executors share (a path or a URI that
    pyarrow can open). A file is written aside and moved into place, so it is there whole or not at all."""

    def __init__(self, path: str):
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        local = self.path.removeprefix("file://") if self.path.startswith("file:///") else self.path.removeprefix("file:")
        return fs.FileSystem.from_uri(local if local.startswith("/") else self.path)

    @staticmethod
    def digest(system: str, prompt: str) -> str:
        return hashlib.sha256(json.dumps([system, prompt]).encode()).hexdigest()

    def get(self, digest: str) -> str | None:
        store, root = self._open()
        at = f"{root}/{digest[:2]}/{digest}.json"
        if store.get_file_info(at).type != fs.FileType.File:
            return None
        with store.open_input_stream(at) as f:
            return json.loads(f.read())["answer"]

    def put(self, digest: str, answer: str) -> None:
        store, root = self._open()
        folder = f"{root}/{digest[:2]}"
        store.create_dir(folder, recursive=True)
        aside = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps({"answer": answer}).encode())
        store.move(aside, f"{folder}/{digest}.json")
