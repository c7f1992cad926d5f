"""A service of batches for tests: its files' states move on each time that it is asked; it counts how often that is."""

import json
import pathlib


class Service:
    def __init__(self, options):
        self.folder = pathlib.Path(options["folder"])

    def batches(self):
        return json.loads((self.folder / "batches.json").read_text())

    def poll(self, batch_id):
        asked = self.folder / f"asked-{batch_id}"
        n = int(asked.read_text()) if asked.exists() else 0
        asked.write_text(str(n + 1))
        states = ["pending", "running", "done"]
        return [
            {"data_id": f"{batch_id}-a", "state": states[min(n, 2)]}, {"file_name": f"{batch_id}-b", "state": "failed" if n else "running", "err_msg": "bad" if n else ""},
            {"data_id": "", "file_name": None, "state": "done"}, {"data_id": f"{batch_id}-c", "state": None},
        ]
