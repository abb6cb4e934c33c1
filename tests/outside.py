"""Stand-ins that tasks load by name: boards that note who was asked, and a database in a file."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid

FOLDER = "/tmp/jobweave-outside"


class Canned:
    """Answers with the spec it got; a slug of `dead` fails. Each call leaves a file."""

    def __call__(self, spec: dict) -> str:
        os.makedirs(f"{FOLDER}/asked", exist_ok=True)
        with open(f"{FOLDER}/asked/{spec['slug']}-{uuid.uuid4().hex}", "w"):
            pass
        if spec["slug"] == "dead":
            raise OSError("no route")
        return json.dumps({"jobs": [{"id": spec["slug"], "title": "T", "absolute_url": "u", "company_name": spec["company"]}]})


def asked() -> list[str]:
    """Whom the boards were asked for since the last look, in order."""
    folder = f"{FOLDER}/asked"
    names = os.listdir(folder) if os.path.isdir(folder) else []
    for name in names:
        os.remove(f"{folder}/{name}")
    return sorted(n.rsplit("-", 1)[0] for n in names)


def connect():
    os.makedirs(FOLDER, exist_ok=True)
    return sqlite3.connect(f"{FOLDER}/outside.db", timeout=60)
