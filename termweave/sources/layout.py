"""A dictionary folder: scaffold, inspection, manifest. Files on the driver, no data-parallel work."""

from __future__ import annotations

import json
from pathlib import Path

from termweave.sources.store import write_text_atomically

FOLDERS = ("proposals", "snapshots", "review-events")
STARTER = {"version": 1, "scopes": [{"id": "general", "label": "General"}], "terms": [{"id": "general.example_term", "canonical": "example term", "scopes": ["general"]}]}
QUERY = {"id": "example", "text": "use the example term", "expected_status": "resolved", "expected_term_ids": ["general.example_term"]}


def init(root: str, force: bool = False) -> Path:
    """Create the folder with a starter vocabulary and query; existing files stay unless force."""
    base = Path(root) / "dictionary"
    for f in FOLDERS:
        (base / f).mkdir(parents=True, exist_ok=True)
    for name, text in (("vocabulary.json", json.dumps(STARTER, indent=2) + "\n"), ("queries.jsonl", json.dumps(QUERY) + "\n"), ("README.md", "# Dictionary\n\nThe vocabulary, its behaviour queries and their history.\n")):
        if force or not (base / name).exists():
            write_text_atomically(str(base / name), text)
    return base


def inspect(root: str) -> dict:
    """What is there and what is missing."""
    base = Path(root) / "dictionary"
    missing = [n for n in ("vocabulary.json", "queries.jsonl", *FOLDERS) if not (base / n).exists()]
    counts = {f: sum(1 for p in (base / f).glob("*.json*")) if (base / f).is_dir() else 0 for f in FOLDERS}
    return {"path": str(base), "valid": not missing, "missing": missing, "counts": counts}


def write_manifest(root: str) -> str:
    path = Path(root) / "dictionary" / "manifest.json"
    write_text_atomically(str(path), json.dumps(inspect(root), sort_keys=True, indent=2) + "\n")
    return str(path)
