"""Manifests, fingerprints and stage caches, on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import urllib.request
import zipfile
from pathlib import Path

#: Files beyond WHOLE bytes are fingerprinted by their first and last EDGE bytes.
WHOLE, EDGE = 256 << 20, 64 << 20


def read_manifest(path: str) -> dict:
    """The manifest, or an empty one."""
    return json.loads(Path(path).read_text()) if os.path.exists(path) else {}


def write_manifest(path: str, manifest: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True))


def fingerprint(path: str, whole: int = WHOLE, edge: int = EDGE) -> str:
    """sha256 of a file and, for large ones, of size, head and tail."""
    size, h = os.path.getsize(path), hashlib.sha256()
    with open(path, "rb") as f:
        if size <= whole:
            while block := f.read(1 << 20):
                h.update(block)
        else:
            h.update(str(size).encode() + f.read(edge))
            f.seek(size - edge)
            h.update(f.read(edge))
    return h.hexdigest()


def config_signature(config: dict, sections: list[str], version: int = 1) -> str:
    """sha256 of a version and the sections that a stage depends on."""
    return hashlib.sha256(json.dumps([version, {s: config.get(s) for s in sections}], sort_keys=True).encode()).hexdigest()


def up_to_date(manifest: dict, stage: str, fingerprints: dict[str, str], signature: str, outputs: list[str]) -> bool:
    """Whether a stage ran on the same inputs and settings and its outputs are still there."""
    known = manifest.get(stage, {})
    return known.get("fingerprints") == fingerprints and known.get("signature") == signature and all(map(os.path.exists, outputs))


def fetch(url: str, target: str, force: bool = False) -> str:
    """Download once, by a part file that is renamed when it is whole."""
    if force or not os.path.exists(target):
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        with urllib.request.urlopen(url) as source, open(f"{target}.part", "wb") as part:
            shutil.copyfileobj(source, part)
        os.replace(f"{target}.part", target)
    return target


def unzip(archive: str, folder: str) -> str:
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
    return folder


def find_file(folder: str, name: str) -> str:
    """The first match by path, outside resource folders."""
    found = sorted(p for p in Path(folder).rglob(name) if "__MACOSX" not in p.parts)
    if not found:
        raise FileNotFoundError(f"{name} is not in {folder}")
    return str(found[0])


def clean_dir(folder: str) -> str:
    shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(folder)
    return folder


def discover_methods(folder: str, split: str) -> list[str]:
    """Retrieval methods with candidates of a split: folders method=.../split=..., the lexical one first."""
    found = sorted(p.parent.name.removeprefix("method=") for p in Path(folder).glob(f"method=*/split={split}"))
    return sorted(found, key=lambda m: (m != "bm25", m))


def unique_name(taken: list[str], name: str) -> str:
    """The name, or the first of name_1, name_2, ... that is free."""
    out, i = name, 0
    while out in taken:
        i += 1
        out = f"{name}_{i}"
    return out
