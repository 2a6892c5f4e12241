"""Getting checkpoints: files over HTTP, written whole or not at all, and single members of archives."""

from __future__ import annotations

import os
import tarfile
import tempfile
import urllib.request
import zipfile
from collections.abc import Callable
from typing import BinaryIO

from lodestone.functions.models import Model

# Where the published checkpoints lie.
HUB = "https://huggingface.co/"
PUBLISHED = {
    "all-MiniLM-L6-v2": ("Xenova/all-MiniLM-L6-v2", "model.onnx"),
    "arctic-embed-xs": ("Snowflake/snowflake-arctic-embed-xs", "model.onnx"),
    "bge-small-en-v1.5": ("Xenova/bge-small-en-v1.5", "model.onnx"),
    "bge-small-en-v1.5-int8": ("Xenova/bge-small-en-v1.5", "model_quantized.onnx"),
}
TIMEOUT, LARGEST = 600, 500 << 20  # seconds for an answer; bytes of a member at most
Progress = Callable[[str, int, int], None]


def sources(model: Model, hub: str = HUB) -> dict[str, str]:
    """Where each file of a checkpoint is had from."""
    repo, weights = PUBLISHED[model.name]
    return {"model.onnx": f"{hub}{repo}/resolve/main/onnx/{weights}", "tokenizer.json": f"{hub}{repo}/resolve/main/tokenizer.json"}


def _place(stream: BinaryIO, path: str, limit: int | None = None, told: Callable[[int], None] = lambda n: None) -> None:
    """Write a stream beside a path and move it there once it is whole; an error leaves nothing."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
    try:
        done = 0
        with os.fdopen(handle, "wb") as out:
            while block := stream.read(1 << 20):
                done += len(block)
                if limit is not None and done > limit:
                    raise ValueError(f"{os.path.basename(path)} has over {limit} bytes")
                out.write(block)
                told(done)
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def fetch(url: str, path: str, progress: Progress = lambda name, done, total: None) -> None:
    """Get a file; ``progress`` hears its name, the bytes there are and how many there will be (-1: not known)."""
    with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
        if getattr(answer, "status", 200) not in (200, None):
            raise OSError(f"{url}: {answer.status}")
        total = int(answer.headers.get("Content-Length") or -1)
        _place(answer, path, told=lambda n: progress(os.path.basename(path), n, total))


def extract(archive: str, wanted: Callable[[str], bool], path: str, limit: int = LARGEST) -> None:
    """Write the first file of a tar or zip archive whose base name is wanted; folders and links are none."""
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for entry in z.infolist():
                if not entry.is_dir() and wanted(os.path.basename(entry.filename)):
                    with z.open(entry) as member:
                        return _place(member, path, limit)
    else:
        with tarfile.open(archive) as t:
            for entry in t:
                if entry.isfile() and wanted(os.path.basename(entry.name)):
                    return _place(t.extractfile(entry), path, limit)
    raise ValueError(f"{archive} holds nothing that is wanted")


def ensure(model: Model, models_dir: str, progress: Progress = lambda name, done, total: None, hub: str = HUB) -> list[str]:
    """Get what is missing of a checkpoint; the files that were got.

    ``LODESTONE_NO_DOWNLOAD`` forbids it: then what is missing is an error.
    """
    folder = model.folder(models_dir)
    missing = [name for name in sources(model, hub) if not os.path.isfile(os.path.join(folder, name))]
    if missing and os.environ.get("LODESTONE_NO_DOWNLOAD", "").strip():
        raise ValueError(f"{model.name} lacks {', '.join(missing)}, and downloads are forbidden")
    for name in missing:
        fetch(sources(model, hub)[name], os.path.join(folder, name), progress)
    return missing
