"""Where named artifacts lie in a data folder."""

from __future__ import annotations

from pathlib import PurePosixPath

SPLITS = ("DEV", "REPORT", "HELD_OUT")
KINDS = {"source": "artifacts/source/{name}.{version}.jsonl", "review": "reviews/{name}.{version}.review.jsonl", "teacher": "artifacts/teacher/{name}.{version}.jsonl", "train": "artifacts/train/{name}.{version}.jsonl", "tokenizer": "artifacts/tokenizer/{name}.{version}.json", "eval": "artifacts/eval/{name}.{version}.{split}.json", "plan": "artifacts/sequences/{name}.{version}.plan.jsonl", "sequences": "artifacts/sequences/{name}.{version}.metadata.jsonl"}


def identifier(value: str, what: str = "name", more: str = "-_.") -> str:
    """value, if it is letters and digits of any script and the signs in `more`, and not signs alone."""
    bare = value.translate({ord(c): None for c in more})
    if not bare.isalnum():
        raise ValueError(f"{what} must be letters, digits and {' '.join(more)}: {value!r}")
    return value


def split_argument(value: str, allowed: tuple[str, ...] = SPLITS) -> str:
    if value not in allowed:
        raise ValueError(f"split must be one of {', '.join(allowed)}: {value!r}")
    return value


def artifact_path(kind: str, name: str, version: str = "v0", split: str = "DEV") -> PurePosixPath:
    """The relative path of an artifact; names are checked, so it never leaves its folder."""
    return PurePosixPath(KINDS[kind].format(name=identifier(name), version=identifier(version, "version"), split=split_argument(split)))


def relative_to(path: str, root: str, placeholder: str = "$DATA_DIR") -> str:
    """path below root as placeholder/rest; other paths as they are."""
    p = PurePosixPath(path)
    return f"{placeholder}/{p.relative_to(root)}" if p.is_absolute() and p.is_relative_to(root) else str(p)
