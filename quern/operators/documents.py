"""Single documents on the driver: model shapes, run states, checks of a configuration. No tables here."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

UNITS = {"M": 1_000_000, "B": 1_000_000_000}
BAND = re.compile(r"(\d+(?:\.\d+)?)([MB])-(\d+(?:\.\d+)?)([MB])")


def decoder_parameters(vocabulary: int, hidden: int, layers: int, heads: int, kv_heads: int, intermediate: int) -> int:
    """Weights of a decoder with tied embeddings, grouped-query attention, a gated MLP and two norms a layer; positions have none."""
    narrow = kv_heads * (hidden // heads)
    attention = 2 * hidden * hidden + 2 * hidden * narrow
    return vocabulary * hidden + layers * (attention + 3 * hidden * intermediate + 2 * hidden) + hidden


def within_band(value: int, band: str) -> bool:
    """Whether a number of parameters lies in a band such as 50M-150M or 0.5B-1B, ends included; False for what is no band."""
    m = BAND.fullmatch(band)
    return bool(m) and int(float(m[1]) * UNITS[m[2]]) <= value <= int(float(m[3]) * UNITS[m[4]])


def document_errors(document: Mapping, required: Mapping[str, object]) -> list[str]:
    """What a document lacks or has otherwise: required maps a path such as "data.splits" to a value, a type, or a test of the value."""
    out = []
    for path, want in required.items():
        value: object = document
        for part in path.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        if value is None:
            out.append(f"{path} is missing")
        elif isinstance(want, type):
            if not isinstance(value, want) or (isinstance(value, bool) and want is not bool):
                out.append(f"{path} must be of type {want.__name__}")
        elif callable(want):
            if not want(value):
                out.append(f"{path} is not allowed: {value!r}")
        elif value != want:
            out.append(f"{path} must be {want!r}")
    return out


def unknown_keys(document: Mapping, known: Sequence[str]) -> list[str]:
    return sorted(set(document) - set(known))


def resume_errors(checkpoint: Mapping, run: Mapping, keys: Sequence[str] = ("run_id", "trainer_id", "config_sha256", "weights_sha256")) -> list[str]:
    """The keys in which a checkpoint isn't the run's own."""
    return [f"checkpoint {k} does not match the run" for k in keys if checkpoint.get(k) != run.get(k)]


def run_status(blockers: Sequence[str], done: int, planned: int) -> str:
    """blocked with any blocker, trained when all planned steps are done, else partial."""
    return "blocked" if blockers else "trained" if done >= planned else "partial"
