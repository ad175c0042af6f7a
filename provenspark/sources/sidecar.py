"""What was measured about an encoder, as a JSON file beside its model; and what its family expects of a query."""

from __future__ import annotations

import dataclasses
import json
import struct
from pathlib import Path

#: Ending of the file beside a model; readers of other tools' files name theirs.
SUFFIX = ".calibration.json"


@dataclasses.dataclass
class Calibration:
    """An encoder's floors, ceiling and bands.  Backgrounds of query-to-document and document-to-document pairs are apart."""

    model: str = ""
    measured_at: float = 0.0
    corpus_size: int = 0
    noise_floor: float = 0.40
    search_floor: float = 0.25
    level_weight: float = 0.25
    margin_scale: float = 0.30
    ceiling: float = 1.0
    related: tuple[float, float] = (0.0, 0.0)
    unrelated: tuple[float, float] = (0.0, 0.0)
    related_margins: tuple[float, float] = (0.0, 0.0)
    unrelated_margins: tuple[float, float] = (0.0, 0.0)
    separator: str = ""
    anisotropy: float = 0.0
    anisotropy_p95: float = 0.0
    headroom: float = 0.0
    separability: float = 0.0
    doc_anisotropy: float = 0.0
    doc_anisotropy_p95: float = 0.0
    notes: list[str] = dataclasses.field(default_factory=list)


def save(calibration: Calibration, model_path: str | Path, suffix: str = SUFFIX) -> Path:
    path = Path(f"{model_path}{suffix}")
    path.write_text(json.dumps(dataclasses.asdict(calibration), indent=2, sort_keys=True), encoding="utf-8")
    return path


def load(model_path: str | Path, suffix: str = SUFFIX) -> Calibration | None:
    """The model's calibration; None without a readable file.

    Unknown fields are passed over.  A file from before the ceiling was measured
    gets the top of its related band; one whose background mixes both kinds of
    pairs loses it.
    """
    path = Path(f"{model_path}{suffix}")
    try:
        held = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    if not isinstance(held, dict):
        return None
    names = {f.name for f in dataclasses.fields(Calibration)}
    bands = {"related", "unrelated", "related_margins", "unrelated_margins"}
    found = Calibration(**{k: tuple(v) if k in bands else v for k, v in held.items() if k in names})
    if "ceiling" not in held:
        top = found.related[-1] if found.related else 0.0
        if 0 < top <= 1:
            found.ceiling = top
        found.notes.append(f"ceiling taken from the related band: {top}" if 0 < top <= 1 else "ceiling was not measured")
    if found.anisotropy and "doc_anisotropy" not in held:
        found.anisotropy = found.anisotropy_p95 = found.headroom = 0.0
        found.notes.append("background left out: it mixed two kinds of pairs")
    return found


def derived(model: str, related: list[float], unrelated: list[float], margins: list[float], other_margins: list[float], background: tuple[float, float], documents: tuple[float, float], separability: float, now: float) -> Calibration:
    """Thresholds from measured bands: by level where the bands part, else by margin where the margins part, else neither."""
    low, high = (min(related), max(related)) if related else (0.0, 1.0)
    noise = max(unrelated) if unrelated else 0.0
    by_level, by_margin = low > noise, bool(margins and other_margins) and min(margins) > max(other_margins)
    return Calibration(
        model=model, measured_at=now, corpus_size=len(related) + len(unrelated), noise_floor=round((low + noise) / 2 if by_level else min(low, noise), 4), search_floor=round(min(low, noise) * 0.9, 4),
        level_weight=0.75 if by_level else 0.25, ceiling=round(high, 4), related=(low, high), unrelated=(min(unrelated, default=0.0), noise), related_margins=(min(margins, default=0.0), max(margins, default=0.0)),
        unrelated_margins=(min(other_margins, default=0.0), max(other_margins, default=0.0)), separator="level" if by_level else "margin" if by_margin else "neither",
        anisotropy=background[0], anisotropy_p95=background[1], headroom=round(low - background[1], 4), separability=separability, doc_anisotropy=documents[0], doc_anisotropy_p95=documents[1],
    )


# What the model families were trained with.
QWEN3_QUERY = "Instruct: Given a search query, retrieve relevant passages that answer it\nQuery: "
BGE_EN_QUERY = "Represent this sentence for searching relevant passages: "


def conventions(architecture: str, name: str, pooling: str = "", causal: bool = False) -> dict[str, str]:
    """Query and document prefixes and the pooling of a model's family; causal models are never pooled at their first token."""
    arch, called = architecture.lower(), name.lower()
    families = (
        ("qwen3" in arch or "qwen3-embedding" in called, QWEN3_QUERY, ""),
        ("bge-m3" in called or "bge_m3" in called, "", ""),
        ("bge" in called, BGE_EN_QUERY, ""),
        ("e5" in called, "query: ", "passage: "),
    )
    query, document = next(((q, d) for fits, q, d in families if fits), ("", ""))
    return {"query_prefix": query, "doc_prefix": document, "pooling": pooling if pooling in ("cls", "mean", "last") else "last" if causal else "cls"}


#: Fixed values of the model file format: value types by number, as struct codes.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
TEXT, LIST = 8, 9
POOLING = {0: "none", 1: "mean", 2: "cls", 3: "last"}


@dataclasses.dataclass
class Model:
    """What a model file says of itself."""

    architecture: str = ""
    name: str = ""
    pooling: str = ""
    dim: int = 0
    context: int = 0
    blocks: int = 0


def model_header(path: str | Path, longest_list: int = 64) -> Model:
    """The header of a GGUF file; lists beyond `longest_list` entries are skipped over, tensors are not read."""
    with open(path, "rb") as f:

        def number(code: str):
            data = f.read(struct.calcsize("<" + code))
            if len(data) < struct.calcsize("<" + code):
                raise ValueError(f"{path} ends inside its header")
            return struct.unpack("<" + code, data)[0]

        def text() -> str:
            return f.read(number("Q")).decode("utf-8", "replace")

        def value(kind: int):
            if kind in SCALARS:
                return number(SCALARS[kind])
            if kind == TEXT:
                return text()
            if kind != LIST:
                raise ValueError(f"{path}: unknown value type {kind}")
            inner, n = number("I"), number("Q")
            if inner in SCALARS and n > longest_list:
                f.seek(struct.calcsize("<" + SCALARS[inner]) * n, 1)
                return []
            return [value(inner) for _ in range(n)]

        if f.read(4) != b"GGUF":
            raise ValueError(f"{path} is not a model file")
        number("I")  # version
        number("Q")  # tensors
        held = {}
        for _ in range(number("Q")):
            key = text()
            held[key] = value(number("I"))
    arch = held.get("general.architecture", "")
    own = lambda name, default=0: held.get(f"{arch}.{name}", default)
    return Model(arch, held.get("general.name", ""), POOLING.get(own("pooling_type", -1), ""), own("embedding_length"), own("context_length"), own("block_count"))
