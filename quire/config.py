"""Parameters and fixed values."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

# Words that carry no meaning in a question.
STOP_WORDS = ("a", "an", "and", "are", "be", "can", "do", "does", "for", "how", "is", "it", "of", "or", "should", "the", "to", "what", "when", "which", "who")

# File types by extension, and the content types that each extension may hold.
FILE_TYPES = {".txt": "txt", ".md": "md", ".markdown": "md", ".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".csv": "csv", ".json": "json"}
CONTENT_TYPES = {
    ".txt": ("text", "markdown", "csv", "json"),
    ".md": ("text", "markdown", "csv", "json"),
    ".markdown": ("text", "markdown", "csv", "json"),
    ".pdf": ("pdf",),
    ".docx": ("docx",),
    ".pptx": ("pptx",),
    ".xlsx": ("xlsx",),
    ".csv": ("text", "csv"),
    ".json": ("json",),
}
BLOCK_TYPES = ("title", "heading", "paragraph", "list_item", "table", "code", "json", "page_break", "unknown")
MAX_FILE_BYTES = 25 * 1024 * 1024
SAMPLE_BYTES = 8192
MAX_UPLOADS = 100
ROLES = ("system", "user", "assistant")


@dataclass(frozen=True)
class Chunking:
    parent_target: int = 1200
    parent_hard_max: int = 2000
    child_target: int = 350
    child_overlap: int = 60
    prefix: bool = True

    def __post_init__(self) -> None:
        if min(self.parent_target, self.parent_hard_max, self.child_target) < 1:
            raise ValueError("token limits must be at least 1")
        if self.parent_hard_max < self.parent_target:
            raise ValueError("parent_hard_max must not be below parent_target")
        if not 0 <= self.child_overlap < self.child_target:
            raise ValueError("child_overlap must be from 0 to below child_target")


@dataclass(frozen=True)
class Weights:
    vector: float = 0.62
    lexical: float = 0.30
    phrase: float = 0.08

    @classmethod
    def from_environment(cls, prefix: str = "QUIRE_HYBRID_") -> Weights:
        """Weights from variables such as QUIRE_HYBRID_VECTOR_WEIGHT where they are set."""
        return cls(*(env_float(f"{prefix}{name.upper()}_WEIGHT", getattr(cls, name)) for name in ("vector", "lexical", "phrase")))


def env_float(name: str, default: float) -> float:
    raw = os.environ.get(name, "").strip()
    if not raw:
        return default
    try:
        return float(raw)
    except ValueError:
        raise ValueError(f"{name} must be a number, not {raw!r}") from None


def env_int(name: str, default: int, least: int | None = None) -> int:
    raw = os.environ.get(name, "").strip()
    if not raw:
        return default
    try:
        found = int(raw)
    except ValueError:
        raise ValueError(f"{name} must be a whole number, not {raw!r}") from None
    if least is not None and found < least:
        raise ValueError(f"{name} must be at least {least}, not {found}")
    return found


def load_env(start: str | None = None) -> Path | None:
    """Set the variables of the nearest .env file, from `start` (the working folder) upwards; those already set stay. Its path, if there is one."""
    own = Path(start or os.getcwd()).resolve()
    found = next((p for folder in (own, *own.parents) if (p := folder / ".env").is_file()), None)
    if found is None or os.environ.get("QUIRE_SKIP_DOTENV") == "1":
        return None
    for row in found.read_text(encoding="utf-8").splitlines():
        entry = re.match(r"\s*(?:export\s+)?([^\s#=][^=]*?)\s*=\s*(.*?)\s*$", row)
        if entry:
            quoted = re.fullmatch(r"""(["'])(.*)\1""", entry[2])
            os.environ.setdefault(entry[1], quoted[2] if quoted else entry[2])
    return found


def page(limit: int, offset: int, most: int = 500) -> tuple[int, int]:
    """A page's limit and offset, checked."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return limit, offset


def query_text(query: str) -> str:
    cleaned = query.strip()
    if not cleaned:
        raise ValueError("query must not be blank")
    return cleaned


def candidate_limit(top_k: int) -> int:
    """How many candidates each branch of a search brings."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return min(max(8 * top_k, 50), 200)


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    weights: Weights = field(default_factory=Weights)
    filters: dict[str, str] = field(default_factory=dict)
