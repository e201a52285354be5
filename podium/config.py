"""Settings shared by the operators: field roles, cutoffs and run parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Results and stored keys depend on them.
CUTOFFS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 500, 1000)
KEY_SEPARATOR = "_{!@#~}_"
DEFAULT_MAX_TOKENS = 77
RBP_PERSISTENCE = (0.7, 0.8, 0.9)
LEADERBOARD_METRICS = ("MAP@1000", "P@10", "Recall@10", "MRR@1000", "NDCG@10", "mERR")


@dataclass(frozen=True)
class FieldSpec:
    """One field of a query or a document: what it holds and how much it counts."""

    name: str
    kind: str = "txt"
    weight: float = 1.0
    max_tokens: int = 0

    def __post_init__(self):
        if self.kind not in ("txt", "img"):
            raise ValueError(f"field {self.name!r}: kind must be 'txt' or 'img', not {self.kind!r}")
        if self.weight < 0:
            raise ValueError(f"field {self.name!r}: weight must not be negative")


@dataclass(frozen=True)
class TripletConfig:
    """Column roles of a triplet table."""

    left: tuple[FieldSpec, ...] = (FieldSpec("text"),)
    # Default roles and their weights.
    right: tuple[FieldSpec, ...] = (FieldSpec("image_local", "img", 0.9), FieldSpec("title", "txt", 0.1))
    weight_key: str | None = None
    doc_id_key: str = "product_id"
    query_id_key: str | None = None

    def __post_init__(self):
        if not self.left or not self.right:
            raise ValueError("both sides need at least one field")


@dataclass(frozen=True)
class EvalConfig:
    """Parameters of one evaluation."""

    top_q: int = 2000
    top_k: int = 1000
    sampling: str = "weighted"
    seed: int = 1
    max_queries: int | None = None
    similarity: str = "cosine"
    score_digits: int | None = None
    ties: str = "reference"
    cutoffs: tuple[int, ...] = CUTOFFS
    persistence: tuple[float, ...] = RBP_PERSISTENCE

    def usable_cutoffs(self) -> list[int]:
        return [k for k in self.cutoffs if k <= self.top_k]


def token_limit(requested: int = 0, configured: int | None = None) -> int:
    """Context length in tokens: the requested one, else the model's, else the default."""
    return requested or configured or DEFAULT_MAX_TOKENS
