"""Validated settings of the stages; the defaults are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class GateConfig:
    rules: tuple[str, ...] = ("non_empty", "min_words", "no_mojibake", "no_boilerplate_markers", "no_pii")
    text_column: str = "text"
    id_column: str = "id"
    min_words: int = 5
    boilerplate_marker_threshold: int = 2
    max_duplicate_sentence_ratio: float = 0.3
    max_reject_rate: float = 0.5
    part_rows: int = 1000

    def __post_init__(self) -> None:
        from millrace.operators.rules import RULES

        unknown = [r for r in self.rules if r not in RULES]
        if unknown:
            raise ValueError(f"unknown rules {unknown}; known: {sorted(RULES)}")
        if not 0 <= self.max_reject_rate <= 1:
            raise ValueError("max_reject_rate must lie between 0 and 1")


@dataclass(frozen=True)
class DedupConfig:
    normalize: str = "whitespace"
    shingle_size: int = 5
    num_perm: int = 128
    bands: int = 32
    threshold: float = 0.8
    backend: str = "bands"
    seed: int = 0
    text_column: str = "text"
    id_column: str = "id"
    part_rows: int = 1000

    def __post_init__(self) -> None:
        if self.normalize not in ("none", "whitespace", "aggressive"):
            raise ValueError("normalize must be none, whitespace or aggressive")
        if self.backend not in ("bands", "mllib"):
            raise ValueError("backend must be bands or mllib")
        if self.num_perm < 2 or self.bands < 1 or self.num_perm % self.bands:
            raise ValueError(f"bands ({self.bands}) must divide num_perm ({self.num_perm})")
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        if self.shingle_size < 1:
            raise ValueError("shingle_size must be positive")


@dataclass(frozen=True)
class ShardConfig:
    seq_len: int = 256
    sequences_per_shard: int = 512
    seed: int = 0
    text_column: str = "text"
    id_column: str = "id"

    def __post_init__(self) -> None:
        if self.seq_len < 8:
            raise ValueError("seq_len must be at least 8")


@dataclass(frozen=True)
class CorpusConfig:
    seed: int = 0
    n_docs: int = 500
    source_weights: tuple[tuple[str, float], ...] = (("news", 0.4), ("forum_qa", 0.3), ("code", 0.2), ("recipes", 0.1))
    exact_dup_rate: float = 0.06
    near_dup_rate: float = 0.10
    junk_rate: float = 0.06
    pii_rate: float = 0.04
    span_days: int = 30

    def __post_init__(self) -> None:
        rates = (self.exact_dup_rate, self.near_dup_rate, self.junk_rate, self.pii_rate)
        if self.n_docs < 10 or any(not 0 <= r <= 0.3 for r in rates) or sum(rates) > 0.6:
            raise ValueError("n_docs must be at least 10, each rate at most 0.3 and their sum at most 0.6")


def override(config, **values):
    """The config with the values that are not None."""
    known = {f.name for f in fields(config)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return replace(config, **{k: v for k, v in values.items() if v is not None})


def from_mapping(kind, values: dict | None):
    """A config from a loaded YAML or JSON mapping; lists become tuples, nulls are ignored."""
    return override(kind(), **{k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items()})
