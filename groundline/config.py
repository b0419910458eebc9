"""Settings of a run, from defaults, a YAML file and dotted overrides; and the engine's errors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


class GroundlineError(Exception):
    """Base of the engine's errors."""


class ConfigurationError(GroundlineError):
    """A setting is unknown or unusable."""


class AcquisitionError(GroundlineError):
    """A source could not be read."""


class EvaluationError(GroundlineError, ValueError):
    """Judgements and collection do not go together."""


class ParsingError(GroundlineError):
    """A document or answer of a source can't be read."""


class IndexNotBuiltError(GroundlineError):
    """A search in an index that has not been built."""


class EmbeddingError(GroundlineError):
    """No encoder fits the settings, or it failed."""


class GenerationError(GroundlineError):
    """No answer can be written from the evidence."""


class RequestError(GroundlineError):
    """A request breaks its limits."""


@dataclass
class Chunking:
    strategy: str = "section_aware"
    target_tokens: int = 300
    overlap_tokens: int = 40
    min_tokens: int = 40

    def check(self) -> None:
        if self.strategy not in ("section_aware", "fixed_window"):
            raise ConfigurationError(f"unknown chunking strategy {self.strategy!r}")
        if not 0 <= self.overlap_tokens < self.target_tokens or self.min_tokens < 1:
            raise ConfigurationError("the overlap must be below the target, and the minimum at least 1")


@dataclass
class Embedding:
    backend: str = "tfidf_svd"
    dim: int = 256
    min_df: int = 1
    max_df: float = 0.85
    ngram_max: int = 2

    def check(self) -> None:
        if self.backend not in ("tfidf_svd", "sentence_transformers", "openai"):
            raise ConfigurationError(f"unknown embedding backend {self.backend!r}")
        if self.dim < 1 or not 0 < self.max_df <= 1:
            raise ConfigurationError("dim must be positive and max_df a share")


@dataclass
class Retrieval:
    top_k: int = 10
    candidate_k: int = 50
    fusion: str = "weighted"
    lexical_weight: float = 0.45
    dense_weight: float = 0.55
    rrf_k: int = 60
    stemming: bool = True

    def check(self) -> None:
        if self.fusion not in ("weighted", "rrf"):
            raise ConfigurationError(f"unknown fusion {self.fusion!r}")
        if self.fusion == "weighted" and self.lexical_weight + self.dense_weight == 0:
            raise ConfigurationError("weighted fusion needs a weight other than zero")
        if self.top_k < 1 or self.candidate_k < self.top_k:
            raise ConfigurationError("candidate_k must be at least top_k")


@dataclass
class Reranking:
    enabled: bool = True
    model: str = "logistic"
    candidate_k: int = 30
    top_k: int = 10

    def check(self) -> None:
        if self.model not in ("logistic", "none"):
            raise ConfigurationError(f"unknown reranker {self.model!r}")


@dataclass
class Planning:
    enabled: bool = True
    max_subqueries: int = 3


@dataclass
class Generation:
    backend: str = "extractive"
    max_spans: int = 4
    span_sentences: int = 2
    min_support_overlap: float = 0.35

    def check(self) -> None:
        if self.backend not in ("extractive", "anthropic", "openai"):
            raise ConfigurationError(f"unknown generation backend {self.backend!r}")


@dataclass
class Evaluation:
    k_values: list[int] = field(default_factory=lambda: [1, 3, 5, 10])
    primary_k: int = 5
    token_budget: int = 400
    max_budget_k: int = 25

    def check(self) -> None:
        if not self.k_values or min(self.k_values) < 1:
            raise ConfigurationError("k_values must be positive")
        self.k_values = sorted(set(self.k_values))
        if self.primary_k not in self.k_values:
            raise ConfigurationError("primary_k must be one of k_values")


@dataclass
class Settings:
    seed: int = 20260101
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    reranking: Reranking = field(default_factory=Reranking)
    planning: Planning = field(default_factory=Planning)
    generation: Generation = field(default_factory=Generation)
    evaluation: Evaluation = field(default_factory=Evaluation)

    def check(self) -> Settings:
        for f in fields(self):
            part = getattr(self, f.name)
            if hasattr(part, "check"):
                part.check()
        return self

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        import yaml

        try:
            with open(path, encoding="utf-8") as f:
                raw = yaml.safe_load(f) or {}
        except (OSError, yaml.YAMLError) as e:
            raise ConfigurationError(f"could not read {path}: {e}") from e
        if not isinstance(raw, dict):
            raise ConfigurationError(f"{path} holds no mapping")
        flat = {f"{k}.{n}": v for k, part in raw.items() if isinstance(part, dict) for n, v in part.items()} | {k: v for k, v in raw.items() if not isinstance(v, dict)}
        return cls().with_overrides(flat)

    def with_overrides(self, overrides: dict[str, Any]) -> Settings:
        """A checked copy with dotted settings replaced; texts are read as YAML scalars."""
        import copy

        import yaml

        out = copy.deepcopy(self)
        for dotted, value in overrides.items():
            at, *path = [out, *dotted.split(".")]
            for name in path[:-1]:
                at = getattr(at, name, None)
            if not is_dataclass(at) or path[-1] not in asdict(at) or is_dataclass(getattr(at, path[-1])):
                raise ConfigurationError(f"unknown setting {dotted}")
            setattr(at, path[-1], yaml.safe_load(value) if isinstance(value, str) else value)
        return out.check()
