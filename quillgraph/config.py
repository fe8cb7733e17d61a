"""Settings by section, checked when they are made; flat keywords are mirrored into the sections, and sections win."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

METHODS = ("ppr", "semantic", "hybrid")
PROVIDERS = ("groq", "openai")


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass
class GraphConfig:
    enable_concept_clustering: bool = False  # accepted; concepts are not clustered at build time
    max_concept_freq_ratio: float = 0.5
    min_concept_freq: int = 2

    def __post_init__(self) -> None:
        _need(isinstance(self.min_concept_freq, int) and self.min_concept_freq > 0, "min_concept_freq must be a positive integer")
        _need(_number(self.max_concept_freq_ratio) and 0 < self.max_concept_freq_ratio <= 1, "max_concept_freq_ratio must be in (0, 1]")


@dataclass
class RetrievalConfig:
    frequency_weight: float = 0.5
    ppr_max_iterations: int = 100
    semantic_weight: float = 0.5
    ppr_alpha: float = 0.15
    default_retrieval_method: str = "ppr"
    top_k: int = 10

    def __post_init__(self) -> None:
        for name in ("top_k", "ppr_max_iterations"):
            _need(isinstance(getattr(self, name), int) and getattr(self, name) > 0, f"{name} must be a positive integer")
        _need(_number(self.ppr_alpha) and 0 <= self.ppr_alpha <= 1, "ppr_alpha must be in [0, 1]")
        for name in ("semantic_weight", "frequency_weight"):
            _need(_number(getattr(self, name)) and getattr(self, name) >= 0, f"{name} must not be negative")
        _need(self.semantic_weight + self.frequency_weight > 0, "semantic_weight and frequency_weight must not both be 0")
        _need(self.default_retrieval_method in METHODS, f"default_retrieval_method must be one of {METHODS}")


@dataclass
class NERConfig:
    extraction_cache_dir: str = "extraction_cache"
    llm_api_key: str | None = None
    llm_model: str | None = None
    llm_provider: str = "groq"
    use_llm_for_ner: bool = False

    def __post_init__(self) -> None:
        _need(self.llm_provider in PROVIDERS, f"llm_provider must be one of {PROVIDERS}")
        _need(bool(str(self.extraction_cache_dir or "").strip()), "extraction_cache_dir must not be empty")


@dataclass
class EmbeddingConfig:
    semantic_match_threshold: float = 0.7
    use_semantic_entity_matching: bool = True

    def __post_init__(self) -> None:
        _need(_number(self.semantic_match_threshold) and 0 <= self.semantic_match_threshold <= 1, "semantic_match_threshold must be in [0, 1]")


@dataclass
class StorageConfig:
    auto_save_graph: bool = False
    graph_save_path: str | None = "quillgraph_graph"

    def __post_init__(self) -> None:
        _need(not self.auto_save_graph or bool(str(self.graph_save_path or "").strip()), "auto_save_graph needs a graph_save_path")


SECTIONS = {"graph_config": GraphConfig, "retrieval_config": RetrievalConfig, "ner_config": NERConfig, "embedding_config": EmbeddingConfig, "storage_config": StorageConfig}


@dataclass(init=False)
class EngineConfig:
    """Five sections; every field of a section is an attribute too, and a keyword unless its section is given."""

    graph_config: GraphConfig = field()
    retrieval_config: RetrievalConfig = field()
    ner_config: NERConfig = field()
    embedding_config: EmbeddingConfig = field()
    storage_config: StorageConfig = field()

    def __init__(self, **given):
        for name, cls in SECTIONS.items():
            section, own = given.pop(name, None), {f.name: given.pop(f.name) for f in fields(cls) if f.name in given}
            if section is None:
                section = cls(**own)
            elif isinstance(section, dict):
                section = cls(**section)
            elif not isinstance(section, cls):
                raise TypeError(f"{name} must be a {cls.__name__} or a dict")
            setattr(self, name, section)
            for f in fields(cls):
                setattr(self, f.name, getattr(section, f.name))
        if given:
            raise TypeError(f"unknown settings: {sorted(given)}")

    def to_dict(self) -> dict[str, dict]:
        return {name: asdict(getattr(self, name)) for name in SECTIONS}
