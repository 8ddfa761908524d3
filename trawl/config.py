"""Plan-time configuration: vectors, metadata indexes, collections and queries, with their checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

TOKENIZERS = ("whitespace", "trigrams", "full_text", "wmtr")
DENSE = ("dense_model", "dense_custom")
SPARSE = (*TOKENIZERS, "sparse_model", "sparse_custom", "noop")
ALIASES = {"keyword": "wmtr"}
DISTANCES = ("cosine", "dot", "euclid")
FIELDS = ("name", "description", "content", "template")
INDEX_TYPES = ("string", "integer", "float", "boolean", "datetime")
EXCLUDABLE = ("name", "description", "content", "tags", "metadata")
ID = re.compile(r"[A-Za-z0-9_-]{1,100}")


class ConfigError(ValueError):
    """A configuration or query that can't be planned."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class VectorConfig:
    name: str
    type: str
    index_fields: tuple[str, ...] = ("content",)
    top_k: int = 128
    word_ratio: int = 80
    trigram_weight: float = 1.0
    language: str = "en"
    detect_language: bool = False
    confidence: float = 0.9
    distance: str = "cosine"
    normalization: bool | None = None
    dimensions: int | None = None
    model: str | None = None
    document_template: str | None = None
    query_template: str | None = None

    def __post_init__(self) -> None:
        kind = ALIASES.get(self.type.lower(), self.type.lower())
        object.__setattr__(self, "type", kind)
        _need(kind in DENSE or kind in SPARSE, f"unknown vector type {self.type!r}")
        dense = kind in DENSE
        if self.normalization is None:
            object.__setattr__(self, "normalization", dense)
        _need(bool(self.name), "a vector needs a name")
        _need(1 <= self.top_k <= 10_000, "top_k must be from 1 to 10000")
        _need(0 <= self.word_ratio <= 100, "word_ratio must be from 0 to 100")
        _need(0 <= self.confidence <= 1, "confidence must be from 0 to 1")
        _need(re.fullmatch("[a-z]{2}", self.language) is not None, "language must be two letters")
        _need(self.distance in DISTANCES, f"unknown distance {self.distance!r}")
        _need(dense or self.distance == "cosine", "a distance other than cosine needs a dense vector")
        _need(dense or not self.normalization, "only dense vectors are normalised")
        _need((self.model is not None) == kind.endswith("_model"), "model vectors, and no others, need a model")
        _need(kind != "dense_custom" or self.dimensions is not None, "dense_custom needs dimensions")
        _need(self.dimensions is None or 1 <= self.dimensions <= 8192, "dimensions must be from 1 to 8192")
        _need((self.document_template is None) == (self.query_template is None), "templates come in pairs")
        if self.document_template is not None:
            _need(not kind.endswith("_custom") and kind != "noop", f"{kind} takes no template")
            _need(self.index_fields in ((), ("content",)), "a template excludes index_fields")
            object.__setattr__(self, "index_fields", ("template",))
        _need(all(f in FIELDS for f in self.index_fields), "unknown index field")

    @property
    def slots(self) -> tuple[str, ...]:
        return tuple(f"{f}_{self.name}" for f in self.index_fields)


@dataclass(frozen=True)
class MetadataIndex:
    key: str
    type: str

    def __post_init__(self) -> None:
        _need(0 < len(self.key) <= 100, "a metadata key has 1 to 100 characters")
        _need(self.type in INDEX_TYPES, f"{self.type!r} can't be indexed")


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    vectors: tuple[VectorConfig, ...] = ()
    metadata_indexes: tuple[MetadataIndex, ...] = ()
    store_content: bool = True

    def __post_init__(self) -> None:
        _need(ID.fullmatch(self.name) is not None, f"bad collection name {self.name!r}")
        if not self.vectors:
            object.__setattr__(self, "vectors", (VectorConfig("noop", "noop", index_fields=("name",)),))
        _need(len({v.name for v in self.vectors}) == len(self.vectors), "vector names must differ")
        _need(len({m.key for m in self.metadata_indexes}) == len(self.metadata_indexes), "metadata keys must differ")

    @property
    def types(self) -> dict[str, str]:
        return {m.key: m.type for m in self.metadata_indexes}


@dataclass(frozen=True)
class SearchOption:
    """One ranked retrieval of a search: a vector over a field, with its weight in the fusion."""

    vector: str
    field: str | None = None
    weight: float = 1.0
    trigram_weight: float = 1.0
    raw_score_threshold: float | None = None


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    options: tuple[SearchOption, ...] = ()
    limit: int = 10
    score_threshold: float | None = None
    fusion: str = "rrf"
    metadata_filter: str | dict | None = None
    tags: tuple[str, ...] = ()
    tags_match_all: bool = False
    exclude: tuple[str, ...] = ()
    raw_scores: bool = False
    group_by: str | None = None
    group_max: int = 3
    group_max_fetches: int = 2
    facets: tuple[str, ...] = ()
    facet_multiplier: int = 2
    facet_values: int = 10
    join: tuple[str, ...] = ()
    custom_vectors: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self) -> None:
        _need(1 <= self.limit <= 100, "limit must be from 1 to 100")
        _need(len(self.text) <= 10_000, "a query has at most 10000 characters")
        _need(self.fusion in ("rrf", "linear"), "fusion is rrf or linear")
        _need(self.group_max >= 1 and self.group_max_fetches >= 1, "group knobs are at least 1")
        _need(1 <= self.facet_multiplier <= 10 and 1 <= self.facet_values <= 100, "facet knobs are out of range")
        object.__setattr__(self, "exclude", tuple(dict.fromkeys(self.exclude)))
        _need(all(x in EXCLUDABLE for x in self.exclude), "unknown field to exclude")

    @property
    def prefetch(self) -> int:
        """How many candidates each arm keeps."""
        n = max(int(1.5 * self.limit), 5)
        return max(n, 50, self.facet_multiplier * self.limit) if self.facets else n


def arms_of(config: CollectionConfig, query: SearchQuery) -> list[tuple[VectorConfig, str, SearchOption]]:
    """The arms of a query: all vectors and fields in equal parts without options; weight 0 drops an arm."""
    by_name = {v.name: v for v in config.vectors}
    if not query.options:
        arms = [(v, f) for v in config.vectors if v.type != "noop" for f in v.index_fields]
        return [(v, f, SearchOption(v.name, f, 1.0 / len(arms))) for v, f in arms]
    out = []
    for option in query.options:
        _need(option.vector in by_name, f"unknown vector {option.vector!r}")
        vector = by_name[option.vector]
        if vector.document_template is not None:
            option = replace(option, field="template")
        _need(option.field is not None, f"vector {vector.name!r} needs a field")
        _need(option.field in vector.index_fields, f"field {option.field!r} isn't indexed by {vector.name!r}")
        if option.weight != 0:
            out.append((vector, option.field, option))
    return out


def resolve_field(vector: VectorConfig, name: str | None) -> str:
    """A template vector ignores the field that is asked for; others need an indexed one."""
    if vector.document_template is not None:
        return "template"
    _need(name is not None and name in vector.index_fields, f"field {name!r} isn't indexed by {vector.name!r}")
    return name
