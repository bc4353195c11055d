"""What a collection is made of: fields, sources and where its index lives."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

TYPES = ("text", "keyword", "number", "enum", "boolean")
RAW = ("keyword", "enum", "boolean")  # one term: the whole value
ENUM_VALUES = 128  # distinct values of an automatic enum that are listed


@dataclass(frozen=True)
class Field:
    """A column.  ``values``: a tuple lists an enum's values; anything else means
    that they are found in the data."""

    name: str
    type: str = "text"
    fuzzy: bool = False
    values: tuple[str, ...] | None = None
    max_values: int = ENUM_VALUES

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"{self.name}: unknown type {self.type!r}")

    @property
    def analyzed(self) -> str | None:
        """How a text is cut into terms: trigrams, words, or (None) not at all."""
        return ("trigram" if self.fuzzy else "word") if self.type == "text" else None


@dataclass(frozen=True)
class Source:
    path: str
    mapping: dict[str, str] = field(default_factory=dict)  # field -> CSV column
    defaults: dict[str, str] = field(default_factory=dict)
    use_mapping: str | None = None

    def resolved(self, named: dict[str, dict[str, str]]) -> dict[str, str]:
        """A named mapping replaces the source's own; an unknown name doesn't."""
        return dict(named.get(self.use_mapping or "", self.mapping))


@dataclass(frozen=True)
class Config:
    fields: tuple[Field, ...]
    sources: tuple[Source, ...] = ()
    mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    index_path: str = "index"
    port: int = 8888
    memory_budget: str = "100%"
    auth_token: str | None = None

    def named(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @staticmethod
    def parse(text: str) -> Config:
        raw = tomllib.loads(text)
        server = raw["server"]

        def one(f: dict) -> Field:
            if f.get("search") not in (None, "fuzzy"):
                raise ValueError(f"{f['name']}: unknown search mode {f['search']!r}")
            values = f.get("values")
            return Field(f["name"], f["type"], f.get("search") == "fuzzy", tuple(values) if isinstance(values, list) else None, f.get("max_values", ENUM_VALUES))

        return Config(
            tuple(map(one, raw["schema"]["fields"])),
            tuple(Source(s["path"], s.get("mapping", {}), s.get("defaults", {}), s.get("use_mapping")) for s in raw["sources"]),
            raw.get("mappings", {}),
            server["index_path"],
            server.get("port", 8888),
            server.get("memory_budget", "100%"),
            server.get("auth_token"),
        )

    @staticmethod
    def load(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return Config.parse(f.read())
