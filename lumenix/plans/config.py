"""Index configuration: TOML in, validated dataclasses out."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from typing import Any

from lumenix.functions.identity import fingerprint

DEFAULT_MAX_LEVELS = 3


class ConfigError(ValueError):
    pass


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _known(table: Any, names: set[str], where: str) -> dict:
    _check(isinstance(table, dict), f"{where} must be a table")
    extra = sorted(set(table) - names)
    _check(not extra, f"{where} has unknown settings {extra}")
    return table


@dataclass(frozen=True)
class Stage:
    """An implementation and its settings, which are handed to it as they are."""

    impl: str
    settings: dict[str, Any] = field(default_factory=dict)
    persist_output: bool = True

    @classmethod
    def of(cls, raw: Any, where: str) -> "Stage":
        _check(isinstance(raw, dict) and isinstance(raw.get("impl"), str), f"{where} needs `impl`")
        rest = {k: v for k, v in raw.items() if k not in ("impl", "persist_output")}
        persist = raw.get("persist_output", True)
        _check(isinstance(persist, bool), f"{where}.persist_output must be true or false")
        return cls(raw["impl"], rest, persist)

    def identity(self) -> dict:
        return {"impl": self.impl, "settings": self.settings, "persist_output": self.persist_output}


@dataclass(frozen=True)
class DimensionConfig:
    description: str = ""
    enabled: bool = True
    classifier: Stage | None = None
    embedder: Stage | None = None
    fabricator: Stage | None = None
    levels: tuple[int, ...] | None = None
    dims: int | None = None
    quant: str | None = None

    @property
    def emits_descriptor(self) -> bool:
        return self.classifier is not None and self.classifier.persist_output

    @property
    def emits_tensor(self) -> bool:
        return self.embedder is not None

    def search_levels(self) -> tuple[int, ...]:
        """Declared levels; else up to the fabricator's height, or segments only."""
        if self.levels is not None:
            return tuple(sorted(set(self.levels)))
        if self.fabricator is None:
            return (0,)
        return tuple(range(int(self.fabricator.settings.get("max_levels", DEFAULT_MAX_LEVELS)) + 1))

    def fingerprint(self) -> str:
        """Of what decides stored bytes: not the description, not whether it is enabled."""
        stage = lambda s: s.identity() if s else None
        return fingerprint({"classifier": stage(self.classifier), "embedder": stage(self.embedder), "fabricator": stage(self.fabricator), "dims": self.dims, "quant": self.quant})


@dataclass(frozen=True)
class Config:
    lines: int = 40
    overlap: int = 8
    dimensions: dict[str, DimensionConfig] = field(default_factory=dict)
    max_bytes: int = 4 << 20

    def active(self) -> dict[str, DimensionConfig]:
        return {n: d for n, d in sorted(self.dimensions.items()) if d.enabled}

    def fingerprint(self) -> str:
        return fingerprint({"lines": self.lines, "overlap": self.overlap, "dimensions": {n: d.fingerprint() for n, d in self.active().items()}})

    def segmenter(self) -> str:
        return fingerprint({"impl": "window", "lines": self.lines, "overlap": self.overlap})


def _fabricator(name: str, dim: DimensionConfig) -> None:
    stage = dim.fabricator
    where = f"dimensions.{name}.fabricator"
    _check(dim.emits_descriptor, f"{where}: clusters are labelled from stored descriptors, and there are none")
    _check(stage.impl == "agglomerative", f"{where}.impl: only agglomerative is implemented")
    _check(dim.emits_tensor, f"{where}: clusters are built from vectors, and there is no embedder")
    s = stage.settings

    def whole(key: str) -> int | None:
        v = s.get(key)
        _check(v is None or (isinstance(v, int) and not isinstance(v, bool)), f"{where}.{key} must be an integer")
        return v

    t = s.get("threshold")
    _check(t is None or (isinstance(t, (int, float)) and not isinstance(t, bool) and 0 < t <= 1), f"{where}.threshold must be a number in (0, 1]")
    low, high, levels, left = (whole(k) for k in ("min_cluster", "max_cluster", "max_levels", "min_remaining"))
    _check(low is None or low >= 2, f"{where}.min_cluster must be 2 or more")
    _check(high is None or high == 0 or high >= (low or 2), f"{where}.max_cluster must be 0 or no less than min_cluster")
    _check(levels is None or 1 <= levels <= 65535, f"{where}.max_levels must be from 1 to 65535")
    _check(left is None or left >= 1, f"{where}.min_remaining must be 1 or more")


def validate(config: Config) -> Config:
    _check(config.lines > 0, "segmenter.lines must be positive")
    _check(0 <= config.overlap < config.lines, "segmenter.overlap must be smaller than lines")
    for name in config.dimensions:
        _check(re.fullmatch(r"[a-z0-9_-]{1,64}", name) is not None, f"dimension name {name!r} is not usable")
    persist: dict[str, bool] = {}
    for name, d in config.active().items():
        where = f"dimensions.{name}"
        _check(d.emits_descriptor or d.emits_tensor, f"{where} stores neither a descriptor nor a vector")
        _check(d.classifier is None or "prompt" not in d.classifier.settings, f"{where}.classifier.prompt is now classifier.prompts, by level")
        _check(d.fabricator is None or "label_prompt" not in d.fabricator.settings, f"{where}.fabricator.label_prompt is now classifier.prompts, by level")
        if d.fabricator is not None:
            _fabricator(name, d)
        if d.classifier is not None:
            kept = persist.setdefault(d.classifier.impl, d.classifier.persist_output)
            _check(kept == d.classifier.persist_output, f"{where}: dimensions that share a classifier must agree on persist_output")
        _check(d.dims is None, f"{where}.dims is not implemented")
        _check(d.quant is None, f"{where}.quant is not implemented")
    shared = {tuple(sorted((k, repr(d.classifier.settings.get(k))) for k in ("prompts", "prompt", "facets"))) for d in config.active().values() if d.classifier and d.classifier.impl == "llm"}
    _check(len(shared) <= 1, "all llm dimensions must agree on prompts and facets")
    return config


def parse(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}") from e
    _known(raw, {"version", "segmenter", "dimensions", "storage", "discover"}, "the configuration")
    _check(raw.get("version") == 1, "version must be 1")
    seg = _known(raw.get("segmenter", {}), {"impl", "lines", "overlap"}, "segmenter")
    _check(seg.get("impl", "window") == "window", "segmenter.impl: only window is implemented")
    storage = _known(raw.get("storage", {}), {"commit", "location"}, "storage")
    _check(storage.get("commit", "full") == "full", "storage.commit: only full is implemented")
    _check(storage.get("location", "working-tree") == "working-tree", "storage.location: only working-tree is implemented")
    for k in ("lines", "overlap"):
        _check(isinstance(seg.get(k, 0), int) and not isinstance(seg.get(k, 0), bool), f"segmenter.{k} must be an integer")
    disc = _known(raw.get("discover", {}), {"max_bytes"}, "discover")
    dims = {}
    for name, d in raw.get("dimensions", {}).items():
        _known(d, {"description", "enabled", "classifier", "embedder", "fabricator", "levels", "dims", "quant"}, f"dimensions.{name}")
        stages = {k: Stage.of(d[k], f"dimensions.{name}.{k}") for k in ("classifier", "embedder", "fabricator") if k in d}
        levels = tuple(d["levels"]) if "levels" in d else None
        dims[name] = DimensionConfig(d.get("description", ""), d.get("enabled", True), **stages, levels=levels, dims=d.get("dims"), quant=d.get("quant"))
    base = default()
    return validate(Config(seg.get("lines", 40), seg.get("overlap", 8), dims or base.dimensions, disc.get("max_bytes", 4 << 20)))


def default() -> Config:
    """Without a file: declarations and terms."""
    return Config(dimensions={"declaration": DimensionConfig("declared names", classifier=Stage("declaration")), "lexical": DimensionConfig("terms", classifier=Stage("structural"))})


def check_levels(name: str, declared: tuple[int, ...] | None, built: tuple[int, ...]) -> None:
    """Levels declared narrower than built would hide records: refused. Wider is fine."""
    missing = sorted(set(built) - set(declared)) if declared is not None else []
    _check(not missing, f"dimension {name!r} holds levels {missing} that its configuration leaves out")
