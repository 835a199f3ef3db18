"""Strict run configuration."""

from __future__ import annotations

import re
from typing import Literal

from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

SAFE = re.compile(r"[A-Za-z0-9._-]+")


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Universe(Strict):
    kind: Literal["table", "csv"] = "table"
    path: str | None = None
    tickers: list[str] | None = None
    limit: int | None = None

    @model_validator(mode="after")
    def csv_has_path(self):
        if self.kind == "csv" and not self.path:
            raise ValueError("a csv universe needs a path")
        return self


class Method(Strict):
    name: str
    kind: Literal["tfidf", "model"] = "tfidf"
    section: str = "business"
    center: bool = False
    doc_tokens: int | None = None
    min_df: int = 2
    max_df: float = 0.25

    @field_validator("name")
    @classmethod
    def safe(cls, v: str) -> str:
        if not SAFE.fullmatch(v):
            raise ValueError(f"unsafe name: {v}")
        return v

    @model_validator(mode="after")
    def options_fit(self):
        if self.kind == "tfidf" and (self.center or self.doc_tokens):
            raise ValueError("center and doc_tokens are for dense methods")
        return self


class Ensemble(Strict):
    name: str
    members: dict[str, float]

    @field_validator("members")
    @classmethod
    def several(cls, v: dict[str, float]) -> dict[str, float]:
        if len(v) < 2 or sum(v.values()) <= 0:
            raise ValueError("an ensemble needs two members and positive weights")
        return v


class Threshold(Strict):
    accept: float = 0.8
    reject: float = 0.2

    @model_validator(mode="after")
    def ordered(self):
        if self.reject > self.accept:
            raise ValueError("reject must not exceed accept")
        return self


class Evaluation(Strict):
    k: list[int] = Field(default_factory=lambda: [1, 5, 10])
    primary_k: int | None = None
    n_boot: int = 1000

    @model_validator(mode="after")
    def primary_known(self):
        if self.primary_k is not None and self.primary_k not in self.k:
            raise ValueError("primary_k must be one of k")
        return self

    def main_k(self) -> int:
        return self.primary_k or (5 if 5 in self.k else max(self.k))


class Config(Strict):
    name: str
    universe: Universe = Field(default_factory=Universe)
    sections: list[str] = Field(default_factory=lambda: ["business", "risk_factors"])
    exclude_suspect: bool = True
    methods: list[Method]
    ensembles: list[Ensemble] = Field(default_factory=list)
    evaluation: Evaluation = Field(default_factory=Evaluation)
    thresholds: dict[str, Threshold] = Field(default_factory=dict)
    default_threshold: Threshold = Field(default_factory=Threshold)

    @model_validator(mode="after")
    def consistent(self):
        names = [m.name for m in self.methods]
        if len(set(names)) != len(names):
            raise ValueError("method names must be unique")
        if bad := [m.name for m in self.methods if m.section not in self.sections]:
            raise ValueError(f"unknown section in: {', '.join(bad)}")
        known = set(self.variant_names())
        for e in self.ensembles:
            if e.name in known or set(e.members) - known:
                raise ValueError(f"ensemble {e.name}: unknown member or name clash")
        return self

    def variant_names(self) -> list[str]:
        return [v for m in self.methods for v in ([m.name, f"{m.name}+center"] if m.center else [m.name])]

    def statuses(self) -> tuple[str, ...]:
        """Section statuses that are read."""
        return ("ok",) if self.exclude_suspect else ("ok", "suspect")

    def threshold(self, question: str) -> Threshold:
        return self.thresholds.get(question, self.default_threshold)


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config.model_validate(yaml.safe_load(f))
