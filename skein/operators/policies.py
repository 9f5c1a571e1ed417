"""Placement policies as column expressions over call features.

A policy maps a features struct to a struct (placement, reason, detail). A
policy that also caps the output offers effective_max_tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL, CLOUD = "local", "cloud"


def decision(placement: str, reason: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(placement).alias("placement"), F.lit(reason).alias("reason"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


@dataclass(frozen=True)
class CloudOnly:
    name: str = "cloud-only"

    def decide(self, f: Column) -> Column:
        return decision(CLOUD, "policy")


@dataclass(frozen=True)
class LocalOnly:
    name: str = "local-only"

    def decide(self, f: Column) -> Column:
        return decision(LOCAL, "policy")


@dataclass(frozen=True)
class Static:
    """Local unless the call needs server tools, more tokens than the budget, or tools that local cannot call."""

    cap: int = 32_000
    margin: float = 0.9
    clamp: int | None = 4_096
    local_tools: bool = True
    name: str = "static"

    def __post_init__(self) -> None:
        if self.clamp is not None and self.clamp < 1:
            raise ValueError("clamp must be null (off) or at least 1")

    @property
    def budget(self) -> int:
        return int(self.cap * self.margin)

    def effective_max_tokens(self, f: Column) -> Column:
        asked = f["max_tokens"].cast("long")
        if self.clamp is None:
            return asked
        room = F.greatest(F.lit(0), F.lit(self.budget) - f["est_prompt_tokens"])
        return F.greatest(F.lit(1), F.least(asked, F.lit(self.clamp), room)).cast("long")

    def decide(self, f: Column) -> Column:
        need = f["est_prompt_tokens"] + self.effective_max_tokens(f)
        detail = F.concat(need.cast("string"), F.lit(f" > {self.budget} tokens"))
        return (
            F.when(f["has_server_tools"], decision(CLOUD, "server-side-tool"))
            .when(need > self.budget, decision(CLOUD, "too-large", detail))
            .when(f["has_tools"] & F.lit(not self.local_tools), decision(CLOUD, "tools-unsupported"))
            .otherwise(decision(LOCAL, "fits"))
        )


POLICIES: dict[str, Callable] = {"cloud-only": CloudOnly, "local-only": LocalOnly, "static": Static}


def build(name: str, **parameters):
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known: {', '.join(sorted(POLICIES))}")
    return POLICIES[name](**parameters)


def label(name: Column, cap: Column, clamp: Column, tools: Column) -> Column:
    """Name of a configuration; only static has parameters, a null clamp reads off."""
    text = F.format_string("static cap=%sK clamp=%s tools=%s", F.floor(cap / 1000).cast("string"), F.coalesce(clamp.cast("string"), F.lit("off")), F.when(tools, "on").otherwise("off"))
    return F.when(name == "static", text).otherwise(name)
