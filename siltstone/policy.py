"""Policies of a reduction: features, presets, validation and identity."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from siltstone.functions.cdc import CdcProfile

FEATURES = ("raw", "cdc", "exact", "compression", "grouping", "similarity", "delta", "reorder")
# The named presets.
PRESETS = {
    "raw": ("raw",),
    "cdc": ("raw", "cdc"),
    "exact": ("raw", "cdc", "exact"),
    "compression": ("raw", "cdc", "compression"),
    "grouping": ("raw", "cdc", "compression", "grouping"),
    "similarity": ("raw", "cdc", "exact", "similarity"),
    "delta": ("raw", "cdc", "exact", "similarity", "delta"),
    "reorder": ("raw", "cdc", "compression", "grouping", "reorder"),
    "all": FEATURES,
}


@dataclass(frozen=True)
class Policy:
    """A set of features with the parameters that decide results; any change is another policy."""

    features: frozenset[str]
    profile: CdcProfile = field(default_factory=CdcProfile)
    fixed_bytes: int = 65536
    fill_bytes: int = 65536
    region_bytes: int = 512 * 1024
    window_bytes: int = 64 << 20
    inflight_bytes: int = 64 << 20
    candidates: int = 16
    trials: int = 4

    def __post_init__(self):
        needs = {"delta": "similarity", "grouping": "compression"}
        unknown = self.features - set(FEATURES)
        if unknown:
            raise ValueError(f"unknown features: {sorted(unknown)}")
        for feature, other in needs.items():
            if feature in self.features and other not in self.features:
                raise ValueError(f"{feature} needs {other}")
        if not self.features & {"raw", "compression"}:
            raise ValueError("a policy needs raw or compression")
        if self.inflight_bytes < self.profile.most:
            raise ValueError(f"inflight_bytes must be at least {self.profile.most}")

    @classmethod
    def preset(cls, name: str, **changes) -> Policy:
        return cls(frozenset(PRESETS[name]), **changes)

    def has(self, feature: str) -> bool:
        return feature in self.features

    @property
    def policy_id(self) -> str:
        parts = [",".join(f for f in FEATURES if f in self.features), self.profile.canonical()]
        parts += [str(x) for x in (self.fixed_bytes, self.fill_bytes, self.region_bytes, self.window_bytes, self.candidates, self.trials)]
        return hashlib.sha256(";".join(parts).encode()).hexdigest()
