"""Scan configuration: immutable, merged by override."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from types import MappingProxyType
from typing import Any

from inkprint import fixed


@dataclass(frozen=True)
class ScannerConfig:
    """Switches of one scanner input. ``options`` holds scanner-specific values."""

    enabled: bool = True
    options: Mapping[str, Any] = field(default_factory=dict)

    def merged(self, override: Mapping[str, Any] | ScannerConfig | None) -> ScannerConfig:
        if override is None:
            return self
        if isinstance(override, ScannerConfig):
            return override
        given = {k: v for k, v in override.items() if v is not None}
        enabled = given.pop("enabled", self.enabled)
        return ScannerConfig(enabled, MappingProxyType({**self.options, **given}))


def _default_scanners() -> Mapping[str, ScannerConfig]:
    return MappingProxyType(
        {
            "semgrep": ScannerConfig(options={"config": "auto", "timeoutMs": 30_000}),
            "eslint": ScannerConfig(options={"timeoutMs": 30_000}),
            "npmAudit": ScannerConfig(options={"severityThreshold": "HIGH", "timeoutMs": 60_000}),
            "nodejsscan": ScannerConfig(options={"requireDocker": True, "timeoutMs": 120_000}),
            "bearer": ScannerConfig(options={"reportType": "security", "timeoutMs": 60_000}),
        }
    )


@dataclass(frozen=True)
class ScanConfig:
    threshold: int = fixed.DEFAULT_THRESHOLD
    block_on: tuple[str, ...] = fixed.BLOCK_ON
    exclude: tuple[str, ...] = fixed.DEFAULT_EXCLUDES
    secret_detection: bool = True
    hallucination_detection: bool = True
    max_file_size: int = fixed.MAX_FILE_SIZE
    weights: Mapping[str, int] = field(default_factory=lambda: MappingProxyType(dict(fixed.SIGNAL_WEIGHTS)))
    scanners: Mapping[str, ScannerConfig] = field(default_factory=_default_scanners)

    def merged(self, **overrides: Any) -> ScanConfig:
        """A new configuration with ``overrides`` on top.

        Plain fields are replaced; ``weights`` and ``scanners`` are merged key by key, so
        naming one weight or one scanner keeps the others.
        """
        known = {f.name for f in fields(self)}
        unknown = set(overrides) - known
        if unknown:
            raise TypeError(f"unknown configuration fields: {sorted(unknown)}")
        changes = {k: v for k, v in overrides.items() if v is not None}
        if "weights" in changes:
            changes["weights"] = MappingProxyType({**self.weights, **changes["weights"]})
        if "scanners" in changes:
            current = dict(self.scanners)
            for name, override in changes["scanners"].items():
                current[name] = current.get(name, ScannerConfig()).merged(override)
            changes["scanners"] = MappingProxyType(current)
        for name in ("block_on", "exclude"):
            if name in changes:
                changes[name] = tuple(changes[name])
        return replace(self, **changes)

    def scanner(self, name: str) -> ScannerConfig | None:
        return self.scanners.get(name)


DEFAULT_CONFIG = ScanConfig()


def merge_config(**overrides: Any) -> ScanConfig:
    """Defaults with ``overrides`` on top; the defaults themselves never change."""
    return DEFAULT_CONFIG.merged(**overrides)
