"""Scanner plug-ins over DataFrames."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from inkprint import fixed
from inkprint.config import DEFAULT_CONFIG, ScanConfig, ScannerConfig
from inkprint.operators import normalize as nz
from inkprint.operators.findings import to_common

log = logging.getLogger(__name__)

Run = Callable[[DataFrame, str, ScannerConfig], DataFrame]


@dataclass(frozen=True)
class Scanner:
    """A scanner: turns its raw output table into raw findings.

    ``source`` tags its findings. ``available`` says if it can run given the inputs; by
    default, if its raw table is among them.
    """

    name: str
    run: Run
    source: str = ""
    version: str = "1.0.0"
    available: Callable[[Mapping[str, DataFrame]], bool] | None = None
    normalize: Callable[[DataFrame, ScanConfig], DataFrame] | None = None

    def is_available(self, inputs: Mapping[str, DataFrame]) -> bool:
        return self.available(inputs) if self.available else self.name in inputs

    def findings(self, inputs: Mapping[str, DataFrame], root: str, config: ScanConfig) -> DataFrame:
        raw = self.run(inputs.get(self.name), root, config.scanner(self.name))
        if self.normalize:
            return self.normalize(raw, config)
        return to_common(raw, self.source or self.name, config)


class ScannerRegistry:
    """Scanners in the order of their registration; a name registered again is replaced."""

    def __init__(self, scanners: tuple[Scanner, ...] = ()):
        self._scanners: dict[str, Scanner] = {s.name: s for s in scanners}

    def register(self, scanner: Scanner) -> None:
        self._scanners[scanner.name] = scanner

    def unregister(self, name: str) -> None:
        self._scanners.pop(name, None)

    def get(self, name: str) -> Scanner | None:
        return self._scanners.get(name)

    def all(self) -> list[Scanner]:
        return list(self._scanners.values())

    def run_enabled(
        self, inputs: Mapping[str, DataFrame], root: str, config: ScanConfig = DEFAULT_CONFIG
    ) -> DataFrame | None:
        """Findings of every enabled and available scanner, or None if there is none.

        A scanner whose plan cannot be built is left out and the others go on. The plan of a
        scanner that is switched off is never built. Errors in a scanner's data show when the
        findings are read; `run_isolated` keeps those apart, too.
        """
        parts = [rows for _, _, rows, _ in self._each(inputs, root, config, lambda _, rows: rows) if rows is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def run_isolated(
        self, spark: SparkSession, inputs: Mapping[str, DataFrame], root: str, config: ScanConfig, folder: str
    ) -> tuple[DataFrame | None, DataFrame]:
        """Findings of the scanners that came through, and the status of every enabled one.

        Each scanner's findings are written below ``folder`` on their own, so that what fails in one
        scanner's data stops no other. Status: ``name, status (done, unavailable, failed), error``.
        """

        def write(name: str, rows: DataFrame) -> DataFrame:
            place = f"{folder}/scanner={name}"
            rows.write.mode("overwrite").parquet(place)
            return spark.read.schema(rows.schema).parquet(place)

        told = list(self._each(inputs, root, config, write))
        parts = [rows for _, _, rows, _ in told if rows is not None]
        status = spark.createDataFrame([(n, s, e) for n, s, _, e in told], "name string, status string, error string")
        return (reduce(DataFrame.unionByName, parts) if parts else None), status

    def _each(
        self, inputs: Mapping[str, DataFrame], root: str, config: ScanConfig, keep: Callable[[str, DataFrame], DataFrame]
    ) -> Iterator[tuple[str, str, DataFrame | None, str | None]]:
        for scanner in self.all():
            settings = config.scanner(scanner.name)
            if settings is None or not settings.enabled:
                continue
            try:
                if not scanner.is_available(inputs):
                    log.warning("scanner %s is not available, skipped", scanner.name)
                    yield scanner.name, "unavailable", None, None
                    continue
                yield scanner.name, "done", keep(scanner.name, scanner.findings(inputs, root, config)), None
            except Exception as error:  # noqa: BLE001 - one scanner must not stop the others
                log.warning("scanner %s failed: %s", scanner.name, error)
                yield scanner.name, "failed", None, str(error).splitlines()[0]

    def availability(self, spark: SparkSession, inputs: Mapping[str, DataFrame]) -> DataFrame:
        rows = [(s.name, s.version, bool(s.is_available(inputs))) for s in self.all()]
        return spark.createDataFrame(rows, "name string, version string, available boolean")


def default_registry() -> ScannerRegistry:
    runs: dict[str, Run] = {
        "semgrep": lambda raw, root, _: nz.semgrep(raw, root),
        "eslint": lambda raw, root, cfg: nz.eslint(raw, root, rules=cfg.options.get("rules")),
        "npmAudit": lambda raw, root, cfg: nz.npm_audit(
            raw, root, threshold=cfg.options.get("severityThreshold") or "HIGH"
        ),
        "nodejsscan": lambda raw, root, _: nz.nodejsscan(raw, root),
        "bearer": lambda raw, root, _: nz.bearer(raw, root),
    }
    return ScannerRegistry(tuple(Scanner(n, runs[n], source=tag) for n, tag in fixed.SCANNER_SOURCES.items()))
