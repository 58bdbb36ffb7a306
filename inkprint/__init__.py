"""inkprint: code provenance and findings analytics on Spark DataFrames."""

from inkprint.config import DEFAULT_CONFIG, ScanConfig, ScannerConfig, merge_config

__all__ = ["DEFAULT_CONFIG", "ScanConfig", "ScannerConfig", "merge_config"]
