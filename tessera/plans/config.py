"""Settings of the analyser, the index, search and verification; defaults as users of such engines expect them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalyzerConfig:
    stemming: bool = True
    remove_stopwords: bool = True
    keep_negators: bool = True
    finance_mode: bool = False


@dataclass(frozen=True)
class IndexConfig:
    analyzer: AnalyzerConfig = AnalyzerConfig()
    strategy: str = "sentence"
    sentences: int = 3
    step: int = 2
    size: int = 120
    overlap: int = 30
    zone_weight: float = 2.0
    champions: int = 0


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    method: str = "tfidf"
    champions: bool = False
    eliminate: float = 1.0
    proximity_weight: float = 0.5
    proximity_window: int = 30
    static_weight: float = 0.0
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class VerifyConfig:
    high: float = 0.20
    low: float = 0.12
    novelty_weight: float = 0.6
