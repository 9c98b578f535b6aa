"""Parameters of the analytics, with the values that the queries use."""

from __future__ import annotations

from dataclasses import dataclass

# Payment formats and the column prefixes of their counts.
FORMATS = {"Wire": "wire", "Cash": "cash", "Bitcoin": "bitcoin", "Cheque": "cheque", "Credit Card": "credit_card", "ACH": "ach", "Reinvestment": "reinvestment"}


@dataclass(frozen=True)
class Config:
    window_days: int = 3
    stride_days: int = 1
    alpha_deep: float = 0.85
    alpha_shallow: float = 0.75
    pagerank_rounds: int = 100
    pagerank_tolerance: float = 1e-6
    #: The reference allows 500 of a faster iteration; sparse windows of sf0.1 need up to 2,520 of these.
    hits_rounds: int = 10_000
    hits_tolerance: float = 1e-8
    pivots: int = 80
    fan_least: int = 6
    degree_most: int = 16
    cycle_length: int = 6
    top_k: tuple[int, ...] = (1, 2, 10, 50, 100, 500)
    target_recall: float = 0.85
    #: Edges of a window up to which a Python worker takes the whole window.
    local_edges: int = 5_000_000
    #: Rows and values (rows times columns) of a feature table up to which models train in workers where a Config is passed to
    #: them; without one they do so at every size.
    local_rows: int = 3_000_000
    local_values: int = 64_000_000


DEFAULT = Config()
