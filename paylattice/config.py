"""Settings and the column contracts shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

SIDES = ("dt", "kt")


def other(side: str) -> str:
    return "kt" if side == "dt" else "dt"


def entity(side: str) -> str:
    return f"inn_{side}"


# Bank substrings as (name, source, first character, length).
# `79` takes two characters from position 7.
BANK_PARTS = (
    ("bic_{s}_34", "c_bic_{s}", 3, 2),
    ("bic_{s}_56", "c_bic_{s}", 5, 2),
    ("bic_{s}_79", "c_bic_{s}", 7, 2),
    ("num_{s}_13", "c_num_{s}", 1, 3),
    ("num_{s}_45", "c_num_{s}", 4, 2),
    ("num_{s}_68", "c_num_{s}", 6, 3),
)

# Fills for one-row and constant groups, and for absent code levels.
STDDEV_FILL = 200_000.0
SKEWNESS_FILL = 2.5
LEVEL_FILL = "-1"
CODE_DEPTH = 4


def bank_columns(side: str) -> list[str]:
    return [name.format(s=side) for name, *_ in BANK_PARTS]


def level_columns(side: str) -> list[str]:
    return [f"okved_cd_{side}_lvl{i}" for i in range(1, CODE_DEPTH + 1)]


def category_columns(side: str) -> list[str]:
    """The 12 categorical columns of a passport, in model order."""
    return [f"okved_cd_{side}", f"okato_cd_{side}", *bank_columns(side), *level_columns(side)]


def indexed_columns(side: str) -> list[str]:
    """The 13 label-indexed columns: the entity id and its categories."""
    return [entity(side), *category_columns(side)]


def index_features(side: str) -> list[str]:
    return [f"{c}_index" for c in indexed_columns(side)]


def large_stats(side: str) -> list[str]:
    names = ("avg_sum", "stddev_sum", "min_sum", "max_sum", "median_sum", "buyers_count")
    return [f"{side}_{n}" for n in names]


def numeric_features(side: str) -> list[str]:
    """The 7 numeric columns in model order (skewness comes before the partner count)."""
    names = ("avg_sum", "stddev_sum", "min_sum", "max_sum", "median_sum", "skewness_sum", "buyers_count")
    return [f"{side}_{n}" for n in names]


def importance_names(side: str, blocks: tuple[str, ...] = ("numbers", "embedding", "topic")) -> list[str]:
    """Names of the attention weights of one entity, one per token: the indexed features, then the blocks."""
    return [f"{c}_weight" for c in (*indexed_columns(side), *blocks)]


@dataclass(frozen=True)
class Settings:
    """One run of the pipeline. What depends on the data (dates, categories, purpose) has no default."""

    report_dt: str
    segments: tuple[str, ...]
    kinds: tuple[str, ...]
    purpose: str
    train: tuple[str, str]
    test: tuple[str, str]
    words_since: str
    segment_column: str = "org_segment"
    min_test_rows: int = 15
    embedding_width: int = 256
    n_topics: int = 50
    vocab_size: int = 5000
    min_df: int = 5
    topic_iterations: int = 20
    seed: int = 42
    top_k: int = 100
    metrics_k: tuple[int, ...] = (10, 50, 100)
    tower_width: int = 128
    als_rank: int = 64
    als_iterations: int = 15
    fm_factors: int = 16
    fm_iterations: int = 20
    map_weight_below: int = 3
    top_words: int = 5
    sum_weight: float = 0.7
    frequency_weight: float = 0.3
