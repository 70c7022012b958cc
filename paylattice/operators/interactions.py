"""From client snapshots and raw payments to the interaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylattice.config import BANK_PARTS, SIDES, Settings, bank_columns, entity
from paylattice.plans.skew import join_on_key
from paylattice.session import cut_lineage


def base_clients(clients: DataFrame, cfg: Settings, live_only: bool = True) -> DataFrame:
    """Clients of one snapshot in the wanted segments and legal forms (`active_flg` 0 means live)."""
    wanted = (
        (F.col("report_dt") == cfg.report_dt)
        & F.col(cfg.segment_column).isin(*cfg.segments)
        & F.col("type").isin(*cfg.kinds)
    )
    if live_only:
        wanted &= F.col("active_flg") == 0
    return clients.filter(wanted)


def first_clients(clients: DataFrame, n: int) -> DataFrame:
    """The `n` clients with the lowest ids (a top-n, kept per task before anything is merged)."""
    return clients.orderBy("inn").limit(n)


def snapshot_inventory(clients: DataFrame) -> DataFrame:
    """Clients per snapshot, newest first; `clients` above `distinct_clients` tells of repeated ids."""
    return (
        clients.groupBy("report_dt")
        .agg(F.count("inn").alias("clients"), F.countDistinct("inn").alias("distinct_clients"))
        .orderBy(F.desc("report_dt"))
    )


def in_window(payments: DataFrame, window: tuple[str, str], purpose: str) -> DataFrame:
    """Payments of one purpose inside a window that includes both days."""
    return payments.filter(F.col("short_dt").between(*window) & (F.col("predicted_value_last") == purpose))


def with_bank_parts(payments: DataFrame) -> DataFrame:
    """Replace bank and account numbers of both sides by their 12 fixed substrings."""
    raw = {source.format(s=s) for s in SIDES for _, source, *_ in BANK_PARTS}
    kept = [c for c in payments.columns if c not in raw]
    return payments.select(
        *kept,
        *[
            F.substring(source.format(s=s), start, length).alias(name.format(s=s))
            for s in SIDES
            for name, source, start, length in BANK_PARTS
        ],
    )


def interaction_keys() -> list[str]:
    codes = [f"{name}_{s}" for s in SIDES for name in ("okved_cd", "okato_cd")]
    return ["inn_dt", "inn_kt", "short_dt", *codes, *bank_columns("kt"), *bank_columns("dt")]


def build_interactions(
    payments: DataFrame, clients: DataFrame, cfg: Settings, window: tuple[str, str]
) -> DataFrame:
    """Amounts summed per pair, day, codes and bank parts; both parties must be base clients.

    The payments of the window are written once: both joins count their frequent keys in them.
    """
    base = base_clients(clients, cfg)
    wanted = in_window(payments, window, cfg.purpose)
    paid = cut_lineage(wanted.select("inn_dt", "inn_kt", "short_dt", "c_sum", "c_bic_kt", "c_num_kt", "c_bic_dt", "c_num_dt"))
    joined = with_bank_parts(paid)
    for side in ("kt", "dt"):
        party = base.select(
            F.col("inn").alias(entity(side)),
            F.col("okved_cd").alias(f"okved_cd_{side}"),
            F.col("okato_cd").alias(f"okato_cd_{side}"),
        )
        joined = join_on_key(joined, party, entity(side), count_in=paid)
    return joined.groupBy(*interaction_keys()).agg(F.sum("c_sum").alias("c_sum_fin"))
