"""Sorts, pages, previews and feature ranking."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capforge.functions import fixed as FX
from capforge.operators.profile import target_correlation

DROP_REASON = FX.DROP_REASON


def _order(cols: Sequence[str | Column], descending: bool = False) -> list[Column]:
    out = []
    for c in cols:
        c = F.col(f"`{c}`") if isinstance(c, str) else c
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return out


def sort_series(df: DataFrame, keys: Sequence[str] = ("Type", "Application", "IP"), ts: str = "Date",
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """Order by keys then time, NULLs last (row 51). A global sort: range-partitioned, not one task."""
    return df.orderBy(*_order([*keys, ts, *tiebreak]))


def page(df: DataFrame, order: str = "created_at", tiebreak: str = "id", page_no: int = 1,
         size: int = FX.PAGE_SIZE_DEFAULT) -> DataFrame:
    """Newest first, page ``page_no`` of ``size`` rows, with ``total``, ``page``, ``page_size``
    and ``total_pages`` (row 52).

    Planned as a top-(offset+size) with offset, not a full sort; the total is a
    one-row aggregate. A page past the end is empty.
    """
    if not FX.PAGE_SIZE_MIN <= int(size) <= FX.PAGE_SIZE_MAX:
        raise ValueError(f"page size must be between {FX.PAGE_SIZE_MIN} and {FX.PAGE_SIZE_MAX}")
    if int(page_no) < 1:
        raise ValueError("page number starts at 1")
    rows = df.orderBy(F.col(order).desc_nulls_last(), F.col(tiebreak).asc_nulls_last()).offset(
        (int(page_no) - 1) * int(size)).limit(int(size))
    total = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(int(page_no)).alias("page"), F.lit(int(size)).alias("page_size"),
        F.ceil(F.col("total") / F.lit(int(size))).cast("long").alias("total_pages"))
    return rows.crossJoin(F.broadcast(total))


def preview(df: DataFrame, order: Sequence[str], n: int = FX.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows after an explicit order (row 53): a top-n, no full sort."""
    if not FX.PAGE_SIZE_MIN <= int(n) <= FX.PAGE_SIZE_MAX:
        raise ValueError(f"preview size must be between {FX.PAGE_SIZE_MIN} and {FX.PAGE_SIZE_MAX}")
    return df.orderBy(*_order(order)).limit(int(n))


def _ranked_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    corr = target_correlation(df, target)
    if exclude:
        corr = corr.filter(~F.col("feature").isin(list(exclude)))
    # p rows (one per numeric column): a window without partition is fine here
    w = Window.orderBy(F.abs(F.col("correlation")).desc_nulls_last(), F.col("feature").asc())
    return corr.withColumn("rank", F.row_number().over(w))


def select_top_features(df: DataFrame, target: str, k: int = FX.TOP_K, exclude: Sequence[str] = ()) -> DataFrame:
    """The ``k`` numeric columns with the largest |Pearson| against ``target`` (row 54).

    → ``(rank, feature, correlation)``; ties by name, undefined correlations last.
    Faithful default: every numeric column except the target is a candidate (pass
    ``exclude`` to keep label-derived columns out).
    """
    r = _ranked_features(df, target, exclude)
    return r.filter(F.col("rank") <= int(k)).select("rank", "feature", "correlation")


def dropped_features(df: DataFrame, target: str, k: int = FX.TOP_K, exclude: Sequence[str] = ()) -> DataFrame:
    """The other numeric columns with the reason text (row 55) → ``(feature, reason)``."""
    r = _ranked_features(df, target, exclude)
    return r.filter(F.col("rank") > int(k)).select("feature", F.lit(DROP_REASON).alias("reason"))


def selection_record(df: DataFrame, target: str, k: int = FX.TOP_K, exclude: Sequence[str] = ()) -> DataFrame:
    """One selection-run row: ``selected_features`` array and ``dropped_features`` array of structs."""
    r = _ranked_features(df, target, exclude)
    return r.agg(
        F.lit(target).alias("target_column"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "feature")))),
                    lambda s: s["feature"]).alias("selected_features"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > k, F.struct("rank", "feature")))),
                    lambda s: F.struct(s["feature"].alias("name"), F.lit(DROP_REASON).alias("reason")))
        .alias("dropped_features"))
