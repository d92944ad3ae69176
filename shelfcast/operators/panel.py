"""Zero-filled monthly panels with leakage-safe history, targets and store closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from shelfcast.functions import scalars as S
from shelfcast.operators import cleaning

FILLED = (*cleaning.MEASURES, "sales_days")
DESCRIPTORS = ("gds_ctgry_3_lvel", "price", "blt_site_no")
KEY = ("site_no", "item_id")


def _order() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("month_idx")


def expand(monthly_rows: DataFrame, ends: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """Every month of each store and item from its first flow to the last month of all, or of its store in ``ends`` (site_no, last_idx). The last month of all is ``last``, if it is known beforehand.

    Months without rows have measures 0 and the descriptors of the month before. Each series fills its
    own gaps: a row makes the months up to the next one, so months, stores and items are never crossed.
    """
    if ends is None and last is not None:
        bounded = monthly_rows.withColumn("last_idx", F.lit(last))
    elif ends is None:
        end = monthly_rows.agg(F.max("month_idx").alias("last_idx"))
        bounded = monthly_rows.crossJoin(F.broadcast(end))  # one row
    else:
        bounded = monthly_rows.join(ends.select("site_no", "last_idx"), "site_no")
    until = F.coalesce(F.lead("month_idx").over(_order()) - 1, F.greatest("last_idx", "month_idx"))
    known = {c: F.last(c, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)) for c in DESCRIPTORS}  # before months are filled in, as these only repeat them
    months = bounded.withColumns({"__until": until} | known).withColumn("__month", F.explode(F.sequence("month_idx", "__until")))
    own = F.col("__month") == F.col("month_idx")
    return months.select(
        "site_no", "item_id", F.col("__month").alias("month_idx"), S.month_text(F.col("__month")).alias("month"), *[F.when(own, F.col(c)).otherwise(F.lit(0).cast(dict(monthly_rows.dtypes)[c])).alias(c) for c in FILLED],
        *DESCRIPTORS,
    )


def history(panel: DataFrame) -> DataFrame:
    """Lags and rolling features of the months before each row; none sees the row's own month."""
    back = {n: _order().rowsBetween(-n, -1) for n in (1, 3, 6)}
    none = F.lit(0.0)
    out: dict[str, Column] = {f"qty_lag_{n}m": F.coalesce(F.lag("total_qty", n).over(_order()), none) for n in (1, 2, 3, 6)}
    out |= {f"{c}_lag_1m": F.coalesce(F.lag(c, 1).over(_order()), F.lit(0)) for c in ("offline_qty", "online_qty", "sales_days")}
    sold = F.when(F.col("total_qty") > 0, 1).otherwise(0)
    for n in (3, 6):
        over = back[n]
        total = lambda c, over=over: F.coalesce(F.sum(c).over(over), none)
        count = F.count(F.lit(1)).over(over)
        qty, square = total("total_qty"), total(F.col("total_qty") * F.col("total_qty"))
        out |= {
            f"qty_sum_last_{n}m": qty,
            f"qty_mean_last_{n}m": F.coalesce(S.ratio(qty, count), none),
            f"qty_max_last_{n}m": F.coalesce(F.max("total_qty").over(over), none),
            # from whole-number sums, so that the order of rows cannot matter
            f"qty_std_last_{n}m": F.when(count >= 2, F.sqrt(F.greatest((square - qty * qty / count) / (count - 1), none))).otherwise(none),
            f"offline_qty_sum_last_{n}m": total("offline_qty"),
            f"online_qty_sum_last_{n}m": total("online_qty"),
            f"offline_ratio_last_{n}m": F.coalesce(S.ratio(total("offline_qty"), qty), none),
            f"online_ratio_last_{n}m": F.coalesce(S.ratio(total("online_qty"), qty), none),
            f"sales_days_sum_last_{n}m": F.coalesce(F.sum("sales_days").over(over), F.lit(0)),
            f"active_months_last_{n}m": F.coalesce(F.sum(sold).over(over), F.lit(0)),
            f"zero_sales_months_last_{n}m": count - F.coalesce(F.sum(sold).over(over), F.lit(0)),
            f"is_sold_last_{n}m": F.coalesce(F.max(sold).over(over), F.lit(0)),
            f"tsp_sum_last_{n}m": S.r6(total("total_tsp")),
            f"tlp_sum_last_{n}m": S.r6(total("total_tlp")),
            f"discount_rate_last_{n}m": F.when(F.abs(total("total_tlp")) < 1e-9, none).otherwise(S.r6(S.ratio(total("total_tsp"), total("total_tlp")))),
        }
    out["is_sold_last_1m"] = F.coalesce(F.max(sold).over(back[1]), F.lit(0))
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    out["months_since_last_sale"] = F.coalesce(F.col("month_idx") - F.last(F.when(F.col("total_qty") > 0, F.col("month_idx")), ignorenulls=True).over(before), F.lit(-1))
    return panel.withColumns(out)


def targets(panel: DataFrame, train_until: str, valid_until: str) -> DataFrame:
    """Quantities of the next month and the next two, whether they sell, and the split by month. Months without both targets go."""
    ahead = F.lead("total_qty", 1).over(_order()), F.lead("total_qty", 2).over(_order())
    split = F.when(F.col("month") <= train_until, "train").when(F.col("month") <= valid_until, "valid").otherwise("test")
    found = panel.withColumns({"future_qty_1m": ahead[0], "future_qty_2m": ahead[0] + ahead[1], "split": split}).where("future_qty_2m IS NOT NULL")
    return found.withColumns({f"future_has_sales_{n}m": F.when(F.col(f"future_qty_{n}m") > 0, 1).otherwise(0) for n in (1, 2)})


def active_dataset(panel: DataFrame, activity: DataFrame, train_until: str, valid_until: str) -> DataFrame:
    """Rows whose next month lies within their store's activity, with the horizons that are known and the levels of the targets (-1 where not)."""
    ahead = F.lead("total_qty", 1).over(_order()), F.lead("total_qty", 2).over(_order())
    split = F.when(F.col("month") <= train_until, "train").when(F.col("month") <= valid_until, "valid").otherwise("test")
    joined = panel.withColumns({"future_qty_1m": ahead[0], "__two": ahead[0] + ahead[1], "split": split}).join(activity.select("site_no", "first_idx", "last_idx"), "site_no")
    kept = joined.where((F.col("month_idx") + 1 <= F.col("last_idx")) & F.col("future_qty_1m").isNotNull())
    known = (F.col("month_idx") + 2 <= F.col("last_idx")) & F.col("__two").isNotNull()
    return kept.withColumns({
        "future_qty_2m": F.when(known, F.col("__two")),
        "target_available_1m": F.lit(1),
        "target_available_2m": F.when(known, 1).otherwise(0),
        "future_has_sales_1m": F.when(F.col("future_qty_1m") > 0, 1).otherwise(0),
        "future_has_sales_2m": F.when(known, F.when(F.col("__two") > 0, 1).otherwise(0)),
        "target_mc_1m": S.level(F.col("future_qty_1m")),
        "target_mc_2m": F.when(known, S.level(F.col("__two"), 2)).otherwise(-1),
    }).drop("__two")


def exclusion_reason(month_idx: Column, last_idx: Column) -> Column:
    """Why a store's closure touches a row."""
    return F.when(month_idx > last_idx, "after_closure").when(month_idx + 1 > last_idx, "cross_1m").when(month_idx + 2 > last_idx, "cross_2m_extra").otherwise("unaffected")


def exclusion_counts(rows: DataFrame, activity: DataFrame) -> DataFrame:
    joined = rows.select("site_no", "month_idx", "split").join(activity.select("site_no", "last_idx"), "site_no")
    return joined.groupBy(exclusion_reason(F.col("month_idx"), F.col("last_idx")).alias("reason"), "split").agg(F.count(F.lit(1)).alias("n"))


def closure_audit(panel: DataFrame, activity: DataFrame) -> DataFrame:
    """Rows of the panel, those with quantity 0, those after their store's last month, and of these the ones with a quantity."""
    after = F.col("month_idx") > F.col("last_idx")
    joined = panel.select("site_no", "month_idx", "total_qty").join(activity.select("site_no", "last_idx"), "site_no")
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("total_qty") == 0).alias("zero_rows"), F.count_if(after).alias("rows_after_closure"), F.count_if(after & (F.col("total_qty") != 0)).alias("nonzero_after_closure"))


def dataset_stats(dataset: DataFrame) -> DataFrame:
    """Rows, zero rows and known two-month targets by split and over all."""
    found = dataset.rollup("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("total_qty") == 0).alias("zero_rows"), F.sum("target_available_2m").alias("available_2m"))
    return found.select(F.coalesce("split", F.lit("all")).alias("split"), "n_rows", "zero_rows", S.r6(S.ratio(F.col("zero_rows"), F.col("n_rows"))).alias("zero_ratio"), "available_2m")


def differences(rows: DataFrame) -> DataFrame:
    """Changes of demand from history alone."""
    observed = F.col("active_months_last_6m") + F.col("zero_sales_months_last_6m") == 6
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0)))
    return rows.withColumns({
        "qty_diff_current_lag1": F.col("total_qty") - F.col("qty_lag_1m"),
        "qty_diff_lag1_lag2": F.col("qty_lag_1m") - F.col("qty_lag_2m"),
        "log_qty_diff_current_lag1": log("total_qty") - log("qty_lag_1m"),
        "sales_days_diff_current_lag1": F.col("sales_days") - F.col("sales_days_lag_1m"),
        "qty_diff_recent3_previous3": F.when(observed, F.col("qty_sum_last_3m") / 3 - (F.col("qty_sum_last_6m") - F.col("qty_sum_last_3m")) / 3).otherwise(0.0),
        "qty_diff_6m_history_available": F.when(observed, 1).otherwise(0),
    })


def cross_features(rows: DataFrame, side: DataFrame, near: bool = False) -> DataFrame:
    """Demand of the same item in other stores now and in the two months before: the group less the store itself, month by month.

    The side table has a row for each month and item. Each of its rows is seen from up to three
    months, so it is spread over them first and one join, not three, brings all to the rows. With ``near`` that side
    is broadcast, so rows stay where they are.
    """
    spread = side.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).groupBy((F.col("month_idx") + F.col("back")).alias("month_idx"), "item_id")
    at = lambda c, n: F.sum(F.when(F.col("back") == n, F.col(c)))
    wide = spread.agg(*[at(f"group_positive_{c}", n).alias(f"__{c}_{n}") for c in ("qty", "sites") for n in (0, 1, 2)])
    joined = rows.join(F.broadcast(wide) if near else wide, ["month_idx", "item_id"], "left")
    own = {0: F.col("total_qty"), 1: F.col("qty_lag_1m"), 2: F.col("qty_lag_2m")}
    none = F.lit(0.0)
    qty = {n: F.greatest(F.coalesce(F.col(f"__qty_{n}"), none) - F.greatest(own[n], none), none) for n in own}
    sites = F.greatest(F.coalesce(F.col("__sites_0"), F.lit(0)) - F.when(own[0] > 0, 1).otherwise(0), F.lit(0))
    found = joined.withColumns({
        "xstore_qty_current": qty[0],
        "xstore_positive_sites_current": sites,
        "xstore_qty_per_positive_site_current": F.coalesce(S.ratio(qty[0], sites), none),
        "xstore_qty_mean_last_3m": (qty[0] + qty[1] + qty[2]) / 3,
        "xstore_qty_max_last_3m": F.greatest(*qty.values()),
        "xstore_qty_diff_1m": qty[0] - qty[1],
    })
    return found.drop(*[f"__{c}_{n}" for c in ("qty", "sites") for n in (0, 1, 2)])


def calendar(rows: DataFrame, base: str = "2023-01") -> DataFrame:
    """Year, month, quarter and running index of the row's month and of the months it forecasts."""
    start = int(base[:4]) * 12 + int(base[5:]) - 1
    out: dict[str, Column] = {}
    for name, ahead in (("", 0), ("_1m", 1), ("_2m", 2)):
        index = F.col("month_idx") + ahead
        out |= {f"cal_year{name}": F.floor(index / 12).cast("int"), f"cal_month{name}": (F.pmod(index, F.lit(12)) + 1).cast("int"), f"cal_quarter{name}": (F.floor(F.pmod(index, F.lit(12)) / 3) + 1).cast("int"), f"time_index{name}": (index - start).cast("int")}
    return rows.withColumns(out)


def inference_rows(monthly_rows: DataFrame, target_month: str) -> DataFrame:
    """Features of the month before ``target_month``, from history up to it."""
    observed = int(target_month[:4]) * 12 + int(target_month[5:]) - 2
    known = monthly_rows.where(F.col("month_idx") <= observed)
    end = known.groupBy("site_no").agg(F.lit(observed).alias("last_idx"))
    return history(expand(known, end)).where(F.col("month_idx") == observed)
