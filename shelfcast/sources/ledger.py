"""The sales ledger: from raw files, from registered tables, and as a view over the given star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.sources.archives import clean_header, first_encoding, read_zipped_csv, write_zipped_csv  # noqa: F401
from shelfcast.sources.staging import staged

# The headers under which each standard field is found in files, in the order of preference.
ALIASES = {
    "site_no": ("site_no", "site", "store_id", "store_no", "门店编码", "门店编号", "门店号", "店号"),
    "item_id": ("item_id", "book_id", "gds_no", "product_id", "商品编码", "图书编码", "书号"),
    "sale_date": ("sale_date", "date", "period", "sales_date", "交易日期", "销售日期", "日期"),
    "qty": ("qty", "quantity", "sales_qty", "count", "数量", "销量", "销售数量"),
    "isbn": ("isbn", "ISBN", "国际标准书号"),
    "book_name": ("book_name", "title", "name", "书名", "图书名称", "商品名称"),
    "category": ("category", "category_name", "分类", "品类", "图书分类"),
    "amount": ("amount", "sales_amount", "tsp", "实洋", "销售额", "金额"),
    "price": ("price", "unit_price", "定价", "售价", "价格"),
    "channel": ("channel", "oln_or_ofln", "渠道", "销售渠道", "线上线下"),
}
#: Headers of the ledger itself that files of its own kind carry besides.
LEDGER_NAMES = {"category": "gds_ctgry_3_lvel", "return_flag": "rtn_flag"}
REQUIRED = ("site_no", "item_id", "sale_date", "qty")


def normalised(df: DataFrame) -> DataFrame:
    return df.toDF(*map(clean_header, df.columns))


def field_mapping(columns: list[str]) -> dict[str, str]:
    """Standard field to the column that holds it; the item is the isbn where there is no item column."""
    held = {clean_header(c): c for c in reversed(columns)}
    mapping = {}
    for field in (*ALIASES, *LEDGER_NAMES):
        known = [clean_header(a) for a in (*ALIASES.get(field, ()), *([LEDGER_NAMES[field]] if field in LEDGER_NAMES else []))]
        if present := [held[a] for a in known if a in held]:
            mapping[field] = present[0]
    if "isbn" in mapping:
        mapping.setdefault("item_id", mapping["isbn"])
    if missing := set(REQUIRED) - set(mapping):
        raise ValueError(f"no column for {', '.join(sorted(missing))}")
    return mapping


def to_ledger(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Standard fields in the ledger's own names; the list amount is the sales amount, else the price, else 0."""
    if unknown := [c for c in mapping.values() if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")

    def of(field: str) -> Column:
        return F.col(mapping[field]).cast("string") if field in mapping else F.lit(None).cast("string")

    return df.select(
        of("sale_date").alias("period"), of("site_no").alias("site_no"), of("site_no").alias("blt_site_no"), of("isbn").alias("isbn"), of("item_id").alias("gds_no"), of("category").alias("gds_ctgry_3_lvel"),
        of("channel").alias("oln_or_ofln"), of("return_flag").alias("rtn_flag"), of("qty").alias("qty"), of("price").alias("price"), F.coalesce(of("amount"), of("price"), F.lit("0")).alias("tlp"), of("amount").alias("tsp"),
    )


def horizon_scan(dataset: DataFrame, months: int, splits: list[str], columns: list[str]) -> DataFrame:
    """Rows whose target of that horizon is known, of these splits; columns and filters reach the scan."""
    known = f"target_available_{months}m"
    if missing := [c for c in [*columns, known, "split"] if c not in dataset.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return dataset.where((F.col(known) == 1) & F.col("split").isin(*splits)).select(*columns)


def history_union(tables: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """All registered tables; of equal keys the last registered stays. Each row names its table."""
    parts = [df.withColumn("source_dataset_id", F.lit(name)).withColumn("__order", F.lit(i)) for i, (name, df) in enumerate(tables)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__order")))
    return union.withColumn("__row", last).where("__row = 1").drop("__row", "__order")


def write_parquet(df: DataFrame, path: str, sort: list[str] | None = None, codec: str = "zstd") -> None:
    """Write anew, sorted within partitions; a path that exists is an error."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("errorifexists").option("compression", codec).parquet(path)


def numbered(df: DataFrame, keys: list, number: str = "row_number", parts: int | None = None) -> DataFrame:
    """Rows with their place in the total order by ``keys`` (names or columns such as ``F.desc``), from 1.

    Rows are dealt by ranges of the keys and sorted there; a row's place is its own in its range behind the rows of all ranges before, of
    which there is one count a range. No task holds more than a range; there are ``parts`` of them, or as many as shuffles have.
    """
    columns = df.columns
    ranged = staged(df.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = counts.select("__part", before.alias("__before"))
    return ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*columns, (F.col("__before") + place + 1).alias(number))


def write_sorted(df: DataFrame, path: str, keys: list, number: str | None = None, codec: str = "zstd") -> None:
    """Files in total order by ``keys``: each is sorted and goes on where the one before ends. With ``number`` rows carry their place. A path that exists is an error."""
    rows, order = (numbered(df, keys, number), [number]) if number else (df, keys)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("compression", codec).parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A small metric table as one UTF-8 CSV file with a byte order mark in its header."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def retail_ledger(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The star schema's order lines as a ledger: suppliers are stores, brands are items.

    With ``parts`` both joins are dealt over that many tasks and look orders and parts up by hash: lines pass by, they are neither sorted nor held.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    orders, goods = read("orders").select("o_orderkey", "o_orderpriority"), read("part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    size = F.greatest(F.lit(1.0), F.floor(F.col("l_quantity") * F.col("l_quantity") / 100).cast("double"))
    qty = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), -size).otherwise(size)
    priority = F.col("o_orderpriority")
    dealt = lambda df, key: df.repartition(parts, key) if parts else df
    held = lambda df, key: dealt(df, key).hint("shuffle_hash") if parts else df
    ordered = dealt(lines, "l_orderkey").join(held(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = dealt(ordered, "l_partkey").join(held(goods, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")).withColumn("q", qty)
    return joined.select(
        F.to_date("l_shipdate").alias("period"), F.col("l_suppkey").cast("string").alias("site_no"), F.col("l_suppkey").cast("string").alias("blt_site_no"), F.col("p_brand").alias("isbn"), F.col("p_brand").alias("gds_no"),
        F.col("p_type").alias("gds_ctgry_3_lvel"), F.when(priority.isin("1-URGENT", "2-HIGH"), "oln").when(priority == "4-NOT SPECIFIED", "x").otherwise("ofln").alias("oln_or_ofln"), F.lit(None).cast("string").alias("rtn_flag"),
        F.col("q").alias("qty"), F.col("p_retailprice").alias("price"), (F.col("q") * F.col("p_retailprice")).cast("decimal(18,4)").alias("tlp"),
        (F.col("q") * F.col("p_retailprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("tsp"),
    )
