"""Rule bitmask ledger: evaluate every rule once, keep bits and measurements, then apply versioned policies.

``ledger`` measures each whole text once and stores one bit for each rule that it fails. A policy is
only a mask over those bits, so another version needs no second look at the text. ``ablation``
groups the ledger by its bits (at most two to the number of rules) and derives by bitwise
operations what each rule rejects, and what it alone rejects.

Defined cases: a null or empty text has no words and fails ``few_words``; equal rows get equal
results; an empty table gives an empty ledger; other columns of the input are not looked at, and
measured columns are named in ``MEASURES``, so clashing names in the input do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import words as W
from shelfcast.llm.tables import mapped, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_pipes")

#: Name and condition of failure of each rule, in the order of their bits. The
#: conditions are whole-number SQL, the same in Spark and DuckDB.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouting", "100 * n_upper > 40 * word_chars"),
    ("bangs", "4 * n_bangs > n_words"),
    ("pipes", "5 * n_pipes > n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that reject.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "dup_lines"),
    "v3": tuple(name for name, _ in RULES),
}
WINDOW = 8


def mask(names: tuple[str, ...] | list[str]) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in names)


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _BANG, _PIPE = W.byte_set((0x41, 0x5A)), W.byte_set((0x21, 0x21)), W.byte_set((0x7C, 0x7C))


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    found = W.runs(data, offsets, W.NOT_SPACE)
    hashed = W.hashes(data, found)
    in_word = W.NOT_SPACE[data]
    first, value = W.windows(hashed, found.of_text, WINDOW)
    text_of_word = np.repeat(np.arange(n, dtype=np.uint64), np.diff(found.of_text))
    covered = np.zeros(len(hashed) + 1, np.int64)
    if len(first):
        _, back, times = np.unique(W.mix(value + W.salted(text_of_word[first], 1)), return_inverse=True, return_counts=True)
        again = first[times[back] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    lines = W.runs(data, offsets, W.NOT_NEWLINE)
    word_bytes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=word_bytes[1:])
    kept = word_bytes[lines.ends] > word_bytes[lines.starts]
    text_of_line = np.repeat(np.arange(n, dtype=np.uint64), np.diff(lines.of_text))[kept]
    n_lines = np.bincount(text_of_line.astype(np.int64), minlength=n)
    key = W.mix(W.hashes(data, lines)[kept] + W.salted(text_of_line, 2))
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(text_of_line[at].astype(np.int64), minlength=n)
    return {
        "n_words": np.diff(found.of_text),
        "word_chars": W.per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": W.per_text(_SYMBOLS[data], offsets),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": W.per_text(np.cumsum(covered[:-1]) > 0, found.of_text),
        "n_lines": n_lines,
        "n_upper": W.per_text(_UPPER[data], offsets),
        "n_bangs": W.per_text(_BANG[data], offsets),
        "n_pipes": W.per_text(_PIPE[data], offsets),
    }


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` with the measurements of each whole text."""
    column = text if text in keep else "__text"
    source = docs.select(*[F.col(k) for k in keep], *([] if text in keep else [F.col(text).alias("__text")]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"] + [f"{m} bigint" for m in MEASURES])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch, column):
                values = _measure(data, offsets)
                own = [batch.column(k).slice(row, end - row) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(own + [pa.array(values[m].astype(np.int64)) for m in MEASURES], names=[*keep, *MEASURES])

    return mapped(source, rows, schema)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: ``keep``, the measurements, and ``failed_bits``."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    return measured(docs, text, keep).withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def rejected_by(version: str, bits: str = "failed_bits") -> Column:
    """True where the policy of that version rejects."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[version]))) != 0


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: rows failing it, rows that it alone rejects, and rows kept without it.

    The ledger is first counted by its bit patterns, so that what follows is as small as the number of patterns.
    """
    whole = mask(POLICIES[version])
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).cast("long").alias("bit")) for name in POLICIES[version]]))
    bits = F.col("failed_bits").bitwiseAND(F.lit(whole))
    return (
        patterns.withColumn("r", one)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(bits.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
            F.sum(F.when(bits == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(bits.bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~rejected_by("v3")).alias("kept"),
        "failed_bits", (~rejected_by("v2")).alias("kept_v2"), (F.bit_count(F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES["v3"])))) == 1).alias("one_rule_decides"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest policy's ablation over all documents."""
    return ablation(ledger(table(spark, sf_dir, "documents")), "v3")


_MEASURED_SQL = r"""
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT k, i, word, count(*) OVER a AS size, list(word) OVER a AS g FROM w WINDOW a AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
again AS (SELECT k, unnest(list(i)) AS i FROM g WHERE size = 8 GROUP BY k, g HAVING count(*) > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM again, range(8) AS r(o) GROUP BY k),
ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
ws AS (SELECT k, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY k),
m AS (SELECT d.k, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(replace(t, '|', '')) AS n_pipes
  FROM d LEFT JOIN ws USING (k) LEFT JOIN rep USING (k) LEFT JOIN ln USING (k))"""
_BITS_SQL = " + ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, (_, rule) in enumerate(RULES))
MEASURED_SQL = f"{_MEASURED_SQL},\nledger AS (SELECT *, CAST({_BITS_SQL} AS BIGINT) AS failed_bits FROM m)"

SQL = f"""WITH {MEASURED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {mask(BASE)}) <> 0 AS base_failed, (failed_bits & {mask(POLICIES['v3'])}) = 0 AS kept,
  failed_bits, (failed_bits & {mask(POLICIES['v2'])}) = 0 AS kept_v2, bit_count(failed_bits & {mask(POLICIES['v3'])}) = 1 AS one_rule_decides
FROM ledger"""

_NAMES_SQL = ", ".join(f"('{name}', {mask((name,))})" for name in POLICIES["v3"])
ABLATION_SQL = f"""WITH {MEASURED_SQL},
bits AS (SELECT failed_bits & {mask(POLICIES['v3'])} AS b FROM ledger)
SELECT rule, CAST(count(*) FILTER (WHERE b & bit <> 0) AS BIGINT) AS n_failing, CAST(count(*) FILTER (WHERE b = bit) AS BIGINT) AS n_only_this, CAST(count(*) FILTER (WHERE b = 0 OR b = bit) AS BIGINT) AS n_kept_without
FROM bits, (VALUES {_NAMES_SQL}) AS r(rule, bit) GROUP BY rule HAVING count(*) > 0"""
