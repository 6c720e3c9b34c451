"""A Bloom filter of key columns: built by a JVM-side aggregation, tested in Arrow batches.

Its bits grow with the keys. Up to ``MAX_BITS`` (16 MiB) the filter is broadcast. Beyond that it is cut by a hash of the
key into parts of that size, which stay a table: rows and the part that holds their keys meet in a task by a shuffle,
the part's words first, and the rows are tested as they stream by.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brindle.session import Stage

MAX_BITS = 1 << 27
BITS_PER_KEY = 12
_SECOND, _THIRD = 0x9E3779B9, 0x85EBCA6B


def _hashes(cols: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(*cols), F.xxhash64(*cols, F.lit(_SECOND))


def _part(cols: list[Column], parts: int) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(_THIRD)), F.lit(parts)).cast("int")


def _hit(words: np.ndarray, bits: int, rounds: int, h: np.ndarray, step: np.ndarray) -> np.ndarray:
    yes, mask = np.ones(len(h), dtype=bool), np.int64(bits - 1)
    with np.errstate(over="ignore"):
        for i in range(rounds):
            at = (h + np.int64(i) * step) & mask
            yes &= (words[at >> 6] >> (at & 63)) & 1 == 1
    return yes


class BloomFilter:
    """``mark`` adds a column that is never false for a key that was put in."""

    def __init__(self, spark: SparkSession, bits: int, rounds: int, parts: int, words: np.ndarray | DataFrame) -> None:
        self.bits, self.rounds, self.parts = bits, rounds, parts
        self._words = words if parts > 1 else spark.sparkContext.broadcast(words)

    def mark(self, df: DataFrame, *cols: str, name: str = "maybe") -> DataFrame:
        """``df`` with the boolean ``name``: whether the key in ``cols`` may be one of the filter's. Nulls are values here."""
        at = [F.col(c) for c in cols]
        return df.withColumn(name, self._test(at)) if self.parts == 1 else self._meet(df, at, name)

    def _test(self, cols: list[Column]) -> Column:
        shared, bits, rounds = self._words, self.bits, self.rounds

        @F.pandas_udf("boolean")
        def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series(_hit(shared.value, bits, rounds, a.to_numpy(), b.to_numpy()))

        return test(*_hashes(cols))

    def _meet(self, df: DataFrame, cols: list[Column], name: str) -> DataFrame:
        bits, rounds = self.bits, self.rounds
        h, step = _hashes(cols)
        rows = df.select(_part(cols, self.parts).alias("p"), F.lit(1).alias("kind"), h.alias("a"), step.alias("b"), F.struct(*df.columns).alias("row"))
        words = self._words.select("p", F.lit(0).alias("kind"), F.col("w").alias("a"), "b", F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
        both = words.unionByName(rows).repartition("p").sortWithinPartitions("p", "kind")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, part = np.zeros(bits // 64, dtype=np.int64), -1
            for batch in batches:
                p, kind, a, b = (batch.column(i).to_numpy() for i in range(4))
                yes = np.zeros(len(p), dtype=bool)
                # stretches of one part and kind: few a batch, for a task has few parts
                cuts = np.flatnonzero((np.diff(p) != 0) | (np.diff(kind) != 0)) + 1
                for i, j in zip([0, *cuts], [*cuts, len(p)]):
                    if i == j:
                        continue
                    if p[i] != part:
                        held[:], part = 0, p[i]
                    if kind[i]:
                        yes[i:j] = _hit(held, bits, rounds, a[i:j], b[i:j])
                    else:
                        held[a[i:j]] = b[i:j]
                keep = pa.array(kind == 1)
                yield pa.RecordBatch.from_arrays([batch.column(4).filter(keep), pa.array(yes).filter(keep)], ["row", name])

        out = both.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {name} boolean")
        return out.select("row.*", name)


def build(keys: DataFrame, cols: list[str], n_keys: int, max_bits: int | None = None) -> BloomFilter:
    """Filter of the distinct values of ``cols``, with ``BITS_PER_KEY`` bits for each of about ``n_keys`` keys or more.

    Bits are set by a partial-then-final ``bit_or`` per 64-bit word, so at most ``max_bits / 64`` words reach the driver, and
    none if the filter is cut into parts. Few keys too many only raise the share of false hits.
    """
    spark, max_bits = keys.sparkSession, max_bits or MAX_BITS
    parts = max(1, math.ceil(n_keys * BITS_PER_KEY / max_bits))
    bits = 1 << max(10, math.ceil(math.log2(max(1, n_keys) * BITS_PER_KEY / parts)))
    rounds = max(1, min(8, round(bits * parts / max(1, n_keys) * math.log(2))))
    key = [F.col(c) for c in cols]
    a, b = _hashes(key)
    # long arithmetic that may wrap: hashes are cut by masks, which keeps the sum below 2^40
    at = [(a.bitwiseAND(F.lit(bits - 1)) + F.lit(i) * b.bitwiseAND(F.lit(bits - 1))).bitwiseAND(F.lit(bits - 1)) for i in range(rounds)]
    words = (
        keys.select(_part(key, parts).alias("p"), F.explode(F.array(*at)).alias("at"))
        .select("p", F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
        .groupBy("p", "w")
        .agg(F.bit_or("b").alias("b"))
    )
    if parts > 1:
        return BloomFilter(spark, bits, rounds, parts, Stage(spark, "bloom").put(words))
    got = words.toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return BloomFilter(spark, bits, rounds, 1, out)
