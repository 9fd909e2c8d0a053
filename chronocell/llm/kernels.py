"""Nyström approximation pieces for the two string-kernel classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def inverse_root(k: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """The symmetric inverse square root of a kernel matrix of landmarks; directions below the floor are left out."""
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    ok = values > floor * max(1e-12, values.max(initial=0.0))
    return (vectors[:, ok] / np.sqrt(values[ok])) @ vectors[:, ok].T


def remainder(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, label: str, per_label: int, keys=("doc_id", "text")) -> DataFrame:
    """About per_label rows of each label, whole: those with the lowest hashes u of the keys; a rarer label has all.

    rows: (doc_id, text, label) -> (doc_id, u, text, label). The bound is 1.25 * per_label rows a label on average; every label
    has its share, whatever their number.
    """
    # written first, so that its size is known: a table of few labels is broadcast, and texts are not dealt by label
    counts = cut(rows.groupBy(label).agg(F.count("*").alias("held")).select(F.col(label).alias("of"), "held"), "label-counts")
    u = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("u", u).join(counts, F.col(label) == F.col("of")).where(F.col("u") < 1.25 * per_label / F.col("held"))
    return chosen.select("doc_id", "u", "text", F.col(label).alias("label"))
