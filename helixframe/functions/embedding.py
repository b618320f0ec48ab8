"""A pluggable sequence embedder. Without model weights the default hashes k-mers into signed buckets; the contract is that of
any model: one vector of fixed length for each sequence, of unit norm."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_RESIDUES = 1022


def kmer_hash(dim: int = 320, k: int = 3) -> Callable[[list[str]], np.ndarray]:
    """The default embedder: counts of k-mers in ``dim`` signed buckets, scaled to unit length."""

    def embed(sequences: list[str]) -> np.ndarray:
        out = np.zeros((len(sequences), dim), dtype=np.float32)
        for row, seq in zip(out, sequences):
            codes = np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8).astype(np.uint64)
            if not len(codes):
                continue
            n = max(1, len(codes) - k + 1)
            h = np.zeros(n, dtype=np.uint64)
            for i in range(min(k, len(codes))):
                h = (h * np.uint64(1_000_003)) ^ (codes[i : i + n] + np.uint64(1))
            h *= np.uint64(0x9E3779B97F4A7C15)
            np.add.at(row, (h >> np.uint64(40)) % np.uint64(dim), np.where((h >> np.uint64(33)) & np.uint64(1), 1.0, -1.0))
            row /= np.linalg.norm(row) or 1.0
        return out

    return embed


def embed(records: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]] = kmer_hash, limit: int = MAX_RESIDUES) -> DataFrame:
    """(protein_id, embedding): sequences are trimmed, upper-cased and cut to ``limit`` residues; ``make`` runs once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pd.DataFrame({"protein_id": pdf["protein_id"], "embedding": list(model(pdf["sequence"].tolist()))})

    ship(records.sparkSession)
    rows = records.select(F.col("protein_id"), F.substr(F.upper(F.trim("sequence")), F.lit(1), F.lit(limit)).alias("sequence")).where("sequence <> ''")
    return rows.mapInPandas(run, f"protein_id {dict(records.dtypes)['protein_id']}, embedding array<float>")
