"""Scores from small convolutional networks whose weights the user brings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ACGT"
FILLED = 28
NORM_EPSILON = 1e-3


def one_hot(seq: Column, filled: int = FILLED) -> Column:
    """Four zeros or ones a letter in the order A, C, G, T; letters after the first ``filled`` stay zeros."""
    places = F.sequence(F.lit(1), F.length(seq))
    letter = lambda i: F.when(i <= filled, F.upper(F.substr(seq, i, F.lit(1)))).otherwise("")
    return F.transform(places, lambda i: F.array(*(F.when(letter(i) == k, 1).otherwise(0) for k in LETTERS)))


def tensor(seqs: list[str], filled: int = FILLED) -> np.ndarray:
    """The same for sequences of one length, sequence by place by letter."""
    codes = np.frombuffer("".join(seqs).upper().encode(), np.uint8).reshape(len(seqs), -1)
    out = (codes[:, :, None] == np.frombuffer(LETTERS.encode(), np.uint8)).astype(np.float32)
    out[:, filled:] = 0
    return out


def convolved(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A rectified one-dimensional convolution that keeps the length; kernel is width by input by output."""
    width = len(kernel)
    before = (width - 1) // 2
    padded = np.pad(x, ((0, 0), (before, width - 1 - before), (0, 0)))
    views = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)
    return np.maximum(np.einsum("nlcw,wcf->nlf", views, kernel, optimize=True) + bias, 0)


def normalised(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    return (x - mean) / np.sqrt(variance + NORM_EPSILON) * scale + shift


def pooled(x: np.ndarray, how) -> np.ndarray:
    """Pairs of places brought together by ``how``; an odd last place is left out."""
    return how(x[:, : x.shape[1] // 2 * 2].reshape(len(x), -1, 2, x.shape[2]), 2)


def network_scores(seqs: list[str], weights: dict[str, np.ndarray]) -> np.ndarray:
    """Negated output of two convolutions, each normalised and pooled (by maximum, then by mean), and dense layers.

    ``weights`` holds conv1_kernel, conv1_bias, norm1_scale, norm1_shift, norm1_mean, norm1_variance, the same for 2, and
    dense1_kernel, dense1_bias and so on; all dense layers but the last are rectified.
    """
    x = tensor(seqs)
    for n, how in ((1, np.max), (2, np.mean)):
        x = convolved(x, weights[f"conv{n}_kernel"], weights[f"conv{n}_bias"])
        x = pooled(normalised(x, *(weights[f"norm{n}_{k}"] for k in ("scale", "shift", "mean", "variance"))), how)
    x = x.reshape(len(x), -1)
    layers = sum(k.startswith("dense") and k.endswith("kernel") for k in weights)
    for n in range(1, layers + 1):
        x = x @ weights[f"dense{n}_kernel"] + weights[f"dense{n}_bias"]
        x = np.maximum(x, 0) if n < layers else x
    return -x[:, 0]


def with_network_score(df: DataFrame, window: str, size: int, weights: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """``df`` with the network's score of the column ``window``; null for other lengths than ``size`` and for nulls."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = np.full(len(series), np.nan)
            there = (series.str.len() == size).fillna(False).to_numpy(dtype=bool)
            if there.any():
                out[there] = network_scores(series[there].to_list(), weights)
            yield pd.Series(out)

    return df.withColumn(name, F.nanvl(F.pandas_udf(predict, "double")(F.col(window)), F.lit(None).cast("double")))
