"""Waveforms and gray images as arrays: normalisation, slices, differences, and spectral features.

Arrays of doubles or floats come in; what needs a Fourier transform is NumPy in Arrow batches, the rest are Column
expressions."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples a second; window and step of the log-mel spectrogram, its bands and frames; window, step and
#: bands of the cepstrum; the range kept below the loudest value, and the least power.
RATE, WINDOW, STEP, BANDS, FRAMES = 16000, 400, 160, 80, 200
CEPSTRUM_WINDOW, CEPSTRUM_STEP, CEPSTRUM_BANDS, COEFFICIENTS = 2048, 512, 128, 80
RANGE_DB, LEAST_POWER = 80.0, 1e-10
#: The mel scale is linear up to a break, logarithmic from there.
MEL_HZ, BREAK_HZ, LOG_STEP = 200.0 / 3, 1000.0, np.log(6.4) / 27


def peak_normalized(wave: Column) -> Column:
    """The waveform over its largest absolute sample."""
    peak = F.aggregate(wave, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x).cast("double")))
    return F.transform(wave, lambda x: x / (peak + 1e-8))


def time_slice(wave: Column, start: Column, end: Column, rate: Column) -> Column:
    """The samples from start to end (seconds), by rounded sample numbers within the waveform."""
    lo = F.greatest(F.lit(0), F.rint(start * rate)).cast("int")
    hi = F.least(F.size(wave), F.rint(end * rate).cast("int"))
    return F.slice(wave, lo + 1, F.greatest(F.lit(0), hi - lo))


def gray_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two images of equal size; null for empty ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a))


def _mel(hz: np.ndarray) -> np.ndarray:
    hz = np.asarray(hz, float)
    above = BREAK_HZ / MEL_HZ + np.log(np.maximum(hz, BREAK_HZ) / BREAK_HZ) / LOG_STEP
    return np.where(hz < BREAK_HZ, hz / MEL_HZ, above)


def _hz(mel: np.ndarray) -> np.ndarray:
    knee = BREAK_HZ / MEL_HZ
    return np.where(mel < knee, mel * MEL_HZ, BREAK_HZ * np.exp(LOG_STEP * (np.maximum(mel, knee) - knee)))


@functools.cache
def mel_filters(rate: int, window: int, bands: int) -> np.ndarray:
    """Triangles of unit area over the frequencies of a Fourier transform (bands x bins)."""
    bins = np.fft.rfftfreq(window, 1 / rate)
    edges = _hz(np.linspace(_mel(0.0), _mel(rate / 2), bands + 2))
    rise = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def mel_power(wave: np.ndarray, rate: int, window: int, step: int, bands: int) -> np.ndarray:
    """Power in each band of centred, Hann-weighted frames (bands x frames)."""
    padded = np.pad(np.asarray(wave, float), window // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, window)[::step]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    return mel_filters(rate, window, bands) @ (np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2).T


def decibels(power: np.ndarray, reference: float) -> np.ndarray:
    """Decibels over the reference, none further than RANGE_DB below the loudest."""
    db = 10 * np.log10(np.maximum(power, LEAST_POWER)) - 10 * np.log10(max(reference, LEAST_POWER))
    return np.maximum(db, db.max() - RANGE_DB)


def log_mel(wave: np.ndarray, rate: int = RATE) -> np.ndarray:
    """FRAMES x BANDS decibels below the loudest; longer ones keep their middle, shorter ones end in zeros."""
    power = mel_power(wave, rate, WINDOW, STEP, BANDS)
    x = decibels(power, float(power.max())).T
    first = max(0, (len(x) - FRAMES) // 2)
    x = x[first : first + FRAMES]
    return np.pad(x, ((0, FRAMES - len(x)), (0, 0)))


def mfcc(wave: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Means over time of the first COEFFICIENTS coefficients of the orthonormal cosine transform of the decibels."""
    db = decibels(mel_power(wave, rate, CEPSTRUM_WINDOW, CEPSTRUM_STEP, CEPSTRUM_BANDS), 1.0)
    n = CEPSTRUM_BANDS
    basis = np.cos(np.pi * np.arange(COEFFICIENTS)[:, None] * (2 * np.arange(n)[None] + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return (basis @ db).mean(axis=1)


#: Waveforms whose features are in memory at once: 200 x 80 doubles of each are 128 kB.
AT_ONCE = 64


def _vectors(function):
    def over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for waves in batches:
            for i in range(0, len(waves), AT_ONCE):
                yield pd.Series([None if w is None or not len(w) else function(np.asarray(w, float)).ravel() for w in waves.iloc[i : i + AT_ONCE]], dtype=object)

    return F.pandas_udf(over, "array<double>")


def log_mel_column(wave: Column) -> Column:
    """log_mel of each waveform, frame after frame; null for null and empty ones."""
    return _vectors(log_mel)(wave)


def mfcc_column(wave: Column) -> Column:
    return _vectors(mfcc)(wave)
