"""Column expressions for rounding, ticks, frame times, tempo weights and variable-length numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ticks per quarter note, note-activation frame rate, hop, window and frames per window
TICKS_PER_QUARTER = 480
SAMPLE_RATE, HOP, WINDOW_SAMPLES, WINDOW_FRAMES = 22050, 256, 43844, 172
# fixed values: frames at both ends of a window that aren't used, samples between windows, zeros before the first, whole frames a second
EDGE_FRAMES = 15
WINDOW_HOP, WINDOW_LEAD, FRAMES_A_SECOND = WINDOW_SAMPLES - 2 * EDGE_FRAMES * HOP, EDGE_FRAMES * HOP, SAMPLE_RATE // HOP
WINDOW_SHIFT = HOP / SAMPLE_RATE * (WINDOW_FRAMES - WINDOW_SAMPLES / HOP) + 0.0018


def half_up(x: Column) -> Column:
    """The nearest whole number as a long, halves upwards (floor of x + 0.5)."""
    return F.floor(x + 0.5).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ticks(seconds: Column, bpm: Column) -> Column:
    return half_up(seconds * TICKS_PER_QUARTER * bpm / 60)


def frame_seconds(frame: Column) -> Column:
    """Time of a note-activation frame; each window of frames starts a little early."""
    return frame * HOP / SAMPLE_RATE - F.floor(frame / WINDOW_FRAMES) * WINDOW_SHIFT


def frames_of(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    """Whole note-activation frames of so many samples."""
    return F.floor(samples * FRAMES_A_SECOND / rate).cast("long")


def tempo_weight(bpm: Column, centre: float = 120.0, octaves: float = 0.7) -> Column:
    """A bell over the logarithm of the tempo."""
    return F.exp(-F.pow(F.log2(bpm / centre), 2) / (2 * octaves * octaves))


def micros_per_quarter(bpm: Column) -> Column:
    """Whole microseconds of a quarter note; null for a tempo of zero."""
    return F.when(bpm != 0, F.floor(F.lit(60_000_000) / bpm)).cast("long")


def vlq_hex(number: Column) -> Column:
    """Hex digits of the variable-length form of 0 to 2**28 - 1: seven bits a byte, highest first, all but the last marked."""
    byte = lambda shift: F.lpad(F.hex(F.shiftright(number, shift).bitwiseAND(F.lit(127)) + (128 if shift else 0)), 2, "0")
    parts = [F.when(number >= (1 << shift), byte(shift)).otherwise("") for shift in (21, 14, 7)]
    return F.lower(F.concat(*parts, byte(0)))
