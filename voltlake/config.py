"""Defaults of the analysis. Every operator takes them as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Band edges in Hz, both inclusive.
SUBBANDS: dict[str, tuple[float, float]] = {
    "Delta": (0.5, 4.0),
    "Theta": (4.0, 8.0),
    "Mu": (8.0, 12.0),
    "Alpha": (8.0, 13.0),
    "Low_Beta": (12.0, 16.0),
    "High_Beta": (20.0, 30.0),
    "Beta": (13.0, 30.0),
    "Gamma": (30.0, 49.0),
}

# Name, numerator band, denominator band.
RATIOS: list[tuple[str, str, str]] = [("alpha_beta", "Alpha", "Beta"), ("theta_alpha", "Theta", "Alpha"), ("delta_theta", "Delta", "Theta")]

# Transitions between tasks.
TRANSITIONS: list[tuple[str, str]] = [("Resting", "Thinking"), ("Thinking", "Acting"), ("Resting", "Acting"), ("Acting", "Typing")]

FEATURES = ["mav", "variance", "std"]
FREQUENCY_FEATURES = ["band_power", "relative_power", "peak_frequency"]
GROUPS = ["ALS", "Normal"]
AMPLITUDE_UV = 100.0
BAD_CHANNEL_MADS = 3.0
NO_MARKER = "none"


def subband_table(spark: SparkSession, subbands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """subband, low, high: a few rows, whatever the data."""
    return spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in (subbands or SUBBANDS).items()], "subband string, low double, high double")


def ratio_table(spark: SparkSession, ratios: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(ratios or RATIOS, "ratio_name string, num string, den string")
