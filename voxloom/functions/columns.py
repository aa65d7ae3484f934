"""Column expressions. All of them stay inside the JVM and whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.schemas import (
    COUNTRY_NAMES, DIGIT_PATTERN, SPLIT_ALIASES, SPLITS, STRIP_CHARACTERS,
)

# Durations are added up as whole ticks of 10 ns. Such sums come out the same whichever
# task finishes first, so a rerun after a lost executor cuts at the same clip. They are
# decimals, as 64 bits would end at 2,900 years of audio.
TICKS_PER_SECOND = 100_000_000
TICKS = "decimal(38,0)"


def ticks(seconds: Column) -> Column:
    """A duration as ticks. What is no duration counts as nothing: null, NaN, and anything
    of 1e18 s or more either way, infinity included."""
    sound = F.abs(seconds) < 1e18  # neither null nor NaN is
    return F.when(sound, F.round(seconds * TICKS_PER_SECOND).cast(TICKS)).otherwise(F.lit(0).cast(TICKS))


def tick_limit(max_seconds: float) -> Column:
    """A cap in seconds as ticks; what is above every sum of clips stands for no cap."""
    return F.lit(str(round(min(max_seconds, 1e28) * TICKS_PER_SECOND))).cast(TICKS)


def exact_sum(amounts: Column) -> Column:
    """Sum of decimal amounts, the same in whatever order rows come; 0 over nothing."""
    return F.coalesce(seconds(F.sum(ticks(amounts))), F.lit(0.0))


def round_to(value: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, halves to even, as Python's round() does.

    Spark's bround goes by the shortest decimal instead: it takes 2.675, which is stored
    as a little less, for a tie. Here the value is scaled, the rounding error of that
    product is worked out without loss (the scale has few bits, so the products of the
    two halves of the value are exact), and it decides where the product looks like a tie.
    """
    scale = float(10 ** digits)

    def rounded(v: Column) -> Column:
        product = v * scale
        split = v * 134217729.0
        high = split - (split - v)
        error = (high * scale - product) + (v - high) * scale
        floor = F.floor(product).cast("double")
        tie = (product - floor) == 0.5
        return F.when(tie & (error > 0), floor + 1).when(tie & (error < 0), floor).otherwise(F.rint(product)) / scale

    # Inside a lambda the value is a variable, so its expression is not repeated.
    return F.transform(F.array(value), rounded)[0]


def seconds(tick_count: Column) -> Column:
    return tick_count.cast("double") / F.lit(float(TICKS_PER_SECOND))


def hours(tick_count: Column) -> Column:
    """Hours to two decimals."""
    return round_to(seconds(tick_count) / F.lit(3600.0), 2)


def check_split(split: str) -> str:
    if split not in SPLITS:
        raise KeyError(f"unknown split {split!r}; choose from {', '.join(SPLITS)}")
    return split


def split_name(split: Column) -> Column:
    """train / val / test, whatever the source calls its validation split."""
    return F.when(split.isin(SPLIT_ALIASES["val"]), F.lit("val")).otherwise(split)


def split_rank(split: Column) -> Column:
    """Place of a split when several are read one after the other."""
    name = split_name(split)
    return F.when(name == "train", 0).when(name == "val", 1).otherwise(2)


def split_size(split: str) -> Column:
    """Clips a catalog row has in one split, or in all of them."""
    return F.col("clips" if check_split(split) == "all" else split)


def country_name(country: Column) -> Column:
    """Display name of a country code; a code without one stands for itself."""
    known = F.create_map(*[F.lit(part) for pair in COUNTRY_NAMES.items() for part in pair])
    return F.coalesce(F.try_element_at(known, country), country)


def avg_clip_seconds() -> Column:
    """Mean clip length a catalog row implies, 0 for a language without clips."""
    return F.when(F.col("clips") > 0, F.col("hours") * 3600 / F.col("clips")).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(STRIP_CHARACTERS))


def has_digit(text: Column) -> Column:
    """Whether a transcript holds a digit of any script; null holds none."""
    return F.coalesce(text.rlike(DIGIT_PATTERN), F.lit(False))


def one_line(text: Column) -> Column:
    """A transcript as it goes on one manifest line. Everything else is verbatim, '|' too."""
    return strip(F.translate(F.coalesce(text, F.lit("")), "\r\n\t", "   "))


def speaker_label(language: Column, subset: Column) -> Column:
    return F.coalesce(F.nullif(language, F.lit("")), F.nullif(subset, F.lit("")), F.lit("spk"))


def language_code(iso: Column) -> Column:
    return F.upper(F.coalesce(iso, F.lit("")))


def waveform_seconds(samples: Column, sampling_rate: Column) -> Column:
    """Exact length of decoded samples; null when either part is missing or the rate is 0."""
    return F.try_divide(F.size(samples).cast("double"), F.nullif(sampling_rate, F.lit(0)).cast("double"))


def waveform_length(samples: Column, sampling_rate: Column) -> Column:
    """Clip length measured on its samples, to the millisecond; 0 when it cannot be."""
    measured = F.when(samples.isNotNull(), round_to(waveform_seconds(samples, sampling_rate), 3))
    return F.coalesce(measured, F.lit(0.0))


def downmix(channels: Column) -> Column:
    """Mean of several channels, sample by sample; no samples for no channels."""
    silent = F.transform(F.coalesce(F.get(channels, F.lit(0)), F.array().cast("array<double>")), lambda _: F.lit(0.0))
    total = F.aggregate(
        channels, silent,
        lambda acc, channel: F.zip_with(acc, channel, lambda a, b: a + b.cast("double")),
    )
    return F.transform(total, lambda v: v / F.size(channels))


def sample_key(clip_id: Column, seed: int) -> Column:
    """Where a clip falls in the random order of this seed: uniform, and fixed for good."""
    return F.md5(F.concat(F.lit(f"{seed}:"), clip_id).cast("binary"))


def has_samples(audio_type: T.DataType) -> bool:
    """Whether an audio column holds decoded samples with their rate, in one channel or several."""
    return (
        isinstance(audio_type, T.StructType) and {"array", "sampling_rate"} <= set(audio_type.names)
        and isinstance(audio_type["array"].dataType, T.ArrayType)
    )


def has_channels(audio_type: T.DataType) -> bool:
    """Whether the samples of an audio column are an array for each channel."""
    return has_samples(audio_type) and isinstance(audio_type["array"].dataType.elementType, T.ArrayType)


def one_channel(audio: Column, audio_type: T.DataType) -> Column:
    """Decoded samples of an audio column as one channel; several are mixed down."""
    return downmix(audio["array"]) if has_channels(audio_type) else audio["array"]
