"""Seeded draws under a clip cap and a duration budget.

A draw takes the first clips of each language in a random but fixed order: by a hash of
seed and clip_id. Being the start of an order, a draw is told completely by its last
clip. So it is found on narrow columns, and then filters the clip table, where audio is
read once and never shuffled.

Languages of up to SLOT_ROWS clips are ranked directly. Where one may be larger, and it
may hold a third of the table, no language is sorted as a whole:

1. clips and ticks are counted per language and slot (the first hex digits of the hash),
   with partial sums on the map side;
2. slots are added up to find the one slot per language in which the draw ends;
3. the clips of that slot alone are ranked to find the last clip.

Slots hold equal shares of a language, and there are enough of them for one to stay
within SLOT_ROWS clips.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.columns import TICKS, sample_key, seconds, split_rank, tick_limit, ticks
from voxloom.operators.joins import attach

# Clips a single task may have to sort.
SLOT_ROWS = 1 << 20
# Caps up to this many Spark already bounds before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000
HELPERS = ["_rank", "_key", "_id", "_split", "_length"]


def check_caps(per_language: int | None, max_seconds: float | None) -> None:
    if per_language is not None and per_language < 0:
        raise ValueError("per_language must not be negative")
    if max_seconds is not None and max_seconds < 0:
        raise ValueError("max_seconds must not be negative")


def with_sample_order(clips: DataFrame, seed: int = 42, ordered_splits: bool = False) -> DataFrame:
    """Add the columns the random order sorts by: _rank, _key, _id, _split, _length.

    ``ordered_splits`` puts all train clips before val and those before test. Ids may come again
    in another split, so the split tells such clips apart, and the length where that is the same.
    """
    clip_id = F.coalesce(F.col("clip_id").cast("string"), F.lit(""))
    return clips.withColumns({
        "_rank": split_rank(F.col("split")) if ordered_splits else F.lit(0),
        "_key": sample_key(clip_id, seed),
        "_id": clip_id,
        "_split": F.coalesce(F.col("split"), F.lit("")) if "split" in clips.columns else F.lit(""),
        "_length": F.coalesce(F.col("length").cast("double"), F.lit(0.0)) if "length" in clips.columns else F.lit(0.0),
    })


def refuse_audio(clips: DataFrame) -> None:
    if "audio" in clips.columns:
        raise ValueError("drop the audio first: every column is shuffled and sorted here")


def group_sizes(clips: DataFrame) -> tuple[int, int]:
    """How many subsets there are and how many clips the largest has: partial counts of one column."""
    sizes = clips.groupBy("subset").count().agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0))).first()
    return sizes[0], sizes[1]


def slot_digits(clips: int, slot_rows: int) -> int:
    """Hex digits that name slots of at most ``slot_rows`` clips. Needless ones would make
    the partial counts as many as the clips."""
    return max(0, math.ceil(math.log(max(clips, 1) / slot_rows, 16)))


def ranking_digits(largest: int, per_language: int | None) -> int:
    """Digits of the slots a draw counts first; none where clips are ranked directly.

    Spark bounds a ranking before the shuffle up to GROUP_LIMIT rows. Larger caps go by slots of
    about the cap, so that little more than the drawn clips is sorted.
    """
    if per_language is None:
        return slot_digits(largest, SLOT_ROWS)
    if per_language + 1 <= GROUP_LIMIT:
        return 0
    return slot_digits(largest, min(SLOT_ROWS, max(per_language, 1)))


def slot_of(key: Column, digits: int) -> Column:
    return F.substring(key, 1, digits) if digits else F.lit("")


def _place() -> Column:
    return F.struct(*HELPERS)


def draw_ends(
    ordered: DataFrame,
    languages: int,
    largest: int,
    *,
    per_language: int | None = None,
    max_seconds: float | None = None,
    nearest: bool = True,
    taken: DataFrame | None = None,
) -> DataFrame:
    """Last place of the draw for each language: (subset, _end). Where nothing is drawn there
    is no row, or an end before the first clip.

    ``ordered`` has subset, length and the columns of ``with_sample_order``. ``languages``
    bounds its subsets and ``largest`` the clips of each. ``taken`` (subset, taken_clips,
    taken_ticks) holds what earlier draws have used up.
    """
    check_caps(per_language, max_seconds)
    tick_cap = None if max_seconds is None else tick_limit(max_seconds)

    def within(clips_before: Column, ticks_before: Column) -> Column:
        """Whether a clip that comes after this much still belongs to the draw."""
        fits = F.lit(True)
        if per_language is not None:
            fits = fits & (clips_before < per_language)
        if tick_cap is not None:
            fits = fits & (ticks_before < tick_cap)
        return fits

    digits = ranking_digits(largest, per_language)
    # A length below 0 is no length; counted as such it would open a budget again that was used up.
    length = F.greatest(ticks(F.col("length")), F.lit(0).cast(TICKS))
    lines = ordered.select("subset", *HELPERS, slot_of(F.col("_key"), digits).alias("_slot"), length.alias("_ticks"))
    nothing, no_time = F.lit(0).cast("bigint"), F.lit(0).cast(TICKS)
    if taken is None:
        used_n, used_t = nothing, no_time
    else:
        used_n, used_t = F.coalesce("taken_clips", nothing), F.coalesce("taken_ticks", no_time)

    if digits == 0:
        ranked = lines.withColumn("_row", F.row_number().over(Window.partitionBy("subset").orderBy(*HELPERS)))
        if per_language is not None:
            # A plain bound on the row number also thins out clips before the shuffle. One more
            # than needed shows whether the last place is taken twice.
            ranked = ranked.where(F.col("_row") <= per_language + 1)
        if taken is not None:
            ranked = ranked.join(taken, "subset", "left")
        in_slot = ranked.withColumns({"_n0": used_n, "_t0": used_t})
    else:
        slots = lines.groupBy("subset", "_rank", "_slot").agg(F.count("*").alias("_n"), F.sum("_ticks").alias("_t"))
        if taken is not None:
            slots = slots.join(taken, "subset", "left")
        earlier = Window.partitionBy("subset").orderBy("_rank", "_slot").rowsBetween(Window.unboundedPreceding, -1)
        reached = slots.select(
            "subset", "_rank", "_slot",
            (F.coalesce(F.sum("_n").over(earlier), nothing) + used_n).alias("_n0"),
            (F.coalesce(F.sum("_t").over(earlier), no_time) + used_t).cast(TICKS).alias("_t0"),
        )
        open_slots = reached.where(within(F.col("_n0"), F.col("_t0")))
        last_slots = open_slots.groupBy("subset").agg(F.max(F.struct("_rank", "_slot", "_n0", "_t0")).alias("_last"))
        in_slot = attach(lines, last_slots, "subset", languages, "_id").where(
            (F.col("_rank") == F.col("_last._rank")) & (F.col("_slot") == F.col("_last._slot"))
        ).select("subset", *HELPERS, "_slot", "_ticks", "_last._n0", "_last._t0").withColumn(
            "_row", F.row_number().over(Window.partitionBy("subset").orderBy(*HELPERS))
        )

    by_place = Window.partitionBy("subset").orderBy(*HELPERS).rowsBetween(Window.unboundedPreceding, 0)
    counted = in_slot.withColumns({
        "_n": F.col("_n0") + F.col("_row"), "_t": (F.col("_t0") + F.sum("_ticks").over(by_place)).cast(TICKS),
        "_again": F.lag(_place()).over(Window.partitionBy("subset").orderBy(*HELPERS)) == _place(),
    })
    twice = F.raise_error(F.concat(F.lit("clip comes twice in a subset and split: "), F.col("_id")))
    counted = counted.withColumn("_n", F.when(F.col("_again"), twice.cast("bigint")).otherwise(F.col("_n")))
    short = (F.col("_t") - F.col("_ticks")).cast(TICKS)
    kept = within(F.col("_n") - 1, short)
    if nearest and tick_cap is not None:
        # Stop one clip early where that is strictly nearer to the target.
        over = (F.col("_n") > 1) & (F.col("_t") > tick_cap) & (tick_cap - short < F.col("_t") - tick_cap)
        kept = kept & ~over
    if digits == 0:
        return counted.where(kept).groupBy("subset").agg(F.max(_place()).alias("_end"))
    # When nothing of the slot is kept the draw ends before it: any place in the slot is
    # greater than the bare slot digits, and any place in an earlier slot is smaller.
    slot_start = F.struct("_rank", F.col("_slot").alias("_key"), F.lit("").alias("_id"), F.lit("").alias("_split"), F.lit(float("-inf")).alias("_length"))
    return counted.groupBy("subset").agg(F.max(F.when(kept, _place()).otherwise(slot_start)).alias("_end"))


def last_places(
    clips: DataFrame,
    *,
    per_language: int | None = None,
    max_seconds: float | None = None,
    nearest: bool = True,
    ordered_splits: bool = False,
    seed: int = 42,
    unfiltered: DataFrame | None = None,
    taken: DataFrame | None = None,
) -> tuple[DataFrame, int, int]:
    """Last place of a capped draw for each language, the number of languages and the size of the largest.

    Languages are sized up first, by counting one column. ``unfiltered``, a table that
    ``clips`` is a filtered part of, spares that job the filters.
    """
    languages, largest = group_sizes(clips if unfiltered is None else unfiltered)
    ends = draw_ends(
        with_sample_order(clips, seed, ordered_splits), languages, largest,
        per_language=per_language, max_seconds=max_seconds, nearest=nearest, taken=taken,
    )
    return ends, languages, largest


def up_to(
    clips: DataFrame, ends: DataFrame, languages: int, largest: int, *, seed: int = 42, ordered_splits: bool = False
) -> DataFrame:
    """Clips up to the last place of their language: a filter, for streams as well."""
    ordered = with_sample_order(clips, seed, ordered_splits)
    salts = max(1, math.ceil(largest / SLOT_ROWS))
    return attach(ordered, ends, "subset", languages, salts=salts).where(_place() <= F.col("_end")).drop(*HELPERS, "_end")


def draw(
    clips: DataFrame,
    *,
    per_language: int | None = None,
    max_seconds: float | None = None,
    nearest: bool = True,
    ordered_splits: bool = False,
    seed: int = 42,
    unfiltered: DataFrame | None = None,
    taken: DataFrame | None = None,
) -> DataFrame:
    """Clips of a capped draw, per subset; the input unchanged when no cap is set.

    Whichever cap binds first ends a language. The duration budget is met as nearly as
    possible: the clip that crosses it is dropped when stopping short is strictly nearer
    and it is not the only clip. With ``nearest=False`` it always stays. ``unfiltered`` and ``taken``
    are as in ``last_places`` and ``draw_ends``.
    """
    check_caps(per_language, max_seconds)
    if per_language is None and max_seconds is None:
        return clips
    ends, languages, largest = last_places(
        clips, per_language=per_language, max_seconds=max_seconds, nearest=nearest, ordered_splits=ordered_splits, seed=seed,
        unfiltered=unfiltered, taken=taken,
    )
    return up_to(clips, ends, languages, largest, seed=seed, ordered_splits=ordered_splits)


def sample_ranks(clips: DataFrame, *, seed: int = 42, ordered_splits: bool = False) -> DataFrame:
    """Every clip with its place in the draw order of its subset (``rn``, from 1) and the
    seconds up to and including it (``cum``).

    Clips are ranked within slots, and slots are added up: no task sorts a whole language. All
    columns are sorted along, so a table with audio is refused: rank it without and join.
    """
    refuse_audio(clips)
    _, largest = group_sizes(clips)
    ordered = with_sample_order(clips, seed, ordered_splits).withColumns({
        "_slot": slot_of(F.col("_key"), slot_digits(largest, SLOT_ROWS)), "_ticks": ticks(F.col("length")),
    })
    slots = ordered.groupBy("subset", "_rank", "_slot").agg(F.count("*").alias("_n"), F.sum("_ticks").alias("_t"))
    earlier = Window.partitionBy("subset").orderBy("_rank", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(
        "subset", "_rank", "_slot",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_t").over(earlier), F.lit(0).cast(TICKS)).alias("_t0"),
    )
    slot = ["subset", "_rank", "_slot"]
    by_place = Window.partitionBy(*slot).orderBy("_key", "_id", "_split", "_length").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.withColumns({
        "_n": F.row_number().over(by_place), "_t": F.sum("_ticks").over(by_place),
    })
    return placed.join(starts, slot).withColumns({
        "rn": (F.col("_n0") + F.col("_n")).cast("bigint"),
        "cum": seconds(F.col("_t0") + F.col("_t")),
    }).drop(*HELPERS, "_slot", "_ticks", "_n", "_t", "_n0", "_t0")


def holdout_split(clips: DataFrame, test_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``fold``: exactly ceil(test_size x clips) rows are 'test', the others 'train'.

    The test rows are the first of the seeded order over the whole table. Two small jobs
    find its last one; labelling the table is then a plain filter.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be between 0 and 1")
    ordered = with_sample_order(clips, seed)
    if "subset" in clips.columns:  # ids may come again in another subset
        ordered = ordered.withColumn("_split", F.concat_ws("/", F.coalesce("subset", F.lit("")), "_split"))
    whole = ordered.withColumns({"subset": F.lit("all"), "length": F.lit(0.0)})  # its own length stays in its place
    clip_count = clips.count()
    tests = math.ceil(test_size * clip_count)
    end = draw_ends(whole, 1, clip_count, per_language=tests).first()
    if end is None:
        return clips.withColumn("fold", F.lit("train"))
    place = ["_key", "_id", "_split", "_length"]
    in_test = F.struct(*place) <= F.struct(*[F.lit(end["_end"][c]).alias(c) for c in place])
    return ordered.withColumn("fold", F.when(in_test, "test").otherwise("train")).drop(*HELPERS)
