import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import voxloom as vx
from voxloom.operators import numbering, sampling

SCHEMA = "subset string, clip_id string, split string, length double"


def place(clip_id, seed=42):
    return hashlib.md5(f"{seed}:{clip_id}".encode()).hexdigest(), clip_id


def draw_loop(rows, per_language=None, max_seconds=None, nearest=True, ordered=False, seed=42):
    """Clip by clip: (clip_id, split, length) rows of one subset to the ids drawn."""
    rank = {"train": 0, "val": 1, "test": 2}
    queue = sorted(rows, key=lambda r: ((rank[r[1]] if ordered else 0), place(r[0], seed)))
    drawn, total = [], 0.0
    for clip_id, _, length in queue:
        if per_language is not None and len(drawn) == per_language:
            break
        if max_seconds is not None and total >= max_seconds:
            break
        drawn.append((clip_id, length or 0.0))
        total += length or 0.0
    if nearest and max_seconds is not None and len(drawn) > 1 and total > max_seconds:
        if max_seconds - (total - drawn[-1][1]) < total - max_seconds:
            drawn.pop()
    return {clip_id for clip_id, _ in drawn}


@pytest.fixture(params=["ranked directly", "by slots"])
def either_way(request, monkeypatch):
    if request.param == "by slots":
        monkeypatch.setattr(sampling, "SLOT_ROWS", 8)
        monkeypatch.setattr(sampling, "GROUP_LIMIT", 0)
        monkeypatch.setattr(numbering, "NUMBERED_ROWS", 8)


@pytest.fixture(scope="module")
def clips(spark):
    """Ragged languages, one of which has most of the clips; zeros and nulls among the lengths."""
    rng = random.Random(7)
    rows = []
    for subset, count in [("hot", 900), ("mid", 60), ("few", 5), ("one", 1), ("zero", 4)]:
        for i in range(count):
            length = 0.0 if subset == "zero" else rng.choice([None, 0.0, 0.25, 1.0, 2.5, 3.75, 8.0, 16.0])
            rows.append((subset, f"{subset}-{i}", rng.choice(["train", "train", "val", "test"]), length))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache(), rows


CAPS = [
    {"per_language": 0}, {"per_language": 1}, {"per_language": 37}, {"per_language": 5000},
    {"max_seconds": 0.0}, {"max_seconds": 0.5}, {"max_seconds": 21.0}, {"max_seconds": 333.0}, {"max_seconds": 1e6},
    {"max_seconds": 100.0, "nearest": False}, {"max_seconds": 60.0, "per_language": 9},
    {"max_seconds": 1200.0, "ordered": True}, {"per_language": 700, "ordered": True, "nearest": False, "max_seconds": 2500.0},
    {"per_language": 12, "seed": 7},
]


@pytest.mark.parametrize("options", CAPS, ids=str)
def test_draw_is_what_clip_by_clip_gives(clips, either_way, options):
    df, rows = clips
    names = {"ordered": "ordered_splits"}
    drawn = vx.draw(df, **{names.get(k, k): v for k, v in options.items()})
    found = {}
    for row in drawn.collect():
        found.setdefault(row.subset, []).append(row.clip_id)
    for subset in {r[0] for r in rows}:
        expected = draw_loop([r[1:] for r in rows if r[0] == subset], **options)
        assert len(found.get(subset, [])) == len(expected)
        assert set(found.get(subset, [])) == expected, subset


@pytest.mark.parametrize(("target", "kept"), [(25, 3), (21, 2), (100, 4), (0, 0)])
def test_budget_on_even_lengths(spark, either_way, target, kept):
    df = spark.createDataFrame([("s", str(i), "train", 10.0) for i in range(4)], SCHEMA)
    assert vx.draw(df, max_seconds=float(target)).count() == kept


def test_single_overshooting_clip_stays(spark, either_way):
    df = spark.createDataFrame([("s", "a", "train", 50.0)], SCHEMA)
    assert vx.draw(df, max_seconds=1.0).count() == 1


def test_decimal_lengths_add_up_exactly(spark, either_way):
    # Ten times 0.1 is not 1.0 in floating point.
    df = spark.createDataFrame([("s", str(i), "train", 0.1) for i in range(30)], SCHEMA)
    assert vx.draw(df, max_seconds=1.0, nearest=False).count() == 10


def test_unknown_lengths_count_as_nothing(spark, either_way):
    df = spark.createDataFrame([("s", str(i), "train", float("nan") if i % 2 else None) for i in range(6)], SCHEMA)
    assert vx.draw(df, max_seconds=1.0).count() == 6


def test_no_cap_no_change(clips):
    df, rows = clips
    assert vx.draw(df).count() == len(rows)


def test_negative_caps_are_refused(clips):
    for options in ({"per_language": -1}, {"max_seconds": -0.5}):
        with pytest.raises(ValueError):
            vx.draw(clips[0], **options)


def test_draw_does_not_depend_on_layout(clips, either_way):
    df, _ = clips
    ids = lambda d: sorted(r.clip_id for r in vx.draw(d, per_language=20, max_seconds=90.0).collect())
    assert ids(df.repartition(13, "length")) == ids(df.coalesce(1))


def test_ranks_and_running_seconds(clips, either_way):
    df, rows = clips
    found = {(r.subset, r.clip_id): (r.rn, r.cum) for r in vx.sample_ranks(df).collect()}
    assert len(found) == len(rows)
    for subset in {r[0] for r in rows}:
        total = 0.0
        ordered = sorted((r for r in rows if r[0] == subset), key=lambda r: place(r[1]))
        for rank, row in enumerate(ordered, 1):
            total += row[3] or 0.0
            assert found[subset, row[1]] == (rank, total)


def test_holdout_is_exact(clips, either_way):
    df, rows = clips
    for size in (0.1, 0.25, 0.999):
        folds = {r.clip_id: r.fold for r in vx.holdout_split(df, size).collect()}
        first = sorted((r[1] for r in rows), key=place)[: math.ceil(size * len(rows))]
        assert {k for k, v in folds.items() if v == "test"} == set(first)
        assert len(folds) == len(rows)
    with pytest.raises(ValueError):
        vx.holdout_split(df, 1.0)
    assert vx.holdout_split(df.where("false"), 0.5).count() == 0


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("with_position", [False, True])
def test_numbers_run_over_the_whole_export(spark, clips, either_way, ordered, with_position):
    df, rows = clips
    position = {"mid": 1, "hot": 2, "few": 4, "one": 5, "zero": 9}
    if with_position:
        df = df.withColumn("position", F.create_map(*[F.lit(v) for p in position.items() for v in p])[F.col("subset")].cast("bigint"))
    rank = {"train": 0, "val": 1, "test": 2}
    order = sorted(rows, key=lambda r: (
        position[r[0]] if with_position else 0, rank[r[2]] if ordered else 0, place(r[1])
    ))
    found = {r.clip_id: r.idx for r in vx.number_clips(df, ordered_splits=ordered).collect()}
    assert [found[r[1]] for r in order] == list(range(len(rows)))


def test_speakers_by_first_appearance(clips):
    df, rows = clips
    named = df.withColumn("language", F.when(F.col("subset") == "one", "").otherwise(F.upper("subset")))
    label = {r[0]: "one" if r[0] == "one" else r[0].upper() for r in rows}
    expected = list(dict.fromkeys(label[r[0]] for r in sorted(rows, key=lambda r: place(r[1]))))
    found = sorted(vx.speaker_ids(named).collect(), key=lambda r: r.sid)
    assert [r.speaker for r in found] == expected and [r.sid for r in found] == list(range(len(expected)))


SPLITS = ("train", "val", "test")


@pytest.fixture(scope="module")
def recurring(spark):
    """Ten ids that are used in all three splits of four subsets, a second each."""
    rows = [(s, str(i), p, 1.0) for s in ("a", "b", "c", "d") for p in SPLITS for i in range(10)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("ordered", [False, True])
def test_caps_hold_where_ids_come_again_in_another_split(recurring, either_way, ordered):
    one = recurring.where("subset = 'a'")
    assert vx.draw(one, per_language=4, ordered_splits=ordered).count() == 4
    assert vx.draw(one, max_seconds=4.0, ordered_splits=ordered).count() == 4
    assert vx.draw(recurring, per_language=11, ordered_splits=ordered).count() == 44


def test_holdout_is_exact_where_ids_come_again(recurring, either_way):
    assert vx.holdout_split(recurring, 0.15).where("fold = 'test'").count() == 18
    assert vx.holdout_split(recurring.where("split = 'train'"), 0.15).where("fold = 'test'").count() == 6


@pytest.mark.parametrize("ordered", [False, True])
def test_numbers_are_fixed_where_ids_come_again(recurring, either_way, ordered):
    def numbered(df):
        return {(r.subset, r.split, r.clip_id): r.idx for r in vx.number_clips(df, ordered_splits=ordered).collect()}

    found = numbered(recurring.coalesce(1))
    assert sorted(found.values()) == list(range(120))
    assert found == numbered(recurring.orderBy(F.desc("subset"), "split").repartition(7, "clip_id"))


def test_a_clip_that_comes_twice_is_an_error(spark, either_way):
    df = spark.createDataFrame([("s", "a", "train", 1.0)] * 2, SCHEMA)
    with pytest.raises(Exception, match="comes twice"):
        vx.draw(df, per_language=1).collect()


def test_negative_lengths_count_as_nothing(spark, either_way):
    lengths = [5.0, 5.0, -20.0, 5.0, 5.0, 5.0, 5.0, 5.0]
    order = sorted((str(i) for i in range(8)), key=place)
    df = spark.createDataFrame([("s", i, "train", n) for i, n in zip(order, lengths)], SCHEMA)
    assert {r.clip_id for r in vx.draw(df, max_seconds=10.0, nearest=False).collect()} == set(order[:2])


def test_sums_beyond_64_bits(spark, either_way):
    df = spark.createDataFrame([("s", str(i), "train", 9.3e10) for i in range(5)], SCHEMA)
    assert vx.draw(df, max_seconds=1.9e11, nearest=False).count() == 3
    assert max(r.cum for r in vx.sample_ranks(df).collect()) == 4.65e11


def test_audio_is_not_sorted_along(spark):
    df = spark.createDataFrame([("s", "a", "train", 1.0, b"")], SCHEMA + ", audio binary")
    for number in (vx.sample_ranks, vx.number_clips):
        with pytest.raises(ValueError, match="audio"):
            number(df)
