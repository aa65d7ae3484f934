"""SQL counterparts of the queries, written for DuckDB over the same tables.

They use plain windows over whole languages, which is the simplest way to say what a
query must return and not how the library computes it.
"""

from __future__ import annotations

from standins import NATION_CODES
from voxloom.schemas import COUNTRY_NAMES, STRIP_CHARACTERS

DIGIT = r"coalesce(regexp_matches(text, '\p{Nd}'), false)"
# The place of a clip in the draw order of its language; ids may come again in another split.
KEY = "md5(concat('42:', clip_id)), clip_id, split, length"
CATALOG = "subset, language, iso, country, clips, hours, train, val, test"
STANDARD = "audio, text, language, country, length, iso, subset"


def rounded(value: str, digits: int) -> str:
    """Rounding by the exact value of a double, halves to even: what printf does."""
    return f"cast(printf('%.{digits}f', cast({value} as double)) as double)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lookup(column: str, names: dict[str, str]) -> str:
    cases = " ".join(f"when {quoted(code)} then {quoted(name)}" for code, name in names.items())
    return f"case {column} {cases} else {column} end"


WITH_CLIPS = """
with clips as (
  select doc_id, cast(doc_id + case cast(floor(doc_id / 20) as bigint) % 20 when 0 then 40 when 1 then 20 else 0 end as varchar) as clip_id, concat(source, '_', lang) as subset, source as language, lang as iso,
    upper(lang) as country, text, cast(n_chars as double) / 256 as length,
    case cast(floor(doc_id / 20) as bigint) % 20 when 0 then 'val' when 1 then 'test' else 'train' end as split,
    concat('clips/', cast(doc_id as varchar), '.mp3') as audio
  from documents)
"""

WITH_ITEMS = f"""
with names as (
  select concat('sup_', cast(s_suppkey as varchar)) as subset, s_name as language,
    concat('n', cast(n_nationkey as varchar)) as iso, {lookup('n_name', NATION_CODES)} as country
  from supplier join nation on s_nationkey = n_nationkey),
raw as (
  select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar), '-', cast(l_partkey as varchar), '-',
      cast(l_suppkey as varchar)) as clip_id,
    concat('sup_', cast(l_suppkey as varchar)) as subset, l_quantity as length,
    case l_returnflag when 'N' then 'train' when 'R' then 'val' else 'test' end as split
  from lineitem),
clips as (
  select clip_id, concat(clip_id, '.mp3') as audio, '' as text, language, country, length, iso, subset, split
  from raw join names using (subset))
"""

HOURS = rounded("sum(length) / 3600", 2)
CATALOG_OF_CLIPS = f""",
catalog as (
  select subset, max(language) as language, max(iso) as iso, max(country) as country, count(*) as clips,
    {HOURS} as hours,
    count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val,
    count(*) filter (where split = 'test') as test
  from clips group by subset)
"""

ITEM_CATALOG = WITH_ITEMS + CATALOG_OF_CLIPS
DOC_CATALOG = WITH_CLIPS + CATALOG_OF_CLIPS


def balanced(pool: str, n: int, cap: int, fill: bool = False) -> str:
    """CTE ``chosen``: country-balanced selection in closed form."""
    depth = f"{cap}" if fill else f"least({cap}, (select min(least(size, {cap})) from leads) + 1)"
    return f""",
ranked as (select *, row_number() over (partition by country order by hours desc, subset) as depth from {pool}),
leads as (select country, count(*) as size, max(hours) as lead_hours, min(subset) filter (where depth = 1) as lead_subset
  from ranked group by country),
chosen as (select * from (
  select row_number() over (order by depth, lead_hours desc, lead_subset) as position, {CATALOG}
  from ranked join leads using (country) where depth <= {depth}) where position <= {n})
"""


def plan_of(source: str, cap: int | None, seconds: float, low: float, high: float) -> str:
    """CTE ``plan``."""
    limit = "" if cap is None else f"{cap}, "
    return f""",
means as (select *, case when clips > 0 then hours * 3600 / clips else 0 end as mean from {source}),
clamped as (select *, case when mean > 0 then least(greatest(mean, {low}), {high}) else 0 end as clip from means),
counted as (select *, least(train, {limit}case when clip > 0
  then greatest(1, cast({rounded(f'{seconds} / clip', 0)} as bigint)) else train end) as planned from clamped),
timed as (select *, {rounded('least(' + rounded('planned * clip', 1) + ', train * clip)', 1)} as planned_seconds from counted),
plan as (select * exclude (mean, clip), {lookup('country', COUNTRY_NAMES)} as country_name, 'train' as split,
  train as available, {rounded('planned_seconds / 3600', 2)} as planned_hours from timed)
"""


def drawn_from(source: str, *, order: str = KEY, cap: int | None = None, budget: float | None = None, nearest=True) -> str:
    """CTE ``drawn``: the start of each subset in draw order, up to a cap and a budget."""
    limits = []
    if cap is not None:
        limits.append(f"rn <= {cap}")
    if budget is not None:
        limits.append(f"cum - length < {budget}")
        if nearest:
            limits.append(
                f"not (rn > 1 and cum > {budget} and abs(cum - length - {budget}) < abs(cum - {budget}))"
            )
    return f""",
placed as (select *, row_number() over w as rn, sum(length) over (w rows unbounded preceding) as cum
  from {source} window w as (partition by subset order by {order})),
drawn as (select * from placed where {' and '.join(limits)})
"""


PLANNED = rounded("sum(cast(planned_hours as decimal(18, 2)))", 2)
SPLIT_ORDER = f"case split when 'train' then 0 when 'val' then 1 else 2 end, {KEY}"
PLAIN_CLIPS = f""",
usable as (select * from clips where not {DIGIT})
"""

# The documents build: 12 balanced languages, clips of 1 to 30 s, at most 20 clips and 120 s.
DOC_CHOSEN = DOC_CATALOG + ", pool as (select * from catalog where clips >= 2 and train > 0)" + balanced("pool", 12, 4)


def doc_pool(split: str | None = "train") -> str:
    where = "true" if split is None else f"split = '{split}'"
    return DOC_CHOSEN + f""",
usable as (select * from clips where {where} and length between 1 and 30 and not {DIGIT}
  and subset in (select subset from chosen))
"""


DOC_BUILT = doc_pool() + drawn_from("usable", cap=20, budget=120) + f""",
built as (select position, clip_id, split, {STANDARD} from drawn join (select position, subset from chosen) using (subset))
"""
# The job has 0.4 h for all languages together and shares them out evenly.
DOC_JOB = doc_pool() + f""",
placed as (select *, 0.4 * 3600 / (select count(*) from chosen) as budget,
    row_number() over w as rn, sum(length) over (w rows unbounded preceding) as cum
  from usable window w as (partition by subset order by {KEY})),
drawn as (select * from placed where rn <= 20 and cum - length < budget
  and not (rn > 1 and cum > budget and abs(cum - length - budget) < abs(cum - budget)))
select position, clip_id, split, {STANDARD} from drawn join (select position, subset from chosen) using (subset)
"""

STREAM_BUILT = f"""
select position, clip_id, split, {STANDARD} from drawn join (select position, subset from chosen) using (subset)
"""

STRIP = " || ".join(f"chr({ord(ch)})" for ch in STRIP_CHARACTERS)
LINE = f"trim(translate(text, chr(13) || chr(10) || chr(9), '   '), {STRIP})"

EVERY = """,
chosen as (select row_number() over (order by hours desc, subset) as position, * from catalog)
"""
# All documents by language and then in draw order, as manifests number them.
EXPORT = DOC_CATALOG + EVERY + """,
exported as (select clips.*, position from clips join (select position, subset from chosen) using (subset))
"""
MANIFEST = EXPORT + f""",
numbered as (select *, row_number() over (order by position, {KEY}) - 1 as idx from exported),
lines as (select idx, language as speaker, upper(iso) as code, {LINE} as text,
  printf('%s_%06d', subset, idx) as uid from numbered),
speakers as (select speaker, row_number() over (order by min(idx)) - 1 as sid from lines group by speaker)
"""

PICKED = "(values (1, 'sup_7'), (2, 'sup_3'), (3, 'sup_7'), (4, 'sup_9')) as asked(position, subset)"
WITH_PICKED = ITEM_CATALOG + f""",
picked as (select cast(position as bigint) as position, {CATALOG} from {PICKED} join catalog using (subset))
"""
ITEM_PLAN = ITEM_CATALOG + EVERY + plan_of("chosen", 200, 1800.0, 3.0, 15.0)
ITEM_GAPS = WITH_ITEMS + ", gaps as (select clip_id as id, subset, nullif(length, 7) as duration from clips)"

ORACLES = {
    # --- catalog
    "catalog_refresh": ITEM_CATALOG + f"select {CATALOG} from catalog",
    "catalog_refresh_files": ITEM_CATALOG + f"select {CATALOG} from catalog",
    "catalog_refresh_samples": f"""select concat('wave_', label) as subset, concat('wave_', label) as language, '' as iso, '' as country,
  count(*) as clips, {rounded("coalesce(sum(round(len(embedding) / nullif(label * 3, 0), 8)), 0) / 3600", 2)} as hours,
  count(*) as train, 0::bigint as val, 0::bigint as test from embeddings group by label""",
    "catalog_scan": ITEM_CATALOG + f"select {CATALOG} from catalog",
    "catalog_roundtrip": ITEM_CATALOG + f"""select subset, concat('Nd''i "North", ', language) as language,
  iso, country, clips, hours, train, val, test from catalog""",
    "catalog_refresh_labels": WITH_ITEMS + f""",
counted as (select subset, count(*) as clips, {HOURS} as hours,
    count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val,
    count(*) filter (where split = 'test') as test from clips group by subset),
known as (select * from names where length(country) = 2),
listed as (select subset from names union all select n_name from nation)
select listed.subset, coalesce(language, listed.subset) as language, coalesce(iso, '') as iso, coalesce(country, '') as country,
  coalesce(clips, 0) as clips, coalesce(hours, 0) as hours, coalesce(train, 0) as train, coalesce(val, 0) as val,
  coalesce(test, 0) as test
from listed left join counted using (subset) left join known using (subset)""",
    "split_size": ITEM_CATALOG + "select subset, train as in_train, val as in_val, test as in_test, clips as in_all from catalog",
    "country_name": ITEM_CATALOG + f"select {CATALOG}, {lookup('country', COUNTRY_NAMES)} as country_name from catalog",
    "avg_clip_seconds": ITEM_CATALOG + "select subset, case when clips > 0 then hours * 3600 / clips else 0 end as avg_seconds from catalog",
    "filter_hours": ITEM_CATALOG + f"select {CATALOG} from catalog where hours between 4.0 and 4.3 and train > 0",
    "filter_min_clips": ITEM_CATALOG + f"select {CATALOG} from catalog where clips >= 600 and train > 0",
    "filter_countries": ITEM_CATALOG + f"select {CATALOG} from catalog where country in ('GH', 'NG', 'NATION_7') and train > 0",
    "filter_require_split": DOC_CATALOG + f"select {CATALOG} from catalog where test > 0",
    "filter_catalog": DOC_CATALOG + f"""select {CATALOG} from catalog
where hours between 0.01 and 50 and clips >= 5 and country in ('EN', 'FR') and val > 0""",
    "countries": ITEM_CATALOG + "select distinct country from catalog",
    "catalog_totals": ITEM_CATALOG + f"""select count(*) as languages, {rounded('sum(cast(hours as decimal(18, 2)))', 1)} as total_hours,
  count(distinct country) as countries from catalog""",
    # --- selection
    "top_n": ITEM_CATALOG + f"""select * from (select row_number() over (order by hours desc, subset) as position, {CATALOG}
  from catalog) where position <= 20""",
    "top_n_capped": ITEM_CATALOG + f""",
ranked as (select *, row_number() over (partition by country order by hours desc, subset) as depth from catalog)
select * from (select row_number() over (order by hours desc, subset) as position, {CATALOG} from ranked where depth <= 2)
where position <= 30""",
    "top_n_balanced": ITEM_CATALOG + balanced("catalog", 60, 3) + "select * from chosen",
    "top_n_balanced_filled": ITEM_CATALOG + balanced("catalog", 60, 3, fill=True) + "select * from chosen",
    "list_languages": ITEM_CATALOG + ", pool as (select * from catalog where hours >= 1)" + balanced("pool", 40, 2) + f"""
select subset, language, country, case when {lookup('country', COUNTRY_NAMES)} <> country
  then {lookup('country', COUNTRY_NAMES)} else '' end as country_name, hours, clips from chosen""",
    "pick_languages": WITH_PICKED + "select * from picked",
    "pick_lenient": ITEM_CATALOG + f"""select cast(position as bigint) as position, {CATALOG}
from (values (1, 'sup_7'), (2, 'sup_3'), (3, 'sup_7'), (4, 'sup_9'), (5, 'sup_0')) as asked(position, subset)
join catalog using (subset)""",
    "unknown_names": ITEM_CATALOG + """select asked.subset from (values ('sup_7'), ('sup_3'), ('sup_9'), ('sup_0'), ('nobody'), ('Sup_7'))
  as asked(subset) where asked.subset not in (select subset from catalog)""",
    # --- planning
    "plan_samples": ITEM_CATALOG + plan_of("catalog", 200, 1800.0, 3.0, 15.0) + "select * from plan",
    "plan_view": ITEM_PLAN + """select language, country_name as country, iso, hours, clips, available as in_split,
  planned as to_pull, planned_hours as est_hours, subset from plan""",
    "plan_totals": ITEM_PLAN + f"""select count(*) as languages, count(distinct country) as countries,
  cast(sum(planned) as bigint) as planned_clips, {PLANNED} as planned_hours from plan""",
    "shortfall": ITEM_CATALOG + EVERY + plan_of("chosen", None, 5400.0, 3.0, 15.0) + """
select position, language, planned_seconds, 5400.0::double - planned_seconds as missing_seconds from plan
where planned_seconds < 5400.0 * 0.98""",
    "shortfall_summary": ITEM_CATALOG + EVERY + plan_of("chosen", None, 5400.0, 3.0, 15.0) + f""",
limiting as (select *, row_number() over (order by position) as place from plan where planned_seconds < 5400.0 * 0.98),
total as (select {PLANNED} as planned_hours, (select count(*) from limiting) as limiting from plan)
select cast(150.0 as double) as requested_hours, planned_hours, planned_hours < 150.0 * 0.98 as short, limiting,
  case when planned_hours < 150.0 * 0.98 then concat(
    (select coalesce(string_agg(language, ', ' order by position), '') from limiting where place <= 6),
    case when limiting > 6 then '…' else '' end) else '' end as limited_by
from total""",
    "even_budget": WITH_PICKED + """select count(*) as languages, cast(24.0 as double) * 3600 / greatest(1, count(*)) as seconds_each
  from picked""",
    # --- clips
    "clip_scan": WITH_CLIPS + """select clip_id, subset, split, length from clips
where subset in ('src1_en', 'src2_fr', 'src3_de') and split = 'train'""",
    "resolve_columns": WITH_CLIPS + """select clip_id, 'transcript' as text_column, 'Duration_Seconds' as duration_column,
  length(text) as text_length, length from clips""",
    "split_normalise": WITH_ITEMS + "select split, count(*) as clips from clips group by split",
    "concat_splits": WITH_CLIPS + "select clip_id as id, subset, split from clips where split in ('train', 'val', 'test')",
    "clip_window": ITEM_GAPS + "select * from gaps where duration between 3 and 15",
    "clip_window_stream": ITEM_GAPS + "select * from gaps where coalesce(duration, 0) <= 15",
    "digit_filter": WITH_CLIPS + f"select clip_id as id, text as transcript from clips where not {DIGIT}",
    "standardise": WITH_CLIPS + f"select clip_id, split, {STANDARD} from clips",
    "waveform_length": f"""select cast(vec_id as varchar) as clip_id, concat('wave_', cast(label as varchar)) as subset,
  case when label = 0 then 0.0 else {rounded('len(embedding) / (label * 3)', 3)} end as length from embeddings""",
    "waveform_downmix": """select vec_id, place, (cast(a as double) + cast(b as double)) / 2 as sample from (
  select vec_id, unnest(range(len(embedding))) as place, unnest(embedding) as a,
    unnest(list_reverse(embedding)) as b from embeddings)""",
    "oneline_text": WITH_CLIPS + f"select doc_id, {LINE} as line from clips",
    "speaker_label": """select doc_id, coalesce(nullif(case when source like 'src1%' then '' else source end, ''),
  nullif(case when lang <> 'de' then lang end, ''), 'spk') as speaker from documents""",
    "schema_asr": WITH_CLIPS + PLAIN_CLIPS + "select audio, text from usable",
    "schema_whisper": WITH_CLIPS + PLAIN_CLIPS + "select audio, text as sentence from usable",
    "schema_common_voice": WITH_CLIPS + PLAIN_CLIPS + "select audio, text as sentence, language, country, length from usable",
    # --- draws
    "sample_order": WITH_CLIPS + PLAIN_CLIPS + f"""
select clip_id, subset, split, row_number() over w as rn, sum(length) over (w rows unbounded preceding) as cum
from usable window w as (partition by subset order by {KEY})""",
    "clip_cap": WITH_CLIPS + PLAIN_CLIPS + drawn_from("usable", cap=5) + "select clip_id, subset, split, length from drawn",
    "duration_budget": WITH_ITEMS + drawn_from("clips", budget=600) + "select clip_id, subset, length from drawn",
    "duration_budget_stream": WITH_ITEMS + drawn_from("clips", budget=600, nearest=False) + "select clip_id, subset, length from drawn",
    "cap_and_budget": WITH_CLIPS + PLAIN_CLIPS + ", windowed as (select * from usable where length between 1 and 15)"
    + drawn_from("windowed", cap=8, budget=30) + "select clip_id, subset, split, length from drawn",
    "ordered_split_draw": WITH_ITEMS + drawn_from("clips", order=SPLIT_ORDER, cap=260, budget=6000, nearest=False)
    + "select clip_id, subset, split, length from drawn",
    "holdout_split": WITH_CLIPS + f"""
select clip_id, subset, split, case when row_number() over (
    order by md5(concat('42:', clip_id)), clip_id, concat(subset, '/', split), length) <= ceil(0.1 * (select count(*) from clips))
  then 'test' else 'train' end as fold from clips""",
    # --- builds
    "build_subset": WITH_ITEMS + ", windowed as (select * from clips where length between 3 and 45)"
    + drawn_from("windowed", cap=40, budget=600) + f"select clip_id, split, {STANDARD} from drawn",
    "build_dataset": DOC_BUILT + "select * from built",
    "build_summary": WITH_CLIPS + PLAIN_CLIPS + """select subset, language, count(*) as clips, sum(length) as seconds from usable
group by subset, language""",
    "clip_uid": ITEM_CATALOG + EVERY + f"""
select clip_id, position, idx, printf('%s_%06d', subset, idx) as uid from (
  select clip_id, position, subset, row_number() over (order by position, {KEY}) - 1 as idx
  from clips join (select position, subset from chosen) using (subset))""",
    "speaker_ids": MANIFEST + "select speaker, sid from speakers",
    # --- sinks
    "manifest_ljspeech": MANIFEST + "select concat(uid, '|', text, '|', text) as line from lines",
    "manifest_piper": MANIFEST + "select concat(uid, '|', speaker, '|', text) as line from lines",
    "manifest_vits": MANIFEST + """select concat('wavs/', uid, '.wav|', cast(sid as varchar), '|', text) as line
from lines join speakers using (speaker)""",
    "manifest_melo": MANIFEST + "select concat('wavs/', uid, '.wav|', speaker, '|', code, '|', text) as line from lines",
    "speakers_vits": MANIFEST + "select concat(cast(sid as varchar), chr(9), speaker) as line from speakers",
    "manifest_csv": EXPORT + "select position, clip_id, split, text, language, country, length, iso, subset from exported",
    "parquet_roundtrip": EXPORT + f"select position, clip_id, split, {STANDARD} from exported",
    "dataset_roundtrip": EXPORT + f"select position, clip_id, split, {STANDARD} from exported",
    "selection_job": DOC_JOB,
    # --- streams
    "stream_filter": doc_pool() + f"select position, clip_id, split, {STANDARD} from usable join (select position, subset from chosen) using (subset)",
    "stream_admit": doc_pool(None) + drawn_from("usable", order=SPLIT_ORDER, cap=20, budget=120, nearest=False) + STREAM_BUILT,
    "stream_dataset": doc_pool(None) + drawn_from("usable", order=SPLIT_ORDER, budget=120, nearest=False)
    + "select audio, text as sentence, language, country, length from drawn",
}
ORACLES["manifests_together"] = " union all ".join(
    f"select '{layout}' as layout, line from ({ORACLES[f'manifest_{layout}']})" for layout in ("ljspeech", "piper", "vits", "melo")
)
