"""The registered queries again, as SQL for an independent engine.

Written from the definitions, not from the DataFrame plans: series are self-joined,
quantiles are picked from sorted lists, folds come from one global row number.
"""

from __future__ import annotations

import random

from gamelog.plans.dataset import MODEL_FEATURES

ADAPTERS = """
li as (
  select l_orderkey,
    cast(count_if(l_returnflag = 'A' and l_linestatus = 'F') as bigint) as FieldGoalsMade2,
    cast(count_if(l_returnflag = 'A') as bigint) as FieldGoalsAttempted2,
    cast(count_if(l_returnflag = 'R' and l_linestatus = 'F') as bigint) as FieldGoalsMade3,
    cast(count_if(l_returnflag = 'R') as bigint) as FieldGoalsAttempted3,
    cast(count_if(l_returnflag = 'N' and l_linestatus = 'F') as bigint) as FreeThrowsMade,
    cast(count_if(l_returnflag = 'N') as bigint) as FreeThrowsAttempted,
    cast(count_if(l_quantity > 40) as bigint) as OffensiveRebounds,
    cast(count_if(l_quantity <= 20) as bigint) as DefensiveRebounds,
    cast(count_if(l_discount > 0.075) as bigint) as Assistances,
    cast(count_if(l_discount < 0.015) as bigint) as Steals,
    cast(count_if(l_tax > 0.065) as bigint) as Turnovers,
    cast(count_if(l_tax < 0.015) as bigint) as BlocksFavour,
    cast(count_if(l_linenumber = 1) as bigint) as BlocksAgainst,
    cast(count_if(l_linenumber >= 5) as bigint) as FoulsCommited,
    cast(count_if(l_linenumber = 2) as bigint) as FoulsReceived
  from lineitem group by l_orderkey),
box as (
  select case when o_orderdate < timestamp '1998-04-15 00:00:00' then 2023 else 2024 end as Season, 'RS' as Phase,
    cast((year(o_orderdate) - 1995) * 53 + floor(dayofyear(o_orderdate) / 7) as int) as Round, o_orderkey as Gamecode,
    case when o_orderkey % 50 = 0 then 'Total' else cast(cast(floor(o_custkey / 10) as bigint) as string) end as Player_ID,
    concat('Player ', cast(cast(floor(o_custkey / 10) as bigint) as string)) as Player,
    concat('Team ', cast(cast(floor(o_custkey / 10) as bigint) % 18 as string)) as Team,
    cast(o_orderkey % 2 as int) as IsStarter,
    cast(cast(floor(o_orderkey / 2) as bigint) % 2 as int) as Home,
    case when o_orderkey % 17 = 0 then 'DNP' when o_orderkey % 19 = 0 then ''
         when o_orderkey % 23 = 0 then cast(null as string)
         else concat(cast(o_orderkey % 40 as string), ':', lpad(cast(o_orderkey % 60 as string), 2, '0')) end as Minutes,
    2 * FieldGoalsMade2 + 3 * FieldGoalsMade3 + FreeThrowsMade as Points,
    FieldGoalsMade2, FieldGoalsAttempted2, FieldGoalsMade3, FieldGoalsAttempted3,
    FreeThrowsMade, FreeThrowsAttempted, OffensiveRebounds, DefensiveRebounds, Assistances,
    Steals, Turnovers, BlocksFavour, BlocksAgainst, FoulsCommited, FoulsReceived
  from orders left join li on o_orderkey = l_orderkey),
shots as (
  select case when o_orderdate < timestamp '1998-04-15 00:00:00' then 2023 else 2024 end as Season, cast(cast(floor(o_custkey / 10) as bigint) as string) as ID_PLAYER,
    l_orderkey as Gamecode,
    case when l_linenumber = 1 then '1' else '0' end as FASTBREAK,
    case when l_linenumber = 2 then '1' else '0' end as SECOND_CHANCE,
    (l_quantity - 25) / 5 as COORD_X, l_discount * 100 as COORD_Y,
    case when l_tax = 0 then cast(null as string) else cast(cast(round(l_tax * 100) as int) as string) end as ZONE,
    concat(l_returnflag, l_linestatus) as ID_ACTION,
    case when l_returnflag = 'A' and l_linestatus = 'F' then 'Two Pointer'
         when l_returnflag = 'A' then 'Missed Two Pointer'
         when l_returnflag = 'R' and l_linestatus = 'F' then 'Three Pointer'
         when l_returnflag = 'R' then 'Missed Three Pointer'
         else 'Free Throw In' end as ACTION
  from lineitem join orders on l_orderkey = o_orderkey),
plays as (
  select case when o_orderdate < timestamp '1998-04-15 00:00:00' then 2023 else 2024 end as Season, cast(cast(floor(o_custkey / 10) as bigint) as string) as PLAYER_ID,
    o_orderkey as Gamecode, event_id as NUMBEROFPLAY,
    cast(floor(hour(ts) / 6) as int) + 1 as PERIOD,
    cast(floor((hour(ts) * 60 + minute(ts)) / 36) as int) + 1 as MINUTE,
    case event_type
      when 'purchase' then case event_id % 3 when 0 then '2FGM' when 1 then '3FGM' else 'FTM' end
      when 'view' then case event_id % 3 when 0 then '2FGA' when 1 then '3FGA' else 'FTA' end
      when 'click' then case event_id % 3 when 0 then 'AS' when 1 then 'D' else 'O' end
      when 'error' then case event_id % 3 when 0 then 'TO' when 1 then 'CM' else cast(null as string) end
      else case event_id % 3 when 0 then 'ST' when 1 then 'BLK' else 'RV' end end as PLAYTYPE,
    case when event_id % 5 = 0 then cast(null as string) else cast(cast(floor(value / 4) as int) as string) end as POINTS_A,
    regexp_extract(props, '([0-9]+)', 1) as POINTS_B
  from events join orders on o_orderkey = cast(floor(event_id / 8) as bigint))"""

RAW_TEXT = ("Phase", "Player_ID", "Player", "Team", "Minutes")
RAW_NUMBERS = (
    "Season", "Round", "Gamecode", "IsStarter", "Home", "Points",
    "FieldGoalsMade2", "FieldGoalsAttempted2", "FieldGoalsMade3", "FieldGoalsAttempted3",
    "FreeThrowsMade", "FreeThrowsAttempted", "OffensiveRebounds", "DefensiveRebounds",
    "Assistances", "Steals", "Turnovers", "BlocksFavour", "BlocksAgainst",
    "FoulsCommited", "FoulsReceived",
)

BOX = """
timed as (
  select *, case when Minutes is null or Minutes in ('', 'DNP') then 0.0
    else cast(split_part(Minutes, ':', 1) as double)
       + cast(split_part(Minutes, ':', 2) as double) / 60 end as minutes_played
  from box),
rated as (
  select *,
    cast(FieldGoalsMade2 + FieldGoalsMade3 as double)
      / greatest(coalesce(FieldGoalsAttempted2 + FieldGoalsAttempted3, 1), 1) as fg_percentage,
    cast(FieldGoalsMade2 as double) / greatest(coalesce(FieldGoalsAttempted2, 1), 1) as fg_percentage_2pt,
    cast(FieldGoalsMade3 as double) / greatest(coalesce(FieldGoalsAttempted3, 1), 1) as fg_percentage_3pt,
    cast(FreeThrowsMade as double) / greatest(coalesce(FreeThrowsAttempted, 1), 1) as ft_percentage,
    case when FieldGoalsAttempted2 + FieldGoalsAttempted3 + FreeThrowsAttempted is null then null else
      cast(Points as double) / greatest(cast(2 * (FieldGoalsAttempted2 + FieldGoalsAttempted3)
        + 0.88 * FreeThrowsAttempted as double), 1.0) end as true_shooting_percentage,
    Points + OffensiveRebounds + DefensiveRebounds + Assistances + Steals + BlocksFavour + FoulsReceived
      - FieldGoalsAttempted2 + FieldGoalsMade2 - FieldGoalsAttempted3 + FieldGoalsMade3
      - FreeThrowsAttempted + FreeThrowsMade - Turnovers - BlocksAgainst - FoulsCommited as PIR,
    row_number() over (partition by Season, Player_ID order by Round, Gamecode, Team) as t
  from timed)"""


def _rolling(name: str, source: str, size: int, function: str) -> str:
    return (
        f"case when count({source}) over w{size} = {size} "
        f"then {function}({source}) over w{size} end as {name}"
    )


_ROLLS = ",\n    ".join(
    part
    for n in (3, 5, 10)
    for part in (
        _rolling(f"minutes_ma{n}", "minutes_played", n, "avg"),
        _rolling(f"Points_ma{n}", "Points", n, "avg"),
        _rolling(f"pir_ma{n}", "PIR", n, "avg"),
        _rolling(f"pir_std_ma{n}", "PIR", n, "stddev_samp"),
    )
)

FORM = f"""
rolled as (
  select *,
    {_ROLLS}
  from rated
  window w3 as (partition by Season, Player_ID order by t rows between 2 preceding and current row),
    w5 as (partition by Season, Player_ID order by t rows between 4 preceding and current row),
    w10 as (partition by Season, Player_ID order by t rows between 9 preceding and current row)),
weighted as (
  select a.Season as s, a.Player_ID as p, a.t as at_t,
    sum(b.PIR * pow(0.7, a.t - b.t)) / nullif(sum(case when b.PIR is not null then pow(0.7, a.t - b.t) end), 0) as pir_ewm,
    sum(b.Points * pow(0.7, a.t - b.t)) / nullif(sum(case when b.Points is not null then pow(0.7, a.t - b.t) end), 0) as points_ewm
  from rated a join rated b on a.Season = b.Season and a.Player_ID = b.Player_ID and b.t <= a.t
  group by 1, 2, 3),
formed as (
  select rolled.*, pir_ewm, points_ewm, pir_ma3 - pir_ma10 as recent_form
  from rolled join weighted on Season = s and Player_ID = p and t = at_t)"""

ROLLING_NAMES = [f"{p}_ma{n}" for n in (3, 5, 10) for p in ("minutes", "Points", "pir", "pir_std")]
BOX_DOUBLES = [
    "minutes_played", "fg_percentage", "fg_percentage_2pt", "fg_percentage_3pt",
    "ft_percentage", "true_shooting_percentage", "pir_ewm", "points_ewm", "recent_form",
    *ROLLING_NAMES,
]

SHOT_ROWS = """
shot_rows as (
  select Season, ID_PLAYER as Player_ID, Gamecode, cast(FASTBREAK as bigint) as fb,
    cast(SECOND_CHANCE as bigint) as sc, COORD_X as x, COORD_Y as y, ZONE,
    sqrt(COORD_X * COORD_X + COORD_Y * COORD_Y) as d, atan2(COORD_Y, COORD_X) as angle,
    ACTION like '%Two Pointer%' as two, ACTION like '%Three Pointer%' as three,
    (ACTION like '%Two Pointer%' or ACTION like '%Three Pointer%') and ACTION not like '%Missed%' as made
  from shots),
shot_classes as (
  select *, cast(case when fb = 1 then 1.3 when sc = 1 then 1.1 when d < 3 then 1.2
      when d > 7 then 0.8 else 1.0 end as double) as quality,
    case when made and two then 2 when made and three then 3 else 0 end as points
  from shot_rows)"""


def _shot_rate(condition: str) -> str:
    return (
        f"cast(count_if(made and {condition}) as double) / greatest(count_if({condition}), 1)"
    )


def _quantile(q: float) -> str:
    position = f"cast(floor((count(d) - 1) * {q} + 0.5) as int) + 1"
    return f"(list_sort(list(d) filter (where d is not null)))[{position}]"


SHOT_MEASURES = {
    "shot_quality_index": "avg(quality)",
    "avg_shot_distance": "avg(d)",
    "shot_distance_variation": "stddev_samp(d)",
    "court_coverage_area": "stddev_samp(x) * stddev_samp(y)",
    "unique_scoring_zones": "cast(count(distinct ZONE) + max(case when ZONE is null then 1 else 0 end) as bigint)",
    "fastbreak_rate": "avg(fb)",
    "second_chance_rate": "avg(sc)",
    "three_point_attempt_rate": "avg(cast(three as int))",
    "shot_distance_75th": _quantile(0.75),
    "shot_distance_25th": _quantile(0.25),
    "shot_angle_spread": "stddev_samp(angle)",
    "points_per_shot": "avg(points)",
    "effective_fg_percentage": "(count_if(made and two) + 1.5 * count_if(made and three))"
    " / cast(greatest(count_if(two) + count_if(three), 1) as double)",
    "close_shot_percentage": _shot_rate("d < 3"),
    "mid_range_percentage": _shot_rate("(d >= 3 and d < 5)"),
    "long_range_percentage": _shot_rate("d >= 5"),
    "fastbreak_fg_percentage": _shot_rate("fb = 1"),
    "second_chance_fg_percentage": _shot_rate("sc = 1"),
}

SHOT_COUNTS = ("unique_scoring_zones",)


def _play_rows(exact: bool) -> str:
    def has(*tokens: str) -> str:
        if exact:
            return "PLAYTYPE in (" + ", ".join(f"'{t}'" for t in tokens) + ")"
        return "(" + " or ".join(f"contains(PLAYTYPE, '{t}')" for t in tokens) + ")"

    made = has("2FGM", "3FGM", "FTM") if exact else has("Made", "FTM")
    impacts = (("3FGM", 4), ("2FGM", 3), ("AS", 2), ("ST", 2), ("BLK", 1.5), ("O", 1.2), ("D", 1), ("TO", -1.5))
    impact = " ".join(f"when {has(token)} then {worth}" for token, worth in impacts)
    return f"""
play_rows as (
  select Season, PLAYER_ID as Player_ID, Gamecode, NUMBEROFPLAY, PERIOD, MINUTE, PLAYTYPE,
    cast(POINTS_A as double) - cast(POINTS_B as double) as margin,
    PERIOD = 4 and MINUTE >= 35 as clutch, PERIOD = 4 and MINUTE >= 38 as super_clutch,
    {has("AS")} as assist, {has("2FGA", "3FGA")} as shot_attempt, {has("D", "BLK", "ST")} as defensive_play,
    {has("TO")} as turnover, {has("O")} as offensive_rebound, {has("D")} as defensive_rebound,
    {has("BLK")} as block, {has("ST")} as steal, {made} as made,
    PLAYTYPE in ('2FGM', '3FGM', 'FTM', 'D', 'O', 'AS', 'ST', 'BLK') as positive,
    cast(case {impact} else 0 end as double) as impact,
    case when {has("2FGM")} then 2 when {has("3FGM")} then 3 when {has("FTM")} then 1 else 0 end as points,
    {has("2FGA", "3FGA", "FTA")} as scoring_attempt, {has("BLK", "ST")} as disruption
  from plays),
play_runs as (
  select *, lead(positive) over w as next_positive,
    case when row_number() over w >= 3
      then impact + lag(impact, 1) over w + lag(impact, 2) over w end as run3
  from play_rows window w as (partition by Season, Player_ID, Gamecode order by NUMBEROFPLAY))"""


def _percent(flag: str) -> str:
    return f"coalesce(100.0 * count(*) filter (where {flag}) / cast(nullif(count(PLAYTYPE), 0) as double), 0)"


PLAY_MEASURES = {
    "clutch_plays": "count(*) filter (where clutch)",
    "clutch_scores": "count(*) filter (where clutch and made)",
    "super_clutch_plays": "count(*) filter (where super_clutch)",
    "super_clutch_scores": "count(*) filter (where super_clutch and made)",
    "close_game_impact_plays": "count(*) filter (where abs(margin) <= 5 and positive)",
    "first_quarter_plays": "count(*) filter (where PERIOD = 1)",
    "fourth_quarter_plays": "count(*) filter (where PERIOD = 4)",
    "unique_play_types": "count(distinct PLAYTYPE) + max(case when PLAYTYPE is null then 1 else 0 end)",
    "assist_rate": _percent("assist"),
    "shot_attempt_rate": _percent("shot_attempt"),
    "defensive_play_rate": _percent("defensive_play"),
    "turnover_rate": "coalesce(100.0 * count(*) filter (where turnover)"
    " / cast(nullif(count(*) filter (where shot_attempt) + count(*) filter (where assist), 0) as double), 0)",
    "offensive_rebound_rate": _percent("offensive_rebound"),
    "defensive_rebound_rate": _percent("defensive_rebound"),
    "block_rate": _percent("block"),
    "steal_rate": _percent("steal"),
    "avg_play_impact": "avg(impact)",
    "total_play_impact": "sum(impact)",
    "clutch_play_impact": "coalesce(sum(case when clutch then impact else 0 end), 0)",
    "game_volatility": "coalesce(stddev_samp(margin), 0)",
    "close_game_time_ratio": "coalesce(avg(case when abs(margin) <= 5 then 1.0 when margin is not null then 0.0 end), 0)",
    "consecutive_positive_plays": "count(*) filter (where positive and next_positive)",
    "best_impact_sequence": "coalesce(max(run3), 0)",
    "worst_impact_sequence": "coalesce(min(run3), 0)",
}
MATCHUP_MEASURES = {
    "scoring_efficiency": "coalesce(sum(points) / cast(nullif(count(*) filter (where scoring_attempt), 0) as double), 0)",
    "points_in_close_games": "coalesce(sum(points) filter (where abs(margin) <= 5), 0)",
    "clutch_points": "coalesce(sum(points) filter (where clutch), 0)",
    "defensive_plays": "count(*) filter (where disruption)",
    "scoring_volatility": "coalesce(stddev_samp(points), 0)",
    "usage_rate": "coalesce(100.0 * sum(points) / cast(nullif(count(PLAYTYPE), 0) as double), 0)",
}
PLAY_COUNTS = {
    *list(PLAY_MEASURES)[:8], "consecutive_positive_plays", "points_in_close_games",
    "clutch_points", "defensive_plays",
}


def _double(expression: str, name: str) -> str:
    return f"round(cast({expression} as double), 6) as {name}"


def _bigint(expression: str, name: str) -> str:
    return f"cast({expression} as bigint) as {name}"


def _typed(measures: dict[str, str], counts) -> str:
    return ",\n  ".join(
        _bigint(e, n) if n in counts else _double(e, n) for n, e in measures.items()
    )


def _with(*ctes: str) -> str:
    return "with " + ",".join(ctes)


def _box_query(columns: str, *, form: bool = False) -> str:
    if form:
        return f"{_with(ADAPTERS, BOX, FORM)} select {columns} from formed"
    return f"{_with(ADAPTERS, BOX)} select {columns} from rated"


def _shot_query(names=None, fill: bool = False) -> str:
    chosen = {n: e for n, e in SHOT_MEASURES.items() if names is None or n in names}
    if fill:
        chosen = {n: f"coalesce({e}, 0)" for n, e in chosen.items()}
    return (
        f"{_with(ADAPTERS, SHOT_ROWS)} select Season, Player_ID, Gamecode,\n  "
        f"{_typed(chosen, SHOT_COUNTS)} from shot_classes group by Season, Player_ID, Gamecode"
    )


def _play_query(measures: dict[str, str], exact: bool = False) -> str:
    return (
        f"{_with(ADAPTERS, _play_rows(exact))} select Season, Player_ID, Gamecode,\n  "
        f"{_typed(measures, PLAY_COUNTS)} from play_runs group by Season, Player_ID, Gamecode"
    )


_GAME = "Season, Player_ID, Gamecode"


def _doubles(names) -> str:
    return ", ".join(_double(n, n) for n in names)


# The feature matrix, with unrounded values for the queries built on it.
_SHOT_PART = ", ".join(f"{e} as {n}" for n, e in SHOT_MEASURES.items())
_PLAY_PART = ", ".join(f"{e} as {n}" for n, e in {**PLAY_MEASURES, **MATCHUP_MEASURES}.items())
_JOINED = [*SHOT_MEASURES, *PLAY_MEASURES, *MATCHUP_MEASURES]
MATRIX = f"""
shot_part as (select {_GAME}, {_SHOT_PART} from shot_classes group by {_GAME}),
play_part as (select {_GAME}, {_PLAY_PART} from play_runs group by {_GAME}),
matrix as (
  select {", ".join(f"formed.{c}" for c in RAW_TEXT)},
    {", ".join(f"coalesce(formed.{c}, 0) as {c}" for c in RAW_NUMBERS)},
    coalesce(PIR, 0) as PIR,
    {", ".join(f"coalesce({c}, 0) as {c}" for c in BOX_DOUBLES)},
    {", ".join(f"coalesce({c}, 0) as {c}" for c in _JOINED)}
  from formed
    left join shot_part using (Season, Player_ID, Gamecode)
    left join play_part using (Season, Player_ID, Gamecode))"""
_MATRIX_CTES = _with(ADAPTERS, BOX, FORM, SHOT_ROWS, _play_rows(False), MATRIX)
_COUNT_COLUMNS = {*SHOT_COUNTS, *PLAY_COUNTS, "PIR"}
_MATRIX_COLUMNS = ", ".join(
    [
        *RAW_TEXT,
        *RAW_NUMBERS,
        _bigint("PIR", "PIR"),
        *[_double(c, c) for c in BOX_DOUBLES],
        *[_bigint(c, c) if c in _COUNT_COLUMNS else _double(c, c) for c in _JOINED],
    ]
)

# Box features only, filled, for the queries that need no more.
FILLED = f"""
filled as (
  select {", ".join(RAW_TEXT)}, {", ".join(f"coalesce({c}, 0) as {c}" for c in RAW_NUMBERS)},
    coalesce(PIR, 0) as PIR, {", ".join(f"coalesce({c}, 0) as {c}" for c in BOX_DOUBLES)}
  from formed)"""
_FILLED_CTES = _with(ADAPTERS, BOX, FORM, FILLED)


def _target(source: str, keys: str) -> str:
    return f"""
led as (
  select * from (
    select *, lead(PIR) over (partition by {keys} order by Season, Round, Gamecode, Team) as next_PIR
    from {source})
  where next_PIR is not null)"""


_PRODUCED = {c.lower(): c for c in [*BOX_DOUBLES, "Points", *_JOINED]}


def _model_column(name: str) -> str:
    source = _PRODUCED.get(name.lower())
    if source is None:
        return f"cast(0 as double) as {name}"
    if source in _COUNT_COLUMNS or source == "Points":
        return _bigint(source, name)
    return _double(source, name)


def _scaled_column(name: str) -> str:
    source = _PRODUCED.get(name.lower())
    if source is None:
        return f"cast(0 as double) as {name}"
    centred = f"({source} - avg({source}) over ())"
    scaled = f"{centred} / nullif(stddev_pop({source}) over (), 0)"
    return _double(f"coalesce({scaled}, 0)", name)


_MODEL_COLUMNS = ", ".join(_model_column(c) for c in MODEL_FEATURES)

FOLDS = """
numbered as (
  select *, row_number() over (order by Season, Round, Gamecode, Player_ID, Team) - 1 as row_index,
    count(*) over () as n from led),
folded as (
  select *, cast(case when row_index < n - 5 * (n // 6) then 0
      else (row_index - (n - 5 * (n // 6))) // (n // 6) + 1 end as int) as test_fold
  from numbered),
forecasts as (
  select test_fold as fold, cast(next_PIR as double) as actual, pir_ma3 as predicted
  from folded where test_fold > 0),
metrics as (
  select fold, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
    avg(abs(actual - predicted)) as mae,
    1 - sum((actual - predicted) * (actual - predicted))
      / (sum(actual * actual) - sum(actual) * sum(actual) / count(*)) as r2
  from forecasts group by fold)"""
_FOLD_CTES = _with(ADAPTERS, BOX, FORM, FILLED, _target("filled", "Player_ID"), FOLDS)

LATEST = """
season_rows as (select * from filled where Season = 2024),
last_round as (select max(Round) as r from season_rows),
active as (
  select distinct Player_ID from season_rows
  where Player_ID <> 'Total' and Round = (select r from last_round)),
latest as (
  select * from (
    select *, row_number() over (partition by Player_ID order by Round desc, Gamecode desc) as k
    from season_rows where Player_ID in (select Player_ID from active))
  where k = 1),
meta as (
  select distinct Player_ID, Player, Team from box
  where Season = 2024 and Player_ID <> 'Total' and Player_ID in (select Player_ID from active)),
predictions as (
  select Player_ID, pir_ma3 as PredictedPIR, PIR as CurrentPIR, pir_ma3 as PIRTrend,
    minutes_played as MinutesPlayed, Points, (select r from last_round) + 1 as Round,
    meta.Player as Player, meta.Team as Team
  from (select Player_ID, pir_ma3, PIR, minutes_played, Points from latest)
    left join meta using (Player_ID))"""
_LATEST_CTES = _with(ADAPTERS, BOX, FORM, FILLED, LATEST)


def _quartiles() -> str:
    cuts = {"lowest": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "highest": 1}
    parts = [
        f"select '{m}' as metric, "
        + ", ".join(_double(f"quantile_cont({m}, {q})", n) for n, q in cuts.items())
        + " from metrics"
        for m in ("rmse", "mae", "r2")
    ]
    return f"{_FOLD_CTES} " + " union all ".join(parts)


# Least squares of the next rating on the three-game mean, fitted on the rows before a fold.
LINE = """
line_rows as (select *, cast(next_PIR as double) as y, pir_ma3 as x from folded),
lines as (
  select f as fold, regr_slope(y, x) as slope, regr_intercept(y, x) as base
  from line_rows, generate_series(1, 5) as g(f) where test_fold < f group by f),
guesses as (
  select test_fold as fold, y, slope * x + base as p from line_rows join lines on test_fold = fold),
line_metrics as (
  select fold, sqrt(avg((y - p) * (y - p))) as rmse, avg(abs(y - p)) as mae,
    1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) as r2
  from guesses group by fold)"""
_LINE_CTES = _with(ADAPTERS, BOX, FORM, FILLED, _target("filled", "Player_ID"), FOLDS, LINE)


def _linear_curve() -> str:
    return f"""{_LINE_CTES},
sizes as (
  select i / 10.0 as fraction, greatest(1, cast(floor((i / 10.0) * first_train) as bigint)) as n_train
  from (select count(*) as first_train from line_rows where test_fold = 0), generate_series(1, 10) as g(i)),
curves as (
  select fraction, n_train, regr_slope(y, x) as slope, regr_intercept(y, x) as base
  from sizes join line_rows on row_index < n_train group by 1, 2),
errors as (
  select fraction, n_train, test_fold, row_index < n_train as trained, (y - slope * x - base) ** 2 as e
  from curves, line_rows)
select cast(v.fraction as double) as fraction, fold, v.n_train as n_train,
  round(train_mse, 6) as train_mse, round(val_mse, 6) as val_mse
from (select fraction, n_train, test_fold as fold, avg(e) as val_mse from errors where test_fold > 0 group by 1, 2, 3) v
join (select fraction, avg(e) as train_mse from errors where trained group by 1) t using (fraction)"""


def _linear_importance(seed: int = 42, repeats: int = 10) -> str:
    draw = random.Random(seed)
    shares = ", ".join(f"({r}, {draw.random()!r})" for r in range(repeats))
    return f"""{_LINE_CTES},
line as (select regr_slope(y, x) as slope, regr_intercept(y, x) as base from line_rows),
shuffled as (
  select x, y, count(*) over () as n, row_number() over (order by
    md5(concat_ws('|', '{seed}', Season, Round, Gamecode, Player_ID, Team)), Season, Round, Gamecode, Player_ID, Team) - 1 as at
  from line_rows),
shares(r, u) as (values {shares}),
trials as (
  select r, a.y as y, b.x as moved, a.x as x
  from shuffled a, shares join shuffled b on true
  where b.at = (a.at + 1 + cast(floor(u * (a.n - 1)) as bigint)) % a.n),
losses as (
  select r, (sum((y - slope * moved - base) ** 2) - sum((y - slope * x - base) ** 2))
    / (var_pop(y) * count(*)) as loss
  from trials, line group by r)
select 'pir_ma3' as feature, round(avg(loss), 6) as importance, round(stddev_pop(loss), 6) as deviation from losses"""


def _linear_importances(names: tuple[str, ...] = ("pir_ma3", "minutes_played", "Points"), seed: int = 42, repeats: int = 10) -> str:
    """Least squares on three inputs by Cramer's rule, then each input shuffled."""
    draw = random.Random(seed)
    shares = ", ".join(f"({r}, {draw.random()!r})" for r in range(repeats))

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        parts = [f"{'-' if k % 2 else '+'} ({c}) * ({det([row[:k] + row[k + 1:] for row in m[1:]])})" for k, c in enumerate(m[0])]
        return " ".join(parts)

    s = [[f"covar_pop(x{i}, x{j})" for j in range(3)] for i in range(3)]
    replaced = lambda i: [[f"covar_pop(x{r}, y)" if c == i else s[r][c] for c in range(3)] for r in range(3)]
    slopes = ", ".join(f"({det(replaced(i))}) / ({det(s)}) as b{i}" for i in range(3))
    inputs = ", ".join(f"cast({n} as double) as x{i}" for i, n in enumerate(names))
    error = "y - base - b0 * a.x0 - b1 * a.x1 - b2 * a.x2"
    losses = " union all ".join(
        f"select '{n}' as feature, r, (sum(({error} - b{i} * (b.x{i} - a.x{i})) ** 2) - sum(({error}) ** 2)) / (var_pop(y) * count(*)) as loss "
        f"from trials, fitted group by r"
        for i, n in enumerate(names)
    ).replace("a.x", "x").replace("b.x", "moved")
    return f"""{_FOLD_CTES},
rows3 as (select *, cast(next_PIR as double) as y, {inputs} from folded),
slopes as (select {slopes}, avg(y) as my, avg(x0) as m0, avg(x1) as m1, avg(x2) as m2 from rows3),
fitted as (select b0, b1, b2, my - b0 * m0 - b1 * m1 - b2 * m2 as base from slopes),
shuffled as (
  select x0, x1, x2, y, count(*) over () as size, row_number() over (order by
    md5(concat_ws('|', '{seed}', Season, Round, Gamecode, Player_ID, Team)), Season, Round, Gamecode, Player_ID, Team) - 1 as at
  from rows3),
shares(r, u) as (values {shares}),
trials as (
  select r, a.y as y, a.x0 as x0, a.x1 as x1, a.x2 as x2, b.x0 as moved0, b.x1 as moved1, b.x2 as moved2
  from shuffled a, shares join shuffled b on true
  where b.at = (a.at + 1 + cast(floor(u * (a.size - 1)) as bigint)) % a.size),
losses as ({losses})
select feature, round(avg(loss), 6) as importance, round(stddev_pop(loss), 6) as deviation from losses group by feature"""


# Clocks that do not parse, at known places, and what a lenient reading makes of them.
_SPOILT = (
    "spoilt as (select Gamecode, case when Gamecode % 29 = 0 then 'x' || Minutes else Minutes end as Minutes from box)"
)
_LENIENT = (
    "case when Minutes is null or Minutes in ('', 'DNP') then 0.0 "
    "else try_cast(split_part(Minutes, ':', 1) as double) + try_cast(split_part(Minutes, ':', 2) as double) / 60 end"
)


def oracle_sql() -> dict[str, str]:
    twins = _oracle_sql()
    # the plan for hot keys must give the same rows
    split = ("rolling_means", "ewm_form", "play_streaks", "next_game_target", "shot_quantiles")
    twins |= {f"{name}_split": twins[name] for name in split}
    # and so must new rounds appended to carried state
    return twins | {"box_features_advanced": twins["box_features"]}


def _oracle_sql() -> dict[str, str]:
    play_names = list(PLAY_MEASURES)

    def plays(*names):
        return _play_query({n: PLAY_MEASURES[n] for n in names})

    return {
        "scan_box": f"with {ADAPTERS} select * from box",
        "scan_shots": f"with {ADAPTERS} select * replace (round(COORD_X, 6) as COORD_X, "
        "round(COORD_Y, 6) as COORD_Y) from shots",
        "scan_plays": f"with {ADAPTERS} select * from plays",
        "raw_manifest": f"with {ADAPTERS} "
        + " union all ".join(
            f"select Season, '{name}' as table_name, count(*) as n_rows from {cte} group by Season"
            for name, cte in (("player_stats", "box"), ("shot_data", "shots"), ("playbyplay", "plays"))
        ),
        "landed_manifest": f"with {ADAPTERS} "
        + " union all ".join(
            f"select Season, '{name}' as table_name, count(*) as n_rows from {cte} group by Season"
            for name, cte in (("player_stats", "box"), ("shot_data", "shots"), ("playbyplay", "plays"))
        ),
        "feature_matrix_landed": f"{_MATRIX_CTES} select {_MATRIX_COLUMNS} from matrix",
        "feature_matrix_bucketed": f"{_MATRIX_CTES} select {_MATRIX_COLUMNS} from matrix",
        "lenient_minutes": f"with {ADAPTERS}, {_SPOILT} select Gamecode, Minutes, {_double(_LENIENT, 'minutes_played')} from spoilt",
        "lenient_flags": f"with {ADAPTERS} select ID_PLAYER, "
        "cast(sum(try_cast(case when Gamecode % 31 = 0 then 'n/a' else FASTBREAK end as int)) as bigint) as fastbreaks, "
        "cast(sum(try_cast(SECOND_CHANCE as int)) as bigint) as second_chances, "
        "count(try_cast(case when Gamecode % 31 = 0 then 'n/a' else FASTBREAK end as int)) as known from shots group by ID_PLAYER",
        "quarantined_cells": f"with {ADAPTERS}, {_SPOILT} select Gamecode, 'Minutes' as column_name, Minutes as text "
        f"from spoilt where Minutes is not null and {_LENIENT} is null "
        "union all select Gamecode, 'FASTBREAK', 'n/a' from shots where Gamecode % 31 = 0",
        "approx_zones": f"with {ADAPTERS} select Season, count(*) as n, "
        "count(distinct ZONE) + max(case when ZONE is null then 1 else 0 end) as zones, true as within_bound from shots group by Season",
        "approx_quartiles": f"with {ADAPTERS} select Season, count(*) as n, true as shot_distance_75th, true as shot_distance_25th "
        "from shots where COORD_X is not null and COORD_Y is not null group by Season",
        "clock_minutes_played": _box_query(f"Gamecode, Minutes, {_doubles(['minutes_played'])}"),
        "shooting_percentages": _box_query(
            f"{_GAME}, "
            + _doubles(["fg_percentage", "fg_percentage_2pt", "fg_percentage_3pt", "ft_percentage"])
        ),
        "true_shooting": _box_query(f"{_GAME}, {_doubles(['true_shooting_percentage'])}"),
        "pir": _box_query(f"{_GAME}, PIR"),
        "rolling_means": _box_query(
            f"{_GAME}, {_doubles([c for c in ROLLING_NAMES if 'std' not in c])}", form=True
        ),
        "rolling_std": _box_query(
            f"{_GAME}, {_doubles([c for c in ROLLING_NAMES if 'std' in c])}", form=True
        ),
        "ewm_form": _box_query(f"{_GAME}, {_doubles(['pir_ewm', 'points_ewm'])}", form=True),
        "recent_form": _box_query(
            f"{_GAME}, {_doubles(['pir_ma3', 'pir_ma10', 'recent_form'])}", form=True
        ),
        "box_features": _box_query(
            f"{_GAME}, Phase, Round, IsStarter, Home, Points, PIR, {_doubles(BOX_DOUBLES)}", form=True
        ),
        "shot_geometry": f"{_with(ADAPTERS, SHOT_ROWS)} select {_GAME}, {_double('x', 'COORD_X')}, "
        f"{_double('y', 'COORD_Y')}, {_double('d', 'shot_distance')}, "
        f"{_double('angle', 'shot_angle')} from shot_rows",
        "shot_quality_class": f"{_with(ADAPTERS, SHOT_ROWS)} select {_GAME}, quality as shot_quality, "
        "points as points_scored, d < 3 as is_close_shot, d >= 3 and d < 5 as is_mid_range, "
        "d >= 5 as is_long_range from shot_classes",
        "shot_spread": _shot_query(
            ("shot_distance_variation", "court_coverage_area", "shot_angle_spread")
        ),
        "shot_quantiles": _shot_query(("shot_distance_75th", "shot_distance_25th")),
        "shot_zone_distinct": _shot_query(("unique_scoring_zones",)),
        "shot_success_by_distance": _shot_query(
            ("close_shot_percentage", "mid_range_percentage", "long_range_percentage")
        ),
        "effective_fg": _shot_query(
            (
                "effective_fg_percentage",
                "points_per_shot",
                "fastbreak_fg_percentage",
                "second_chance_fg_percentage",
            )
        ),
        "shot_features": _shot_query(fill=True),
        "play_flags": f"{_with(ADAPTERS, _play_rows(False))} select {_GAME}, NUMBEROFPLAY, "
        "assist as is_assist, shot_attempt as is_shot_attempt, defensive_play as is_defensive_play, "
        "turnover as is_turnover, offensive_rebound as is_offensive_rebound, "
        "defensive_rebound as is_defensive_rebound, block as is_block, steal as is_steal, "
        "made as is_made, positive as is_positive, clutch as is_clutch, "
        "super_clutch as is_super_clutch, margin as score_diff, abs(margin) <= 5 as is_close, "
        "impact as play_impact from play_rows",
        "play_counts": plays(*play_names[:8]),
        "play_rates": plays(*play_names[8:16]),
        "play_impact": plays("avg_play_impact", "total_play_impact", "clutch_play_impact"),
        "score_volatility": plays("game_volatility", "close_game_time_ratio"),
        "play_streaks": plays(*play_names[-3:]),
        "play_features": plays(*play_names),
        "play_features_exact": _play_query(PLAY_MEASURES, exact=True),
        "matchup_features": _play_query(MATCHUP_MEASURES),
        "play_and_matchup_features": _play_query({**PLAY_MEASURES, **MATCHUP_MEASURES}),
        "feature_matrix": f"{_MATRIX_CTES} select {_MATRIX_COLUMNS} from matrix",
        "feature_matrix_season": f"{_MATRIX_CTES} select {_MATRIX_COLUMNS} from matrix where Season = 2024",
        "season_union": f"with {ADAPTERS} select * from box where Season = 2023 "
        "union all select * from box where Season = 2024",
        "feature_summary": f"{_MATRIX_CTES} select "
        f"cast({len(RAW_TEXT) + len(RAW_NUMBERS) + 1 + len(BOX_DOUBLES) + len(_JOINED)} as bigint) as n_columns, "
        "count(*) as n_rows, count(distinct Season) as n_seasons, min(Season) as first_season, "
        "max(Season) as last_season from matrix",
        "next_game_target": f"{_FILLED_CTES}, {_target('filled', 'Player_ID')} "
        f"select {_GAME}, PIR, next_PIR from led",
        "next_game_target_in_season": f"{_FILLED_CTES}, {_target('filled', 'Season, Player_ID')} "
        f"select {_GAME}, PIR, next_PIR from led",
        "aligned_training_set": f"{_MATRIX_CTES}, {_target('matrix', 'Player_ID')} "
        f"select {_GAME}, {_MODEL_COLUMNS}, next_PIR from led",
        "scoring_set": f"{_MATRIX_CTES} select {_GAME}, Phase, Round, PIR, {_MODEL_COLUMNS} from matrix",
        "scaled_features": f"{_MATRIX_CTES}, {_target('matrix', 'Player_ID')} select {_GAME}, "
        + ", ".join(_scaled_column(c) for c in MODEL_FEATURES)
        + " from led",
        "time_split_folds": f"{_FOLD_CTES} select {_GAME}, Round, row_index, test_fold from folded",
        "forecast_metrics": f"{_FOLD_CTES} select fold, {_doubles(['rmse', 'mae', 'r2'])} from metrics",
        "mean_forecast_metrics": f"{_FOLD_CTES} select "
        + ", ".join(_double(f"avg({m})", m) for m in ("rmse", "mae", "r2"))
        + " from metrics",
        "metrics_record": f"{_FOLD_CTES} " + " union all ".join(
            f"select fold, '{m}' as metric, {_double(m, 'value')} from metrics "
            f"union all select null as fold, '{m}' as metric, {_double(f'avg({m})', 'value')} from metrics"
            for m in ("rmse", "mae", "r2")
        ),
        "linear_cv_metrics": f"{_LINE_CTES} select fold, {_doubles(['rmse', 'mae', 'r2'])} from line_metrics",
        "linear_learning_curve": _linear_curve(),
        "linear_importance": _linear_importance(),
        "linear_importances": _linear_importances(),
        "metric_quartiles": _quartiles(),
        "oof_scatter_bins": f"{_FOLD_CTES} select cast(floor(actual / 5) as bigint) as actual_bin, "
        "cast(floor(predicted / 5) as bigint) as predicted_bin, count(*) as n "
        "from forecasts group by 1, 2",
        "latest_round": f"{_LATEST_CTES} select r as latest_round, r + 1 as next_round from last_round",
        "active_players": f"{_LATEST_CTES} select Player_ID from active",
        "latest_per_player": f"{_LATEST_CTES} select Player_ID, Round, Gamecode, PIR, "
        f"{_doubles(['pir_ma3', 'minutes_played'])}, Points from latest",
        "player_meta": f"{_LATEST_CTES} select Player_ID, Player, Team from meta",
        "prediction_table": f"{_LATEST_CTES} select Player_ID, "
        f"{_doubles(['PredictedPIR', 'PIRTrend', 'MinutesPlayed'])}, "
        "CurrentPIR, Points, Round, Player, Team from predictions",
        "top_n_report": f"{_LATEST_CTES}, ranked as (select *, row_number() over "
        "(order by PredictedPIR desc, Player_ID) as rank from predictions) "
        "select rank, concat(Player, ' (', Team, ')') as line, "
        "concat('Predicted PIR: ', printf('%.1f', PredictedPIR)) as forecast_line "
        "from ranked where rank <= 20",
    }
