"""Small helpers for hand-made tables and order-free comparison."""

import math

TINY = "/root/testdata/sf0.001"


def rows_of(df, digits=9):
    """Sorted rows with rounded doubles, columns in name order."""
    names = sorted(df.columns)

    def cell(value):
        return round(value, digits) + 0.0 if isinstance(value, float) else value

    rows = [tuple(cell(v) for v in row) for row in df.select(*names).collect()]
    return names, sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def assert_same(left, right, digits=9):
    names, rows = rows_of(left, digits)
    other_names, other = rows_of(right, digits)
    assert names == other_names
    assert len(rows) == len(other)
    for a, b in zip(rows, other):
        for name, x, y in zip(names, a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-8), (name, x, y)
            else:
                assert x == y, (name, a, b)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


COUNTERS = (
    "Points",
    "FieldGoalsMade2",
    "FieldGoalsAttempted2",
    "FieldGoalsMade3",
    "FieldGoalsAttempted3",
    "FreeThrowsMade",
    "FreeThrowsAttempted",
    "OffensiveRebounds",
    "DefensiveRebounds",
    "Assistances",
    "Steals",
    "Turnovers",
    "BlocksFavour",
    "BlocksAgainst",
    "FoulsCommited",
    "FoulsReceived",
)
BOX_SCHEMA = (
    "Season int, Phase string, Round int, Gamecode bigint, Player_ID string, Player string, "
    "Team string, IsStarter int, Home int, Minutes string, "
    + ", ".join(f"{c} bigint" for c in COUNTERS)
)


def box_table(spark, games):
    """Box-score rows from dicts; counters default to 0."""
    rows = []
    for i, game in enumerate(games, 1):
        full = {
            "Season": 2024, "Phase": "RS", "Round": i, "Gamecode": i, "Player_ID": "P1",
            "Player": "Ann", "Team": "A", "IsStarter": 1, "Home": 0, "Minutes": "10:00",
            **{c: 0 for c in COUNTERS}, **game,
        }
        rows.append(full)
    names = [part.split()[0] for part in BOX_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], BOX_SCHEMA)


PLAY_SCHEMA = (
    "Season int, Player_ID string, Gamecode bigint, NUMBEROFPLAY bigint, PERIOD int, "
    "MINUTE int, PLAYTYPE string, POINTS_A string, POINTS_B string"
)


def play_table(spark, plays):
    """Play rows from (playtype, period, minute, a, b) or just playtype, in one game."""
    rows = []
    for i, play in enumerate(plays, 1):
        kind, period, minute, a, b = play if isinstance(play, tuple) else (play, 1, 5, "10", "2")
        rows.append((2024, "P1", 1, i, period, minute, kind, a, b))
    return spark.createDataFrame(rows, PLAY_SCHEMA)


SHOT_SCHEMA = (
    "Season int, Player_ID string, Gamecode bigint, FASTBREAK string, SECOND_CHANCE string, "
    "COORD_X double, COORD_Y double, ZONE string, ID_ACTION string, ACTION string"
)


def shot_table(spark, shots):
    rows = [
        (2024, "P1", 1, *[{**{"f": "0", "s": "0", "x": 1.0, "y": 0.0, "z": "A", "a": "Two Pointer"}, **s}[k] for k in "fsxyz"], "X",
         {**{"a": "Two Pointer"}, **s}["a"])
        for s in shots
    ]
    return spark.createDataFrame(rows, SHOT_SCHEMA)
