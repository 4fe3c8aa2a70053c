"""Game-log tables derived from generic order, line-item and event tables.

An order stands for a player-game, its line items for shots and box-score counts,
its events for plays. Used by the registered queries, the bench and the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.operators.spread import spread

SOURCES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def read_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _together(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column) -> DataFrame:
    """The two tables joined, in as many tasks as the rows of ``left`` need."""
    rows = left.count()
    return spread(left, [left_key], rows).join(spread(right, [right_key], rows), left_key == right_key)


def _season() -> Column:
    second = F.col("o_orderdate") >= F.lit("1998-04-15 00:00:00").cast("timestamp")
    return F.when(second, 2024).otherwise(2023)


def _player() -> Column:
    return F.floor(F.col("o_custkey") / 10).cast("string")


def _counts(lineitem: DataFrame) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    made = status == "F"
    counts = {
        "FieldGoalsMade2": (flag == "A") & made,
        "FieldGoalsAttempted2": flag == "A",
        "FieldGoalsMade3": (flag == "R") & made,
        "FieldGoalsAttempted3": flag == "R",
        "FreeThrowsMade": (flag == "N") & made,
        "FreeThrowsAttempted": flag == "N",
        "OffensiveRebounds": F.col("l_quantity") > 40,
        "DefensiveRebounds": F.col("l_quantity") <= 20,
        "Assistances": F.col("l_discount") > 0.075,
        "Steals": F.col("l_discount") < 0.015,
        "Turnovers": F.col("l_tax") > 0.065,
        "BlocksFavour": F.col("l_tax") < 0.015,
        "BlocksAgainst": F.col("l_linenumber") == 1,
        "FoulsCommited": F.col("l_linenumber") >= 5,
        "FoulsReceived": F.col("l_linenumber") == 2,
    }
    return lineitem.groupBy("l_orderkey").agg(
        *[F.count_if(condition).alias(name) for name, condition in counts.items()]
    )


def player_stats(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_source(spark, folder, "lineitem")
    rows = lineitem.count()
    counts = _counts(spread(lineitem, ["l_orderkey"], rows))
    names = [c for c in counts.columns if c != "l_orderkey"]
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    points = (
        2 * F.col("FieldGoalsMade2") + 3 * F.col("FieldGoalsMade3") + F.col("FreeThrowsMade")
    )
    clock = F.concat(
        (key % 40).cast("string"), F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0")
    )
    team = (F.floor(F.col("o_custkey") / 10) % 18).cast("string")
    return (
        spread(read_source(spark, folder, "orders"), ["o_orderkey"], rows)
        .join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            _season().alias("Season"),
            F.lit("RS").alias("Phase"),
            ((F.year(day) - 1995) * 53 + F.floor(F.dayofyear(day) / 7)).cast("int").alias("Round"),
            key.alias("Gamecode"),
            F.when(key % 50 == 0, "Total").otherwise(_player()).alias("Player_ID"),
            F.concat(F.lit("Player "), _player()).alias("Player"),
            F.concat(F.lit("Team "), team).alias("Team"),
            (key % 2).cast("int").alias("IsStarter"),
            (F.floor(key / 2) % 2).cast("int").alias("Home"),
            F.when(key % 17 == 0, "DNP")
            .when(key % 19 == 0, "")
            .when(key % 23 == 0, F.lit(None).cast("string"))
            .otherwise(clock)
            .alias("Minutes"),
            points.alias("Points"),
            *names,
        )
    )


def shot_data(spark: SparkSession, folder: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    action = (
        F.when((flag == "A") & (status == "F"), "Two Pointer")
        .when(flag == "A", "Missed Two Pointer")
        .when((flag == "R") & (status == "F"), "Three Pointer")
        .when(flag == "R", "Missed Three Pointer")
        .otherwise("Free Throw In")
    )
    zone = F.round(F.col("l_tax") * 100).cast("int").cast("string")
    return (
        _together(read_source(spark, folder, "lineitem"), F.col("l_orderkey"), read_source(spark, folder, "orders"), F.col("o_orderkey"))
        .select(
            _season().alias("Season"),
            _player().alias("ID_PLAYER"),
            F.col("l_orderkey").alias("Gamecode"),
            F.when(F.col("l_linenumber") == 1, "1").otherwise("0").alias("FASTBREAK"),
            F.when(F.col("l_linenumber") == 2, "1").otherwise("0").alias("SECOND_CHANCE"),
            ((F.col("l_quantity") - 25) / 5).alias("COORD_X"),
            (F.col("l_discount") * 100).alias("COORD_Y"),
            F.when(F.col("l_tax") != 0, zone).alias("ZONE"),
            F.concat(flag, status).alias("ID_ACTION"),
            action.alias("ACTION"),
        )
    )


def playbyplay(spark: SparkSession, folder: str) -> DataFrame:
    event, ts = F.col("event_id"), F.col("ts")

    def one_of(*values: str | None) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (event % 3 + 1).cast("int"))

    kind = F.col("event_type")
    play = (
        F.when(kind == "purchase", one_of("2FGM", "3FGM", "FTM"))
        .when(kind == "view", one_of("2FGA", "3FGA", "FTA"))
        .when(kind == "click", one_of("AS", "D", "O"))
        .when(kind == "error", one_of("TO", "CM", None))
        .otherwise(one_of("ST", "BLK", "RV"))
    )
    own = F.floor(F.col("value") / 4).cast("int").cast("string")
    return (
        _together(read_source(spark, folder, "events"), F.floor(event / 8).cast("bigint"), read_source(spark, folder, "orders"), F.col("o_orderkey"))
        .select(
            _season().alias("Season"),
            _player().alias("PLAYER_ID"),
            F.col("o_orderkey").alias("Gamecode"),
            event.alias("NUMBEROFPLAY"),
            (F.floor(F.hour(ts) / 6).cast("int") + 1).alias("PERIOD"),
            (F.floor((F.hour(ts) * 60 + F.minute(ts)) / 36).cast("int") + 1).alias("MINUTE"),
            play.alias("PLAYTYPE"),
            F.when(event % 5 != 0, own).alias("POINTS_A"),
            F.regexp_extract("props", "([0-9]+)", 1).alias("POINTS_B"),
        )
    )


def game_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "player_stats": player_stats(spark, folder),
        "shot_data": shot_data(spark, folder),
        "playbyplay": playbyplay(spark, folder),
    }
