"""Home games of the tracked clubs from an archive of scoreboard polls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.times import instant, parse_iso

# Key, league, name, abbreviation, keyword, typical length in minutes.
CLUBS = [
    ("avalanche", "NHL", "Colorado Avalanche", "COL", "avalanche", 150),
    ("nuggets", "NBA", "Denver Nuggets", "DEN", "nuggets", 145),
    ("rockies", "MLB", "Colorado Rockies", "COL", "rockies", 180),
    ("broncos", "NFL", "Denver Broncos", "DEN", "broncos", 195),
    ("rapids", "MLS", "Colorado Rapids", "COL", "rapids", 115),
    ("summit", "NWSL", "Denver Summit FC", "DEN", "summit", 115),
]
POST_WINDOW_MINUTES = 120


def clubs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CLUBS,
        "team_key string, league string, club_name string, club_abbr string, keyword string,"
        " typical_minutes int",
    )


def poll_events(polls: DataFrame) -> DataFrame:
    """All events of all polls; inside one poll the last copy of an event id counts."""
    order = F.struct("day_order", "place")
    rows = polls.select("poll_time", "league", "day_order", F.posexplode("events").alias("place", "event"))
    return (
        rows.groupBy("poll_time", "league", F.coalesce("event.id", F.lit("None")).alias("event_key"))
        .agg(F.max_by("event", order).alias("event"))
        .select("poll_time", "league", "event")
    )


def _side(name: str) -> Column:
    return F.try_element_at(
        F.filter(F.col("game.competitors"), lambda c: c["homeAway"] == name), F.lit(1)
    )


def _text(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def home_games(events: DataFrame, club_table: DataFrame) -> DataFrame:
    """One row per poll and home game of a club, with state, scores and result.

    A club matches when its keyword occurs in any of the home team's names; the
    club table is a fixed list, matched within its league.
    """
    rows = (
        events.withColumn("game", F.try_element_at("event.competitions", F.lit(1)))
        .withColumn("home", _side("home"))
        .withColumn("away", _side("away"))
        .filter(F.col("home").isNotNull() & F.col("away").isNotNull())
    )
    names = F.lower(F.concat_ws(" ", *[
        F.col(f"home.team.{f}") for f in ("displayName", "shortDisplayName", "name", "location", "nickname")
    ]))
    rows = rows.withColumn("_names", names).join(club_table, "league").filter(
        F.col("_names").contains(F.col("keyword"))
    )
    kind = F.coalesce("game.status.type", "event.status.type")
    state = F.lower(kind["state"])
    start = parse_iso(F.coalesce("game.date", "event.date"))
    ours, theirs = (F.col(f"{side}.score").try_cast("int") for side in ("home", "away"))
    result = (
        F.when(F.col("home.winner"), "win")
        .when(F.col("away.winner"), "loss")
        .when(ours > theirs, "win")
        .when(ours < theirs, "loss")
        .when(ours == theirs, "draw")
    )
    out = rows.select(
        "poll_time",
        F.coalesce("event.id", "game.id", F.date_format(start, "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("event_id"),
        "league", "team_key", "typical_minutes",
        F.coalesce(_text("home.team.abbreviation"), F.col("club_abbr")).alias("team_abbr"),
        F.coalesce(_text("home.team.shortDisplayName", "home.team.displayName"), F.col("club_name")).alias("team_name"),
        F.coalesce(_text("away.team.abbreviation"), F.lit("OPP")).alias("opponent_abbr"),
        F.coalesce(_text("away.team.shortDisplayName", "away.team.displayName"), F.lit("Opponent")).alias("opponent_name"),
        F.when(state.isin("pre", "in", "post"), state).otherwise("pre").alias("state"),
        start.alias("start"),
        F.coalesce(*[F.nullif(F.trim(kind[f]), F.lit("")) for f in ("shortDetail", "detail", "description")], F.lit("")).alias("detail"),
        ours.alias("team_score"), theirs.alias("opponent_score"),
        _text("game.venue.fullName").alias("venue"),
        result.alias("result"),
    ).filter(F.col("start").isNotNull())
    return out.withColumn("result", F.when(F.col("state") == "post", F.col("result")))


def with_end_times(games: DataFrame) -> DataFrame:
    """Add the end of finished games to every poll row.

    The first poll that shows a game finished dates its end, but only when an
    earlier poll showed it live; otherwise start plus the club's typical length.
    """
    finals = games.groupBy("event_id").agg(
        F.min(F.when(F.col("state") == "in", F.col("poll_time"))).alias("first_live")
    )
    ended = (
        games.filter(F.col("state") == "post")
        .join(finals, "event_id")
        .filter(F.col("first_live") < F.col("poll_time"))
        .groupBy("event_id")
        .agg(F.min("poll_time").alias("seen_final"))
    )
    typical = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("typical_minutes"), F.lit(0))
    seen = F.when(F.col("seen_final") <= F.col("poll_time"), F.col("seen_final"))
    return (
        games.join(ended, "event_id", "left")
        .withColumn("end", F.when(F.col("state") == "post", F.coalesce(seen, typical)))
        .drop("seen_final")
    )


def board_at(games: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Games of the newest poll per league, finished ones for two hours, live ones
    first, then upcoming, then the latest finished."""
    rows = games if now is None else games.filter(F.col("poll_time") <= instant(now))
    newest = rows.groupBy("league").agg(F.max("poll_time").alias("poll_time"))
    shown = rows.join(newest, ["league", "poll_time"])
    moment = F.col("poll_time") if now is None else instant(now)
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(POST_WINDOW_MINUTES), F.lit(0))
    shown = shown.filter((F.col("state") != "post") | (moment <= F.col("end") + limit))
    rank = F.when(F.col("state") == "in", 0).when(F.col("state") == "pre", 1).otherwise(2)
    return shown.orderBy(
        rank,
        F.when(F.col("state") != "post", F.col("start")).asc_nulls_last(),
        F.col("end").desc_nulls_last(),
        "event_id",
    )


def games_history(polls: DataFrame) -> DataFrame:
    """Last known state of every home game in the archive."""
    games = with_end_times(home_games(poll_events(polls), clubs(polls.sparkSession)))
    rest = [c for c in games.columns if c != "event_id"]
    return games.groupBy("event_id").agg(F.max_by(F.struct(*rest), "poll_time").alias("r")).select(
        "event_id", "r.*"
    )
