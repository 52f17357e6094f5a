"""Users' saved items, feedback and tokens as folds over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_write(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    cols = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("v")).select(*keys, "v.*")


def last_write(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("v")).select(*keys, "v.*")


def saved_state(log: DataFrame) -> DataFrame:
    """(user_id, item_id, active, saved_at, removed_at, title) from a log (user_id, item_id, action, ts, title).

    A save of an item reactivates it and renews saved_at; its title is the last that isn't null. A removal holds only if
    the item was active. Items that were only ever removed have no state.
    """
    save = F.col("action") == "save"
    by_item = log.groupBy("user_id", "item_id").agg(F.max(F.when(save, F.col("ts"))).alias("saved_at"), F.max_by("title", F.when(save & F.col("title").isNotNull(), F.col("ts"))).alias("title"))
    later = log.filter(~save).join(by_item.select("user_id", "item_id", "saved_at"), ["user_id", "item_id"]).filter("ts > saved_at").groupBy("user_id", "item_id").agg(F.min("ts").alias("removed_at"))
    out = by_item.filter("saved_at IS NOT NULL").join(later, ["user_id", "item_id"], "left")
    return out.select("user_id", "item_id", F.col("removed_at").isNull().alias("active"), "saved_at", "removed_at", "title")


def saved_page(state: DataFrame, user_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """A user's active items, newest first."""
    mine = state.filter((F.col("user_id") == user_id) & F.col("active"))
    return mine.orderBy(F.desc("saved_at"), "item_id").offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def valid_tokens(tokens: DataFrame, now: str) -> DataFrame:
    return tokens.filter(F.col("expires_at") > F.lit(now).cast("timestamp"))


def snapshot_position(shown: Column, liked: Column) -> Column:
    """The entry (id, rank, score) of a result list with a liked id: the first, or null."""
    return F.get(F.filter(shown, lambda r: r["id"] == liked), F.lit(0))


def add_user(users: DataFrame, new: DataFrame) -> DataFrame:
    """users with the new ones; an e-mail counts lowered and trimmed, and one that is taken raises ValueError."""
    key = F.lower(F.trim("email"))
    new = new.withColumn("email", key)
    if not new.join(users.select(key.alias("email")), "email", "left_semi").isEmpty() or not new.groupBy("email").count().filter("count > 1").isEmpty():
        raise ValueError("an e-mail is taken")
    return users.unionByName(new)


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.lower(F.trim("email")) == email.strip().lower())


def latest_per_user(log: DataFrame, order: str = "ts") -> DataFrame:
    """Each user's last row, ranked in a window; ties by event id."""
    w = Window.partitionBy("user_id").orderBy(F.desc(order), F.desc("event_id"))
    return log.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def append_events(events: DataFrame, path: str) -> None:
    """Adds events (user_id, event_type, item_id, context, ts) to a log that is only ever added to, a folder a day.

    The context goes in as JSON, null if there is none; a null ts is now.
    """
    ts = F.coalesce("ts", F.current_timestamp())
    out = events.select("user_id", "event_type", "item_id", F.to_json("context").alias("context_json"), ts.alias("ts"), F.to_date(ts).alias("day"))
    out.write.mode("append").partitionBy("day").parquet(path)
