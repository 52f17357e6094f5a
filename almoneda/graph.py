"""The award graph as node and edge tables, and its four questions.

Awards (sid, lot_id, nif, name, amount, award_date, seq) are lots won; seq orders writes, the last of a key wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almoneda.functions import scalar as S


def _last(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of the row of greatest order for each key; summed before the shuffle."""
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"))
    return got.select(*keys, "v.*")


def company_nodes(awards: DataFrame) -> DataFrame:
    """(nif, is_ute): joint venture if any contract's first lot of the company says so."""
    first = awards.filter("nif IS NOT NULL").groupBy("sid", "nif").agg(F.min_by(S.is_ute("name", "nif"), F.struct("seq", "lot_id")).alias("ute"))
    return first.groupBy("nif").agg(F.bool_or("ute").alias("is_ute"))


def contract_nodes(contracts: DataFrame, awards: DataFrame) -> DataFrame:
    """Contracts with at least one lot won by a known company."""
    return contracts.join(awards.filter("nif IS NOT NULL").select("sid"), "sid", "left_semi")


def lot_nodes(awards: DataFrame) -> DataFrame:
    """(lot_key, sid, amount): lots of such contracts, the last write of each."""
    won = awards.filter("nif IS NOT NULL").withColumn("lot_key", F.concat_ws(":", "sid", "lot_id"))
    return _last(won, ["lot_key"], "seq", ["sid", "amount"])


def won_edges(awards: DataFrame) -> DataFrame:
    """(nif, lot_key, amount, award_date, name_norm, name_display), the last write of each pair."""
    won = awards.filter("nif IS NOT NULL").select("nif", F.concat_ws(":", "sid", "lot_id").alias("lot_key"), "amount", "award_date", "name", "seq")
    last = _last(won, ["nif", "lot_key"], "seq", ["amount", "award_date", "name"])
    return last.select("nif", "lot_key", "amount", "award_date", S.normalize_name("name").alias("name_norm"), F.col("name").alias("name_display"))


def canonical_names(won: DataFrame) -> DataFrame:
    """(nif, name): a display name of the company's most frequent normalized name, the least of equals."""
    counts = won.groupBy("nif", "name_norm").agg(F.count("*").alias("n"), F.min("name_display").alias("name"))
    return counts.groupBy("nif").agg(F.min_by("name", F.struct(-F.col("n"), "name_norm")).alias("name"))


def drop_contracts(sids: DataFrame, contracts: DataFrame, lots: DataFrame, won: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts, lots and won edges without the tombstoned contracts; companies stay."""
    lots_left = lots.join(sids, "sid", "left_anti")
    return contracts.join(sids, "sid", "left_anti"), lots_left, won.join(lots_left.select("lot_key"), "lot_key", "left_semi")


def company_profile(nif: str, won: DataFrame, lots: DataFrame, classified: DataFrame, tendered: DataFrame, fanout: bool = False) -> DataFrame:
    """One row: contracts, lots, amount, distinct codes and authorities of a company.

    fanout sums the amount over every (code, authority) of a lot, as a plain chain of optional matches would.
    """
    mine = won.filter(F.col("nif") == nif).join(lots.select("lot_key", "sid"), "lot_key")
    fan = mine.join(classified, "lot_key", "left").join(tendered, "sid", "left")
    counts = fan.agg(F.countDistinct("sid").alias("n_contracts"), F.countDistinct("lot_key").alias("n_lots"), F.countDistinct("cpv").alias("n_cpv"), F.countDistinct("authority").alias("n_authorities"))
    amount = (fan if fanout else mine).agg(F.round(F.sum("amount"), 2).alias("total_amount"))
    return counts.crossJoin(F.broadcast(amount))  # one row each


def company_contracts(nif: str, won: DataFrame, lots: DataFrame, contracts: DataFrame, tendered: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Lots won by a company with their contract and authority, newest first, undated ones before all."""
    mine = won.filter(F.col("nif") == nif).join(lots.select("lot_key", "sid"), "lot_key").join(contracts, "sid").join(tendered, "sid", "left")
    return mine.orderBy(F.col("award_date").desc_nulls_first(), "lot_key", "authority").offset(offset).limit(limit)


def contract_neighborhood(sid: str, contracts: DataFrame, lots: DataFrame, won: DataFrame, classified: DataFrame, tendered: DataFrame, located: DataFrame) -> DataFrame:
    """One row a lot: authority, region, winner and codes around a contract."""
    base = contracts.filter(F.col("sid") == sid).select("sid").join(tendered, "sid", "left").join(located, "sid", "left")
    around = lots.filter(F.col("sid") == sid).select("lot_key", "sid")
    codes = classified.join(around.select("lot_key"), "lot_key", "left_semi").groupBy("lot_key").agg(F.array_join(F.sort_array(F.collect_set("cpv")), ",").alias("cpvs"))
    winners = won.join(around.select("lot_key"), "lot_key", "left_semi").groupBy("lot_key").agg(F.array_join(F.sort_array(F.collect_set("nif")), ",").alias("winners"))
    return base.join(around, "sid").join(codes, "lot_key", "left").join(winners, "lot_key", "left").select("sid", "authority", "nuts", "lot_key", "winners", "cpvs")


def similar_companies(nif: str, won: DataFrame, classified: DataFrame, limit: int = 10) -> DataFrame:
    """(nif, shared_lots, shared_cpvs): other companies by distinct lots won under the company's codes.

    A code counts if it has at least two lots, which stands for a third lot beside the two; the lots themselves are
    never paired.
    """
    codes = won.filter(F.col("nif") == nif).select("lot_key").join(classified, "lot_key").select("cpv").distinct()
    busy = classified.join(codes, "cpv", "left_semi").groupBy("cpv").agg(F.countDistinct("lot_key").alias("n")).filter("n >= 2").select("cpv")
    theirs = classified.join(busy, "cpv", "left_semi").join(won.filter(F.col("nif") != nif).select("nif", "lot_key"), "lot_key")
    return theirs.groupBy("nif").agg(F.countDistinct("lot_key").alias("shared_lots"), F.countDistinct("cpv").alias("shared_cpvs")).orderBy(F.desc("shared_lots"), "nif").limit(limit)


#: Tables of a batch of graph writes.
TABLES = ("companies", "contracts", "lots", "won", "authorities", "tendered", "classified", "located")


def merge_batches(batches: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Batches of graph tables as one, table by table; a batch without won edges adds nothing."""
    held = [b for b in batches if "won" in b and not b["won"].isEmpty()]
    return {t: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for t in TABLES if (parts := [b[t] for b in held if t in b])}


#: Keys that no two nodes share.
UNIQUE = {"companies": ["nif"], "contracts": ["sid"], "lots": ["lot_key"], "authorities": ["authority"], "classified": ["lot_key", "cpv"], "located": ["sid", "nuts"]}


def check_unique(tables: dict[str, DataFrame]) -> None:
    """Raises ValueError if two rows of a table share its key."""
    for name, df in tables.items():
        if name in UNIQUE and not df.groupBy(*UNIQUE[name]).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"{name}: a key occurs twice")
