"""Entries of a feed to contracts, as struct paths; no Python runs on the executors.

Of candidate paths the first that is present decides, blank or not; a blank value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoneda.functions.scalar import last_segment


def _text(*paths: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(*paths)), F.lit(""))


def _num(*paths: Column) -> Column:
    return _text(*paths).try_cast("double")


def _int(path: Column) -> Column:
    return _text(path).try_cast("double").cast("int")


def _flag(path: Column) -> Column:
    low = F.lower(_text(path))
    return F.when(low == "true", True).when(low == "false", False)


def _first(array: Column, of) -> Column:
    """The first element whose value is present, field by field."""
    return F.get(F.filter(F.transform(array, of), lambda x: x.isNotNull()), F.lit(0))


def _codes(project: Column) -> Column:
    return F.filter(F.transform(F.flatten(F.transform(F.coalesce(project["RequiredCommodityClassification"], F.array()), lambda c: F.coalesce(c["ItemClassificationCode"], F.array()))), lambda x: F.nullif(F.trim(x), F.lit(""))), lambda x: x.isNotNull())


def contracts(entries: DataFrame) -> DataFrame:
    """One row an entry with a status: the contract's fields, lots and lot results. Entries may say which are tombstones; these
    need no status."""
    s, dead = F.col("status"), F.col("tombstone") if "tombstone" in entries.columns else F.lit(False)
    party, project, results = s["LocatedContractingParty"], s["ProcurementProject"], F.coalesce(s["TenderResult"], F.array())
    lots = F.coalesce(s["ProcurementProjectLot"], F.array())
    parents = F.regexp_extract_all(party["ParentLocatedParty"], F.lit(r"<(?:[\w.-]+:)?PartyName\b[^>]*>\s*<(?:[\w.-]+:)?Name\b[^>]*>([^<]*)<"), F.lit(1))
    top = F.try_element_at(F.filter(F.transform(parents, lambda x: F.trim(x)), lambda x: x != ""), F.lit(-1))  # the last name is the topmost parent's
    name = lambda p: F.get(p["PartyName"], F.lit(0))["Name"]
    ident = lambda p: F.get(p["PartyIdentification"], F.lit(0))["ID"]
    of_code = lambda c, n: [_text(c["_VALUE"]).alias(f"{n}_code"), last_segment(F.coalesce(c["_listURI"], c["_listURIID"])).alias(f"{n}_list")]
    total = lambda r: r["AwardedTenderedProject"]["LegalMonetaryTotal"]
    lot = F.transform(lots, lambda x: F.struct(
        F.coalesce(_text(x["ID"]), F.lit("")).alias("lot_id"), _text(x["ProcurementProject"]["Name"]).alias("name"), _num(x["ProcurementProject"]["BudgetAmount"]["TaxExclusiveAmount"]).alias("amount"), _codes(x["ProcurementProject"]).alias("cpv"),
    ))
    result = F.transform(results, lambda r: F.struct(
        F.coalesce(_text(r["AwardedTenderedProject"]["ProcurementProjectLotID"]), F.lit("0")).alias("lot_id"), _text(name(r["WinningParty"])).alias("winner_name"), _text(ident(r["WinningParty"])).alias("winner_nif"),
        _num(total(r)["TaxExclusiveAmount"], total(r)["PayableAmount"]).alias("amount"), _text(r["AwardDate"]).alias("award_date"), _flag(r["SMEAwardedIndicator"]).alias("sme_awarded"), _int(r["ReceivedTenderQuantity"]).alias("n_bids"),
        _int(r["SMEsReceivedTenderQuantity"]).alias("n_sme_bids"), _num(r["LowerTenderAmount"]).alias("lower_tender_amount"), _num(r["HigherTenderAmount"]).alias("higher_tender_amount"),
    ))
    notices = F.coalesce(s["ValidNoticeInfo"], F.array())
    issue = lambda n: F.get(F.get(n["AdditionalPublicationStatus"], F.lit(0))["AdditionalPublicationDocumentReference"], F.lit(0))["IssueDate"]
    urls = F.flatten(F.transform(F.coalesce(s["GeneralDocument"], F.array()), lambda g: F.transform(F.coalesce(g["GeneralDocumentDocumentReference"], F.array()), lambda x: _text(x["Attachment"]["ExternalReference"]["URI"]))))
    out = entries.filter(dead | s.isNotNull()).select(
        "sid", "category", "updated", "pos", dead.alias("tombstone"), F.col("link").alias("source_url"), _text(s["ContractFolderID"]).alias("expediente"), _text(project["Name"]).alias("title"), *of_code(s["ContractFolderStatusCode"], "status"),
        *of_code(project["TypeCode"], "contract_type"), *of_code(s["TenderingProcess"]["ProcedureCode"], "procedure"), *of_code(project["RealizedLocation"]["CountrySubentityCode"], "nuts"),
        _text(_first(notices, lambda n: n["NoticeTypeCode"])).alias("notice_type"), F.concat(_codes(project), F.flatten(F.transform(lots, lambda x: _codes(x["ProcurementProject"])))).alias("cpv"),
        _text(name(party["Party"])).alias("contracting_authority"), _text(ident(party["Party"])).alias("contracting_authority_id"), _text(party["BuyerProfileURIID"]).alias("buyer_profile_url"), top.alias("org_top_level"),
        _text(party["Party"]["PostalAddress"]["CityName"]).alias("city"), _text(project["RealizedLocation"]["Address"]["Country"]["Name"], party["Party"]["PostalAddress"]["Country"]["Name"]).alias("country"),
        _text(_first(notices, issue)).alias("publication_date"), _text(s["TenderingProcess"]["TenderSubmissionDeadlinePeriod"]["EndDate"]).alias("submission_deadline"), _text(s["TenderingTerms"]["FundingProgramCode"]).alias("funding_program"),
        F.filter(urls, lambda u: u.isNotNull()).alias("document_urls"), F.array(F.struct(F.nullif(F.substring("updated", 1, 10), F.lit("")).alias("date"), _text(s["ContractFolderStatusCode"]["_VALUE"]).alias("code"))).alias("history"), _num(project["BudgetAmount"]["TaxExclusiveAmount"], project["BudgetAmount"]["TotalAmount"]).alias("budget_amount"), _num(project["BudgetAmount"]["EstimatedOverallContractAmount"]).alias("estimated_value"),
        _num(_first(results, lambda r: total(r)["TaxExclusiveAmount"]), _first(results, lambda r: total(r)["PayableAmount"])).alias("awarded_amount"), _text(_first(results, lambda r: r["ResultCode"]["_VALUE"])).alias("result_code"),
        last_segment(_first(results, lambda r: F.coalesce(r["ResultCode"]["_listURI"], r["ResultCode"]["_listURIID"]))).alias("result_list"),
        _text(_first(results, lambda r: r["AwardDate"])).alias("award_date"), _text(_first(results, lambda r: name(r["WinningParty"]))).alias("adjudicatario"), _text(_first(results, lambda r: ident(r["WinningParty"]))).alias("adjudicatario_nif"),
        _int(_first(results, lambda r: r["ReceivedTenderQuantity"])).alias("n_bids"), _flag(_first(results, lambda r: r["SMEAwardedIndicator"])).alias("sme_awarded"), lot.alias("lots"), result.alias("bare_results"),
    )
    meta = lambda r: F.try_element_at(F.filter("lots", lambda x: x["lot_id"] == r["lot_id"]), F.lit(-1))  # noqa: E731  the last lot of that id
    full = F.transform("bare_results", lambda r: F.struct(*[r[c].alias(c) for c in ("lot_id", "winner_name", "winner_nif", "amount", "award_date", "sme_awarded", "n_bids", "n_sme_bids", "lower_tender_amount", "higher_tender_amount")], meta(r)["name"].alias("name"), meta(r)["cpv"].alias("cpv")))
    return out.withColumn("lot_results", full).drop("bare_results").withColumn("lang", F.lit("es"))


def decode(df: DataFrame, codelists: DataFrame, field: str) -> DataFrame:
    """df with `<field>_label`: the code's label in its list, else the code."""
    names = codelists.select(F.col("list_file").alias(f"{field}_list"), F.col("code").alias(f"{field}_code"), F.col("label").alias("__label"))
    out = df.join(names, [f"{field}_list", f"{field}_code"], "left")
    return out.withColumn(f"{field}_label", F.coalesce("__label", f"{field}_code")).drop("__label")


def awards(contracts_df: DataFrame) -> DataFrame:
    """Lots won, as the award graph takes them: numbers normalized, in order of writing."""
    from almoneda.functions.scalar import normalize_nif

    x = contracts_df.select("sid", F.struct("updated", "pos").alias("at"), F.posexplode("lot_results").alias("i", "r"))
    return x.select("sid", "r.lot_id", normalize_nif("r.winner_nif").alias("nif"), F.col("r.winner_name").alias("name"), F.coalesce("r.amount", F.lit(0.0)).alias("amount"), "r.award_date", F.struct("at", "i").alias("seq"))
