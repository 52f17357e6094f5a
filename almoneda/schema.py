"""Schemas of feed entries. Every leaf is a string: inference would turn the code 03110000 into a number.

The chain of parents nests without bound, so it is read as the text of its XML.
"""

from __future__ import annotations

_CODE = "struct<_VALUE:string,_listURI:string,_listURIID:string>"
_ID = "array<struct<ID:string>>"
_NAME = "array<struct<Name:string>>"
_CPV = "array<struct<ItemClassificationCode:array<string>>>"


_BUDGET = "struct<EstimatedOverallContractAmount:string,TotalAmount:string,TaxExclusiveAmount:string>"
_PROJECT = f"struct<Name:string,TypeCode:{_CODE},BudgetAmount:{_BUDGET},RequiredCommodityClassification:{_CPV},RealizedLocation:struct<CountrySubentityCode:{_CODE},Address:struct<Country:struct<Name:string>>>>"
_REFERENCE = "array<struct<GeneralDocumentDocumentReference:array<struct<Attachment:struct<ExternalReference:struct<URI:string>>>>>>"
STATUS = (
    f"struct<ContractFolderID:string,ContractFolderStatusCode:{_CODE},"
    f"LocatedContractingParty:struct<BuyerProfileURIID:string,Party:struct<PartyIdentification:{_ID},PartyName:{_NAME},PostalAddress:struct<CityName:string,Country:struct<Name:string>>>,ParentLocatedParty:string>,"
    f"ProcurementProject:{_PROJECT},"
    f"ProcurementProjectLot:array<struct<ID:string,ProcurementProject:{_PROJECT}>>,"
    f"TenderResult:array<struct<ResultCode:{_CODE},AwardDate:string,ReceivedTenderQuantity:string,SMEsReceivedTenderQuantity:string,SMEAwardedIndicator:string,LowerTenderAmount:string,HigherTenderAmount:string,"
    f"WinningParty:struct<PartyIdentification:{_ID},PartyName:{_NAME}>,AwardedTenderedProject:struct<ProcurementProjectLotID:string,LegalMonetaryTotal:struct<TaxExclusiveAmount:string,PayableAmount:string>>>>,"
    f"TenderingTerms:struct<FundingProgramCode:string>,TenderingProcess:struct<ProcedureCode:{_CODE},TenderSubmissionDeadlinePeriod:struct<EndDate:string>>,"
    f"ValidNoticeInfo:array<struct<NoticeTypeCode:string,AdditionalPublicationStatus:array<struct<AdditionalPublicationDocumentReference:array<struct<IssueDate:string>>>>>>,"
    f"GeneralDocument:{_REFERENCE}>"
)
ENTRY = f"id string, updated string, link array<struct<_href:string,_rel:string>>, ContractFolderStatus {STATUS}"
ENTRY_STRUCT = f"struct<id:string,updated:string,link:array<struct<_href:string,_rel:string>>,ContractFolderStatus:{STATUS}>"
TOMBSTONE = "_ref string, _when string, comment struct<_type:string>"
CODELIST_ROW = "Value array<struct<_ColumnRef:string,SimpleValue:string>>"
