"""Schemas of the raw inputs."""

from __future__ import annotations

_POINT = "struct<start:string,end:string,val:double,form:string,accn:string>"
#: Company facts: taxonomy, tag, unit, points; ``page`` numbers the documents of a company that has several.
COMPANY_FACTS = f"cik long, entityName string, page long, facts map<string,map<string,struct<label:string,units:map<string,array<{_POINT}>>>>>"
SUBMISSIONS = (
    "cik string, name string, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,"
    "primaryDocument:array<string>,reportDate:array<string>>>"
)
COMPANIES = "ticker string, cik long, name string, fiscal_year_end string, sector string, history_note string, xbrl_taxonomy string"
FIELDS = "key string, label string, statement string, unit string, period_type string, us_gaap_tags array<string>, dimensional boolean"
INFO_TABLE = "nameOfIssuer string, titleOfClass string, cusip string, value string, shrsOrPrnAmt struct<sshPrnamt:string,sshPrnamtType:string>, putCall string"
_V = "struct<value:string>"
FORM4 = (
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,"
    "officerTitle:string,isTenPercentOwner:string,isOther:string,otherText:string>>>, footnotes struct<footnote:array<string>>, aff10b5One string, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:{_V},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_V},transactionPricePerShare:{_V},transactionAcquiredDisposedCode:{_V}>,"
    f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_V}>>>>, _corrupt_record string"
)
MARKET = (
    "ticker string, as_of string, info map<string,string>, price_targets struct<mean:double,high:double,low:double>, "
    "earnings_estimate array<struct<period:string,avg:double,growth:double>>, "
    "recommendations array<struct<strongBuy:long,buy:long,hold:long,sell:long,strongSell:long>>"
)
NEWS = "source string, uid string, tickers array<string>, title string, summary string, url string, published long"
VERDICT = "n int, relevant boolean, materiality int, direction string, why string, event string"
FACTS_LONG = (
    "ticker string, cik long, fiscal_year int, fiscal_period string, period string, field_key string, label string, statement string, value double, "
    "unit string, period_start date, period_end date, form string, accession string, xbrl_tag string"
)
