"""Readers of filings: company facts, filing lists, holdings and ownership forms."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.functions import text as X

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Raw JSON documents of the landing zone, one for each file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def company_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Facts as rows: ``cik, taxonomy, tag, unit, unit_pos, pos`` and the point.

    Three maps are exploded in turn; positions keep the order of the document,
    which later ties refer to.  A document is read whole by one task, so a
    company of very many points comes in several, numbered by ``page``: their
    points follow each other, and each names all units of its tags in the same
    order, without points where it has none.
    """
    raw = read_json(spark, path, schemas.COMPANY_FACTS)
    return facts_rows(raw)


def facts_rows(raw: DataFrame) -> DataFrame:
    pos = F.coalesce("page", F.lit(0)) * (1 << 32) + F.col("pos")
    return (
        raw.select("cik", "page", F.explode("facts").alias("taxonomy", "_tags"))
        .select("cik", "page", "taxonomy", F.explode("_tags").alias("tag", "_node"))
        .select("cik", "page", "taxonomy", "tag", F.posexplode("_node.units").alias("unit_pos", "unit", "_points"))
        .select("cik", "page", "taxonomy", "tag", "unit", "unit_pos", F.posexplode("_points").alias("pos", "_p"))
        .select("cik", "taxonomy", "tag", "unit", "unit_pos", pos.alias("pos"), F.to_date("_p.start").alias("start"), F.to_date("_p.end").alias("end"), F.col("_p.val").alias("value"), "_p.form", "_p.accn")
    )


def filings(submissions: DataFrame) -> DataFrame:
    """The parallel arrays of a filing list as rows, newest first by ``pos``."""
    r = "filings.recent."
    zipped = F.arrays_zip(*(F.col(r + c).alias(c) for c in ("accessionNumber", "form", "filingDate", "primaryDocument", "reportDate")))
    return submissions.select(F.col("cik").cast("long").alias("cik"), F.posexplode(zipped).alias("pos", "_f")).select(
        "cik", "pos", F.col("_f.accessionNumber").alias("accession"), F.col("_f.form").alias("form"), F.col("_f.filingDate").alias("date"),
        F.col("_f.primaryDocument").alias("document"), F.col("_f.reportDate").alias("report_date"),
    )


def tracked_filings(submissions: DataFrame, forms: list[str]) -> DataFrame:
    """Filings of the given forms with their page and XML addresses."""
    base = F.concat_ws("/", F.lit(ARCHIVE), F.col("cik").cast("string"), F.replace("accession", F.lit("-"), F.lit("")))
    return filings(submissions).where(F.col("form").isin(forms)).withColumns({
        "view_url": F.concat_ws("/", base, "document"),
        "xml_url": F.concat_ws("/", base, F.element_at(F.split("document", "/"), -1)),
    })


def latest_filing(submissions: DataFrame, form: str) -> DataFrame:
    """For each company its first filing of a form, lists being newest first."""
    mine = filings(submissions).where(F.col("form") == form)
    return mine.groupBy("cik").agg(F.min_by(F.struct(*[c for c in mine.columns if c != "cik"]), "pos").alias("_f")).select("cik", "_f.*")


def unzip(archive: str | Path, target: str | Path) -> None:
    """Members of a bulk archive as files, which Spark can split and read."""
    with zipfile.ZipFile(archive) as z:
        z.extractall(target)


def read_tsv(spark: SparkSession, path: str, pos: str | None = None) -> DataFrame:
    """A tab-separated file without quoting, its first line the header.  Lines
    with fewer cells than the header are left out; further cells of longer lines
    are ignored.  ``pos`` names a column for the place of each line, which
    orders the lines as they are in the file."""
    lines = spark.read.text(path)
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "value string")
    names = head[0].rstrip("\r").split("\t")
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    # Within a block lines are numbered as they are read.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    placed = lines.select("value", place.alias("_at"))
    first = (F.col("_at.block") == 0) & (F.col("_at.line").bitwiseAND(F.lit((1 << 33) - 1)) == 0) & (F.col("value") == head[0])
    cells = placed.where(~first).select(parts.alias("_p"), "_at").where(F.size("_p") >= len(names))
    return cells.select(*(F.col("_p")[i].alias(n) for i, n in enumerate(names)), *([F.col("_at").alias(pos)] if pos else []))


def information_table_file(files: DataFrame) -> DataFrame:
    """Of the XML files of a filing (``filing, pos, name, content``) the first
    that isn't the cover and holds an information table."""
    name = F.lower("name")
    fit = files.where(F.endswith(name, F.lit(".xml")) & ~F.contains(name, F.lit("primary_doc")) & F.contains(F.col("content").cast("string"), F.lit("infoTable")))
    return fit.groupBy("filing").agg(F.min_by("name", "pos").alias("name"))


def information_table(spark: SparkSession, path: str, period: str | None = None) -> DataFrame:
    """Positions of information table files.

    Name spaces are ignored, missing and blank numbers are 0, malformed ones
    fail.  Before 2023 values were reported in thousands.
    """
    raw = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", "true").schema(schemas.INFO_TABLE).load(path)
    return positions(raw, F.lit(period))


def positions(raw: DataFrame, period: Column) -> DataFrame:
    number = lambda c: F.coalesce(X.blank_to_null(F.trim(c)), F.lit("0")).cast("double")
    value = number(F.col("value"))
    return raw.select(
        F.coalesce(F.trim("nameOfIssuer"), F.lit("")).alias("issuer"), F.coalesce(F.trim("cusip"), F.lit("")).alias("cusip"),
        F.when(period < "2023-01-01", value * 1000).otherwise(value).alias("value"), number(F.col("shrsOrPrnAmt.sshPrnamt")).alias("shares"),
        F.coalesce(F.trim("putCall"), F.lit("")).alias("put_call"),
    )


def ownership(forms: DataFrame, xml: str = "xml", footnotes: bool = True, en_dash: bool = True) -> DataFrame:
    """Ownership forms parsed by schema.

    A form that can't be read has a null owner and no transactions, and the
    text in ``_corrupt_record``; the row stays.  The switches give the older
    readings of a 10b5-1 plan: without en dashes, or by the flag alone.
    """
    doc = F.from_xml(F.col(xml), schemas.FORM4, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    first = F.try_element_at(F.col("_d.reportingOwner"), F.lit(1))
    rel = first["reportingOwnerRelationship"]
    notes = F.coalesce(F.col("_d.footnotes.footnote"), F.array().cast("array<string>")) if footnotes else F.array().cast("array<string>")
    plan = X.is_plan_sale(F.col("_d.aff10b5One"), notes if en_dash else F.transform(notes, lambda n: F.replace(n, F.lit("–"), F.lit("?"))))
    lots = F.coalesce(F.col("_d.nonDerivativeTable.nonDerivativeTransaction"), F.array().cast("array<struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:string>>>>"))
    num = lambda c: F.trim(c).try_cast("double")
    lot = lambda t: F.struct(
        F.trim(t["transactionDate"]["value"]).alias("date"), F.trim(t["transactionCoding"]["transactionCode"]).alias("code"),
        F.trim(t["transactionAmounts"]["transactionAcquiredDisposedCode"]["value"]).alias("acq_disp"),
        num(t["transactionAmounts"]["transactionShares"]["value"]).alias("shares"), num(t["transactionAmounts"]["transactionPricePerShare"]["value"]).alias("price"),
        num(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"]).alias("after"),
    )
    return forms.withColumn("_d", doc).withColumns({
        "owner": F.coalesce(X.blank_to_null(F.trim(first["reportingOwnerId"]["rptOwnerName"])), F.lit("?")),
        "roles": X.roles(rel["isDirector"], rel["isOfficer"], rel["officerTitle"], rel["isTenPercentOwner"], rel["isOther"], rel["otherText"]),
        "has_plan": plan, "lots": F.transform(lots, lot), "malformed": F.col("_d._corrupt_record").isNotNull(),
    }).drop("_d")
