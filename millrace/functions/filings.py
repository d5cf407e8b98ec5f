"""Columns derived from filing metadata. Dates are ISO strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms, their order of weight, and what marks an earnings release.
ANNUAL_FORMS = ("10-K", "10-K405", "10-KSB", "10-KT")
QUARTERLY_FORMS = ("10-Q", "10-QSB", "10-QT")
EARLY_FILED_FORMS = ("10-K", "10-K405", "10-KSB")
FORM_PRIORITY = {"10-K": 1, "10-K405": 1, "10-KSB": 1, "10-Q": 2, "8-K": 3}
TARGET_FORMS = ("10-K", "10-K405", "10-KSB", "10-Q", "8-K")
EARNINGS_ITEMS = ("2.02", "7.01", "8.01")
EARNINGS_WORDS = ("earnings", "result", "revenue", "financial", "quarter", "annual", "q1", "q2", "q3", "q4", "fy", "release")
EXHIBIT_TYPES = ("EX-99.1", "EX-99.2", "EX-99", "EX-13", "EX-10.1")


def report_priority(form: Column) -> Column:
    """1 for annual, 2 for quarterly, 3 for event reports, else 9."""
    found = F.lit(9)
    for name, rank in FORM_PRIORITY.items():
        found = F.when(F.upper(form) == name, rank).otherwise(found)
    return found


def period_type(form: Column) -> Column:
    return F.when(F.upper(form).isin(*ANNUAL_FORMS), "annual").when(F.upper(form).isin(*QUARTERLY_FORMS), "quarterly").otherwise("event")


def iso_date(text: Column) -> Column:
    """The date of the first ten characters, null if they aren't one."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def fiscal_year(period_end: Column, filed: Column, form: Column) -> Column:
    """The year of the period's end, else of filing; annual reports filed up to June belong to the year before."""
    day = iso_date(filed)
    early = F.upper(form).isin(*EARLY_FILED_FORMS) & (F.month(day) <= 6)
    return F.coalesce(F.year(iso_date(period_end)), F.year(day) - F.when(early, 1).otherwise(0))


def fiscal_quarter(period_end: Column, kind: Column) -> Column:
    """The calendar quarter of the period's end, of quarterly reports only."""
    return F.when(kind == "quarterly", F.quarter(iso_date(period_end)))


def padded_cik(cik: Column) -> Column:
    trimmed = F.trim(cik)
    return F.when(F.length(trimmed) >= 10, trimmed).otherwise(F.lpad(trimmed, 10, "0"))


def form_label(form: Column) -> Column:
    return F.translate(F.lower(form), "-/", "")


def dashed_accession(accession: Column) -> Column:
    return F.concat_ws("-", F.substring(accession, 1, 10), F.substring(accession, 11, 2), F.substring(accession, 13, 100))


def filing_id(ticker: Column, form: Column, filed: Column, accession: Column) -> Column:
    return F.concat_ws("_", ticker, form_label(form), filed, F.right(accession, F.lit(6)))


def point_id(chunk_id: Column) -> Column:
    """The first eight bytes of the id's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(chunk_id, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def safe_int(value: Column) -> Column:
    """Whole numbers in text; anything else is null."""
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long"))


def quarter_text(value: Column) -> Column:
    """Q1..Q4 in any case as 1..4; other text trimmed; blank is null."""
    text = F.trim(value.cast("string"))
    return F.when(text == "", None).when(F.upper(text).rlike("^Q[1-4]$"), F.substring(text, 2, 1)).otherwise(text)


def source_class(form: Column, kind: Column, section: Column, text: Column) -> Column:
    """10-K, 10-Q, 8-K-earnings, 8-K, proxy, another form, or unknown."""
    up, head, part = F.upper(F.coalesce(form, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500)), F.lower(F.coalesce(section, F.lit("")))
    event = (F.lower(F.coalesce(kind, F.lit(""))) == "event") & (part.contains("2.02") | part.contains("7.01") | part.contains("results of operations"))
    told = head.contains("earnings release") | head.contains("financial results") | head.contains("quarterly results") | head.contains("annual results")
    return (
        F.when(up.contains("10-K"), "10-K").when(up.contains("10-Q"), "10-Q")
        .when(up.contains("8-K"), F.when(event | told, "8-K-earnings").otherwise("8-K"))
        .when(up.contains("DEF") | up.contains("PROXY"), "proxy").when(up == "", "unknown").otherwise(up)
    )


def filed_epoch(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy")) -> Column:
    """Seconds since 1970 of a date in the first of ``formats`` that fits."""
    return F.coalesce(*[F.unix_seconds(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def is_earnings_report(items: Column, document: Column) -> Column:
    """Listed items decide, if there are any; else words in the document's name."""
    listed = F.array_remove(F.split(F.coalesce(items, F.lit("")), r"[,\s]+"), "")
    named = F.lower(F.coalesce(document, F.lit(""))).rlike("|".join(EARNINGS_WORDS))
    return F.when(F.coalesce(items, F.lit("")) != "", F.arrays_overlap(listed, F.array(*map(F.lit, EARNINGS_ITEMS)))).otherwise(named)


def is_target(form: Column, filed: Column, cutoff: str) -> Column:
    return form.isin(*TARGET_FORMS) & (filed >= cutoff)


def rows_of_recent(submissions: DataFrame, recent: str = "recent") -> DataFrame:
    """Struct-of-arrays as rows: shorter arrays count as padded by "" (``recent`` has string arrays)."""
    fields = submissions.schema[recent].dataType.names
    zipped = F.arrays_zip(*[F.col(f"{recent}.{f}").alias(f) for f in fields])
    others = [c for c in submissions.columns if c != recent]
    rows = submissions.select(*others, F.posexplode(zipped).alias("position", "row"))
    return rows.select(*others, "position", *[F.coalesce(F.col(f"row.{f}"), F.lit("")).alias(f) for f in fields])


def sector_of(filings: DataFrame, sic_sectors: DataFrame) -> DataFrame:
    """``filings`` with the sector of their ``sic`` from a table (sic, sector); others are Unknown."""
    return filings.join(sic_sectors.select("sic", F.col("sector").alias("_sector")), "sic", "left").withColumn("sector", F.coalesce("_sector", F.lit("Unknown"))).drop("_sector")
