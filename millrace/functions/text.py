"""Predicates and renderings of text blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that decide which blocks of a filing are noise, footnotes or headings.
XBRL_MARKS = (r"https?://\S+", r"\d{10}\s+\d{4}-\d{2}-\d{2}", r"(iso4217|xbrli|us-gaap|srt):[A-Za-z]", r"0{7}\d{3}\s+\w+:\w+Member", r"<[a-z]+:[A-Za-z]+\s")
NAMESPACE = r"\b[a-z][a-z0-9]*:[A-Za-z]"
IMAGE_NAME = r"(?i)^\s*[\w\-]+\.(jpg|jpeg|png|gif|svg|webp|tiff|bmp)\s*$"
BOILERPLATE = r"(?im)See\s+accompanying\s+Notes\s+to|Apple\s+Inc\.\s*\|\s*Q\d\s*\d{4}|\bForm\s+10-[QK]\s*\|\s*\d+\s*$|^\s*\|\s*\d+\s*$"
COVER_FRAGMENT = r"(?i)^(?:\(State\s+or\s+other\s+jurisdiction|of\s+incorporation(?:\s+or\s+organization)?\)|\(Commission|File\s+Number\)|\(I\.R\.S\.\s+Employer|Identification\s+No\.\)|\(Address\s+of\s+principal|\(Zip\s+Code\)|\(Telephone\s+Number|Indicate\s+by\s+check\s+mark\s+whether)\s*$"
SPILLS = (
    r"^\s*\(\s*[\d,]+(?:\.\d+)?\s*\)\s*$",
    r"(?i)^(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*$",
    r"(?i)^(?:Adjusted|Unrealized|Marketable|Non-Current|Equivalents?|Fair\s+Value|Cash\s+and|Gains?|Losses?|Cost)\s*$",
)
FOOTNOTES = ((r"^\s*(\(\d+\)|\d+\.|[a-z]\))\s+", 599), (r"^\s*\([^)]{3,80}\)\s*$", 120), (r"^[¹²³⁰-⁹]\s+\S", 299))
HEADING = r"(?i)^(?:PART\s+[IVX]+\b|Item\s+\d+[A-Za-z]?\.|Note\s+\d+[\s\-–—]|NOTES?\s+TO\s+|CONDENSED\s+CONSOLIDATED\s+)"
HEADING_ANCHOR = r"(?i)^(?:PART\s+[IVX]+|Item\s+\d|Note\s+\d)"
STATEMENT_TITLE = r"(?i)(?:Apple\s+Inc\.\s+)?(?:CONDENSED\s+)?CONSOLIDATED\s+(?:CONDENSED\s+)?(?:STATEMENTS?\s+OF\s+(?:OPERATIONS|INCOME|EARNINGS|COMPREHENSIVE\s+INCOME|CASH\s+FLOWS?|SHAREHOLDERS|STOCKHOLDERS)|BALANCE\s+SHEET)"
NOTE_BODY = r"(?i)(?<= )\b(The|A\b|An\b|During|In\b|As\b|For\b|This|With|Each|All|These|Such|Any|Upon|Under|If\b|When|Pursuant|Effective|Following|Including|Certain|At\b|By\b|No\b|Our|Its|From)\b"
SECTIONS = {
    "10-K": (
        ("1a", "Item 1A. Risk Factors"), ("1b", "Item 1B. Unresolved Staff Comments"), ("1", "Item 1. Business"), ("2", "Item 2. Properties"), ("3", "Item 3. Legal Proceedings"),
        ("4", "Item 4. Mine Safety"), ("5", "Item 5. Market for Registrant"), ("6", "Item 6. Selected Financial Data"), ("7a", "Item 7A. Quantitative and Qualitative Disclosures"),
        ("7", "Item 7. MD&A"), ("8", "Item 8. Financial Statements"), ("9a", "Item 9A. Controls and Procedures"), ("9", "Item 9. Changes in Disagreements"), ("10", "Item 10. Directors and Officers"),
        ("11", "Item 11. Executive Compensation"), ("12", "Item 12. Security Ownership"), ("13", "Item 13. Certain Relationships"), ("14", "Item 14. Principal Accountant Fees"), ("15", "Item 15. Exhibits"),
    ),
    "10-Q": (
        ("1a", "Item 1A. Risk Factors"), ("1", "Item 1. Financial Statements"), ("2", "Item 2. MD&A"), ("3", "Item 3. Quantitative and Qualitative Disclosures"),
        ("4", "Item 4. Controls and Procedures"), ("5", "Item 5. Other Information"), ("6", "Item 6. Exhibits"),
    ),
    "8-K": (
        ("1.01", "Item 1.01. Entry into Material Agreement"), ("1.02", "Item 1.02. Termination of Agreement"), ("2.02", "Item 2.02. Results of Operations"),
        ("2.03", "Item 2.03. Creation of Direct Financial Obligation"), ("5.02", "Item 5.02. Director/Officer Changes"), ("7.01", "Item 7.01. Regulation FD Disclosure"),
        ("8.01", "Item 8.01. Other Events"), ("9.01", "Item 9.01. Financial Statements and Exhibits"),
    ),
}
PHRASES = (
    (r"management.{0,10}discussion\s+and\s+analysis", "MD&A"), (r"results\s+of\s+operations", "Results of Operations"), (r"liquidity\s+and\s+capital", "Liquidity and Capital Resources"),
    (r"critical\s+accounting", "Critical Accounting Policies"), (r"segment\s+information", "Segment Information"), (r"notes?\s+to\s+(the\s+)?condensed", "Notes to Financial Statements"),
    (r"notes?\s+to\s+(the\s+)?financial", "Notes to Financial Statements"), (r"risk\s+factors", "Risk Factors"), (r"financial\s+statements", "Financial Statements"),
)


def is_xbrl_noise(text: Column) -> Column:
    """Long texts with many links or namespaces, or two of the marks."""
    marks = sum((F.when(text.rlike(p), 1).otherwise(0) for p in XBRL_MARKS), F.lit(0))
    links = (F.length(text) - F.length(F.replace(text, F.lit("http"), F.lit("")))) / 4
    return ((F.length(text) > 300) & (links > 4)) | (marks >= 2) | ((F.length(text) > 500) & (F.regexp_count(text, F.lit(NAMESPACE)) > 10))


def is_image_name(text: Column) -> Column:
    return text.rlike(IMAGE_NAME)


def is_boilerplate(text: Column) -> Column:
    return text.rlike(BOILERPLATE)


def is_cover_fragment(text: Column) -> Column:
    return text.rlike(COVER_FRAGMENT)


def is_table_spill(text: Column) -> Column:
    return text.rlike(SPILLS[0]) | text.rlike(SPILLS[1]) | text.rlike(SPILLS[2])


def is_footnote(text: Column) -> Column:
    """A short block that begins with a mark, or is one parenthesis."""
    own, found = F.trim(text), F.lit(False)
    for pattern, most in FOOTNOTES:
        found = found | (own.rlike(pattern) & (F.length(own) <= most))
    return found


def is_prose(text: Column, least: int = 8) -> Column:
    """Blocks that are kept as prose at parsing."""
    own = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(own) >= least) & ~is_xbrl_noise(own) & ~is_image_name(own) & ~is_boilerplate(own) & ~is_cover_fragment(own) & ~is_table_spill(own)


def n_tokens(text: Column) -> Column:
    """The token estimate without a tokeniser: characters over 4.5."""
    return F.floor(F.length(text) / 4.5)


def note_title(text: Column) -> Column:
    """``Note n - title``, cut before the first word that begins a body."""
    number, rest = F.regexp_extract(text, r"(?i)^(Note\s+\d+)\s*[\-–—]\s*", 1), F.regexp_replace(text, r"(?i)^Note\s+\d+\s*[\-–—]\s*", "")
    title = F.regexp_replace(F.trim(F.element_at(F.split(rest, NOTE_BODY, 2), 1)), ",+$", "")
    whole = F.regexp_replace(F.concat(number, F.lit(" - "), F.trim(title)), r"[ \-]+$", "")
    return F.when(number == "", F.substring(text, 1, 80)).otherwise(F.trim(whole))


def short_heading(text: Column) -> Column:
    """The heading that a block is or begins with, else null."""
    own = F.trim(text)
    long = F.regexp_extract(own, r"(?i)^((?:PART\s+[IVX]+[^.]*?|Item\s+\d+[A-Za-z]?\.\s*[^.]{0,60}|CONDENSED\s+CONSOLIDATED\s+[A-Z\s]+))", 1)
    cut = F.when(long == "", F.substring(own, 1, 80)).otherwise(F.trim(long))
    return F.when(own.rlike(HEADING), F.when(own.rlike(r"(?i)^Note\s+\d+"), note_title(own)).when(F.length(own) <= 120, own).otherwise(cut))


def statement_title(text: Column) -> Column:
    """The title of a financial statement without its tail in parentheses, else null."""
    own = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?is)\s*\((?:Unaudited|In millions[^)]*)\)[^\n]*", "")), r"(?i)^Apple\s+Inc\.\s+", "")
    return F.when(text.rlike(STATEMENT_TITLE) & (F.length(F.trim(own)) >= 10), F.trim(own))


def section_of(text: Column, form: Column) -> Column:
    """The section that a block opens: by item number in headings and short blocks, else by phrase; null if none."""
    own, head = F.trim(text), F.lower(F.substring(F.trim(text), 1, 200))

    def items(kind: str) -> Column:
        end = "" if kind == "8-K" else r"[\.\s]"
        return F.coalesce(*[F.when(head.rlike(r"^item\s+" + n.replace(".", r"\.") + end), label) for n, label in SECTIONS[kind]])

    up = F.upper(F.coalesce(form, F.lit("")))
    by_item = F.when(up.contains("10-Q"), items("10-Q")).when(up.contains("8-K"), items("8-K")).otherwise(items("10-K"))
    by_phrase = F.coalesce(*[F.when(head.rlike(p), label) for p, label in PHRASES])
    return F.coalesce(F.when((F.length(own) <= 200) | own.rlike(HEADING_ANCHOR), by_item), by_phrase)


def citation_key(page: Column, section: Column, order: Column, surrogate: Column) -> Column:
    named = F.trim(F.replace(F.coalesce(F.nullif(section, F.lit("")), F.lit("General")), F.lit("|"), F.lit("-")))
    return F.when(surrogate, F.concat(named, F.lit(" §"), order.cast("string"))).otherwise(F.concat(F.lit("p."), page.cast("string")))


def content_hash(kind: Column, citation: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", kind, citation, F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")))


def embed_text() -> Column:
    """What an encoder reads of a chunk: prose with its place, rows with their table, tables alone."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    place = F.concat_ws(" | ", some("ticker"), some("form_type"), some("section"))
    statement = F.when(F.col("statement_type") != "other_table", some("statement_type"))
    row = F.concat_ws(" | ", some("ticker"), some("form_type"), statement)
    prefix = F.when(F.col("chunk_type").isin("table", "micro_block"), "").when(F.col("chunk_type") == "row", row).otherwise(place)
    return F.when(prefix == "", F.col("text")).otherwise(F.concat(prefix, F.lit("\n"), F.col("text")))
