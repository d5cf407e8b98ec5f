"""Tables: from cells to a grid, from a grid to a described record with its cells unpivoted.

A grid is one row (table_id, grid: array<array<string>>), so tables are independent and need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of cells and headers, and the rules (title, header, label) in order of precedence.
NUMBER = re.compile(r"\s*[\$\(]?[\d,]+\.?\d*[BKMG%\)]?\s*$")
PURE_NUMBER = re.compile(r"\s*[\(\-]?[\d,]+\.?\d*\)?\s*$")
UNIT = re.compile(r"\s*[\$%€£¥]\s*$")
PERIOD_HEADER = re.compile(r"\b(19|20)\d{2}\b|Q[1-4]|quarter|ended", re.I)
PERIOD_COLUMN = re.compile(r"\b(19|20)\d{2}\b|(?i:Q[1-4]|quarter|months|year|ended|fiscal)")
FULL_DATE = re.compile(r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},[ \t]+\d{4}$", re.I)
COVER_ADMIN = r"(?i)title\s+of\s+each\s+class|trading\s+symbol|exchange\s+on\s+which\s+registered|accelerated\s+filer|emerging\s+growth\s+company|^\s*Part\s+[IVX]+\s*/\s*Item\s+\d|state\s+or\s+other\s+jurisdiction\s+of\s+incorporation|i\.r\.s\.\s+employer\s+identification"
STATEMENTS = (
    (r"consolidated\s+statements?\s+of\s+(operations|income|earnings|profit)", r"net\s+(sales|revenue)|gross\s+(profit|margin)|operating\s+income", "income_statement"),
    (r"consolidated\s+statements?\s+of\s+comprehensive\s+income|other\s+comprehensive\s+income", r"comprehensive\s+income|unrealized\s+(gains?|losses?)", "comprehensive_income_statement"),
    (r"consolidated\s+balance\s+sheet|consolidated\s+statements?\s+of\s+financial\s+position", r"total\s+assets|total\s+liabilities", "balance_sheet"),
    (r"consolidated\s+statements?\s+of\s+cash\s+flows?", r"cash\s+(used|provided|from)\s+(in|by)\s+(operating|investing|financing)", "cash_flow_statement"),
    (r"consolidated\s+statements?\s+of\s+(stockholders|shareholders).equity|changes\s+in\s+(stockholders|shareholders).equity", r"common\s+stock\s+and\s+additional|retained\s+earnings|accumulated\s+other\s+comprehensive", "equity_statement"),
    (r"segment\s+(information|results|data|revenue)|(revenue|income)\s+by\s+(segment|geography|region)", r"segment|geographic|region", "segment_table"),
    (r"earnings\s+per\s+share|per\s+share\s+data", r"\beps\b|basic|diluted", "eps_table"),
    (r"(long.term\s+)?debt|borrowings?|notes?\s+payable|credit\s+facilit", r"maturity|interest\s+rate|principal|coupon", "debt_table"),
    (r"stock.based\s+compensation|share.based|stock\s+options?|restricted\s+stock\s+units?", r"grant|vest|exercise|fair\s+value", "compensation_table"),
)
MAIN_STATEMENTS = ("income_statement", "balance_sheet", "cash_flow_statement", "equity_statement", "comprehensive_income_statement")
PERIODS = (("annual", r"(?i)year\s+ended|annual|twelve\s+months|52[- ]weeks?|53[- ]weeks?"), ("quarterly", r"(?i)quarter(?:ly)?|three\s+months|thirteen\s+weeks|nine\s+months|six\s+months"), ("instant", r"(?i)as\s+of\b|balance\s+at\b"))
MATURITY = r"(?i)due\s+(after|within|in)|thereafter|remaining\s+(months?|year)|maturities|maturity\s+date"
BIG_NUMBER = r"\$\s*[\d,]{4,}|\b\d{1,3}(?:,\d{3})+\b|\b\d{5,}\b"
GROUPED_NUMBER = r"\b\d{1,3}(?:,\d{3})+\b|\b\d{5,}\b"
COVER_TEXT = r"(?i)\$0\.\d{5}|par\s+value|CUSIP|ISIN"


def grids(cells: DataFrame, blanks: tuple[str, ...] = ("<!-- rich cell -->",)) -> DataFrame:
    """(table_id, grid) of ``cells`` (table_id, r, c, pos, text): the first cell of a place wins, placeholders are
    blank, empty columns go, and of equal rows the first stays; rows without text go."""
    first = Window.partitionBy("table_id", "r", "c").orderBy("pos")
    shown = cells.withColumn("text", F.when(F.trim("text").isin(*blanks), "").otherwise(F.trim(F.coalesce("text", F.lit("")))))
    once = shown.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    used = once.where("text <> ''").select("table_id", "c").distinct()
    columns = used.groupBy("table_id").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    rows = once.groupBy("table_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("at")).join(columns, "table_id")
    rows = rows.withColumn("row", F.transform("cs", lambda c: F.coalesce(F.try_element_at("at", c), F.lit("")))).where(F.exists("row", lambda x: x != ""))
    distinct = rows.groupBy("table_id", "row").agg(F.min("r").alias("r"))
    ordered = F.array_sort(F.collect_list(F.struct("r", "row")))
    return distinct.groupBy("table_id").agg(F.transform(ordered, lambda x: x["row"]).alias("grid"))


def _density(row: list[str]) -> float:
    filled = [x for x in row if x]
    return sum(bool(NUMBER.match(x)) for x in filled) / len(filled) if filled else 0.0


def split_header(grid: list[list[str]]) -> tuple[list[str], list[list[str]], list[str]]:
    """Header, data rows and units. Up to three more rows that are mostly words join the header; numbers among its
    cells, bare years too, become a first data row, and unit signs are collected."""
    depth = 1
    while depth < min(4, len(grid)) and _density(grid[depth]) < 0.5:
        depth += 1
    width = len(grid[0])
    columns = [[row[c] if c < len(row) else "" for row in grid[:depth]] for c in range(width)]
    kinds = [[("number" if PURE_NUMBER.match(x) else "unit" if UNIT.match(x) else "name", x) for x in col if x] for col in columns]
    header = [" / ".join(x for kind, x in col if kind == "name") for col in kinds]
    numbers = [next((x for kind, x in reversed(col) if kind == "number"), "") for col in kinds]
    units = list(dict.fromkeys(x.strip() for col in kinds for kind, x in col if kind == "unit"))
    return header, ([numbers] if any(numbers) else []) + [list(r) for r in grid[depth:]], units


def drop_phantoms(header: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Without columns that are empty in header and data."""
    keep = [c for c, h in enumerate(header) if h or any(len(r) > c and r[c] for r in rows)]
    return [header[c] for c in keep], [[r[c] for c in keep if c < len(r)] for r in rows]


def compact(header: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """A column without a header right after one with a header belongs to it; its first value counts, signs don't."""
    owner = [c - 1 if c and not h and header[c - 1] else c for c, h in enumerate(header)]
    keep = sorted(set(owner))
    if len(keep) == len(header):
        return header, rows
    return [header[c] for c in keep], [[next((r[c] for c in range(len(header)) if owner[c] == k and c < len(r) and r[c] and not UNIT.match(r[c])), "") for k in keep] for r in rows]


def label_column(header: list[str], rows: list[list[str]]) -> int:
    """The leftmost column, not headed by a period, whose values are mostly words; else the first."""
    for c, h in enumerate(header):
        values = [r[c] for r in rows if c < len(r) and r[c]]
        if values and not PERIOD_HEADER.search(h) and sum(not NUMBER.match(v) for v in values) / len(values) >= 0.6:
            return c
    return 0


def render(header: list[str], rows: list[list[str]], label: int) -> str:
    """A line of headers, then ``label | column: value`` for each row."""
    named = lambda c, v: f"{header[c]}: {v}" if c != label and c < len(header) and header[c] and header[c] != v else v
    lines = [" | ".join(h for h in header if h), *(" | ".join(named(c, v) for c, v in enumerate(r) if v) for r in rows)]
    return "\n".join(x for x in lines if x)


def cells_of(header: list[str], rows: list[list[str]], label: int) -> list[tuple[str, str, str]]:
    """Unpivoted: (row label, column header, value), without blanks and signs."""
    return [(r[label] if label < len(r) else "", header[c], v) for r in rows for c, v in enumerate(r) if v and c != label and c < len(header) and not UNIT.match(v)]


RECORD = "column_headers array<string>, row_labels array<string>, label_col_index int, retrieval_text string, header_text string, units array<string>, periods array<string>, cell_grid array<struct<row_label:string,col_header:string,value:string>>"


def structured(tables: DataFrame) -> DataFrame:
    """``tables`` (table_id, grid, ...) with the parts of a table record; tables without header or text go."""
    others = [f for f in tables.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                grid = [list(r) for r in row["grid"]] if row["grid"] is not None else []
                if not grid:
                    continue
                header, rows, units = split_header(grid)
                header, rows = compact(*drop_phantoms(header, rows))
                label = label_column(header, rows)
                text = render(header, rows, label)
                if header and text:
                    labels = [r[label] if label < len(r) else "" for r in rows]
                    cells = [dict(zip(("row_label", "col_header", "value"), x, strict=True)) for x in cells_of(header, rows, label)]
                    periods = [h for h in header if PERIOD_COLUMN.search(h) and not FULL_DATE.match(h)]
                    out.append(row | {"column_headers": header, "row_labels": labels, "label_col_index": label, "retrieval_text": text, "header_text": " ".join(h for h in header if h), "units": units, "periods": periods, "cell_grid": cells, "grid": grid})
            yield pd.DataFrame(out, columns=[f.name for f in others] + ["column_headers", "row_labels", "label_col_index", "retrieval_text", "header_text", "units", "periods", "cell_grid"])

    return tables.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", " + RECORD)


def statement_type(title: Column, header: Column, text: Column) -> Column:
    """The kind of table with the most points, 3 for its title and 1 for its headers; earlier rules win ties."""
    admin = F.concat(header, F.lit(" "), F.substring(text, 1, 300)).rlike(COVER_ADMIN)
    points = lambda t, h: F.when(F.coalesce(title, F.lit("")).rlike("(?i)" + t), 3).otherwise(0) + F.when(header.rlike("(?i)" + h), 1).otherwise(0)
    best = F.greatest(*[F.struct(points(t, h).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (t, h, name) in enumerate(STATEMENTS)])
    return F.when(admin, "cover_admin_table").when(best["n"] > 0, best["name"]).otherwise("other_table")


def period_signals(header: Column, labels: Column) -> Column:
    mature = F.when(header.rlike(MATURITY) | labels.rlike(MATURITY), "maturity_schedule")
    return F.array_compact(F.array(mature, *[F.when(header.rlike(p), name) for name, p in PERIODS]))


def period_type(signals: Column) -> Column:
    return F.when(F.array_contains(signals, "maturity_schedule"), "maturity_schedule").when(F.size(signals) == 0, "unknown").when(F.size(signals) == 1, signals[0]).otherwise("mixed")


def described(records: DataFrame) -> DataFrame:
    """``structured`` records (with table_title) and their kind, periods, and whether they are statements or covers."""
    flat = F.array_join(F.flatten("grid"), " ")
    labels = F.array_join("row_labels", " ")
    rows = records.withColumn("statement_type", statement_type(F.col("table_title"), F.col("header_text"), F.col("retrieval_text")))
    rows = rows.withColumn("period_signals", period_signals(F.array_join("column_headers", " "), labels))
    rows = rows.withColumn("period_type", period_type(F.col("period_signals")))
    statement = F.col("statement_type").isin(*MAIN_STATEMENTS)
    numeric = flat.rlike(BIG_NUMBER) & (F.size("grid") >= 3) & ~flat.rlike(COVER_TEXT)
    admin = F.col("statement_type") == "cover_admin_table"
    rows = rows.withColumn("is_financial_statement", F.when(statement, True).when(admin, False).otherwise(numeric))
    cells = F.aggregate("grid", F.lit(0), lambda n, r: n + F.size(r))
    rows = rows.withColumn("is_cover_page", admin | (~flat.rlike(GROUPED_NUMBER) & (cells <= 12)))
    return rows.withColumn("periods", F.when(admin, F.array().cast("array<string>")).otherwise(F.col("periods")))
