"""Where results go: tables of fixed columns, JSON, a page for people."""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAPPING_COLUMNS = ["source_id", "ordinal", "raw", "normalised", "concept", "symbol", "method", "confidence"]
#: A page for people shows so many rows; the tables hold all.
PAGE_ROWS = 500


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by bars, structs and maps as JSON, so that any row fits a delimited file."""
    out = {}
    for field in df.schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.AtomicType):
            out[field.name] = F.array_join(F.transform(column, lambda x: x.cast("string")), "|")
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            out[field.name] = F.to_json(column, {"ignoreNullFields": "false"})
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists", delimiter: str = ",") -> None:
    """The named columns in their order; those that are missing are empty."""
    columns = columns or df.columns
    known = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    flat(df).select(*known).write.mode(mode).options(header=True, sep=delimiter, nullValue="").csv(path)


def by_key_union(*tables: DataFrame) -> DataFrame:
    """Rows of several tables under all their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_json(df: DataFrame, path: str, kind: str, provenance: dict | None = None, mode: str = "errorifexists") -> None:
    """One JSON object a row, with the report's kind and provenance; NULLs are written."""
    row = F.struct(F.lit(kind).alias("report_type"), F.lit(json.dumps(provenance or {}, sort_keys=True)).alias("provenance"), F.struct(*df.columns).alias("result"))
    df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_failures(df: DataFrame, path: str) -> None:
    """Append failure rows as JSON lines."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    df.withColumn("at", stamp).write.mode("append").json(path)


def write_manifest(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Canonical columns first, the others after them."""
    rest = [c for c in df.columns if c not in columns]
    write_csv(df.na.fill(""), path, [*columns, *rest], mode)


def provenance(**settings) -> dict:
    """What a result was made with."""
    return {"generated_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), **{k: str(v) for k, v in sorted(settings.items())}}


def assessment_provenance(verdicts: DataFrame, **settings) -> DataFrame:
    """Each verdict with its provenance in the same row."""
    made = provenance(**settings)
    return verdicts.withColumn("provenance", F.create_map(*(F.lit(x) for pair in made.items() for x in pair)))


def render_page(title: str, *tables: tuple[str, DataFrame], most: int = PAGE_ROWS) -> str:
    """A self-contained page of the first ``most`` rows of some tables; it says where a table has more."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables:
        rows = flat(df).limit(most + 1).collect()
        more = f"<p>The first {most} rows; the table has more.</p>" if len(rows) > most else ""
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
        out.append(f"<h2>{html.escape(name)}</h2>{more}<table><tr>{head}</tr>{body}</table>")
    return "".join(out)


def render_console(df: DataFrame, rows: int = 20, width: int = 60) -> None:
    """A table on the terminal."""
    flat(df).show(rows, truncate=width)
