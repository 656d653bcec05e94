"""Sinks: tables by key of decision, enrichment with checks, small formatted tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet table; the job's committer makes it appear whole or not at all."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_decisions(df: DataFrame, kept: Column, path: str) -> dict[str, int]:
    """All rows under ``path`` in one pass, split by the decision into decision=kept and decision=excluded; the counts are read back and must add up to the rows that the pass has seen."""
    seen = Observation("decisions")
    marked = df.withColumn("decision", F.when(F.coalesce(kept, F.lit(False)), "kept").otherwise("excluded"))
    marked.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy("decision").parquet(path)
    counts = {r[0]: r[1] for r in df.sparkSession.read.parquet(path).groupBy("decision").count().collect()}
    total = seen.get["rows"]
    if sum(counts.values()) != total:
        raise ValueError(f"{path}: {counts} rows written of {total}")
    return {"all": total, "kept": counts.get("kept", 0), "excluded": counts.get("excluded", 0)}


def enrich(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns added; a name that it has already is an error, not an overwrite."""
    clash = sorted(set(columns) & set(df.columns))
    if clash:
        raise ValueError(f"columns exist: {clash}")
    return df.withColumns(columns)


def write_enriched(df: DataFrame, columns: dict[str, Column], path: str) -> int:
    """Write an enriched table and check that it has the rows that the pass over the input has seen."""
    seen = Observation("enriched")
    write_table(enrich(df.observe(seen, F.count(F.lit(1)).alias("rows")), columns), path)
    before = seen.get["rows"]
    after = df.sparkSession.read.parquet(path).count()
    if before != after:
        raise ValueError(f"{path}: {after} rows of {before}")
    return after


def _printed(df: DataFrame, order: list[str], head: list[str], row: Column, foot: list[str]) -> DataFrame:
    """Lines of a printed table in order: ``value``, one row a line. Sorted by ranges; the driver holds none of them."""
    line = lambda part, values: [(part, k, v) for k, v in enumerate(values)]
    edges = df.sparkSession.createDataFrame(line(0, head) + line(2, foot), "__part int, __n long, value string")
    body = df.select(F.lit(1).alias("__part"), F.lit(0).cast("long").alias("__n"), row.alias("value"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    return body.unionByName(edges, allowMissingColumns=True).orderBy("__part", "__n", *[f"__o{k}" for k in range(len(order))], "value").select("value")


def _text(column: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")), r"\s*[\r\n]+\s*", " ")


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """A table of any length as lines of Markdown, rows in ``order``; nulls are empty."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    cells = [F.replace(_text(c), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return _printed(df, order, [line(df.columns), line(["---"] * len(df.columns))], F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), [])


def latex_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """A table of any length as lines of a LaTeX tabular, rows in ``order``; nulls are empty."""
    plain = lambda c: F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    # A backslash, tilde or caret becomes a command; they are put aside while the others are escaped.
    signs = {"\\": ("\x01", r"\textbackslash{}"), "~": ("\x02", r"\textasciitilde{}"), "^": ("\x03", r"\textasciicircum{}")}

    def cell(column: str) -> Column:
        out = _text(column)
        for sign, (aside, _) in signs.items():
            out = F.replace(out, F.lit(sign), F.lit(aside))
        out = plain(out)
        for aside, command in signs.values():
            out = F.replace(out, F.lit(aside), F.lit(command))
        return out

    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\"
    frame = [r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", head, r"\hline"]
    return _printed(df, order, frame, F.concat(F.concat_ws(" & ", *map(cell, df.columns)), F.lit(r" \\")), [r"\hline", r"\end{tabular}"])


def _cells(df: DataFrame, most_rows: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} rows are no printed table")
    return df.columns, [["" if v is None else str(v) for v in r] for r in rows]


def to_markdown(df: DataFrame, most_rows: int = 500) -> str:
    """A small result as a Markdown table."""
    head, rows = _cells(df, most_rows)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)]) + "\n"


def to_latex(df: DataFrame, most_rows: int = 500) -> str:
    """A small result as a LaTeX tabular."""
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    head, rows = _cells(df, most_rows)
    line = lambda cells: " & ".join("".join(special.get(x, x) for x in c) for c in cells) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", r"\hline", line(head), r"\hline", *map(line, rows), r"\hline", r"\end{tabular}"]) + "\n"


def to_json_lines(df: DataFrame, most_rows: int = 500) -> str:
    """A small result as JSON lines of text values, keys sorted."""
    head, rows = _cells(df, most_rows)
    return "".join(json.dumps(dict(zip(head, r, strict=True)), sort_keys=True) + "\n" for r in rows)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with header that ``read_any`` reads back as it was: quotes doubled, numbers in their shortest exact form; only empty texts come back as nulls."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
