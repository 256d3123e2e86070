"""Results as JSON lines, CSV, Markdown and bar charts."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def _cut(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV under a header, numbers to five places."""
    _cut(df, 5).write.mode("overwrite").csv(path, header=True)


def markdown(report: DataFrame) -> str:
    """A report (a few rows, such as one for each configuration) as a Markdown table, numbers to four places."""
    rows = [[str(x) for x in r] for r in _cut(report, 4).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in (report.columns, ["---"] * len(report.columns), *rows)) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def bar_chart(report: DataFrame, label: str, values: list[str], title: str = "", mark: float | None = None, at: float | None = None) -> str:
    """A report's values as an SVG chart of grouped bars; mark draws a line at that height, at one across that share of the width."""
    rows = report.select(label, *values).collect()
    top = max([1e-9, *[float(r[v] or 0) for r in rows for v in values]])
    group, height = 14 * len(values) + 16, 220
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{group * len(rows) + 40}" height="{height + 80}" font-family="sans-serif" font-size="10"><text x="20" y="14">{escape(title)}</text>']
    for i, r in enumerate(rows):
        for j, v in enumerate(values):
            h = height * float(r[v] or 0) / top
            out.append(f'<rect x="{20 + i * group + j * 14}" y="{height + 24 - h:.1f}" width="12" height="{h:.1f}" fill="hsl({j * 67 % 360} 55% 45%)"><title>{escape(v)} {r[v]}</title></rect>')
        out.append(f'<text x="{20 + i * group}" y="{height + 40}">{escape(str(r[label]))}</text>')
    if mark is not None:
        y = height + 24 - height * mark / top
        out.append(f'<line x1="20" x2="{20 + group * len(rows)}" y1="{y:.1f}" y2="{y:.1f}" stroke="black" stroke-dasharray="4"/>')
    if at is not None:
        x = 20 + group * len(rows) * at
        out.append(f'<line x1="{x:.1f}" x2="{x:.1f}" y1="24" y2="{height + 24}" stroke="black" stroke-dasharray="4"><title>{at:.2f}</title></line>')
    return "".join(out) + "</svg>"
