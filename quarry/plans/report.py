"""C16-C20 composite reports built from the per-section operators.

Each section is a distributed job whose result has O(#columns) rows;
only those small results are read on the driver to format the texts the
reference shows (they follow Python's own number formatting), and the
texts are returned as DataFrames again.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.functions import chat_rules as CR
from quarry.functions.kinds import categorical_columns, numeric_columns, q
from quarry.operators import profile as P
from quarry.operators.chat import domain_of
from quarry.operators.clean import drop_missing
from quarry.operators.correlate import correlation_highlights
from quarry.operators.duplicates import duplicate_count
from quarry.operators.outliers import outliers_iqr
from quarry.session import materialize

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def profile_numeric(df: DataFrame, method: str = "exact") -> DataFrame:
    """describe + missing counts: one row per numeric column (two scans of
    the input, joined on the column ordinal; both sides have one row per
    column, so the join is bounded by the schema width)."""
    cols = numeric_columns(df)
    desc = P.describe_numeric(df, cols, method=method)
    miss = P.missing_counts(df, cols).select("ord", "missing")
    return desc.join(miss, "ord").orderBy("ord")


def _facts(df: DataFrame) -> dict:
    mc = P.missing_counts(df).orderBy("ord").collect()      # one row per column
    rows = (mc[0]["missing"] + mc[0]["present"]) if mc else df.count()
    return {"rows": rows, "columns": len(df.columns),
            "missing": {r["column_name"]: r["missing"] for r in mc},
            "total_missing": sum(r["missing"] for r in mc),
            "numeric": numeric_columns(df), "categorical": categorical_columns(df)}


def quality_score_value(rows: int, n_cols: int, total_missing: int, n_num: int, n_cat: int):
    """C16 formula; ``None`` when the table has no cells (JS NaN)."""
    cells = rows * n_cols
    if cells == 0:
        return None
    score = 100.0 - min(total_missing / cells * 100 * 0.5, 30.0)
    if n_cat > 0:
        score += min(n_cat * 2, 10)
    if n_num > 0:
        score += min(n_num * 2, 10)
    return int(max(0, min(100, math.floor(score + 0.5))))


def quality_score(df: DataFrame) -> DataFrame:
    """100 - min(0.5 * missing %, 30) + min(2 * categorical, 10)
    + min(2 * numeric, 10), rounded half up and clamped to 0..100."""
    f = _facts(df)
    s = quality_score_value(f["rows"], f["columns"], f["total_missing"], len(f["numeric"]),
                            len(f["categorical"]))
    return df.sparkSession.createDataFrame([(s,)], "quality_score bigint")


def dataset_summary(df: DataFrame, filename: str, domain: str | None = None) -> DataFrame:
    """C20: the seven-line summary text."""
    f = _facts(df)
    dom = domain or domain_of(df.columns)
    s = quality_score_value(f["rows"], f["columns"], f["total_missing"], len(f["numeric"]),
                            len(f["categorical"]))
    text = "\n".join([
        f"Dataset: {filename}", f"Domain: {dom}",
        f"Shape: {f['rows']} rows × {f['columns']} columns",
        f"Numerical Features: {len(f['numeric'])}", f"Categorical Features: {len(f['categorical'])}",
        f"Missing Values: {f['total_missing']} total", f"Data Quality Score: {s}"])
    return df.sparkSession.createDataFrame([(text,)], "summary string")


def _py(v, dt) -> str:
    """Python ``str`` of a pandas scalar of this Spark type."""
    if v is None:
        return "nan"
    if isinstance(dt, _INTEGRAL):
        return str(int(v))
    return str(float(v))


def auto_insights(df: DataFrame, filename: str, sample_rows: int | None = None,
                  max_cols: int | None = None) -> DataFrame:
    """C17: (ord, text) in the reference's order: file, shape, missing,
    domain hints, top correlations, top categories, numeric summaries,
    IQR outlier total, duplicates.  Correlations use every complete row
    unless ``sample_rows`` is given; the column lists are whole unless
    ``max_cols`` cuts them."""
    types = {fl.name: fl.dataType for fl in df.schema.fields}
    f = _facts(df)
    out = [f"File: {filename}", f"Shape: {f['rows']} rows x {f['columns']} columns",
           f"Warning: {f['total_missing']} Missing Value{'s' if f['total_missing'] != 1 else ''} Found"]
    names = " ".join(df.columns).lower()
    if any(w in names for w in CR.FINANCIAL_HINT_WORDS):
        out.append(CR.FINANCIAL_HINT)
    if any(w in names for w in CR.HEALTHCARE_HINT_WORDS):
        out.append(CR.HEALTHCARE_HINT)
    num, cat = f["numeric"], f["categorical"]
    if len(num) >= 2:
        src = df
        if sample_rows:
            from quarry.operators.charts import sample_rows as _sample
            src = _sample(drop_missing(df, subset=num), sample_rows, df.columns, seed=42)
        for r in correlation_highlights(src, 5, True, num).collect():
            out.append(f"Corr: {r['a']} <-> {r['b']} (|r|={r['abs_r']:.2f})")
    if cat:
        tops = {r["ord"]: r for r in P.top_values(df, 1, cat[:max_cols]).collect()}
        for i, c in enumerate(cat[:max_cols]):
            if i in tops:
                out.append(f"Top in {c}: {tops[i]['value']} ({tops[i]['count']})")
    if num:
        summ = {r["column_name"]: r for r in P.numeric_summary(df, max_cols).collect()}
        for c in num[:max_cols]:
            r = summ.get(c)
            if r is not None and r["count"]:
                out.append(f"Stats {c}: Min={_py(r['min'], types[c])}, "
                           f"Max={_py(r['max'], types[c])}, Mean={r['mean']:.2f}")
        total_iqr = sum(r["outliers"] for r in outliers_iqr(df, num).collect())
        if total_iqr > 0:
            out.append(f"Warning: {total_iqr} potential outliers detected using IQR method")
    dups = duplicate_count(df).first()["duplicates"]
    if dups > 0:
        out.append(f"Duplicates: {dups} duplicate rows found")
    return df.sparkSession.createDataFrame(list(enumerate(out)), "ord int, text string")


def dataset_context(df: DataFrame, filename: str, order_by, overrides: dict | None = None,
                    sample_n: int = 3) -> DataFrame:
    """One struct row with names, kinds, missing counts, ``sample_n``
    sample rows (as text maps), describe statistics and domain; caller keys
    in ``overrides`` win, and keys that are not in the context come back in
    the map ``extra`` (non-text values as JSON)."""
    f = _facts(df)
    desc = {r["column_name"]: {k: r[k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")}
            for r in P.describe_numeric(df).collect()}
    sample = [{k: (None if v is None else str(v)) for k, v in r.asDict().items()}
              for r in df.orderBy(*[q(c) for c in order_by]).limit(sample_n).collect()]
    ctx = {"filename": filename, "shape": {"rows": f["rows"], "columns": f["columns"]},
           "columns": df.columns, "numerical_columns": f["numeric"],
           "categorical_columns": f["categorical"], "missing_values": f["missing"],
           "sample_data": sample, "basic_stats": desc, "domain": domain_of(df.columns)}
    own = {k: v for k, v in (overrides or {}).items() if k in ctx}
    extra = {k: v if isinstance(v, str) or v is None else json.dumps(v, default=str)
             for k, v in (overrides or {}).items() if k not in ctx}
    ctx.update(own)
    schema = ("filename string, shape struct<rows: bigint, columns: bigint>, columns array<string>, "
              "numerical_columns array<string>, categorical_columns array<string>, "
              "missing_values map<string,bigint>, sample_data array<map<string,string>>, "
              "basic_stats map<string,map<string,double>>, domain string, extra map<string,string>")
    stats = {c: {k: (None if v is None else float(v)) for k, v in s.items()} for c, s in ctx["basic_stats"].items()}
    row = (ctx["filename"], (ctx["shape"]["rows"], ctx["shape"]["columns"]), ctx["columns"],
           ctx["numerical_columns"], ctx["categorical_columns"], ctx["missing_values"],
           ctx["sample_data"], stats, ctx["domain"], extra)
    return df.sparkSession.createDataFrame([row], schema)


def profile_report(df: DataFrame, filename: str, order_by, top_k: int | None = None) -> DataFrame:
    """The reference's profile response as one row.  The report holds
    every value's count, as the reference's does; for columns with very many
    values, pass ``top_k`` or take ``value_counts`` as a DataFrame.  The
    table is materialised once, so the sections don't redo its cleaning."""
    df = materialize(df, "profiled")
    f = _facts(df)
    iqr = {r["column_name"]: r["outliers"] for r in outliers_iqr(df).collect()}
    from quarry.operators.outliers import outliers_zscore
    z = {r["column_name"]: r["outliers"] for r in outliers_zscore(df).collect()}
    tops = {}
    for r in (P.value_counts(df) if top_k is None else P.top_values(df, top_k)).collect():
        tops.setdefault(r["column_name"], {})[r["value"]] = r["count"]
    stats = {r["column_name"]: {k: (None if r[k] is None else float(r[k]))
                                for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")}
             for r in P.describe_numeric(df).collect()}
    head = [{k: (None if v is None else str(v)) for k, v in r.asDict().items()}
            for r in df.orderBy(*[q(c) for c in order_by]).limit(5).collect()]
    insights = [r["text"] for r in auto_insights(df, filename).orderBy("ord").collect()]
    dups = duplicate_count(df).first()["duplicates"]
    schema = ("filename string, shape struct<rows: bigint, columns: bigint>, columns array<string>, "
              "numerical_columns array<string>, categorical_columns array<string>, "
              "missing_values map<string,bigint>, stats map<string,map<string,double>>, "
              "value_counts map<string,map<string,bigint>>, outliers_iqr map<string,bigint>, "
              "outliers_zscore map<string,bigint>, duplicates bigint, head array<map<string,string>>, "
              "insights array<string>, quality_score bigint")
    row = (filename, (f["rows"], f["columns"]), df.columns, f["numeric"], f["categorical"],
           f["missing"], stats, tops, iqr, z, dups, head, insights,
           quality_score_value(f["rows"], f["columns"], f["total_missing"], len(f["numeric"]),
                               len(f["categorical"])))
    return df.sparkSession.createDataFrame([row], schema)
