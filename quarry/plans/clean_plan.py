"""B9 ``smart_clean`` as a re-usable, data-derived plan.

``CleanPlan.fit(df)`` runs ONE job over ONE scan (all columns' counts are
fields of one aggregate row) that measures everything the decisions need: raw non-null counts (B1), post-token non-null and numeric
counts (B5), per-format parse counts for date-named columns (B6), and
whether every value of a (converted) double is integral (B7).
``plan.apply(df)`` is a pure projection - no job - so it can be applied
to new batches or a stream with the same schema.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import q
from quarry.functions.parsing import (DATE_FORMATS, DATE_NAME_HINTS, integral, null_tokens,
                                      strip, to_datetime, to_long, to_numeric)

MAX_DISPLAY_COLS = 50


@dataclass
class CleanPlan:
    dropped_all_null: list = field(default_factory=list)
    dropped_unnamed: list = field(default_factory=list)
    text_columns: list = field(default_factory=list)
    numeric_from_text: list = field(default_factory=list)
    date_formats: dict = field(default_factory=dict)
    long_from_text: list = field(default_factory=list)
    narrowed: list = field(default_factory=list)
    columns: list = field(default_factory=list)
    max_display_cols: int = MAX_DISPLAY_COLS

    # ---- fit ----------------------------------------------------------
    @classmethod
    def fit(cls, df: DataFrame, max_display_cols: int = MAX_DISPLAY_COLS,
            numeric_share: float = 0.8, min_parse_ratio: float = 0.0,
            trim_whitespace: bool = True, detect_types: bool = True,
            parse_dates: bool = True, narrow: bool = True) -> "CleanPlan":
        if not 5 <= max_display_cols <= 1000:
            raise ValueError("max_display_cols must be within 5..1000")
        fields = df.schema.fields
        unnamed = [f.name for f in fields if re.match("^Unnamed", f.name)]
        text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
        doubles = [f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        dated = [c for c in text if any(h in c.lower() for h in DATE_NAME_HINTS)]

        def tok(c):
            v = null_tokens(q(c))
            return strip(v) if trim_whitespace else v

        idx = {f.name: i for i, f in enumerate(fields)}
        # one aggregate row over one scan: per column the raw non-null count;
        # for text the post-token, numeric and long counts, whether all numbers
        # are whole, and per-format date counts; for doubles whether all are whole
        zero = F.lit(0).cast("bigint")
        stats = []
        for f in fields:
            c, i = f.name, idx[f.name]
            tokens = num = long = zero
            whole, dates = F.lit(True), F.array().cast("array<bigint>")
            if c in text:
                t = F.col(f"t{i}")
                n = F.col(f"n{i}")
                tokens, num, long = F.count(t), F.count(n), F.count(to_long(t))
                whole = F.bool_and(F.coalesce(integral(n), F.lit(True)))
                if c in dated:
                    dates = F.array(*[F.count(to_datetime(t, fmt)) for fmt in DATE_FORMATS])
            elif c in doubles:
                x = F.when(~F.isnan(q(c)), q(c))
                whole = F.bool_and(F.coalesce(integral(x), F.lit(True)))
            stats.append(F.struct(F.count(q(c)).alias("raw"), tokens.alias("tok"), num.alias("num"), long.alias("long"),
                                  whole.alias("whole"), dates.alias("dates")).alias(f"s{i}"))
        cells = df.withColumns({f"t{idx[c]}": tok(c) for c in text}) if text else df
        cells = cells.withColumns({f"n{idx[c]}": to_numeric(F.col(f"t{idx[c]}")) for c in text}) if text else cells
        got = cells.agg(*stats).first()
        row = {c: got[f"s{i}"] for c, i in idx.items()}

        plan = cls(max_display_cols=max_display_cols)
        plan.dropped_all_null = [f.name for f in fields if row[f.name]["raw"] == 0]
        plan.dropped_unnamed = [c for c in unnamed if c not in plan.dropped_all_null]
        gone = set(plan.dropped_all_null) | set(plan.dropped_unnamed)
        kept = [f.name for f in fields if f.name not in gone]
        plan.text_columns = [c for c in text if c not in gone]
        for c in plan.text_columns:
            r = row[c]
            if detect_types and r["tok"] > 0 and r["num"] / r["tok"] > numeric_share:
                plan.numeric_from_text.append(c)
                if narrow and r["num"] > 0 and r["long"] == r["num"]:
                    plan.long_from_text.append(c)
                elif narrow and r["whole"] and r["num"] > 0:
                    plan.narrowed.append(c)
        for c in dated:
            if c in gone or c in plan.numeric_from_text or not (detect_types and parse_dates):
                continue
            counts = row[c]["dates"]
            best = max(range(len(counts)), key=lambda k: (counts[k], -k))
            non_null = row[c]["tok"]
            # a column of which no cell parses is no date column and stays text
            if counts[best] > 0 and counts[best] / non_null >= min_parse_ratio:
                plan.date_formats[c] = DATE_FORMATS[best]
        for c in doubles:
            if c not in gone and row[c]["whole"] and row[c]["raw"] > 0 and detect_types and narrow:
                plan.narrowed.append(c)
        plan.columns = kept
        return plan

    # ---- apply --------------------------------------------------------
    def expressions(self, trim_whitespace: bool = True) -> list:
        out = []
        for c in self.columns:
            e = q(c)
            if c in self.text_columns:
                e = null_tokens(e)
                if trim_whitespace:
                    e = strip(e)
                if c in self.long_from_text:
                    e = to_long(e)
                elif c in self.numeric_from_text:
                    e = to_numeric(e)
                elif c in self.date_formats:
                    e = to_datetime(e, self.date_formats[c])
            if c in self.narrowed:
                e = e.cast("double")
                # a later batch's fraction has no place in a whole-number column: null, never truncated
                e = F.when(integral(e), e.cast("bigint"))
            out.append(e.alias(c))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """Full cleaned table (lazy)."""
        return df.select(*self.expressions())

    def display(self, df: DataFrame) -> DataFrame:
        """The first ``max_display_cols`` columns of the cleaned table."""
        cleaned = self.apply(df)
        return cleaned.select(*[q(c) for c in cleaned.columns[: self.max_display_cols]])

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, s: str) -> "CleanPlan":
        return cls(**json.loads(s))


def smart_clean(df: DataFrame, max_display_cols: int = MAX_DISPLAY_COLS, **kw):
    """(full, display) cleaned DataFrames plus the fitted plan."""
    plan = CleanPlan.fit(df, max_display_cols, **kw)
    return plan.apply(df), plan.display(df), plan
