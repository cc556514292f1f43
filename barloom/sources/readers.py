"""Sources and sinks: CSV with inferred types, memory, pandas and Arrow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.datetimes import to_datetime
from ..operators.frame import BarFrame

#: The tokens that mean missing.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _names(header: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", header: bool = True, schema: Mapping[str, str] | None = None, parse_dates: Sequence[str] = (), na_values: Sequence[str] = (), keep_default_na: bool = True, date_format: str | None = None, date_unit: str = "ns") -> DataFrame:
    """A CSV file or folder as typed columns.

    Types are the first of long, double, boolean and string that every value of a column fits, found by one pass of
    aggregates; a schema saves that pass. Repeated names get numbers and empty ones positions.
    """
    raw = spark.read.csv(path, sep=sep, header=False, inferSchema=False, nullValue="\0", emptyValue="", mode="PERMISSIVE")
    first = raw.first()
    if first is None:
        raise ValueError("the file has no columns")
    names = _names([x or "" for x in first]) if header else [f"c{i}" for i in range(len(raw.columns))]
    if header:
        raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, nullValue="\0", emptyValue="", enforceSchema=True, schema=", ".join(f"_c{i} string" for i in range(len(names))))
    missing = [*(NA_VALUES if keep_default_na else ()), *na_values]
    rows = raw.toDF(*names)
    rows = rows.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(missing), F.trim(F.col(f"`{c}`"))).alias(c) for c in names))
    kinds = dict(schema or {})
    open_ = [c for c in names if c not in kinds and c not in parse_dates]
    if open_:
        checks = rows.agg(*(fits_of(F.col(f"`{c}`")).alias(c) for c in open_)).first()
        kinds |= {c: checks[c] for c in open_}
    typed = [to_datetime(F.col(f"`{c}`"), date_unit, date_format).alias(c) if c in parse_dates else F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in names]
    return rows.select(*typed)


def fits_of(c: Column) -> Column:
    """The name of the first type that all values fit; a column without values is double."""
    there = c.isNotNull()  # the aggregates skip what is missing
    whole = F.bool_and(F.when(there, c.rlike(r"^[+-]?\d+$") & c.try_cast("long").isNotNull()))
    real = F.bool_and(F.when(there, c.try_cast("double").isNotNull()))
    truth = F.bool_and(F.when(there, F.lower(c).isin("true", "false")))
    some = F.count(c) > 0
    return F.when(~some, "double").when(whole, "long").when(real, "double").when(truth, "boolean").otherwise("string")


def write_csv(df: DataFrame, path: str, *, sep: str = ",", header: bool = True, na_rep: str = "", columns: Sequence[str] | None = None, float_format: str | None = None) -> None:
    rows = df.select(*(columns or df.columns))
    if float_format:
        rows = rows.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(float_format, F.col(c))) for c, kind in rows.dtypes if kind in ("double", "float")})
    rows.write.csv(path, sep=sep, header=header, nullValue=na_rep, emptyValue="")


def from_dict(spark: SparkSession, columns: Mapping[str, Sequence], schema: str | None = None) -> DataFrame:
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("the columns have different lengths")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema or list(columns))


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    return spark.createDataFrame(frame.reset_index() if frame.index.name else frame)


def from_arrow(spark: SparkSession, data) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(data if isinstance(data, pa.Table) else pa.table(data))


def bar_frame(df: DataFrame, key: Sequence[str] = (), ts: str = "ts", tiebreak: Sequence[str] = (), tz: str | None = None) -> BarFrame:
    return BarFrame(df, tuple(key), ts, tuple(tiebreak), tz)
