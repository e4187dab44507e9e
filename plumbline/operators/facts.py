"""Column facts: one row of exact scalars per column, the input of every rule.

Cells are scanned in long form, (ordinal, value), so the number of aggregates
does not grow with the width of the table and generated code stays small. Each
kind of column is unpivoted on its own, which keeps numbers as numbers and lets
the reader prune to the columns in use. All aggregates combine map-side; what
is shuffled is one row per column and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import constants as k
from plumbline.functions import exprs as X
from plumbline.functions import names

STRING, INTEGRAL, FRACTIONAL, BOOLEAN, TEMPORAL = (
    "string",
    "integral",
    "fractional",
    "boolean",
    "temporal",
)
NUMERIC = (INTEGRAL, FRACTIONAL)

# Values longer than this are compared by SHA-256 instead of being shuffled whole.
LONG_VALUE_BYTES = 64

FACTS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("original_dtype", T.StringType()),
        *[
            T.StructField(n, T.BooleanType())
            for n in (
                "named_identifier", "named_non_negative", "named_percentage",
                "named_phone", "named_dated", "named_date", "named_email",
            )
        ],
        *[
            T.StructField(n, T.LongType())
            for n in (
                "rows", "non_null", "blank", "octets",
                "date_values", "short_numbers", "iso", "delimited", "named", "dates", "dates_in_range",
                "truth_bits",
                "len_min", "len_max", "len_sum",
                "at_sign", "email_ok", "phone_ok", "stamps", "stamps_ok",
                "near_empty", "repetitive", "badly_spaced",
                "negatives", "off_percent",
                "unique", "top", "repeated", "outliers", "too_long", "length_limit",
            )
        ],
        *[
            T.StructField(n, T.DoubleType())
            for n in (
                "len_mean", "len_sd", "mn", "mx", "mean", "sd",
                "q25", "q50", "q75", "lower", "upper",
            )
        ],
        T.StructField("earliest", T.StringType()),
        T.StructField("latest", T.StringType()),
        T.StructField("shown", T.StringType()),
    ]
)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.IntegralType):
        return INTEGRAL
    if isinstance(data_type, (T.FractionalType, T.NullType)):
        return FRACTIONAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    return STRING


def scalar_cells(df: DataFrame) -> DataFrame:
    """Every column as a comparable scalar: nested cells as JSON text, NaN as null."""
    from plumbline.sources.flatten import nested_to_json

    df = nested_to_json(df)
    out = []
    for f in df.schema.fields:
        c = X.ref(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c + F.lit(0.0).cast(f.dataType))
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("double")
        elif kind_of(f.dataType) == STRING and not isinstance(f.dataType, T.StringType):
            c = X.text(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def melt(
    df: DataFrame,
    ordinals: Sequence[int],
    data_type: str,
    convert: Callable[[Column, T.DataType], Column] = lambda c, t: c,
) -> DataFrame:
    """(ordinal, value) rows of the non-null cells of some columns."""
    fields = [(i, df.schema.fields[i]) for i in ordinals]
    cells = [convert(X.ref(f.name), f.dataType).cast(data_type).alias(str(i)) for i, f in fields]
    long = df.select(*cells).unpivot(
        [], [X.ref(str(i)) for i in ordinals], "ordinal", "value"
    )
    return long.where("value is not null")


def by_kind(df: DataFrame, *kinds: str) -> list[int]:
    return [i for i, f in enumerate(df.schema.fields) if kind_of(f.dataType) in kinds]


# ---- scalars of one scan ------------------------------------------------------------


def _truth_bit(value: Column) -> Column:
    low = F.lower(value)
    out = F.when(low == "true", 1)
    for bit, word in enumerate(("false", "yes", "no", "y", "n", "t", "f"), start=1):
        out = out.when(low == word, 1 << bit)
    return F.when(value.isNotNull(), out.otherwise(256))


def cell_facts(
    cells: DataFrame, groups: set[str], phone: Sequence[int] = (), dated: Sequence[int] | None = None
) -> tuple[DataFrame, list[str]]:
    """Adds what the rules want to know about each text value, null for a null value.

    Shared steps (strip, date family, parsed date) are columns of their own, so
    each pattern runs once per value. Dates are read in the columns with the
    ordinals of dated, or in all of them; phone numbers in the named columns.
    """
    v, s, family, ts = map(F.col, ("value", "s", "family", "ts"))
    cells = cells.withColumn("s", X.strip(v))
    if groups & {"types", "validity"}:
        wanted = F.lit(True) if dated is None else F.col("ordinal").isin(*map(str, dated))
        cells = cells.withColumn("family", F.when(wanted, X.date_family(s)))
        cells = cells.withColumn("ts", X.parse_date(s, family))
    found = {"c_blank": s == ""}
    if "types" in groups:
        found |= {"c_short": s.rlike(k.SHORT_NUMBER), "c_truth": _truth_bit(v)}
    if groups & {"types", "validity"}:
        found |= {"c_family": family, "c_ts": ts}
    if "lengths" in groups:
        found["c_len"] = F.char_length(v).cast("bigint")
    if "bytes" in groups:
        found["c_bytes"] = F.octet_length(v)
    if "validity" in groups:
        found |= {"c_at": F.contains(v, F.lit("@")), "c_email": X.is_strict_email(s)}
        if phone:
            is_phone_column = F.col("ordinal").isin(*map(str, phone))
            found["c_phone"] = F.when(is_phone_column, X.is_phone(s))
    if "texture" in groups:
        found |= {
            "c_near_empty": F.char_length(s) <= 1,
            "c_repetitive": X.is_repetitive(s),
            "c_spaced": X.has_spacing_problem(v, s),
        }
    return cells.withColumns(found).drop("s", "family", "ts"), list(found)


def _weighted(found: Sequence[str]) -> dict[str, Column]:
    """Aggregates over cell facts of which each stands for n cells."""
    n = F.col("n")
    total = lambda condition: F.sum(F.when(condition, n).otherwise(0))
    out = {"non_null": F.sum(n), "blank": total(F.col("c_blank"))}
    has = set(found)
    if "c_short" in has:
        out |= {
            "short_numbers": total(F.col("c_short")),
            "iso": total(F.col("c_family") == X.ISO),
            "delimited": total(F.col("c_family") == X.DELIMITED),
            "named": total(F.col("c_family") == X.NAMED),
            "dates": total(F.col("c_ts").isNotNull()),
            "dates_in_range": total(X.year_between(F.col("c_ts"), 1800, 2100)),
            "first_ts": F.min("c_ts"),
            "last_ts": F.max("c_ts"),
            "truth_bits": F.bit_or("c_truth"),
        }
    if "c_len" in has:
        length = F.col("c_len")
        out |= {
            "len_min": F.min("c_len"),
            "len_max": F.max("c_len"),
            "len_sum": F.sum(length * n),
            "len_squares": F.sum((length * length * n).cast("decimal(20,0)")),
        }
    if "c_bytes" in has:
        out["octets"] = F.sum(F.col("c_bytes") * n)
    if "c_email" in has:
        out |= {
            "at_sign": total(F.col("c_at")),
            "email_ok": total(F.col("c_email")),
            "stamps": total(F.col("c_ts").isNotNull()),
            "stamps_ok": total(X.year_between(F.col("c_ts"), 1800, 2150)),
        }
    if "c_phone" in has:
        out["phone_ok"] = total(F.col("c_phone"))
    if "c_repetitive" in has:
        out |= {
            "near_empty": total(F.col("c_near_empty")),
            "repetitive": total(F.col("c_repetitive")),
            "badly_spaced": total(F.col("c_spaced")),
        }
    return out


def _string_facts(long: DataFrame, groups: set[str], **options) -> DataFrame:
    """Facts of text columns straight from the cells: no shuffle of values."""
    cells, found = cell_facts(long.withColumn("n", F.lit(1).cast("bigint")), groups, **options)
    return _aggregate(cells, _weighted(found))


def _grouped_string_facts(long: DataFrame, groups: set[str], **options) -> DataFrame:
    """Facts and exact cardinality of text columns in one scan and one shuffle.

    Equal cells are combined first, map-side, and the patterns then run once per
    distinct value. A long text is looked at before the shuffle and travels as
    its SHA-256 together with what was found.
    """
    v = F.col("value")
    is_long = F.octet_length(v) > LONG_VALUE_BYTES
    keyed = long.withColumn("key", F.when(is_long, F.sha2(v, 256)).otherwise(v))
    keyed = keyed.withColumn("value", F.when(is_long, v))
    looked_at, found = cell_facts(keyed, groups, **options)
    before = F.when(v.isNotNull(), F.struct(*found)).alias("before")
    distinct = (
        looked_at.select("ordinal", "key", before)
        .groupBy("ordinal", "key", "before")
        .agg(F.count("*").alias("n"))
    )
    short = distinct.withColumn("value", F.when(F.col("before").isNull(), F.col("key")))
    after, _ = cell_facts(short, groups, **options)
    merged = after.select(
        "ordinal", "n", *[F.coalesce(F.col(f"before.{c}"), F.col(c)).alias(c) for c in found]
    )
    return _aggregate(merged, _weighted(found) | _cardinality_measures())


def _cardinality_measures() -> dict[str, Column]:
    n = F.col("n")
    return {
        "unique": F.count("*"),
        "top": F.max("n"),
        "repeated": F.sum(F.when(n > 1, n).otherwise(0)),
    }


# Columns per aggregate row, so that generated code stays within one method's size.
CHUNK = 16


def _plain_facts(df: DataFrame, ordinals: Sequence[int], groups: set[str]) -> list[DataFrame]:
    """Facts of numbers, booleans and times: a global aggregate needs no grouping."""
    fields = df.schema.fields
    out = []
    for start in range(0, len(ordinals), CHUNK):
        chunk = ordinals[start : start + CHUNK]
        aggregates, rows = [], []
        for i in chunk:
            measures = _measures(X.ref(fields[i].name), kind_of(fields[i].dataType), groups)
            aggregates += [c.alias(f"{n}_{i}") for n, c in measures.items()]
            row = [F.lit(str(i)).alias("ordinal")]
            row += [F.col(f"{n}_{i}").alias(n) for n in measures]
            rows.append((tuple(measures), F.struct(*row)))
        totals = df.agg(*aggregates)
        for names_ in dict.fromkeys(n for n, _ in rows):
            alike = F.array(*[row for n, row in rows if n == names_])
            out.append(totals.select(F.inline(alike)))
    return out


def _measures(c: Column, kind: str, groups: set[str]) -> dict[str, Column]:
    out = {"non_null": F.count(c)}
    if kind in NUMERIC:
        c = c.cast("double")
        if "numbers" in groups:
            out |= {"mn": F.min(c), "mx": F.max(c), "mean": F.avg(c), "sd": F.stddev_samp(c)}
        if "validity" in groups:
            out |= {"negatives": F.count_if(c < 0), "off_percent": F.count_if((c < 0) | (c > 100))}
    if kind == TEMPORAL and "types" in groups:
        c = c.cast("timestamp")
        out |= {"first_ts": F.min(c), "last_ts": F.max(c)}
    return out


def scan(df: DataFrame, groups: Iterable[str]) -> tuple[int, dict[int, dict]]:
    """Row count, and the requested facts per column ordinal, in one job.

    Groups: types, lengths, bytes, validity, texture, numbers, unique. Null and
    blank counts always come along. The result is a few small rows per column.
    """
    groups = set(groups)
    fields = df.schema.fields
    parts: list[DataFrame] = [df.agg(F.lit("-1").alias("ordinal"), F.count("*").alias("rows"))]

    strings = by_kind(df, STRING)
    if strings:
        long = melt(df, strings, "string")
        dated = [i for i in strings if names.is_dated(fields[i].name)]
        options = {
            "phone": [i for i in strings if names.is_phone(fields[i].name)],
            "dated": None if "types" in groups else dated,
        }
        facts = _grouped_string_facts if "unique" in groups else _string_facts
        parts.append(facts(long, groups, **options))

    others = by_kind(df, *NUMERIC, BOOLEAN, TEMPORAL)
    parts += _plain_facts(df, others, groups)
    if "unique" in groups and others:
        parts += [_aggregate(c, _cardinality_measures()) for c in value_counts(df, others)]

    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows, found = 0, {}
    for r in _dates_as_text(merged).collect():
        values = {n: v for n, v in r.asDict().items() if v is not None and n != "ordinal"}
        if r["ordinal"] == "-1":
            rows = values["rows"]
        else:
            found.setdefault(int(r["ordinal"]), {}).update(values)
    return rows, {i: _completed(found.get(i, {}), groups) for i in range(len(fields))}


def _dates_as_text(facts: DataFrame) -> DataFrame:
    """Inside Spark, so that the session time zone decides and not the driver's."""
    if "first_ts" not in facts.columns:
        return facts
    return (
        facts.withColumn("earliest", X.text(F.col("first_ts")))
        .withColumn("latest", X.text(F.col("last_ts")))
        .drop("first_ts", "last_ts")
    )


def _completed(values: dict, groups: set[str]) -> dict:
    """Defaults for columns without values; length mean and deviation from exact sums."""
    out = {"non_null": 0} | values
    if "unique" in groups:
        out = {"unique": 0, "top": 0, "repeated": 0} | out
    squares = out.pop("len_squares", None)
    if squares is not None:
        n, total = out["non_null"], out["len_sum"]
        out["len_mean"] = total / n
        spread = n * int(squares) - total * total
        out["len_sd"] = math.sqrt(spread / (n * (n - 1))) if n > 1 else None
    return out


def date_facts(long: DataFrame) -> dict[int, dict]:
    """The type facts of (ordinal, value) text rows, except the truth words."""
    facts = _dates_as_text(_string_facts(long, {"types"}))
    found = {}
    for r in facts.drop("blank", "truth_bits").collect():
        values = r.asDict()
        # detection compares these counts with the size of the sample
        values["date_values"] = values.pop("non_null")
        found[int(values.pop("ordinal"))] = values
    return found


def first_format_facts(df: DataFrame, order_by: Sequence[str], order: DataFrame) -> dict[int, dict]:
    """Date facts when a column's first value fixes the format of all its values.

    order is the table with its order_by columns. Columns whose first value is
    no date are left out; they keep the value-by-value reading.
    """
    fields = df.schema.fields
    keys = [X.ref(c) for c in order_by]
    s = X.strip(F.col("value"))
    out = {}
    for i in by_kind(df, STRING):
        c = X.ref(fields[i].name)
        first = order.where(c.isNotNull()).orderBy(*keys).limit(1).select(c.alias("value"))
        number = F.regexp_extract(s, r"^(\d{1,2})[-/]", 1)
        seen = first.select(
            X.date_shape(s).alias("shape"), (number.try_cast("int") > 12).alias("day_first")
        ).first()
        if seen is None or seen["shape"] is None:
            continue
        shape, day_first = F.lit(seen["shape"]), F.lit(bool(seen["day_first"]))
        cells = melt(df, [i], "string").select(
            F.when(X.date_shape(s) == shape, X.parse_date(s, day_first=day_first)).alias("ts")
        )
        facts = cells.agg(
            F.count("ts").alias("dates"),
            F.count("ts").alias("stamps"),
            F.count_if(X.year_between(F.col("ts"), 1800, 2100)).alias("dates_in_range"),
            F.count_if(X.year_between(F.col("ts"), 1800, 2150)).alias("stamps_ok"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        out[i] = _dates_as_text(facts).first().asDict()
    return out


def _aggregate(long: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return long.groupBy("ordinal").agg(*[c.alias(n) for n, c in measures.items()])


# ---- exact cardinality --------------------------------------------------------------


def value_counts(df: DataFrame, ordinals: Sequence[int], whole: bool = False) -> list[DataFrame]:
    """(ordinal, value, n) per kind of column: every distinct value with its count.

    A value held by a third of the rows collapses to one row per task before the
    shuffle. Unless whole values are asked for, times and booleans are counted as
    integers and a long text travels as its SHA-256, so near-unique text columns
    do not shuffle their text.
    """
    fields = df.schema.fields
    classes: dict[str, list[int]] = {}
    for i in ordinals:
        classes.setdefault(_counted_as(fields[i].dataType, whole), []).append(i)
    out = []
    for as_type, members in classes.items():
        keys = ["ordinal", "value"]
        if as_type == "bigint":
            long = melt(df, members, as_type, _as_integer)
        else:
            long = melt(df, members, as_type)
        if as_type == "string" and not whole:
            v = F.col("value")
            is_long = F.octet_length(v) > LONG_VALUE_BYTES
            shortened = F.when(is_long, F.sha2(v, 256)).otherwise(v)
            long = long.withColumns({"value": shortened, "is_long": is_long})
            keys.append("is_long")
        out.append(long.groupBy(*keys).agg(F.count("*").alias("n")))
    return out


def _counted_as(data_type: T.DataType, whole: bool) -> str:
    kind = kind_of(data_type)
    if kind == INTEGRAL or (kind in (BOOLEAN, TEMPORAL) and not whole):
        return "bigint"
    if kind == FRACTIONAL and not isinstance(data_type, T.DecimalType):
        return "double"
    return {TEMPORAL: "timestamp", BOOLEAN: "boolean"}.get(kind, "string")


def _as_integer(c: Column, data_type: T.DataType) -> Column:
    if kind_of(data_type) == TEMPORAL:
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("bigint")


def cardinality(df: DataFrame, ordinals: Sequence[int] | None = None) -> dict[int, dict]:
    """Exact distinct count, top frequency and rows with a repeated value."""
    ordinals = range(len(df.columns)) if ordinals is None else ordinals
    if not list(ordinals):
        return {}
    parts = [_aggregate(counts, _cardinality_measures()) for counts in value_counts(df, ordinals)]
    found = {
        int(r["ordinal"]): {"unique": r["unique"], "top": r["top"], "repeated": r["repeated"]}
        for r in reduce(DataFrame.unionByName, parts).collect()
    }
    empty = {"unique": 0, "top": 0, "repeated": 0}
    return {i: found.get(i, empty) for i in ordinals}


def approximate_cardinality(df: DataFrame) -> DataFrame:
    """HyperLogLog distinct counts in one scan without a shuffle of values (opt-in)."""
    fields = df.schema.fields
    wide = df.agg(
        *[F.approx_count_distinct(X.ref(f.name)).alias(str(i)) for i, f in enumerate(fields)]
    )
    rows = wide.unpivot([], [X.ref(str(i)) for i in range(len(fields))], "ordinal", "unique")
    label = F.element_at(
        F.array(*[F.lit(f.name) for f in fields]), F.col("ordinal").cast("int") + 1
    )
    return rows.select(
        F.col("ordinal").cast("int").alias("ordinal"), label.alias("column"), "unique"
    )


# ---- second scan, only of columns that can matter -----------------------------------


def beyond_limits(
    df: DataFrame, fences: dict[int, tuple[float, float]], limits: dict[int, int]
) -> dict[int, int]:
    """Count values outside numeric fences and texts at or above a length limit.

    Callers pass only columns whose extremes reach the limit, so most tables
    need no second scan and the others read just those columns.
    """
    fields = df.schema.fields
    aggregates = []
    for i, (low, high) in fences.items():
        c = X.ref(fields[i].name).cast("double")
        aggregates.append(F.count_if((c < low) | (c > high)).alias(str(i)))
    for i, limit in limits.items():
        c = X.ref(fields[i].name)
        aggregates.append(F.count_if(F.char_length(c) >= limit).alias(str(i)))
    if not aggregates:
        return {}
    return {int(i): n for i, n in df.agg(*aggregates).first().asDict().items()}


def constant_values(df: DataFrame, ordinals: Sequence[int]) -> dict[int, str]:
    """The start of the one value of each constant column, enough to show it."""
    if not ordinals:
        return {}
    fields = df.schema.fields
    picks = [
        F.substring(X.text(F.any_value(X.ref(fields[i].name), F.lit(True))), 1, 41).alias(str(i))
        for i in ordinals
    ]
    return {int(i): v for i, v in df.agg(*picks).first().asDict().items()}
