"""JSON files in their eight shapes.

JSON Lines are read in parallel, and so are large documents: byte ranges cut them into
elements (see ranges), which are written once as JSON Lines. Documents up to LARGE_BYTES
are read by one task each.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import constants as k
from plumbline.functions import exprs as X
from plumbline.session import shared_folder
from plumbline.sources import ranges
from plumbline.sources.flatten import flatten, nested_to_json

SHAPES = (
    "empty", "lines", "records", "scalars", "wrapper", "record_map", "columns", "object",
)

#: Files beyond this are cut by byte ranges; rows are the same either way, but for line
#: breaks inside a nested cell of mixed types, whose text then has spaces for them.
LARGE_BYTES = 64 << 20
#: A large file with longer lines than this on average is no JSON Lines.
LINE_BYTES = 16 << 20


class JsonError(ValueError):
    """Neither JSON nor JSON Lines."""


def read_json(spark: SparkSession, path: str, large: int = LARGE_BYTES) -> DataFrame:
    """Any of the shapes as a table; nested cells that stay are JSON text.

    Each file of a folder has its own shape. Files of one shape are read together, the
    tables are united by column names, and a column that a file lacks is null. Documents
    of more than ``large`` bytes are read by many tasks.
    """
    parts = [
        (_read_split if split else _read_shape)(spark, files, shape, key)
        for shape, key, split, files in _file_shapes(spark, path, large)
    ]
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_shape(spark: SparkSession, path: list[str], shape: str, key: str | None) -> DataFrame:
    if shape == "lines":
        return nested_to_json(read_json_lines(spark, path))
    if shape == "scalars":
        return nested_to_json(_scalars(spark, path))
    doc = _document(spark, path)
    if shape == "records":
        return nested_to_json(flatten(_ordered(doc, _first_keys(spark, path, "$[0]"))))
    if shape == "wrapper":
        rows = doc.select(F.explode(X.ref(key)).alias("r")).select("r.*")
        return nested_to_json(flatten(_ordered(rows, _first_keys(spark, path, f"$.{key}[0]"))))
    names = _first_keys(spark, path, "$")
    if shape == "record_map":
        return nested_to_json(_record_map(spark, path, doc, names))
    if shape == "columns":
        ordered = _ordered(doc, names).columns
        zipped = F.arrays_zip(*[X.ref(c) for c in ordered])
        return nested_to_json(doc.select(F.inline(zipped)).toDF(*ordered))
    return nested_to_json(_ordered(doc, names))


def detect_shape(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The shape of one file, with the wrapping key where there is one."""
    found = file_shapes(spark, path)
    shape, key, _ = found[0] if found else ("empty", None, [])
    return shape, key if shape == "wrapper" else None


def file_shapes(
    spark: SparkSession, path: str, large: int = LARGE_BYTES
) -> list[tuple[str, str | None, list[str]]]:
    """(shape, key, files) for the files with content, by the name of the first file.

    A file is JSON Lines if it has several lines and the first is JSON; that is seen line
    by line. Only other files are looked at whole, large ones in byte ranges. Names of
    files reach the driver.
    """
    return [(shape, key, files) for shape, key, _, files in _file_shapes(spark, path, large)]


def _file_shapes(spark: SparkSession, path: str, large: int) -> list[tuple[str, str | None, bool, list[str]]]:
    listed = spark.read.format("binaryFile").load(path)  # names and sizes alone, no content
    sizes = listed.select("_metadata.file_path", "_metadata.file_size").collect()
    big = sorted(unquote(r["file_path"]) for r in sizes if r["file_size"] > large)
    long = _long_lined(spark, big) if big else []
    rest = sorted({unquote(r["file_path"]) for r in sizes} - set(long))
    by_file = _line_facts(spark, rest) if rest else {}
    shapes = {f: ("lines", None) for f, r in by_file.items() if r["n"] > 1 and r["first_ok"]}
    split = sorted((set(big) & set(by_file)) - set(shapes)) + long
    small = sorted(set(by_file) - set(shapes) - set(split))
    found = {}
    if small:
        whole = _whole(spark, small).select("file", *_shape()).collect()
        found |= {unquote(r["file"]): (r["shape"], r["key"]) for r in whole}
    if split:
        found |= _split_shapes(spark, split)
    unread = [f for f, (shape, _) in found.items() if shape is None and f not in by_file]
    by_file |= _line_facts(spark, unread) if unread else {}
    for file, (shape, key) in found.items():
        if shape is None and not (file in by_file and by_file[file]["any_ok"]):
            raise JsonError(f"{file} is neither JSON nor JSON Lines")
        shapes[file] = ("lines", None) if shape is None else (shape, key)
    groups: dict[tuple, list[str]] = {}
    for file in sorted(shapes):
        shape, key = shapes[file]
        if shape != "empty":
            groups.setdefault((shape, key, file in split and shape not in ("lines", "object")), []).append(file)
    return [(*group, files) for group, files in groups.items()]


def _line_facts(spark: SparkSession, files: list[str]) -> dict[str, Row]:
    """By file: lines with content, whether the first is JSON, whether any is."""
    value = X.strip(F.regexp_replace("value", "^\ufeff", ""))
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
        value.alias("value"),
    )
    lines = lines.where("value <> ''").withColumn("ok", F.try_parse_json("value").isNotNull())
    facts = lines.groupBy("file").agg(
        F.count("*").alias("n"), F.min_by("ok", "at").alias("first_ok"), F.max("ok").alias("any_ok")
    )
    return {unquote(r["file"]): r for r in facts.collect()}


def _long_lined(spark: SparkSession, files: list[str]) -> list[str]:
    """The files whose lines are too long on average to be read as lines."""
    parts = spark.read.option("lineSep", ranges.MARK).text(files)
    ends = F.char_length("value") - F.char_length(F.replace("value", F.lit("\n"), F.lit("")))
    counts = parts.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    rows = counts.agg(F.sum(ends).alias("ends")).collect()
    return sorted(unquote(r["file"]) for r in rows if r["size"] > LINE_BYTES * (r["ends"] + 1) or not r["ends"])


def _shape() -> tuple[Column, Column]:
    """shape and key of a whole text; key sets files of one shape apart that differ in it."""
    v = F.try_parse_json("value")

    def kind(x: Column) -> Column:
        return F.schema_of_variant(x)

    top = kind(v)
    first = kind(F.try_variant_get(v, "$[0]", "variant"))
    wrapper = F.coalesce(
        *[
            F.when(kind(F.try_variant_get(v, f"$.{name}[0]", "variant")).startswith("OBJECT"), name)
            for name in k.JSON_WRAPPER_KEYS
        ]
    )
    fields = F.try_variant_get(v, "$", "map<string, variant>")
    kinds = F.transform(F.map_values(fields), kind)
    several = F.size(kinds) > 0
    lists = F.try_variant_get(v, "$", "map<string, array<variant>>")
    sizes = F.array_distinct(F.transform(F.map_values(lists), F.size))
    columns = several & F.forall(kinds, lambda x: x.startswith("ARRAY")) & (F.size(sizes) == 1)
    shape = (
        F.when(top.isNull(), None)
        .when(top == "ARRAY<VOID>", "empty")
        .when(top.startswith("ARRAY") & first.startswith("OBJECT"), "records")
        .when(top.startswith("ARRAY"), "scalars")
        .when(~top.startswith("OBJECT"), "empty")
        .when(wrapper.isNotNull(), "wrapper")
        .when(several & F.forall(kinds, lambda x: x.startswith("OBJECT")), "record_map")
        .when(columns, "columns")
        .otherwise("object")
    )
    names = F.to_json(F.array_sort(F.map_keys(fields)))
    key = F.when(shape == "wrapper", wrapper).when(shape == "columns", names)
    return shape.alias("shape"), key.alias("key")


# ---- JSON Lines ---------------------------------------------------------------------


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Flattened records; lines that do not parse are dropped (see dropped_lines)."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).json(path)
    first = (
        _lines(spark, path)
        .where(F.try_parse_json("value").isNotNull())
        .select(F.json_object_keys("value").alias("names"))
        .first()
    )
    return flatten(_ordered(df, list(first["names"] or []) if first else []))


def dropped_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row: lines with content, and lines the reader drops since they are no record."""
    parsed = F.try_parse_json("value")
    record = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return _lines(spark, path).agg(
        F.count("*").alias("lines"), F.count_if(~record).alias("dropped")
    )


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    value = X.strip(F.regexp_replace("value", "^\ufeff", ""))
    return spark.read.text(path).select(value.alias("value")).where("value <> ''")


# ---- one document -------------------------------------------------------------------


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): each file as one text."""
    value = X.strip(F.regexp_replace("value", "^\ufeff", ""))
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), value.alias("value"))


def _document(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def _first_keys(spark: SparkSession, path: str | list[str], where: str) -> list[str]:
    """Key order of an object in the file; Spark infers columns alphabetically."""
    names = F.json_object_keys(F.get_json_object("value", where))
    first = _whole(spark, path).orderBy("file").select(names.alias("names")).first()
    return list(first["names"] or [])


def _ordered(df: DataFrame, names: list[str]) -> DataFrame:
    first = [c for c in names if c in df.columns]
    return df.select(*[X.ref(c) for c in first + [c for c in df.columns if c not in first]])


def _record_map(
    spark: SparkSession, path: str | list[str], doc: DataFrame, names: list[str]
) -> DataFrame:
    """{"r1": {...}, "r2": {...}} as rows; the keys are not kept."""
    record = reduce(_merged, (f.dataType for f in doc.schema.fields))
    rows = _whole(spark, path).select(
        F.explode(F.from_json("value", T.MapType(T.StringType(), record))).alias("key", "r")
    )
    order = _first_keys(spark, path, f"$['{names[0]}']")
    return _ordered(rows.select("r.*"), order)


def _merged(a: T.StructType, b: T.StructType) -> T.StructType:
    types = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        known = types.get(f.name, f.dataType)
        if known == f.dataType:
            types[f.name] = known
        elif isinstance(known, T.NumericType) and isinstance(f.dataType, T.NumericType):
            types[f.name] = T.DoubleType()
        else:
            types[f.name] = T.StringType()
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def _scalars(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _typed_scalars(
        _whole(spark, path).select(
            F.explode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("e")
        )
    )


def _typed_scalars(elements: DataFrame) -> DataFrame:
    kind = elements.select(F.schema_of_variant_agg("e").alias("kind")).first()["kind"]
    if kind in ("BIGINT", "BOOLEAN", "STRING", "DOUBLE"):
        as_type = kind.lower()
    elif kind.startswith("DECIMAL"):
        as_type = "double"
    else:
        as_type = "string"
    return elements.select(F.try_variant_get("e", "$", as_type).alias("value"))


# ---- large documents ----------------------------------------------------------------

#: A member of an object: its name, and what follows the colon.
MEMBER = r'(?s)^"((?:[^"\\]|\\.)*)"\s*:\s*(.*)$'


def _elements(segments: DataFrame) -> DataFrame:
    """(file, members, value) of documents cut at the first level."""
    return ranges.joined(segments.filter(F.col("kind") == ranges.FIRST), "members")


def _members(segments: DataFrame) -> DataFrame:
    """(file, members, name, begins) of objects cut at the second level.

    begins is the first character of the member's value.
    """
    outer = segments.filter(F.col("kind") == ranges.FIRST)
    # a member's own text ends where its value opens, or at the comma if it is a scalar
    pieces = F.array_sort(F.collect_list(F.struct("block", "part", "items", "value")))
    closing = F.col("whole") & X.strip(F.col("value")).isin(",", "}")
    named = outer.filter(~closing).groupBy("file", "members").agg(pieces.alias("p"))
    text = X.strip(F.array_join("p.value", ""))
    return named.select(
        "file",
        "members",
        F.from_json(F.concat(F.lit('["'), F.regexp_extract(text, MEMBER, 1), F.lit('"]')), "array<string>")[0].alias("name"),
        F.substring(F.regexp_extract(text, MEMBER, 2), 1, 1).alias("begins"),
    )


def _split_shapes(spark: SparkSession, files: list[str]) -> dict[str, tuple[str | None, str | None]]:
    """Shape and key of each file, None where it isn't one document."""
    segments = ranges.segments(spark, files, 1)
    bare = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"[ \t\r\n]", "")
    beyond, last = F.col("kind") == ranges.BEYOND, F.expr("right(value, 1)")
    closes = (F.col("kind") == ranges.FIRST) & F.col("ended") & last.isin("]", "}")
    facts = segments.groupBy("file").agg(
        F.count_if(beyond & F.col("ended")).alias("opened"),
        F.sum(F.when(beyond, F.char_length(bare)).otherwise(0)).alias("beyond"),
        F.max(F.when(beyond & F.col("ended"), last)).alias("root"),
        F.max(F.when(closes, last)).alias("close"),
        F.max_by(F.when(~F.col("ended"), F.col("kind")), F.when(~F.col("ended"), F.struct("block", "part"))).alias("ends_in"),
    )
    one = (F.col("opened") == 1) & (F.col("beyond") <= 2) & (F.col("ends_in") == ranges.BEYOND)
    one = one & F.concat("root", "close").isin("[]", "{}")
    facts = facts.withColumn("one", F.coalesce(one, F.lit(False)))
    value = F.when(F.col("root") == "{", F.concat(F.lit("{"), "value", F.lit("}"))).otherwise(F.col("value"))
    elements = _elements(segments).join(facts.filter("one").select("file", "root"), "file")
    checked = elements.groupBy("file").agg(
        F.count("*").alias("n"),
        F.count_if(F.try_parse_json(value).isNull()).alias("bad"),
        F.min_by("value", "members").alias("first"),
    )
    out: dict[str, tuple[str | None, str | None]] = {}
    objects = []
    for r in facts.join(checked, "file", "left").select(
        "file", "one", "root", "n", "bad", (F.col("first") == "").alias("blank"), F.col("first").startswith("{").alias("nested")
    ).collect():
        file = unquote(r["file"])
        if not r["one"] or r["bad"] > (1 if r["n"] == 1 and r["blank"] else 0):
            out[file] = (None, None)
        elif r["root"] == "[":
            out[file] = ("empty" if r["blank"] else "records" if r["nested"] else "scalars", None)
        elif r["blank"]:
            out[file] = ("object", None)
        else:
            objects.append(file)
    if objects:
        out |= _object_shapes(ranges.segments(spark, objects, 2))
    return out


def _object_shapes(segments: DataFrame) -> dict[str, tuple[str | None, str | None]]:
    inner = segments.filter(F.col("kind") == ranges.BELOW)
    filled = F.col("value").rlike(r"[^\s,\]}]")
    sizes = inner.groupBy("file", "members").agg(
        (F.max("items") - F.min("items") + 1).alias("size"), F.max(filled).alias("filled")
    )
    begin = inner.filter(filled).groupBy("file", "members").agg(
        F.min_by(F.substring(X.strip(F.col("value")), 1, 1), F.struct("items", "block", "part")).alias("first")
    )
    rows = _members(segments).join(sizes, ["file", "members"], "left").join(begin, ["file", "members"], "left")
    size = F.when(F.col("filled"), F.col("size")).otherwise(0)
    rank = F.array_position(F.array(*[F.lit(n) for n in k.JSON_WRAPPER_KEYS]), F.col("name"))
    wraps = (F.col("begins") == "[") & (F.col("first") == "{") & (rank > 0)
    is_list = F.col("begins") == "["
    facts = rows.groupBy("file").agg(
        F.min(F.when(wraps, rank)).alias("wrapper"),
        F.bool_and(F.col("begins") == "{").alias("objects"),
        F.bool_and(is_list).alias("lists"),
        (F.min(size) == F.max(size)).alias("even"),
        F.to_json(F.array_sort(F.collect_list(F.when(is_list, F.col("name"))))).alias("names"),
    )
    out = {}
    for r in facts.collect():
        if r["wrapper"]:
            found = ("wrapper", k.JSON_WRAPPER_KEYS[r["wrapper"] - 1])
        elif r["objects"]:
            found = ("record_map", None)
        elif r["lists"] and r["even"]:
            found = ("columns", r["names"])
        else:
            found = ("object", None)
        out[unquote(r["file"])] = found
    return out


def _read_split(spark: SparkSession, files: list[str], shape: str, key: str | None) -> DataFrame:
    """As _read_shape, by many tasks a file."""
    if shape in ("records", "scalars", "record_map"):
        rows = _elements(ranges.segments(spark, files, 1)).filter("value <> ''")
        order = F.struct("file", "members")
        if shape == "scalars":
            return nested_to_json(_typed_scalars(rows.select(F.try_parse_json("value").alias("e"))))
        if shape == "record_map":
            rows = rows.withColumn("value", F.regexp_extract("value", MEMBER, 2))
        return _records(rows, order, flat=shape == "records")
    segments = ranges.segments(spark, files, 2)
    members = _members(segments)
    items = ranges.joined(segments.filter(F.col("kind") == ranges.BELOW), "members", "items").filter("value <> ''")
    if shape == "wrapper":
        chosen = members.filter(F.col("name") == key).select("file", "members")
        return _records(items.join(chosen, ["file", "members"]), F.struct("file", "items"))
    first = items.groupBy("file", "members").agg(F.min("items").alias("first"))
    cells = items.join(first, ["file", "members"]).join(members, ["file", "members"])
    name = F.expr("substring(to_json(array(name)), 2, char_length(to_json(array(name))) - 2)")
    cell = F.struct("members", F.concat(name, F.lit(":"), "value").alias("text"))
    rows = cells.groupBy("file", (F.col("items") - F.col("first")).alias("row")).agg(
        F.array_sort(F.collect_list(cell)).alias("cells")
    )
    text = F.concat(F.lit("{"), F.array_join("cells.text", ","), F.lit("}"))
    return _records(rows.select("file", "row", text.alias("value")), F.struct("file", "row"), flat=False)


def _records(rows: DataFrame, order: Column, flat: bool = True) -> DataFrame:
    """Objects in column value as a table, their columns ordered as in the first of them."""
    spark = rows.sparkSession
    path = shared_folder(spark)
    # a line break inside a document is white space: strings have it escaped
    rows.select(F.regexp_replace("value", r"[\r\n]+", " ")).write.text(path)
    found = rows.agg(F.min_by(F.json_object_keys("value"), order).alias("names")).first()
    table = _ordered(spark.read.json(path), list(found["names"] or []))
    return nested_to_json(flatten(table) if flat else table)
