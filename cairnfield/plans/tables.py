"""Result tables: filters, natural sorting, pages, and CSV, JSON and GeoJSON export.

Geometry columns are arrays of doubles (a point), or arrays of those (segment, polyline, polygon).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, NumericType, StringType, StructType

from cairnfield.operators.sequence import ORD, Seq, dense_index

ROW_CAP = 100_000


def column_types(df: DataFrame) -> dict[str, str]:
    """The result type of each column: number, string, bool, point or polyline."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType
        if f.metadata.get("geo"):
            out[f.name] = f.metadata["geo"]
        elif isinstance(t, NumericType):
            out[f.name] = "number"
        elif isinstance(t, BooleanType):
            out[f.name] = "bool"
        elif isinstance(t, ArrayType) and isinstance(t.elementType, DoubleType):
            out[f.name] = "point"
        elif isinstance(t, ArrayType) and isinstance(t.elementType, ArrayType):
            out[f.name] = "polyline"
        elif isinstance(t, StructType) and {"x", "y", "z"} <= set(t.names):
            out[f.name] = "entityRef" if "id" in t.names else "point"
        else:
            out[f.name] = "string"
    return out


def project(df: DataFrame) -> DataFrame:
    """A query's rows as a result table: entity cells become their id and, right after it, a point."""
    cols: list[Column] = []
    for name, kind in column_types(df).items():
        c = F.col(f"`{name}`")
        is_struct = isinstance(df.schema[name].dataType, StructType)
        if kind == "entityRef":
            cols += [c["id"].alias(name), F.when(c.isNotNull(), F.array(c["x"], c["y"], c["z"])).alias(f"{name}.position")]
        elif kind == "point" and is_struct:
            cols.append(F.when(c.isNotNull(), F.array(c["x"], c["y"], c["z"])).alias(name))
        elif kind == "string" and not isinstance(df.schema[name].dataType, StringType):
            cols.append(F.to_json(c).alias(name) if isinstance(df.schema[name].dataType, (StructType, ArrayType)) else c.cast("string").alias(name))
        else:
            cols.append(c)
    return df.select(*cols)


def capped(df: DataFrame, cap: int = ROW_CAP) -> tuple[DataFrame, str | None]:
    """The first ``cap`` rows by ord, and a warning if there are more; counts only then."""
    if df.limit(cap + 1).count() <= cap:
        return df, None
    return df.orderBy(ORD).limit(cap), f"truncated from {df.count()}"


def cell_text(c: Column, kind: str) -> Column:
    """Display text: null is empty, numbers to 3 places without trailing zeros."""
    if kind == "number":
        text = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", c.cast("double")), r"0+$", ""), r"\.$", "")
        return F.coalesce(text, F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def text_filter(df: DataFrame, column: str, query: str) -> Column:
    """Contains, ignoring case; in number columns also ``< <= > >= =`` and a number."""
    kind, q = column_types(df)[column], query.strip()
    c = F.col(f"`{column}`")
    if kind == "number":
        for op in ("<=", ">=", "<", ">", "="):
            if q.startswith(op):
                try:
                    v = F.lit(float(q[len(op) :]))
                except ValueError:
                    break
                return {"<=": c <= v, ">=": c >= v, "<": c < v, ">": c > v, "=": c == v}[op]
    return F.contains(F.lower(cell_text(c, kind)), F.lit(q.lower()))


def _padded(digits: Column, width: int) -> Column:
    """Zeros up to ``width``; longer runs stay whole, after all shorter ones by their length in front."""
    long = F.length(digits) > width
    return F.when(long, F.concat(F.lit("~"), F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(F.lpad(digits, width, "0"))


def natural_key(c: Column, width: int = 20) -> Column:
    """A text key that sorts digit runs by value, ignoring case: runs are padded with zeros."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), _padded(F.regexp_replace(r, r"^0+(?=\d)", ""), width)).otherwise(r)), "")


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    page: int
    pages: int
    first: int
    last: int
    total: int


def _filtered(df: DataFrame, filters: dict[str, str] | None) -> DataFrame:
    for name, q in (filters or {}).items():
        if q.strip():
            df = df.where(text_filter(df, name, q))
    return df


def _sort_key(df: DataFrame, sort: str, descending: bool) -> Column:
    kind, c = column_types(df)[sort], F.col(f"`{sort}`")
    key = c if kind == "number" else c.cast("int") if kind == "bool" else natural_key(F.nullif(cell_text(c, kind), F.lit("")))
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


def view(df: DataFrame, filters: dict[str, str] | None = None, sort: str | None = None, descending: bool = False) -> DataFrame:
    """Filter by all given columns and sort; blanks come last both ways and ties keep their order."""
    df = _filtered(df, filters)
    return df.orderBy(ORD) if sort is None else df.orderBy(_sort_key(df, sort, descending), F.col(ORD).asc())


#: A page that ends within this many rows is the end of a top-k; a later one is found by position.
SHALLOW = 100_000


def page(df: DataFrame, number: int, size: int, filters: dict[str, str] | None = None, sort: str | None = None, descending: bool = False) -> Page:
    """The rows of one page in order, and where it stands. ``number`` is clamped to the pages there are."""
    rows = _filtered(df, filters)
    total = rows.count()
    pages = max(1, -(-total // size))
    at = min(max(number, 1), pages)
    first = (at - 1) * size
    if first + size <= SHALLOW:
        got = view(rows, None, sort, descending).limit(first + size).offset(first)
    else:
        kept = rows.withColumn("__own", F.col(ORD))
        settled = Seq(kept, () if sort is None else (_sort_key(rows, sort, descending),)).settled().df
        got = dense_index(settled, name="__at").where(F.col("__at").between(first, first + size - 1)).orderBy("__at")
        got = got.withColumn(ORD, F.col("__own")).select(*rows.columns)
    return Page(got, at, pages, first + 1 if total else 0, min(first + size, total), total)


# exports -------------------------------------------------------------------------------------


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line a row (column ``line``), quoted only where needed; geometry as JSON. ``ord`` is kept, not written."""
    fields = []
    for f in df.schema.fields:
        if f.name == ORD:
            continue
        c = F.col(f"`{f.name}`")
        text = F.to_json(c) if isinstance(f.dataType, (ArrayType, StructType)) else c.cast("string")
        text = F.coalesce(text, F.lit(""))
        fields.append(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return df.select(ORD, F.concat_ws(",", *fields).alias("line"))


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature (JSON text) for each row and geometry column that isn't null."""
    kinds = column_types(df)
    shapes = {"point": "Point", "segment": "LineString", "polyline": "LineString", "polygon": "Polygon"}
    geo = [n for n, k in kinds.items() if k in shapes]
    rest = [n for n in kinds if n not in geo and n != ORD]
    props = F.struct(*[F.col(f"`{n}`") for n in rest]) if rest else F.from_json(F.lit("{}"), "struct<none:string>")
    features = [
        F.when(
            F.col(f"`{n}`").isNotNull(),
            F.concat(
                F.lit(f'{{"type":"Feature","geometry":{{"type":"{shapes[kinds[n]]}","coordinates":'),
                F.to_json(F.array(F.col(f"`{n}`")) if kinds[n] == "polygon" else F.col(f"`{n}`")),
                F.lit(f'}},"properties":{{"geometry":"{n}","row":'), F.to_json(props, {"ignoreNullFields": "false"}), F.lit("}}"),
            ),
        )
        for n in geo
    ]
    return df.select(ORD, F.posexplode(F.array_compact(F.array(*features))).alias("part", "feature"))


def with_row_ids(df: DataFrame, entity: str | None = None) -> DataFrame:
    """``row_id``: the id of the row's entity if it has one, else its position."""
    placed = dense_index(df, name="__at")
    ident = F.col("__at").cast("string") if entity is None else F.coalesce(F.col(entity).cast("string"), F.col("__at").cast("string"))
    return placed.withColumn("row_id", ident).drop("__at")


def file_name(kind: str, provisional: bool) -> str:
    """Name of an exported file; CSV has no other place to say that a result is provisional."""
    ending = {"csv": "csv", "json": "json", "geojson": "geojson", "annotations": "annotations.json"}[kind]
    return f"query-result{'.provisional' if provisional else ''}.{ending}"


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON array a row (column ``line``), its cells in column order and nulls kept."""
    cells = [F.coalesce(F.regexp_replace(F.to_json(F.array(F.col(f"`{c}`")), {"ignoreNullFields": "false"}), r"^\[|\]$", ""), F.lit("null")) for c in df.columns if c != ORD]
    return df.select(ORD, F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("line"))


def json_header(df: DataFrame, provisional: bool, **meta: str) -> str:
    """What stands around the rows of a JSON export: columns, and the metadata given."""
    kinds = column_types(df)
    columns = [{"name": c, "type": k} for c, k in kinds.items() if c != ORD]
    return json.dumps({"columns": columns, "metadata": {"provisional": provisional} | meta}, sort_keys=True, separators=(",", ":"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def unique_ids(df: DataFrame, base: str) -> Column:
    """The base id, then base#2, base#3 ... in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(ORD))
    return F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), n.cast("string")))


def compare_facts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer comparison of two (fact, value) tables: fact, before, after, same."""
    b, a = before.select("fact", F.col("value").alias("before")), after.select("fact", F.col("value").alias("after"))
    return b.join(a, "fact", "full_outer").withColumn("same", F.col("before").eqNullSafe(F.col("after")))
