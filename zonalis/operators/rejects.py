"""Loading of comma-separated deliveries with the unusable rows set apart, each with its reasons.

The parsed cells are exploded into (row, column, value), joined with a rule table and judged there; the errors are
aggregated by row and the clean rows are what the anti-join with them leaves.  All of it is native expressions.

A delivery record reads well if it has exactly the fields of the schema.  A field that begins with a quote ends with
one directly before the next comma or the end and holds inner quotes doubled; it may hold commas and line feeds.  Any
other field holds no quote.  One carriage return at the very end of a record is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.projection import EPSG_6372, forward


@dataclass(frozen=True)
class Rule:
    """What one column must hold.  kind: text, integer (digits alone) or decimal; empty: whether it may be blank."""

    column: str
    kind: str = "text"
    low: float | None = None
    high: float | None = None
    empty: bool = True


DENUE_RULES = (
    Rule("denue_id", "integer", 1, 2147483647, empty=False),
    *(Rule(c) for c in ("clee", "nombre_unidad", "razon_social", "scian_codigo", "scian_nombre", "estrato_personal",
                        "cve_ent", "cve_mun", "cve_loc", "ageb_id", "manzana_id")),
    Rule("latitud", "decimal", -90, 90),
    Rule("longitud", "decimal", -180, 180),
    Rule("fecha_alta"),
)

#: Whole values: unlike $, \z doesn't match before a final line feed.
INTEGER, DECIMAL = r"\A[0-9]+\z", r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_ESC, _ESC_SELF, _ESC_COMMA = "\u0001", "\u0001a", "\u0001b"


def cells(raw: Column) -> Column:
    """array<struct<value string, sound boolean>> of a record's fields; `sound` tells whether its quoting is right.

    Quotes toggle between outside and inside; commas inside are hidden while the record is split at the others.  Where
    every field is sound this is the grammar above; where one isn't, the record is bad under either reading.
    """
    text = F.when(F.endswith(raw, F.lit("\r")), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    outside = lambda s: F.replace(s, F.lit(_ESC), F.lit(_ESC_SELF))
    inside = lambda s: F.replace(outside(s), F.lit(","), F.lit(_ESC_COMMA))
    hidden = F.array_join(F.transform(F.split(text, '"'), lambda s, i: F.when(i % 2 == 1, inside(s)).otherwise(outside(s))), '"')
    shown = lambda s: F.replace(F.replace(s, F.lit(_ESC_COMMA), F.lit(",")), F.lit(_ESC_SELF), F.lit(_ESC))

    def quoted(c: Column) -> Column:
        body = F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
        begins, has = F.startswith(c, F.lit('"')), F.contains(c, F.lit('"'))
        closed = (F.length(c) >= 2) & F.endswith(c, F.lit('"')) & ~F.contains(F.replace(body, F.lit('""'), F.lit("")), F.lit('"'))
        return F.struct(
            F.when(begins & closed, F.replace(shown(body), F.lit('""'), F.lit('"'))).otherwise(shown(c)).alias("value"),
            F.when(begins, closed).otherwise(~has).alias("sound"),
        )

    plain = F.transform(F.split(text, ","), lambda c: F.struct(c.alias("value"), F.lit(True).alias("sound")))
    return F.when(F.contains(raw, F.lit('"')), F.transform(F.split(hidden, ","), quoted)).otherwise(plain)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.column, r.kind, *(None if v is None else float(v) for v in (r.low, r.high)), r.empty) for i, r in enumerate(rules)],
        "pos int, column string, kind string, low double, high double, may_be_empty boolean",
    )


def _judge(n_rules: int) -> Column:
    """The error of one (row, column, value) beside its rule, or null."""
    v = F.trim("value")
    number = F.try_cast(v, "double") if hasattr(F, "try_cast") else F.expr("try_cast(trim(value) as double)")
    in_range = F.coalesce(number.between(F.col("low"), F.col("high")), F.lit(False))
    shape = F.when(F.col("kind") == "integer", v.rlike(INTEGER)).when(F.col("kind") == "decimal", v.rlike(DECIMAL)).otherwise(F.lit(True))
    return (
        F.when((F.col("pos") == 0) & (F.col("n_fields") != n_rules), F.concat(F.lit("fields:"), F.col("n_fields")))
        .when(~F.col("sound"), F.concat(F.lit("quoting:"), F.coalesce("column", F.lit("beyond"))))
        .when(F.col("n_fields") != n_rules, F.lit(None))
        .when(F.col("kind") == "text", F.lit(None))
        .when(v == "", F.when(~F.col("may_be_empty"), F.concat(F.lit("empty:"), F.col("column"))))
        .when(~shape, F.concat(F.lit("not_"), F.col("kind"), F.lit(":"), F.col("column")))
        .when(~in_range, F.concat(F.lit("out_of_range:"), F.col("column")))
    )


def long_cells(raw: DataFrame, record: str = "raw_record", keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """One row per (record, column): the keys, the record, its number of fields, pos, value and sound.

    A null record counts as an empty one: a single empty field.
    """
    parsed = raw.select(*keys, record, cells(F.coalesce(record, F.lit(""))).alias("_cells"))
    return parsed.select(*keys, record, F.size("_cells").alias("n_fields"), F.posexplode("_cells").alias("pos", "_cell")).select(
        *keys, record, "n_fields", "pos", "_cell.value", "_cell.sound"
    )


def rejected(raw: DataFrame, rules: tuple[Rule, ...] = DENUE_RULES, record: str = "raw_record", keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """The records that cannot be loaded: keys, record and `reasons`, the sorted set of their errors.

    Only errors are shuffled.  Repeated rows (same keys, same record) come out once; keys may be null; an empty table
    gives none; columns of `raw` other than the keys and the record are ignored.  The set of a record's errors is
    bounded by the rule table, whatever the length of the record.
    """
    rule = F.broadcast(rule_table(raw.sparkSession, rules))  # as many rows as the schema has columns
    errors = long_cells(raw, record, keys).join(rule, "pos", "left").withColumn("_error", _judge(len(rules))).where(F.col("_error").isNotNull())
    return errors.groupBy(*keys, record).agg(F.array_sort(F.collect_set("_error")).alias("reasons"))


def loadable(raw: DataFrame, bad: DataFrame, record: str = "raw_record", keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """The rows of `raw` without an error: the anti-join with `bad`, null-safe on the keys and the record."""
    other = bad.select(*[F.col(k).alias(f"_bad_{k}") for k in (*keys, record)])
    on = [raw[k].eqNullSafe(other[f"_bad_{k}"]) for k in (*keys, record)]
    joined = on[0]
    for x in on[1:]:
        joined = joined & x
    return raw.join(other, joined, "left_anti")


def load_denue(raw: DataFrame, bad: DataFrame) -> DataFrame:
    """The good records in the schema of denue, beside their record_id and source_file.

    Texts stay as delivered; blank coordinates become null, and with them geom and the plane coordinates, which are
    rounded to the 1/8 m the stored points have.  The south pole alone has no place in the plane (the cone opens there).
    """
    good = loadable(raw, bad).withColumn("_c", F.transform(cells(F.col("raw_record")), lambda c: c["value"]))
    typed = []
    for i, r in enumerate(DENUE_RULES):
        cell = F.col("_c")[i]
        if r.kind == "text":
            typed.append(cell.alias(r.column))
        else:
            to = "int" if r.kind == "integer" else "double"
            typed.append(F.when(F.trim(cell) != "", F.trim(cell)).cast(to).alias(r.column))
    flat = good.select("record_id", "source_file", "received_at", *typed)
    both = F.col("latitud").isNotNull() & F.col("longitud").isNotNull()
    x, y = forward(F.col("longitud"), F.col("latitud"), EPSG_6372)
    eighth = lambda c: F.when(both & (F.col("latitud") > -90), F.round(c * 8) / 8)
    return flat.select(
        "record_id", "source_file", *[r.column for r in DENUE_RULES],
        F.when(both, F.struct(F.col("longitud").alias("x"), F.col("latitud").alias("y"))).alias("geom"),
        eighth(x).alias("x_6372"), eighth(y).alias("y_6372"), F.col("received_at").alias("cargado_en"),
    )
