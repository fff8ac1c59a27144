"""Ingestion of decoded device messages into the activity tables.

Input rows are ``(athlete_id, source_file, msg_type, fields)`` where ``fields`` is a JSON
object with the decoded message. Decoding the binary files is not part of this library.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S

NULLISH = (T.NullType,)
EXTRA = "extra"
CONTENT = "_content"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(columns: list[str]) -> str:
    return f"xxhash64({', '.join(map(_name, columns))}) AS {CONTENT}"


def flatten_messages(messages: DataFrame, msg_type: str, schema: T.StructType | None = None) -> DataFrame:
    """Typed rows of one message type. Arrays and objects are dropped, whole numbers and
    booleans become doubles, unparsable documents become null rows flagged ``_bad``.

    Undeclared scalars stay, as JSON text with sorted keys in ``extra`` (null if there are none).
    """
    schema = schema or S.ingest_schema(msg_type)
    own = [f for f in schema.fields if f.name not in ("source_file", EXTRA)]
    keys = [c for c in ("athlete_id", "source_file") if c in messages.columns]
    # what a value is decides whether it is nested, not what its text looks like
    document = "try_cast(try_parse_json(fields) as map<string, variant>)"
    scalars = "transform_values(_all, (k, v) -> if(schema_of_variant(v) rlike '^(ARRAY|OBJECT)', null, try_variant_get(v, '$', 'string')))"
    # generators keep filters on the result above them, so a document is parsed once
    parsed = (messages.filter(F.col("msg_type") == msg_type)
              .selectExpr(*keys, f"explode(array({document})) AS _all")
              .selectExpr(*keys, "_all IS NULL AS _bad", f"explode(array({scalars})) AS _f"))

    # as text: with a call for each part of each of 83 columns, building the plan took longer than a small batch's work
    def column(f: T.StructField) -> str:
        raw = f"try_element_at(_f, {_text(f.name)})"
        if isinstance(f.dataType, T.DoubleType):
            return f"case when {raw} = 'true' then 1.0D when {raw} = 'false' then 0.0D else try_cast({raw} as double) end AS {_name(f.name)}"
        return f"try_cast({raw} as {f.dataType.simpleString()}) AS {_name(f.name)}"

    declared = ", ".join(_text(n) for n in [f.name for f in schema.fields] + keys)
    rest = f"map_filter(_f, (k, v) -> k not in ({declared}) and v is not null)"
    extra = f"case when size({rest}) > 0 then to_json(map_from_entries(array_sort(map_entries({rest})))) end AS {EXTRA}"
    return parsed.selectExpr(*keys, "_bad", *[column(f) for f in own], extra)


def not_yet_stored(messages: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """Messages whose (activity, message type) is not stored yet.

    The anti join runs against distinct activity ids of each stored table, not its rows.
    """
    keys = [c for c in ("athlete_id", "source_file") if c in messages.columns]
    done = [
        df.select(*keys).distinct().withColumn("msg_type", F.lit(t)) for t, df in stored.items()
    ]
    if not done:
        return messages
    return messages.join(reduce(DataFrame.unionByName, done), [*keys, "msg_type"], "left_anti")


def align(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give both frames the same sorted columns; the stored type wins, except that an
    all-null column takes the type of the other side."""
    have = {f.name: f.dataType for f in existing.schema.fields}
    come = {f.name: f.dataType for f in new.schema.fields}
    want = {}
    for name in sorted(have.keys() | come.keys()):
        first, second = have.get(name), come.get(name)
        use_second = first is None or (isinstance(first, NULLISH) and second is not None)
        want[name] = second if use_second else first

    def cast(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
        return df.select(*[
            n if types.get(n) == t else (S.lenient_cast(F.col(n), types[n], t) if n in types else F.lit(None).cast(t)).alias(n)
            for n, t in want.items()
        ])

    return cast(existing, have), cast(new, come)


def dedup(df: DataFrame, ignore: str = "source_file") -> DataFrame:
    """One row per distinct content; of equal copies the smallest ``source_file`` stays.

    A partial aggregate runs before the shuffle, so many copies of one row do not travel.
    The content hash leads the group key: the aggregate sorts (its result is text), and a
    leading long settles nearly every comparison.
    """
    content = [c for c in df.columns if c != ignore]
    hashed = df.selectExpr("*", _hash(content))
    return hashed.groupBy(CONTENT, *content).agg(F.min(ignore).alias(ignore)).select(*df.columns)


def without_stored(new: DataFrame, stored: DataFrame, ignore: str = "source_file") -> DataFrame:
    """Rows of ``new`` whose content ``stored`` does not hold under any ``source_file``."""
    left, right = align(stored, new)
    content = [c for c in right.columns if c != ignore]
    s = left.selectExpr("*", _hash(content)).alias("s")
    n = right.selectExpr("*", _hash(content)).alias("n")
    # the hash finds candidates, the content decides
    same = F.expr(" and ".join([f"n.{CONTENT} = s.{CONTENT}", *[f"n.{_name(c)} <=> s.{_name(c)}" for c in content]]))
    return n.join(s, same, "left_anti").drop(CONTENT)


def append_dedup(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    if existing is None:
        return dedup(new)
    left, right = align(existing, new)
    return dedup(left.unionByName(right))


def schema_drift(spark: SparkSession, columns: dict[str, list[str]],
                 allow: tuple[str, ...] = ("athlete_id", "dt", EXTRA)) -> DataFrame:
    """(msg_type, column) for columns no declared schema names. Metadata only, no scan."""
    rows = []
    for msg_type, names in sorted(columns.items()):
        if msg_type not in ("session_mesgs", "record_mesgs"):
            continue
        known = {f.name for f in S.ingest_schema(msg_type).fields} | set(allow)
        rows += [(msg_type, c) for c in sorted(set(names) - known)]
    return spark.createDataFrame(rows, "msg_type string, column string")


def message_drift(messages: DataFrame, allow: tuple[str, ...] = ("athlete_id", "dt", "source_file")) -> DataFrame:
    """Undeclared field names per message type, found in the documents themselves."""
    known = [
        (t, f.name) for t in ("session_mesgs", "record_mesgs") for f in S.ingest_schema(t).fields
    ] + [(t, c) for t in ("session_mesgs", "record_mesgs") for c in allow]
    # fixed size: the declared column names
    names = messages.sparkSession.createDataFrame(known, "msg_type string, column string")
    seen = (
        messages.filter(F.col("msg_type").isin("session_mesgs", "record_mesgs"))
        .select("msg_type", F.explode(F.json_object_keys("fields")).alias("column"))
        .groupBy("msg_type", "column").agg(F.count(F.lit(1)).alias("messages"))
    )
    return seen.join(F.broadcast(names), ["msg_type", "column"], "left_anti")


def ingest_report(messages: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """Per (activity, message type): rows, whether it was skipped, unparsable documents and
    fields whose value does not fit the declared type."""
    keys = [c for c in ("athlete_id", "source_file") if c in messages.columns]
    # as in flatten_messages, what a value is decides whether it is nested, not what its text looks like
    document = F.expr("try_cast(try_parse_json(fields) as map<string, variant>)")
    numeric = sorted({
        f.name for t in S.MESSAGE_TYPES for f in S.ingest_schema(t).fields
        if isinstance(f.dataType, T.DoubleType)
    })

    def misfit(k, v):
        text = F.try_variant_get(v, "$", "string")
        scalar = ~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)")
        return k.isin(numeric) & scalar & text.isNotNull() & ~text.isin("true", "false") & text.try_cast("double").isNull()

    misfits = F.size(F.map_filter("_f", misfit))
    stats = messages.withColumn("_f", document).groupBy(*keys, "msg_type").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.when(F.col("_f").isNull(), 1).otherwise(0)).cast("bigint").alias("unparsable"),
        F.sum(F.coalesce(F.when(F.col("_f").isNotNull(), misfits), F.lit(0))).cast("bigint").alias("misfit_values"),
    )
    fresh = not_yet_stored(stats.select(*keys, "msg_type"), stored).withColumn("_new", F.lit(True))
    return stats.join(fresh, [*keys, "msg_type"], "left").select(
        *keys, "msg_type", "messages", "unparsable", "misfit_values",
        F.col("_new").isNull().alias("skipped"),
    )


def ingest(messages: DataFrame, stored: dict[str, DataFrame], rebuild: bool = False) -> dict[str, DataFrame]:
    """New full content of every table. ``rebuild`` ignores what is stored."""
    stored = {} if rebuild else stored
    fresh = not_yet_stored(messages, stored)
    out = {}
    for msg_type in S.MESSAGE_TYPES:
        rows = flatten_messages(fresh, msg_type).filter(~F.col("_bad")).drop("_bad")
        out[msg_type] = append_dedup(stored.get(msg_type), rows)
    return out
