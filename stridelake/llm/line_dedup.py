r"""Line dedup by a log-template tree of fixed depth, in DataFrame functions alone.

A line is a sequence of tokens between blanks; a token with a digit is a variable field, ``<*>``. The tree sorts
lines by their number of tokens, then by their leading tokens; what shares that path is a leaf. Only leaves
met in several documents are looked into, and a leaf has several templates:

* At each place the token that most lines of the leaf have is part of its first template, and a place without one
  is a variable field. A line belongs to a template if enough of its tokens are the template's.
* Of the other lines, each that recurs in ``min_docs`` documents, fields masked, is a template of its own if it has a token that
  is no field. However many lines or how much prose share the leaf, such a line is found.
* What is still left makes one more majority template; its lines must also have enough of its constant tokens
  behind the leading ones, which the leaf shares anyway.

Templates whose lines come from ``min_docs`` documents or more recur, and their lines are dropped from every document.

Lines end at \n. Lines of fewer than ``min_tokens`` tokens, empty ones included, are never dropped. With a smaller
``min_tokens`` a line of up to three tokens is a leaf and template as a whole, if it has a token that is no field. Null and
empty texts have one empty line. Repeated lines of one document count its doc_id once. Counts are
combined before each shuffle, joins on a hot leaf are left to the engine's split of skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_in, texts

LEADING, MIN_TOKENS, MIN_DOCS, ALIKE = 3, 4, 5, 0.6
FIELD = "<*>"
_BLANK = r"[\x09\x0B\x0C\x0D\x20]+"


def _lines(content: DataFrame, min_tokens: int) -> DataFrame:
    """(doc_id, line_no, leaf, line) of the lines that have enough tokens; ``line`` has single blanks.

    The leaf needs no list of tokens: blanks are counted, and the leading tokens are cut off the line.
    """
    odd = F.col("line").contains("  ")
    for blank in "\t\x0b\f\r":
        odd = odd | F.col("line").contains(blank)
    plain = F.trim(F.when(odd, F.regexp_replace("line", _BLANK, " ")).otherwise(F.col("line")))
    size = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    leading = F.regexp_replace(F.substring_index("line", " ", LEADING), "[^ ]*[0-9][^ ]*", FIELD)
    enough = size >= min_tokens
    if min_tokens <= LEADING:
        enough = enough & ((size > LEADING) | ~leading.rlike(r"^<\*>( <\*>)*$"))
    return (content.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .select("doc_id", "line_no", plain.alias("line")).where((F.col("line") != "") & enough)
            .select("doc_id", "line_no", F.concat_ws(" ", size.cast("string"), leading).alias("leaf"), "line"))


def _met(rows: DataFrame, min_docs: int) -> DataFrame:
    """Leaves that ``rows`` has in enough documents."""
    return (rows.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("n_docs"))
            .where(F.col("n_docs") >= min_docs))


def _majority(rows: DataFrame) -> DataFrame:
    """(leaf, template): at each place the token of most rows, or a field."""
    seen = rows.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
    places = seen.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("total"))
    place = F.struct("at", F.when(F.col("top.n") * 2 > F.col("total"), F.col("top.token")).otherwise(FIELD).alias("token"))
    # a leaf's lines are equally long, so its template is as large as one line
    templates = places.groupBy("leaf").agg(F.array_sort(F.collect_list(place)).alias("places"))
    return templates.select("leaf", F.col("places.token").alias("template"))


def _recurring(members: DataFrame, min_docs: int) -> DataFrame:
    return (members.join(_met(members, min_docs).select("leaf"), "leaf")
            .select("doc_id", "line_no", "leaf", F.concat_ws(" ", "template").alias("template")))


def _members(docs: DataFrame, min_tokens: int, min_docs: int) -> DataFrame:
    """(doc_id, line_no, leaf, template) of the lines that belong to a recurring template."""
    lines = _lines(texts(docs), min_tokens)
    leaves = cut(_met(lines, min_docs).select("leaf"))
    fields = F.transform(F.split("line", " "), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    near = maybe_in(lines, F.col("leaf"), leaves, F.col("leaf")).join(leaves, "leaf")
    near = cut(near.select("doc_id", "line_no", "leaf", fields.alias("tokens")))
    same = F.size(F.filter(F.arrays_zip("tokens", "template"), lambda p: (p["tokens"] == p["template"])))
    judged = near.join(cut(_majority(near)), "leaf")
    first = judged.where(same >= F.size("tokens") * ALIKE)
    rest = cut(judged.where(same < F.size("tokens") * ALIKE).select("doc_id", "line_no", "leaf", "tokens", F.concat_ws(" ", "tokens").alias("masked")))
    # the masked line decides its leaf and whether it belongs to the first template, so all its rows are here
    own = cut(rest.where(F.exists("tokens", lambda t: t != FIELD)).select("masked", "doc_id").distinct().groupBy("masked")
              .agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs).select("masked"))
    second = rest.join(own, "masked").select("doc_id", "line_no", "leaf", F.col("masked").alias("template"))
    left = rest.join(own, "masked", "left_anti").select("doc_id", "line_no", "leaf", "tokens")
    behind = F.filter(F.arrays_zip("tokens", "template"), lambda p, i: (i >= LEADING) & (p["template"] != FIELD))
    alike = F.size(F.filter(behind, lambda p: p["tokens"] == p["template"]))
    third = left.join(_majority(left), "leaf").where(
        (same >= F.size("tokens") * ALIKE) & (F.size(behind) > 0) & (alike >= F.size(behind) * ALIKE))
    return _recurring(first, min_docs).union(second).union(_recurring(third, min_docs))


def templates(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(template, n_docs) of the recurring templates."""
    members = _members(docs, min_tokens, min_docs)
    return (members.select("leaf", "template", "doc_id").distinct().groupBy("leaf", "template")
            .agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs).select("template", "n_docs"))


def _bit(mask: Column, line_no: Column) -> Column:
    """Whether line ``line_no`` is in the words of ``mask``."""
    return F.call_function("shiftrightunsigned", F.get(mask, (line_no / 64).cast("int")), (line_no % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def deduplicated(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): texts without the lines of recurring templates."""
    members = _members(docs, min_tokens, min_docs)
    dropped = members.select("doc_id", "line_no").distinct()
    words = (dropped.select("doc_id", (F.col("line_no") / 64).cast("int").alias("word"),
                            F.expr("shiftleft(1L, cast(line_no % 64 as int))").alias("bit"))
             .groupBy("doc_id", "word").agg(F.bit_or("bit").alias("bits"))
             .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")))
    lines = F.split("text", "\n")
    mask = F.transform(F.sequence(F.lit(0), (F.size(lines) / 64).cast("int")),
                       lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long")))
    kept = F.when(F.col("words").isNotNull(), F.filter("_lines", lambda line, i: ~_bit(F.col("_mask"), i)))
    joined = (texts(docs).join(words, "doc_id", "left")
              .select("doc_id", "text", "words", lines.alias("_lines"), F.when(F.col("words").isNotNull(), mask).alias("_mask")))
    marked = joined.select("doc_id", "text", F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"))
    return marked.select(
        "doc_id", F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "_kept")).alias("text"), "n_lines",
        F.when(F.col("_kept").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size("_kept")).alias("n_dropped"))
