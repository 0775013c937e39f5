"""Text chunks, propositions and exploded attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import count_phrase
from ..sources.scratch import written
from .retrieval import small

WHOLE = -1
FACE_SEPARATOR = "\n//\n"
#: Words of a type line that are supertypes.
SUPERTYPES = ("basic", "legendary", "snow", "world", "ongoing", "host", "elite")
#: Attribute values that say that something is absent.
ABSENT = ("", "n/a", "na", "nil", "none", "not applicable", "not present", "not visible", "nothing", "null", "unknown", "unspecified")


def line_chunks(rows: DataFrame, id_: str, text: str, *along: Column, separator: str = FACE_SEPARATOR) -> DataFrame:
    """(id, ``along``..., face_index, ordinal, text): one row per line that is not blank, numbered within its face without the blank ones."""
    held = rows.select(id_, *along, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), re.escape(separator).replace("/", "\\/"))).alias("face_index", "_face"))
    more = [c for c in held.columns if c not in (id_, "face_index", "_face")]
    lines = held.select(id_, *more, "face_index", F.filter(F.transform(F.split("_face", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "").alias("_lines"))
    return lines.select(id_, *more, "face_index", F.posexplode("_lines").alias("ordinal", "text"))


def chunks(rows: DataFrame, id_: str, name: str, type_line: str, text: str) -> DataFrame:
    """(id, face_index, ordinal, kind, text, text_embedded): a row a line, and one of the whole text under its type line."""
    kind = F.trim(F.coalesce(F.col(type_line), F.lit("")))
    body = F.coalesce(F.col(text), F.lit(""))
    whole = F.when(kind != "", F.regexp_replace(F.concat(kind, F.lit("\n"), body), r"^\n+|\n+$", "")).otherwise(body)
    parts = line_chunks(rows, id_, text, F.col(name).alias("_name")).withColumn("kind", F.lit("ability"))
    wholes = rows.select(id_, F.col(name).alias("_name"), F.lit(0).alias("face_index"), F.lit(WHOLE).alias("ordinal"), whole.alias("text"), F.lit("whole").alias("kind"))
    both = parts.unionByName(wholes)
    return both.select(id_, "face_index", "ordinal", "kind", "text", without_name(F.col("text"), F.col("_name")).alias("text_embedded"))


def without_name(text: Column, name: Column) -> Column:
    """The name, then its part before a comma, replaced as whole words by ``this card``."""
    full = F.trim(F.coalesce(name, F.lit("")))
    short = F.trim(F.split(full, ",")[0])

    def replaced(t: Column, n: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b"))
        return F.when(n == "", t).otherwise(F.regexp_replace(t, pattern, F.lit("this card")))

    return replaced(replaced(text, full), F.when(full.contains(","), short).otherwise(""))


def distinct_statements(rows: DataFrame, id_: str, statements: str, at_least: int = 3) -> DataFrame:
    """(id, position, text): bullets stripped, short ones dropped, of equal ones (white space and case aside) the first kept."""
    each = rows.select(id_, F.posexplode(statements).alias("position", "text"))
    clean = each.withColumn("text", F.trim(F.regexp_replace("text", r"^\s*(?:[-*•]+|\d+[.)])\s*", ""))).where(F.length("text") >= at_least)
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    first = W.partitionBy(id_, key).orderBy("position")
    return clean.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def repeated_lines(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, position, text) of a text's lines, each kept where it occurs first."""
    return distinct_statements(rows.select(id_, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_l")), id_, "_l", 1)


def parsed_types(type_line: Column) -> Column:
    """array<struct<kind, value>> of a type line such as ``Legendary Creature — Elf Druid // Land``, lower-cased, each once."""
    def words(side: Column) -> Column:
        return F.filter(F.split(F.trim(F.lower(side)), r"\s+"), lambda w: w != "")

    def of(face: Column) -> Column:
        sides = F.split(face, "—", 2)
        main = F.transform(words(sides[0]), lambda w: F.struct(F.when(w.isin(*SUPERTYPES), "supertype").otherwise("type").alias("kind"), w.alias("value")))
        sub = F.transform(words(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))), lambda w: F.struct(F.lit("subtype").alias("kind"), w.alias("value")))
        return F.concat(main, sub)

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(type_line, F.lit("")), "//"), of)))


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def present(value: Column) -> Column:
    """The value, or null if it says that there is nothing to see."""
    return F.when(~F.lower(squeezed(value)).isin(*ABSENT), F.trim(value))


def folded_slots(slots: Column) -> Column:
    """Plain statements of nested attributes, each under the name of its attribute; absent values say nothing, of lists the first four count."""
    subject = slots["primary_subject"]

    def said(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), present(value))

    def first(members: Column, statement) -> Column:
        return F.coalesce(F.filter(F.transform(F.slice(members, 1, 4), statement), lambda x: x.isNotNull()), F.array().cast("array<string>"))

    held = first(subject["held_objects"], lambda o: said_of(F.when(o["is_weapon"], "a weapon").otherwise("a non-weapon object"), o["object"]))
    others = first(slots["other_figures"], lambda f: F.concat(said("other figure", f["species"]), F.coalesce(F.concat(F.lit(" ("), present(f["role"]), F.lit(")")), F.lit(""))))
    count = F.coalesce(slots["figure_count"].cast("int"), F.lit(0))
    of_subject = [said(f"primary subject {label}", subject[key]) for label, key in (("species", "species"), ("facial hair", "facial_hair"), ("clothing", "clothing"), ("pose", "pose"))]
    scene = [
        F.concat(F.lit("figure count: "), count.cast("string"), F.lit(" ("), count_phrase(count), F.lit(")")), said("setting", slots["setting"]), said("time of day", slots["time_of_day"]),
        said("palette", F.array_join(slots["palette"], ", ")), said("art style", slots["art_style"]), said("composition", slots["composition"]),
    ]
    return F.concat(F.filter(F.array(*of_subject), lambda x: x.isNotNull()), held, others, F.filter(F.array(*scene), lambda x: x.isNotNull()))


def said_of(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("primary subject holds "), kind, F.lit(": "), present(value))


def statements(rows: DataFrame, id_: str, literal: Column, slots: Column, interpretive: Column) -> DataFrame:
    """(id, position, layer, text): literal statements, those of the slots, then interpretive ones; of equal ones, white space and case
    aside, the first stays, over all layers. An id has its statements in one row as a rule, where they are compared without a shuffle; ids
    are counted to know the others, whose statements meet by id."""
    tag = lambda layer, texts: F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.struct(F.lit(layer).alias("layer"), t.alias("text")))
    every = rows.select(id_, F.concat(tag("literal", literal), tag("literal", folded_slots(slots)), tag("interpretive", interpretive)).alias("s"))
    every = every.withColumn("keys", F.transform("s", lambda s: F.lower(squeezed(s["text"]))))
    each = F.transform("s", lambda s, i: F.struct(i.alias("position"), s["layer"].alias("layer"), s["text"].alias("text"), F.get("keys", i).alias("_key")))
    own = F.filter(each, lambda x: (x["_key"] != "") & (F.array_position("keys", x["_key"]) == x["position"] + 1))
    several = written(rows.groupBy(F.col(id_).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "several")
    if several.isEmpty():
        return every.select(id_, F.inline(own)).drop("_key")
    again = F.col(id_).eqNullSafe(F.col("_id"))
    first = W.partitionBy(id_, "_key").orderBy("position")
    met = every.join(small(several), again, "left_semi").select(id_, F.inline(own)).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_key")
    return every.join(small(several), again, "left_anti").select(id_, F.inline(own)).drop("_key").unionByName(met)


def slot_phrases(rows: DataFrame, id_: str, slots: dict[str, Column]) -> DataFrame:
    """(id, path, phrase): scalars as they are; arrays as compact JSON and member by member."""
    parts = []
    for path, value in slots.items():
        kind = rows.select(value.alias("v")).schema["v"].dataType.typeName()
        if kind == "array":
            parts.append(F.array(F.struct(F.lit(path).alias("path"), F.to_json(value).alias("phrase"))))
            parts.append(_members(path, value))
        else:
            parts.append(F.array(F.struct(F.lit(path).alias("path"), value.cast("string").alias("phrase"))))
    return rows.select(id_, F.explode(F.concat(*parts)).alias("p")).select(id_, "p.path", "p.phrase").where("phrase is not null")


def _members(path: str, value: Column) -> Column:
    # A member is spelled as text: a struct as compact JSON.
    return F.transform(F.coalesce(F.from_json(F.to_json(value), "array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(path).alias("path"), x.alias("phrase")))


def repaired(raw: DataFrame, text: str, schema: str, bounds: dict[str, tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``data`` parsed and ``repairs`` listed, quarantined rows). A row is quarantined when it is no JSON object or an array
    named in ``bounds`` has too few members; one with too many is cut."""
    parsed = raw.withColumn("data", F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"}))
    bad = F.col("data").isNull()
    for name, (least, _) in bounds.items():
        bad = bad | (F.coalesce(F.size(F.col(f"data.{name}")), F.lit(0)) < least)
    notes = [F.when(F.size(F.col("data")[name]) > most, F.lit(f"{name} cut to {most}")) for name, (_, most) in bounds.items()]
    cut = parsed.where(~bad).select("*", F.filter(F.array(*notes), lambda x: x.isNotNull()).alias("repairs"))
    for name, (_, most) in bounds.items():
        cut = cut.withColumn("data", F.col("data").withField(name, F.slice(F.col("data")[name], 1, most)))
    return cut, parsed.where(bad).drop("data")


def marked_line(text: Column, face: Column, ordinal: Column, mark: str = "▸ ", other: str = "  ", separator: str = FACE_SEPARATOR) -> Column:
    """The text with one line of one face marked, by its number among the face's lines that are not blank; the other lines of that face are
    indented. A null or negative number marks nothing."""
    def lines(whole: Column) -> Column:
        each = F.split(whole, "\n")
        at = lambda i: F.size(F.filter(F.slice(each, 1, i), lambda x: F.trim(x) != ""))  # noqa: E731  lines before that are not blank
        return F.array_join(F.transform(each, lambda x, i: F.when(F.trim(x) == "", x).otherwise(F.concat(F.when(at(i) == ordinal, mark).otherwise(other), x))), "\n")

    whole = F.coalesce(text, F.lit(""))
    faces = F.transform(F.split(whole, re.escape(separator).replace("/", "\\/")), lambda f, i: F.when(i == face, lines(f)).otherwise(f))
    return F.when((ordinal >= 0) & face.isNotNull(), F.array_join(faces, separator)).otherwise(whole)
