"""From nested card records to normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import fold, letters_in_order, numeric
from .chunks import FACE_SEPARATOR, parsed_types

#: What is not a printed card.
DIGITAL_ONLY = ("arena", "astral", "sega")
EXCLUDED_LAYOUTS = ("token", "double_faced_token", "emblem", "art_series")
EXCLUDED_SET_TYPES = ("token", "memorabilia")
#: Vendors whose prices are in one currency, by preference.
VENDORS = ("tcgplayer", "cardkingdom", "manapool", "scg", "mtgstocks")

_S, _L = T.StringType(), T.ArrayType(T.StringType())
_IMAGES = T.StructType([T.StructField("normal", _S), T.StructField("art_crop", _S)])
_FACE = T.StructType(
    [T.StructField(n, _S) for n in ("oracle_id", "name", "type_line", "oracle_text", "mana_cost", "power", "toughness", "loyalty", "artist", "illustration_id")]
    + [T.StructField("colors", _L), T.StructField("image_uris", _IMAGES)]
)
#: Schema of the raw records; reading with it prunes all else.
CARD = T.StructType(
    [T.StructField(n, _S) for n in ("id", "oracle_id", "name", "type_line", "oracle_text", "mana_cost", "power", "toughness", "loyalty", "layout", "set", "set_type", "rarity", "artist", "released_at", "illustration_id", "scryfall_uri")]
    + [T.StructField("cmc", T.DoubleType()), T.StructField("edhrec_rank", T.LongType()), T.StructField("digital", T.BooleanType()), T.StructField("reserved", T.BooleanType())]
    + [T.StructField(n, _L) for n in ("colors", "color_identity", "keywords", "games")]
    + [T.StructField("image_uris", _IMAGES), T.StructField("card_faces", T.ArrayType(_FACE))]
    + [T.StructField(n, T.MapType(_S, _S)) for n in ("legalities", "prices", "related_uris", "purchase_uris")]
)


def _faces() -> Column:
    return F.coalesce(F.col("card_faces"), F.array().cast(T.ArrayType(_FACE)))


def _text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def is_commander() -> Column:
    """Legal, and either a legendary creature or one that says that it can lead, on the card or any face."""
    legal = F.col("legalities")["commander"].eqNullSafe("legal")
    creature = _text("type_line").contains("Legendary Creature") | F.exists(_faces(), lambda f: _text(f["type_line"]).contains("Legendary Creature"))
    says = _text("oracle_text").contains("can be your commander") | F.exists(_faces(), lambda f: _text(f["oracle_text"]).contains("can be your commander"))
    return legal & (creature | says)


def is_paper() -> Column:
    """Printed somewhere: dropped only if all its platforms are digital-only, or its layout or set is no card's."""
    games = F.coalesce("games", F.array().cast(_L))
    other = F.array_except(games, F.array(*(F.lit(g) for g in DIGITAL_ONLY)))
    return (F.size(games) > 0) & (F.array_contains(games, "paper") | (F.size(other) > 0)) & ~_text("layout").isin(*EXCLUDED_LAYOUTS) & ~_text("set_type").isin(*EXCLUDED_SET_TYPES)


def card_id() -> Column:
    """The record's id, else that of the first face that has one."""
    return F.coalesce("oracle_id", F.get(F.filter(F.transform(_faces(), lambda f: f["oracle_id"]), lambda x: x.isNotNull()), F.lit(0)))


def image() -> Column:
    """The record's image, else that of the first face that has one."""
    top = F.when(F.length(F.col("image_uris.normal")) > 0, F.col("image_uris.normal"))
    return F.coalesce(top, F.get(F.filter(F.transform(_faces(), lambda f: f["image_uris"]["normal"]), lambda x: F.length(x) > 0), F.lit(0)))


def joined_text() -> Column:
    joined = F.trim(F.array_join(F.transform(_faces(), lambda f: _text(f["oracle_text"])), FACE_SEPARATOR))
    return F.when((_text("oracle_text") == "") & (F.size(_faces()) > 0), joined).otherwise(_text("oracle_text"))


def _front(name: str) -> Column:
    return F.get(_faces(), F.lit(0))[name]


def _price(name: str) -> Column:
    p = F.col("prices")[name]
    return F.when(p.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.trim(p)).cast("double")


def cards(raw: DataFrame) -> DataFrame:
    """One row a record, with every fallback to faces that two-faced cards need."""
    merged = F.flatten(F.transform(_faces(), lambda f: F.coalesce(f["colors"], F.array().cast(_L))))
    both_absent = F.col("power").isNull() & F.col("toughness").isNull()
    power, toughness = (F.when(both_absent, _front(n)).otherwise(F.col(n)) for n in ("power", "toughness"))
    loyalty = F.coalesce("loyalty", _front("loyalty"))
    mana = F.when(_text("mana_cost") != "", F.col("mana_cost")).when(_text(_front("mana_cost")) != "", _front("mana_cost"))
    return raw.select(
        card_id().alias("oracle_id"), _text("name").alias("name"), fold(_text("name")).alias("name_norm"), _text("type_line").alias("type_line"), joined_text().alias("oracle_text"), mana.alias("mana_cost"),
        F.coalesce("cmc", F.lit(0.0)).alias("cmc"), letters_in_order(F.coalesce("colors", merged)).alias("colors"), letters_in_order(F.coalesce("color_identity", F.array().cast(_L))).alias("color_identity"),
        power.alias("power"), toughness.alias("toughness"), loyalty.alias("loyalty"), numeric(power).alias("power_num"), numeric(toughness).alias("toughness_num"), numeric(loyalty).alias("loyalty_num"),
        F.coalesce("keywords", F.array().cast(_L)).alias("keywords"), _text("layout").alias("layout"), F.coalesce("reserved", F.lit(False)).alias("reserved"), "edhrec_rank", _text("released_at").alias("released_at"),
        _text("set").alias("set_code"), _text("rarity").alias("rarity"), image().alias("image_normal"), _price("usd").alias("usd"), _price("usd_foil").alias("usd_foil"), "scryfall_uri",
        F.col("related_uris")["edhrec"].alias("edhrec_uri"), F.col("purchase_uris")["tcgplayer"].alias("tcgplayer_uri"),
    )


def faces(raw: DataFrame) -> DataFrame:
    each = raw.select(card_id().alias("oracle_id"), F.posexplode("card_faces").alias("face_index", "f"))
    return each.select("oracle_id", "face_index", _text(F.col("f.name")).alias("name"), fold(_text(F.col("f.name"))).alias("name_norm"), "f.mana_cost", _text(F.col("f.type_line")).alias("type_line"), _text(F.col("f.oracle_text")).alias("oracle_text"), F.col("f.image_uris.normal").alias("image_normal"))


def types(cards_: DataFrame) -> DataFrame:
    """(oracle_id, kind, value)."""
    return cards_.select("oracle_id", F.explode(parsed_types(F.col("type_line"))).alias("t")).select("oracle_id", "t.kind", "t.value")


def legalities(raw: DataFrame) -> DataFrame:
    """(oracle_id, format, status)."""
    return raw.select(card_id().alias("oracle_id"), F.explode("legalities").alias("format", "status"))


def entry_map(rows: DataFrame, id_: str, key: str, value: str, out: str) -> DataFrame:
    """(id, out): a map of an entity's rows, one a key."""
    return rows.groupBy(id_).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(key, value)))).alias(out))


def legality_maps(rows: DataFrame) -> DataFrame:
    return entry_map(rows, "oracle_id", "format", "status", "legalities")


def arts(raw: DataFrame) -> DataFrame:
    """(oracle_id, printing, face_index, illustration_id, art_crop_url, artist, released_at, digital): the faces with art of each printing,
    else its one illustration, else nothing."""
    own = F.filter(F.transform(_faces(), lambda f, i: F.struct(i.alias("face_index"), f["illustration_id"].alias("illustration_id"), f["image_uris"]["art_crop"].alias("url"), F.coalesce(f["artist"], F.col("artist")).alias("artist"))), lambda x: (F.length(x["illustration_id"]) > 0) & (F.length(x["url"]) > 0))
    one = F.array(F.struct(F.lit(0).alias("face_index"), F.col("illustration_id").alias("illustration_id"), F.col("image_uris.art_crop").alias("url"), F.col("artist").alias("artist")))
    whole = F.filter(one, lambda x: (F.length(x["illustration_id"]) > 0) & (F.length(x["url"]) > 0))
    each = raw.select(card_id().alias("oracle_id"), F.col("id").alias("printing"), _text("released_at").alias("released_at"), F.coalesce("digital", F.lit(False)).alias("digital"), F.explode(F.when(F.size(own) > 0, own).otherwise(whole)).alias("a"))
    return each.select("oracle_id", "printing", "released_at", "digital", "a.face_index", "a.illustration_id", F.col("a.url").alias("art_crop_url"), "a.artist")


def default_printings(raw: DataFrame) -> DataFrame:
    """The newest printing of each card that is not digital, else the newest; ties to the largest id. ``edhrec_rank`` is the first one
    present in that order."""
    order = W.partitionBy("oracle_id").orderBy(F.coalesce("digital", F.lit(False)).cast("int"), F.desc(_text("released_at")), F.desc(_text("id")))
    keyed = raw.withColumn("oracle_id", card_id())
    ranked = keyed.withColumn("_k", F.row_number().over(order)).withColumn("edhrec_rank", F.first("edhrec_rank", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return ranked.where("_k = 1").drop("_k")


def page_stats(pages: DataFrame) -> DataFrame:
    """(slug, num_decks, avg_price, themes, archetypes) of parsed statistics pages (slug, num_decks, prices, themes, taglinks): the first
    vendor's price above 0, where ``prices`` maps a vendor to a struct with ``price``; archetypes falling back to themes."""
    offered = [F.col("prices")[v]["price"].cast("double") for v in VENDORS]
    price = F.coalesce(*(F.when(p > 0, p) for p in offered))
    archetypes = F.when(F.size(F.coalesce("taglinks", F.array())) > 0, F.col("taglinks")).otherwise(F.col("themes"))
    return pages.select("slug", F.col("num_decks").cast("long").alias("num_decks"), price.alias("avg_price"), "themes", archetypes.alias("archetypes"))


def links(rows: DataFrame, base: str) -> DataFrame:
    """Adds ``links``, a map without absent entries. ``records``: array<struct<name, slug, count>>; ``matched_terms``: array<string>. The
    theme is the most played one that the first telling term matches, else the most played."""
    ordered = F.array_sort(F.coalesce("records", F.array()), lambda a, b: (b["count"] - a["count"]).cast("int"))
    hit = lambda term: F.filter(ordered, lambda r: F.lower(r["name"]).contains(F.lower(term)) | r["slug"].contains(F.regexp_replace(F.lower(term), "[^a-z0-9]+", "-")))
    telling = F.filter(F.coalesce("matched_terms", F.array().cast(_L)), lambda t: (F.trim(t) != "") & (F.size(hit(t)) > 0))
    theme = F.coalesce(F.get(hit(F.get(telling, F.lit(0))), F.lit(0)), F.get(ordered, F.lit(0)))
    made = F.create_map(
        F.lit("edhrec"), F.concat(F.lit(base + "/"), F.col("slug")), F.lit("edhrec_theme"), F.concat(F.lit(base + "/"), F.col("slug"), F.lit("/"), theme["slug"]),
        F.lit("scryfall"), F.col("scryfall_uri"), F.lit("tcgplayer"), F.col("tcgplayer_uri"), F.lit("art_crop"), F.col("art_crop_url"),
    )
    return rows.withColumn("links", F.map_filter(made, lambda k, v: v.isNotNull() & (v != "")))


def quality_report(cards_: DataFrame, layouts: int = 8, collisions: int = 20) -> DataFrame:
    """(check, value, n): how many cards there are, without image, without text, and with a folded name that others have; then the commonest
    layouts, and the folded names held by most cards, with their names."""
    counts = cards_.agg(
        F.count("*").alias("cards"), F.sum((F.length(F.coalesce("image_normal", F.lit(""))) == 0).cast("long")).alias("without_image"), F.sum((F.coalesce("oracle_text", F.lit("")) == "").cast("long")).alias("without_text"),
    ).unpivot([], ["cards", "without_image", "without_text"], "check", "n")
    common = cards_.groupBy(F.coalesce("layout", F.lit("?")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(layouts)
    held = cards_.groupBy("name_norm").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("name")), 1, 10).alias("names")).where("n > 1")
    total = held.agg(F.count("*").alias("n")).select(F.lit("name_collisions").alias("check"), F.lit(None).cast("string").alias("value"), "n")
    worst = held.orderBy(F.desc("n"), "name_norm").limit(collisions).select(F.lit("collision").alias("check"), F.concat_ws(" | ", "names").alias("value"), "n")
    return counts.select("check", F.lit(None).cast("string").alias("value"), "n").union(total).union(common.select(F.lit("layout").alias("check"), "value", "n")).union(worst)
