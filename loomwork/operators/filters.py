"""Structured filters: predicates as Columns, sets of ids as DataFrames.

``None`` means unfiltered; an empty set means that nothing is allowed. Hard filters are a conjunction whose empty answer stands; soft ones are
dropped, broadest first kept, where they would leave fewer than a floor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER_LIMITS = (0, 30)
# Attribute paths that slot filters may name, and their operators.
SLOT_PATHS = (
    "primary_subject.species", "primary_subject.facial_hair", "primary_subject.clothing", "primary_subject.pose", "primary_subject.held_objects", "other_figures",
    "figure_count", "setting", "time_of_day", "palette", "art_style", "composition",
)
SLOT_OPS = ("equals", "contains", "not_contains", "gte", "lte")


def between_bounds(value: Column, low: int | None, high: int | None, notes: list[str] | None = None) -> Column | None:
    """Inclusive range. Bounds outside 0..30 are dropped with a note; a reversed range matches nothing; equal bounds are an equality."""
    kept = []
    for name, bound in (("minimum", low), ("maximum", high)):
        if bound is not None and not NUMBER_LIMITS[0] <= bound <= NUMBER_LIMITS[1]:
            if notes is not None:
                notes.append(f"{name} {bound} is outside {NUMBER_LIMITS[0]}-{NUMBER_LIMITS[1]}; ignored")
            bound = None
        kept.append(bound)
    low, high = kept
    if low is None and high is None:
        return None
    if low is not None and high is not None:
        return F.lit(False) if low > high else value == low if low == high else value.between(low, high)
    return value >= low if low is not None else value <= high


def compare(value: Column, op: str, bound: float | None = None, low: float | None = None, high: float | None = None) -> Column | None:
    """One of ``< <= = >= > between``; bounds of ``between`` may come in either order."""
    if op == "between":
        if low is None or high is None:
            return None
        return value.between(min(low, high), max(low, high))
    if bound is None:
        return None
    return {"<": value < bound, "<=": value <= bound, "=": value == bound, ">=": value >= bound, ">": value > bound}.get(op)


def subset_of(letters: Column, wanted: str | None) -> Column | None:
    """Whether all letters of a text are among the wanted ones. No wanted letters: no filter."""
    kept = sorted({c for c in (wanted or "").upper() if c.isalpha()})
    if not kept:
        return None
    own = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")  # splitting '' gives one blank
    return F.size(F.array_except(own, F.array(*(F.lit(c) for c in kept)))) == 0


def with_all(members: DataFrame, id_: str, value: str, wanted: list[str]) -> DataFrame:
    """Ids that have every wanted value (relational division)."""
    distinct = sorted(set(wanted))
    return members.where(F.col(value).isin(distinct)).groupBy(id_).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(distinct)).select(id_)


def typed(members: DataFrame, id_: str, value: str, wanted: list[str], notes: list[str] | None = None) -> DataFrame | None:
    """Ids that match any wanted phrase, a phrase being matched by all its words. A phrase with an unknown word is dropped with a note; if
    all are, there is no filter. One action: which words are known."""
    words = sorted({w for phrase in wanted for w in phrase.lower().split()})
    known = {r[0] for r in members.where(F.lower(value).isin(words)).select(F.lower(value)).distinct().collect()}  # at most the words asked for
    out = None
    for phrase in wanted:
        own = phrase.lower().split()
        unknown = [w for w in own if w not in known]
        if not own or unknown:
            if notes is not None:
                notes.append(f"type {phrase!r}: unknown {', '.join(unknown) or 'value'}; dropped")
            continue
        ids = with_all(members.withColumn(value, F.lower(value)), id_, value, own)
        out = ids if out is None else out.union(ids)
    return None if out is None else out.distinct()


def legal_in(legalities: DataFrame, id_: str, formats: list[str]) -> DataFrame:
    return legalities.where((F.col("status") == "legal") & F.col("format").isin(formats)).select(id_).distinct()


def hard(rows: DataFrame, predicates: Mapping[str, Column | None]) -> DataFrame:
    for p in predicates.values():
        if p is not None:
            rows = rows.where(p)
    return rows


def kept_filters(names: list[str], count: Callable[[tuple[int, ...]], int], floor: int = 0, drop_empty: bool = True, notes: list[str] | None = None) -> list[str]:
    """The soft filters that stay. ``count`` gives the rows that a choice of them, by position, leaves. They are tried by their own matches, most
    first, ties in the order given; one that would leave fewer than ``floor`` rows, or none, is dropped."""
    own = [count((i,)) for i in range(len(names))]
    kept: tuple[int, ...] = ()
    for i in sorted(range(len(names)), key=lambda i: -own[i]):
        if not own[i] and drop_empty:
            note = "matched nothing"
        elif (left := count((*kept, i))) < max(1, floor):
            note = f"would leave {left}"
        else:
            kept = (*kept, i)
            continue
        if notes is not None:
            notes.append(f"{names[i]} {note}; dropped")
    return [names[i] for i in kept]


def soft(rows: DataFrame, predicates: Mapping[str, Column | None], floor: int = 0, drop_empty: bool = True, notes: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``rows`` under as many filters as leave more than ``floor`` rows when ``floor`` is 0, else at least ``floor``; and the filters used.
    Filters are tried by their own matches, most first, ties in the order given. Counts of all conjunctions come from one pass: a row a
    combination of flags."""
    used = [n for n, p in predicates.items() if p is not None]
    if not used:
        return rows, []
    flag = {n: f"_flag{i}" for i, n in enumerate(used)}
    marked = rows.select("*", *(F.coalesce(predicates[n], F.lit(False)).alias(flag[n]) for n in used))
    combos = [(tuple(r[flag[n]] for n in used), r["count"]) for r in marked.groupBy(*flag.values()).count().collect()]  # 2 ** filters rows at most
    kept = kept_filters(used, lambda chosen: sum(c for flags, c in combos if all(flags[i] for i in chosen)), floor, drop_empty, notes)
    for name in kept:
        marked = marked.where(F.col(flag[name]))
    return marked.drop(*flag.values()), kept


def structural(rows: DataFrame, rank: str, id_: str, k: int) -> DataFrame:
    """The k best by popularity rank, unranked ones last."""
    return rows.orderBy(F.col(rank).asc_nulls_last(), F.col(id_)).limit(k)


def mechanical(rows: DataFrame, terms: list[str], columns: list[str], notes: list[str] | None = None) -> DataFrame:
    """Rows with any term in any of the columns; all rows if there is none (the filter is then dropped, with a note)."""
    if not terms:
        return rows
    text = F.lower(F.concat_ws("\n", *columns))
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t.lower())
    found = rows.where(hit)
    if not found.isEmpty():
        return found
    if notes is not None:
        notes.append(f"terms {', '.join(terms)} matched nothing; dropped")
    return rows


def in_bands(rows: DataFrame, low: int, high: int, band: str = "band") -> DataFrame:
    """Rows of the bands, null bands left out; if there is no band at all, every row."""
    if rows.where(F.col(band).isNotNull()).isEmpty():
        return rows
    return rows.where(F.col(band).between(low, high))


def relaxed(low: int, high: int) -> tuple[int, int]:
    """The band range one wider on either side, within 1..5."""
    return max(1, low - 1), min(5, high + 1)


def clean_slots(slots: list[dict], notes: list[str], paths: Iterable[str] = SLOT_PATHS) -> list[dict]:
    """Slot filters with a known path, a known operator and a value; others go with a note."""
    out = []
    for s in slots or []:
        if not isinstance(s, dict):
            notes.append(f"slot filter {s!r} is not understood; dropped")
            continue
        path, op, value = str(s.get("path") or "").strip(), str(s.get("op") or "").strip().lower(), str(s.get("value") or "").strip()
        if path in paths and op in SLOT_OPS and value:
            out.append({"path": path, "op": op, "value": value})
        else:
            notes.append(f"slot filter {path or '?'} {op or '?'} {value or '?'} is not understood; dropped")
    return out


def echo(types: list[str] | None = None, colors: str | None = None, mv: tuple[int | None, int | None] = (None, None), formats: list[str] | None = None) -> str:
    """The filter as a line to show. Equal bounds read as an equality."""
    low, high = mv
    parts = [f"type {' or '.join(types)}"] if types else []
    if colors:
        parts.append(f"colours within {colors.upper()}")
    if low is not None and low == high:
        parts.append(f"mana value = {low}")
    elif low is not None or high is not None:
        parts.append("mana value " + " and ".join(p for p in (f">= {low}" if low is not None else "", f"<= {high}" if high is not None else "") if p))
    if formats:
        parts.append(f"legal in {' or '.join(formats)}")
    return "; ".join(parts)


def external_query(types: list[str] | None = None, colors: str | None = None, mv: tuple[int | None, int | None] = (None, None), formats: list[str] | None = None) -> str:
    """The same in the syntax of the public card search. An impossible range has no query."""
    low, high = mv
    if low is not None and high is not None and low > high:
        return ""
    parts = ["(" + " or ".join(" ".join(f"t:{w}" for w in t.split()) for t in types) + ")"] if types else []
    if colors:
        parts.append(f"id<={colors.lower()}")
    if low is not None and low == high:
        parts.append(f"cmc={low}")
    else:
        parts += [f"cmc>={low}"] * (low is not None) + [f"cmc<={high}"] * (high is not None)
    if formats:
        parts.append("(" + " or ".join(f"f:{f}" for f in formats) + ")")
    return " ".join(parts)
