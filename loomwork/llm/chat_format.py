"""Chat formatting: records of many layouts to turns, turns to text under a template, and back. Built-in functions only.

A record's nested field paths (``messages[].role``), those that some layout knows, are sorted and hashed; the fingerprint selects the layout,
whose declared rules say where its turns are. Fields that no layout knows do not matter. Records are rows with columns (``of_rows``, where a
path is there if its column is not null) or JSON texts (``of_json``, where it is there if the text names it), and each may have another layout.

The template marks turns, and escapes what in a text would be a mark of this or of another common template, so that a text cannot open or
close a turn; the escape is undone by ``read``. The output is pieces in order, each under the loss mask or not; texts of assistants are.

Nulls: a null text or role is empty, and rows without a conversation's id are one conversation. Turns are in the order of their number (null
first), ties by role, then text; repeated rows are repeated turns. Empty texts are turns. Records of no known layout have a null layout and
no turns, unless ``otherwise`` names one. An empty table gives no rows. Columns other than those named go, so none can clash. A conversation is
one output row, so one task holds its texts a few times, and Spark's 2 GB are its limit; for JSON texts the limit is Spark's for a variant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Said:
    """One turn of a role: the texts at ``paths`` with blank lines between; none where all are null."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Own:
    """One turn whose role and text are fields of the record."""

    role: str
    text: str


@dataclass(frozen=True)
class Each:
    """A turn for each entry of an array, whose roles go by ``ROLES``."""

    array: str
    role: str
    text: str


@dataclass(frozen=True)
class Pairs:
    """Turns of user and assistant in turn, from an array of pairs."""

    array: str


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...]
    rules: tuple[Said | Own | Each | Pairs, ...]


#: What roles are called elsewhere.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}

LAYOUTS = (
    Layout("turn", (), ("turn", "role", "text"), (Own("role", "text"),)),
    Layout("messages", ("messages[].role", "messages[].content"), ("system", "prompt"), (Said("system", ("system",)), Each("messages", "role", "content"))),
    Layout("exchange", ("conversations[].from", "conversations[].value"), ("system",), (Said("system", ("system",)), Each("conversations", "from", "value"))),
    Layout("prompt", ("prompt", "completion"), ("system",), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system", "history[][]"), (Said("system", ("system",)), Pairs("history"), Said("user", ("instruction", "input")), Said("assistant", ("output",)))),
    Layout("question", ("question", "answer"), ("context",), (Said("user", ("context", "question")), Said("assistant", ("answer",)))),
)


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of those of a record's ``paths`` that some layout knows; null if there are none."""
    known = sorted({p for x in layouts for p in (*x.paths, *x.optional)})
    own = F.array_sort(F.array_distinct(F.filter(paths, lambda p: p.isin(known))))
    return F.when(F.size(own) > 0, F.xxhash64(F.array_join(own, "\n")))


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """A map from fingerprints to layouts' names: each layout with each choice of its optional paths."""
    entries, seen = [], set()
    for x in layouts:
        for n in range(len(x.optional) + 1):
            for more in combinations(x.optional, n):
                paths = "\n".join(sorted({*x.paths, *more}))
                if paths and paths not in seen:
                    seen.add(paths)
                    entries += [F.xxhash64(F.lit(paths)), F.lit(x.name)]
    return F.create_map(*entries)


def _array(*turns: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(r.alias("role"), t.alias("text")) for r, t in turns))


def _ruled(rule: Said | Own | Each | Pairs, scalar: Callable[[str], Column], entries: Callable[[str, str, str], Column], pairs: Callable[[str], Column]) -> Column:
    """The turns of one rule; ``scalar``, ``entries`` and ``pairs`` read the record."""
    none = F.array().cast(TURNS)
    text = lambda c: F.coalesce(c, F.lit(""))
    if isinstance(rule, Said):
        parts = F.array_compact(F.array(*(scalar(p) for p in rule.paths)))
        return F.when(F.size(parts) > 0, _array((F.lit(rule.role), F.array_join(parts, "\n\n")))).otherwise(none)
    if isinstance(rule, Own):
        return _array((text(scalar(rule.role)), text(scalar(rule.text))))
    if isinstance(rule, Each):
        other = F.create_map(*(F.lit(s) for pair in ROLES.items() for s in pair))
        named = lambda r: F.coalesce(F.element_at(other, r), r, F.lit(""))
        return F.coalesce(F.transform(entries(rule.array, rule.role, rule.text), lambda m: F.struct(named(m[rule.role]).alias("role"), text(m[rule.text]).alias("text"))), none)
    return F.coalesce(F.flatten(F.transform(pairs(rule.array), lambda p: _array((F.lit("user"), text(F.try_element_at(p, F.lit(1)))), (F.lit("assistant"), text(F.try_element_at(p, F.lit(2))))))), none)


def _mapped(df: DataFrame, keep: tuple[str, ...], paths: Column, layouts: tuple[Layout, ...], otherwise: str | None, read: tuple[Callable, Callable, Callable]) -> DataFrame:
    layout = F.coalesce(F.try_element_at(registry(layouts), fingerprint(paths, layouts)), F.lit(otherwise))
    named = df.withColumn("layout", layout.cast("string"))
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, F.concat(*(_ruled(r, *read) for r in x.rules))).otherwise(turns)
    return named.select(*keep, "layout", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def _has(kind: DataType, path: str) -> bool:
    """Whether a schema has the field at ``path``."""
    for step in path.replace("[]", ".[]").split("."):
        if step == "[]":
            if not isinstance(kind, ArrayType):
                return False
            kind = kind.elementType
        else:
            if not isinstance(kind, StructType) or step not in kind.names:
                return False
            kind = kind[step].dataType
    return True


def of_rows(df: DataFrame, *keep: str, layouts: tuple[Layout, ...] = LAYOUTS, otherwise: str | None = None) -> DataFrame:
    """(``keep``, layout, turns) of rows whose columns are the fields."""
    known = sorted({p for x in layouts for p in (*x.paths, *x.optional) if _has(df.schema, p)})
    names = {f"f_{i}": p.split("[")[0] for i, p in enumerate(known)}
    at = {top: c for c, top in names.items()}
    kept = {f"k_{i}": k for i, k in enumerate(keep)}
    rows = df.select(*(F.col(f"`{k}`").alias(c) for c, k in kept.items()), *(F.col(f"`{top}`").alias(c) for c, top in names.items()))
    paths = F.array_compact(F.array(*(F.when(F.col(f"f_{i}").isNotNull(), F.lit(p)) for i, p in enumerate(known)))) if known else F.array().cast("array<string>")

    def scalar(p: str) -> Column:
        return F.col(at[p]).cast("string") if p in at else F.lit(None).cast("string")

    def entries(array: str, role: str, text: str) -> Column:
        if array not in at or not (_has(df.schema, f"{array}[].{role}") and _has(df.schema, f"{array}[].{text}")):
            return F.lit(None).cast(f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(F.col(at[array]), lambda m: F.struct(m[role].cast("string").alias(role), m[text].cast("string").alias(text)))

    def pairs(array: str) -> Column:
        return F.col(at[array]).cast("array<array<string>>") if array in at and _has(df.schema, f"{array}[][]") else F.lit(None).cast("array<array<string>>")

    out = _mapped(rows, tuple(kept), paths, layouts, otherwise, (scalar, entries, pairs))
    return out.select(*(F.col(c).alias(k) for c, k in kept.items()), "layout", "turns")


def shape(record: Column) -> Column:
    """The nested field paths of a variant, from Spark's description of its schema."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(`(?:[^`]|``)*`: |[^<>,:` ]+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?)"), F.lit(1))
    none = F.array().cast("array<string>")
    last = lambda s: F.try_element_at(s, F.lit(-1))
    cut = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    ended = lambda s: F.when(F.coalesce(F.startswith(last(s), F.lit(".")), F.lit(False)), cut(s)).otherwise(s)

    def step(acc: Column, token: Column) -> Column:
        stack, found = acc["stack"], acc["found"]
        is_name, closes = F.endswith(token, F.lit(": ")), token == ">"
        opens = token.isin("OBJECT<", "ARRAY<")
        name = F.concat(F.lit("."), F.regexp_replace(token, "^`|`?: $", ""))
        pushed = F.when(is_name, F.concat(stack, F.array(name))).when(token == "OBJECT<", F.concat(stack, F.array(F.lit("{")))).when(token == "ARRAY<", F.concat(stack, F.array(F.lit("[]")))).when(closes, ended(cut(stack))).otherwise(ended(stack))
        path = F.regexp_replace(F.array_join(F.filter(stack, lambda s: s != "{"), ""), r"^\.", "")
        return F.struct(pushed.alias("stack"), F.when(is_name | closes | opens, found).otherwise(F.concat(found, F.array(path))).alias("found"))

    return F.coalesce(F.aggregate(tokens, F.struct(none.alias("stack"), none.alias("found")), step, lambda acc: acc["found"]), none)


def of_json(df: DataFrame, record: str, *keep: str, layouts: tuple[Layout, ...] = LAYOUTS, otherwise: str | None = None) -> DataFrame:
    """(``keep``, layout, turns) of JSON texts in the column ``record``. What is not JSON has no layout."""
    kept = {f"k_{i}": k for i, k in enumerate(keep)}
    rows = df.select(*(F.col(f"`{k}`").alias(c) for c, k in kept.items()), F.try_parse_json(F.col(f"`{record}`").cast("string")).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    out = _mapped(rows, tuple(kept), shape(F.col("v")), layouts, otherwise, (lambda p: get(p, "string"), lambda a, r, t: get(a, f"array<struct<`{r}`:string,`{t}`:string>>"), lambda a: get(a, "array<array<string>>")))
    return out.select(*(F.col(c).alias(k) for c, k in kept.items()), "layout", "turns")


def gathered(records: DataFrame, by: str, order: str) -> DataFrame:
    """(``by``, turns): the turns of all records with one value of ``by``, in ``order``."""
    own = records.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "turns"))).alias("all"))
    return own.select(by, F.flatten(F.transform("all", lambda x: x["turns"])).alias("turns"))


# The template. Its marks, and how control strings of common templates begin.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = {r"<(?=\||/?s>|/?SYS>>|</?SYS>>)": "l", r"\[(?=/?INST\])": "b"}
LOSS = "assistant"


def escaped(text: Column) -> Column:
    """``text`` with no control string: first each backslash becomes one with ``e``, then what a control string begins with a letter."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for lead, letter in CONTROL.items():
        out = F.regexp_replace(out, lead, f"\\\\{letter}")
    return out


def unescaped(text: Column) -> Column:
    """A backslash stands before one of the letters only, so each pair means one thing."""
    for lead, letter in CONTROL.items():
        text = F.replace(text, F.lit(f"\\{letter}"), F.lit(lead.removeprefix("\\")[0]))
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def pieces(turns: Column) -> Column:
    """The formatted text in pieces (text, loss)."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    name = lambda role: F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))  # noqa: E731 # a role ends with its line
    no = F.lit(False)
    return F.flatten(F.transform(turns, lambda t: F.array(piece(F.concat(F.lit(OPEN), name(t["role"]), F.lit("\n")), no), piece(escaped(t["text"]), t["role"] == LOSS), piece(F.lit(CLOSE), no))))


def formatted(df: DataFrame) -> DataFrame:
    """``df``, which has ``turns``, with ``pieces`` (text, loss) and ``formatted``, their text."""
    return df.withColumn("pieces", pieces(F.col("turns"))).withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))


def read(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(text, OPEN.replace("|", r"\|"))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        own = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - (1 + len(CLOSE)))
        return F.struct(unescaped(role).alias("role"), unescaped(own).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def under_loss(pieces: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"])), "")


def digests(df: DataFrame, by: str) -> DataFrame:
    """What the output of ``formatted`` says, read back."""
    said = df.select(by, read(F.col("formatted")).alias("read"), under_loss(F.col("pieces")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(by, F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
