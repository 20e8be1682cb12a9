"""Chat formatting: records of many layouts to canonical turns, one text with a loss mask, and back.

A record is a JSON object. Its schema fingerprint is the hash of its nested field paths (names and nesting,
sorted, without the types of leaves). The fingerprint selects a declarative ``Layout``, whose turns are then
read; nothing else about a record decides. All of it is DataFrame functions: no code runs outside the JVM.

The template writes ``### role: text</turn>`` and a line feed for each turn. Control strings in roles and texts
are replaced by entities, so the text reads back exactly.

Rules: null text, a missing field and a null role are empty; an element of a turn list that is null is a turn
with both empty. A record whose fingerprint no layout has (also null, malformed or non-object JSON) keeps its row, with
``layout`` null, no turns and an empty text. Repeated rows stay; other columns pass through, except that the columns
named below are replaced. An empty table gives an empty result. Records that Spark's variant parser refuses for their
length (a text of 20 million characters, or 128 MB in all) are read by functions without that limit: names and nesting are
compared object by object; an object or list in place of a text, which is another fingerprint in shorter records, counts as
its JSON text there.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAF_TYPE = r"(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9,]+\))?"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records with certain field paths hold their turns.

    ``turns`` lists (role, path) in order, for layouts with a field per turn; a path that is optional and
    absent gives no turn. Or ``each`` names the list of turns, with the fields of role and text in an
    element. ``roles`` renames roles. ``optional`` paths may be absent, ``ignored`` ones hold no text.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.each:
            top, role, text = self.each
            return {f"{top}[].{role}", f"{top}[].{text}"}
        return {path for _, path in self.turns}

    def path_sets(self) -> list[set[str]]:
        """The path sets this layout accepts."""
        maybe = [*self.optional, *self.ignored]
        fixed = self.paths() - set(maybe)
        return [fixed | set(some) for n in range(len(maybe) + 1) for some in itertools.combinations(maybe, n)]

    def skeletons(self) -> list[str]:
        """These, rendered as ``skeleton`` renders a record's."""
        return [_rendered(paths) for paths in self.path_sets()]


LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", each=("messages", "role", "content"), ignored=("id", "source")),
    Layout("from_value", each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}, ignored=("id", "source")),
    Layout("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",), ignored=("id",)),
    Layout("prompt_completion", turns=(("user", "prompt"), ("assistant", "completion")), ignored=("id",)),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=("system", "input"), ignored=("id",)),
    Layout("question_answer", turns=(("user", "question"), ("assistant", "answer")), ignored=("id",)),
    Layout("nested_pair", turns=(("user", "data.prompt.text"), ("assistant", "data.reply.text"))),
)


def _rendered(paths: set[str]) -> str:
    """Field paths as nested names in the order and form of Spark's variant schemas."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.split("."):
            at = at.setdefault(name, {})
    return _object(tree)


def _object(tree: dict) -> str:
    def one(name: str, below: dict) -> str:
        inner = _object(below) if below else ""
        if name.endswith("[]"):
            return f"{name[:-2]}: ARRAY<{inner}>"
        return f"{name}: {inner}" if inner else name

    return "OBJECT<" + ", ".join(one(n, tree[n]) for n in sorted(tree)) + ">"


def skeleton(document: Column) -> Column:
    """Nested field paths of a variant, without the types of its leaves."""
    text = F.schema_of_variant(document)
    return F.regexp_replace(F.regexp_replace(text, f": {_LEAF_TYPE}(?=[,>])", ""), f"ARRAY<{_LEAF_TYPE}>", "ARRAY<>")


def fingerprint(document: Column) -> Column:
    return F.xxhash64(skeleton(document))


def _layout_of(print_: Column, skeleton_: Column, layouts: Sequence[Layout]) -> Column:
    """Name of the layout with this fingerprint; equal hashes are confirmed on the paths themselves."""
    out = F.lit(None).cast("string")
    for layout in reversed(layouts):
        hit = F.lit(False)
        for text in layout.skeletons():
            hit = hit | ((print_ == F.xxhash64(F.lit(text))) & (skeleton_ == text))
        out = F.when(hit, F.lit(layout.name)).otherwise(out)
    return out


def _text_at(document: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(document, f"$.{path}", "string"), F.lit(""))


def _renamed_turns(rows: Column, layout: Layout) -> Column:
    _, role, text = layout.each
    renamed = lambda x: F.coalesce(
        *[F.when(x[role] == old, F.lit(new)) for old, new in layout.roles.items()], x[role], F.lit(""))
    return F.transform(rows, lambda x: F.struct(renamed(x).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))


def _turns_of(document: Column, layout: Layout) -> Column:
    if layout.each:
        top, role, text = layout.each
        return _renamed_turns(F.try_variant_get(document, f"$.{top}", f"array<struct<`{role}` string, `{text}` string>>"), layout)
    there = [
        F.when(F.lit(path not in layout.optional) | F.try_variant_get(document, f"$.{path}", "variant").isNotNull(),
               F.struct(F.lit(role).alias("role"), _text_at(document, path).alias("text")))
        for role, path in layout.turns
    ]
    return F.filter(F.array(*there), lambda x: x.isNotNull())


# records beyond the variant's limit
_NO_LIMIT = {"maxStringLen": str(2**31 - 1)}


def _names_at(paths: set[str]) -> dict[str, list[str]]:
    """For each object in ``paths``, lists left out, the names in it."""
    out: dict[str, set[str]] = {}
    for path in paths:
        steps = path.split(".")
        for i, name in enumerate(steps):
            if not any(x.endswith("[]") for x in steps[:i]):
                out.setdefault(".".join(steps[:i]), set()).add(name.removesuffix("[]"))
    return {at: sorted(names) for at, names in out.items()}


def _long_list(record: Column, layout: Layout) -> Column:
    top, _, _ = layout.each
    return F.from_json(record, f"`{top}` array<map<string,string>>", _NO_LIMIT)[top]


def _long_object(record: Column, path: str) -> Column:
    """The names and texts of a nested object."""
    kind = "map<string,string>"
    for name in reversed(path.split(".")):
        kind = f"struct<`{name}`:{kind}>"
    found = F.from_json(record, kind, _NO_LIMIT)
    for name in path.split("."):
        found = found[name]
    return found


def _long_skeleton(record: Column, keys: Column, layouts: Sequence[Layout]) -> Column:
    """The skeleton of a long record that has one of a layout; ``keys`` are its outer names, sorted."""
    out = F.lit(None).cast("string")
    for layout in layouts:
        for paths in layout.path_sets():
            hit = F.lit(True)
            for at, names in _names_at(paths).items():
                here = F.array_sort(F.map_keys(_long_object(record, at))) if at else keys
                hit = hit & (here == F.array(*map(F.lit, names)))
            if layout.each:
                inside = F.flatten(F.transform(F.array_compact(_long_list(record, layout)), F.map_keys))
                hit = hit & (F.array_sort(F.array_distinct(inside)) == F.array(*map(F.lit, sorted(layout.each[1:]))))
            out = F.when(hit, F.lit(_rendered(paths))).otherwise(out)
    return out


def _struct_of(paths: set[str]) -> str:
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.split("."):
            at = at.setdefault(name, {})

    def one(below: dict) -> str:
        return "struct<" + ",".join(f"`{n}`:{one(x) if x else 'string'}" for n, x in below.items()) + ">"

    return one(tree)


def _long_turns(record: Column, keys: Column, layout: Layout) -> Column:
    if layout.each:
        return _renamed_turns(_long_list(record, layout), layout)
    read = F.from_json(record, _struct_of(layout.paths()), _NO_LIMIT)

    def text_at(path: str) -> Column:
        at = read
        for name in path.split("."):
            at = at[name]
        return F.coalesce(at, F.lit(""))

    there = [F.when(F.lit(path not in layout.optional) | F.array_contains(keys, path), F.struct(F.lit(role).alias("role"), text_at(path).alias("text")))
             for role, path in layout.turns]
    return F.filter(F.array(*there), lambda x: x.isNotNull())


def canonical_turns(records: DataFrame, column: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` plus ``layout``, ``fingerprint`` and ``turns`` (array of role and text)."""
    parsed = records.withColumn("_document", F.try_parse_json(column))
    # null unless the record is an object that is too long for a variant
    parsed = parsed.withColumn("_keys", F.when(F.col("_document").isNull(), F.array_sort(F.json_object_keys(column))))
    paths = F.when(F.col("_document").isNotNull(), skeleton(F.col("_document"))).when(
        F.col("_keys").isNotNull(), _long_skeleton(F.col(column), F.col("_keys"), layouts))
    parsed = parsed.withColumn("_skeleton", paths).withColumn("fingerprint", F.when(F.col("_skeleton").isNotNull(), F.xxhash64("_skeleton")))
    named = parsed.withColumn("layout", _layout_of(F.col("fingerprint"), F.col("_skeleton"), layouts))
    turns = F.array().cast(_TURNS)
    for layout in reversed(layouts):
        read = F.when(F.col("_keys").isNull(), _turns_of(F.col("_document"), layout)).otherwise(_long_turns(F.col(column), F.col("_keys"), layout))
        turns = F.when(F.col("layout") == layout.name, read).otherwise(turns)
    return named.withColumn("turns", F.coalesce(turns, F.array().cast(_TURNS))).drop("_document", "_skeleton", "_keys")


# the template: what it writes is never found in an escaped text
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ENTITIES = (("&", "&amp;"), ("###", "&hash;"), ("</turn>", "&end;"))


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("&colon;"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&colon;"), F.lit(":")))


def formatted(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """``rows`` with ``turns`` plus ``formatted`` and ``loss_spans``: begin (from 0) and length, in code
    points, of each text of the trained role."""
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(HEAD), _escaped_role(F.coalesce(t["role"], F.lit(""))), F.lit(COLON)).alias("head"),
        escaped(F.coalesce(t["text"], F.lit(""))).alias("text"), (t["role"] == trained).alias("counts")))
    staged = rows.withColumn("_parts", parts)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("spans"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + F.length(part["head"])
        span = F.struct(begin.alias("begin"), F.length(part["text"]).alias("length"))
        return F.struct((begin + F.length(part["text"]) + len(TAIL)).alias("at"),
                        F.when(part["counts"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["text"], F.lit(TAIL))), "")
    return staged.withColumns({"formatted": text, "loss_spans": F.aggregate("_parts", start, step)["spans"]}).drop("_parts")


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, TAIL), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        _unescaped_role(F.substring(p, F.lit(len(HEAD) + 1), F.locate(COLON, p) - 1 - len(HEAD))).alias("role"),
        unescaped(F.substring(p, F.locate(COLON, p) + len(COLON), F.length(p))).alias("text")))


def loss_texts(text: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescaped(F.substring(text, s["begin"] + 1, s["length"])))
