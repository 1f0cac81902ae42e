"""Reading, searching and changing variant values inside one row.

A document or a reply is one row, so everything about its inner tree is an expression on that row: no
shuffle, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rubrica import dims
from rubrica.functions.pointers import tokens
from rubrica.functions.text import bind, lookup, strip

MAX_NESTING = 1000  # the JSON parser of Spark refuses deeper documents


def get(value: Column, *keys: str) -> Column:
    """A member by key path; SQL NULL when missing, a variant null when it is JSON null."""
    return F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in keys), "variant")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    """The elements of a list; an empty array for anything else."""
    return F.coalesce(as_array(value), F.array().cast("array<variant>"))


def listed(value: Column, *keys: str) -> Column:
    """The elements of the list at a key path, taken out in one step; an empty array for anything else."""
    found = F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in keys), "array<variant>")
    return F.coalesce(found, F.array().cast("array<variant>"))


def object_at(value: Column, *keys: str) -> Column:
    """Whether there is an object at a key path."""
    return F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in keys), "struct<>").isNotNull()


def is_array(value: Column) -> Column:
    # Elements are not taken out for that.
    return F.try_variant_get(value, "$", "array<struct<>>").isNotNull()


def keys(value: Column) -> Column:
    """The keys of an object, without its members; NULL for anything else."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,struct<>>"))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def absent(value: Column) -> Column:
    """Missing or JSON null."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))


KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BIGINT": "integer",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "BOOLEAN": "boolean",
    "VOID": "null",
}


def kind(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null; SQL NULL when missing."""
    name = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    # The schema of an object is that of all it holds.
    return F.when(is_object(value), "object").otherwise(lookup(KINDS, name))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def text_of(value: Column) -> Column:
    """A string as it is, anything else as JSON; NULL when missing."""
    return F.coalesce(value.cast("string"), F.to_json(value))


def string_of(value: Column) -> Column:
    """The value when it is a string, else NULL."""
    return F.when(is_string(value), value.cast("string"))


def truthy_text(value: Column) -> Column:
    """Text of a value, NULL when it is missing, null, empty, zero or false."""
    return bind(value, lambda x: _truthy(x.cast("string"), x))


def truthy_at(value: Column, key: str) -> Column:
    """`truthy_text` of a member, whose text is taken out in one step."""
    return _truthy(F.try_variant_get(value, f"$['{key}']", "string"), get(value, key))


def _truthy(text: Column, value: Column) -> Column:
    """The text of `value` where that counts; the value is looked at only where its text is doubtful."""
    doubtful = ("", "0", "0.0", "-0.0", "false", "[]", "{}")
    return bind(
        text,
        lambda s: F.when(s.isNull(), F.lit(None).cast("string")).when(~s.isin(*doubtful), s).when((s != "") & is_string(value), s),
    )


def _brackets(value: Column) -> Column:
    """The opening brackets in the JSON of a value."""
    left = lambda j, bracket: F.length(j) - F.length(F.replace(j, F.lit(bracket), F.lit("")))
    return bind(F.to_json(value), lambda j: left(j, "[") + left(j, "{"))


def first_text(value: Column, *keys: str) -> Column:
    """The stripped text of the first usable member, '' when there is none."""
    return strip(F.coalesce(*[truthy_at(value, k) for k in keys], F.lit("")))


def present_alias(value: Column, *keys: str) -> Column:
    """The first member whose key exists, even if it is null."""
    return F.coalesce(*[get(value, k) for k in keys])


def has_key(value: Column, key: str) -> Column:
    return get(value, key).isNotNull()


def first_list(value: Column, *paths: tuple[str, ...]) -> Column:
    return F.coalesce(
        *[F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in p), "array<variant>") for p in paths],
        F.array().cast("array<variant>"),
    )


def choices(interaction: Column) -> Column:
    """The first list under any choice key, the configuration before the interaction itself."""
    keys = dims.CHOICE_KEYS
    return first_list(interaction, *[("config", k) for k in keys], *[(k,) for k in keys])


def options_of(interaction: Column) -> Column:
    """As `choices`, with the shorter key list the object rules use."""
    keys = dims.OPTION_KEYS
    return first_list(interaction, *[("config", k) for k in keys], *[(k,) for k in keys])


def content_text(value: Column) -> Column:
    """All display text of a value in reading order, joined by blanks; a plain value is its own text.

    Every list or object is replaced in place by its members until only texts are left, so rounds do not grow with the number
    of blocks.
    """
    # An entry is read once it has a text; its type must allow that from the start, so the first one has none.
    no_node, no_text = F.lit(None).cast("variant"), F.lit(None).cast("string")

    def entry(node: Column, text: Column) -> Column:
        return F.struct(node.alias("node"), text.alias("text"))

    def unread(nodes_: Column) -> Column:
        return F.transform(nodes_, lambda n: entry(n, no_text))

    def expand(e: Column) -> Column:
        node = e["node"]
        # All members of an object are taken out in one step.
        fields = F.try_variant_get(node, "$", "struct<" + ",".join(f"{k}:variant" for k in dims.CONTENT_KEYS) + ">")
        members = lambda f: F.when(f.isNotNull(), unread(F.array_compact(F.array(*[f[k] for k in dims.CONTENT_KEYS]))))
        text = strip(node.cast("string"))
        leaf = F.filter(F.array(entry(no_node, text)), lambda x: x["text"] != "")
        return F.when(e["text"].isNotNull(), F.array(e)).otherwise(
            F.coalesce(bind(fields, members), unread(as_array(node)), leaf)
        )

    def open_(entries: Column) -> Column:
        return F.exists(entries, lambda e: e["text"].isNull())

    def walked(value: Column) -> Column:
        # The nesting of a tree is not more than the brackets of its JSON nor than what the parser reads.
        rounds = F.least(_brackets(value), F.lit(MAX_NESTING)) + 1
        return F.aggregate(
            F.sequence(F.lit(1), rounds),
            F.array(entry(value, no_text)),
            lambda entries, _: F.when(open_(entries), F.flatten(F.transform(entries, expand))).otherwise(entries),
            lambda entries: F.array_join(F.transform(entries, lambda e: e["text"]), " "),
        )

    plain = lambda x: F.coalesce(strip(x.cast("string")), F.lit(""))
    return bind(value, lambda x: F.when(is_object(x) | is_array(x), walked(x)).otherwise(plain(x)))


def deep_texts(value: Column) -> Column:
    """Text of a value and of every block nested under its content keys, parents first."""
    return F.filter(
        F.transform(
            F.filter(nodes(value), lambda n: _content_path(n["pointer"]) & n["kind"].isin("array", "object", "string")),
            lambda n: content_text(n["value"]),
        ),
        lambda t: t != "",
    )


def _content_path(pointer: Column) -> Column:
    names = "|".join(dims.DEEP_KEYS)
    return pointer.rlike(f"^(?:/(?:[0-9]+|{names}))*$")


def nodes(value: Column) -> Column:
    """Every node of a tree as array<struct<pointer, key, depth, ord, value, kind>>, level by level."""
    levels = F.least(_brackets(value) + 1, F.lit(MAX_NESTING + 1))
    no_nodes = F.array().cast("array<struct<pointer:string,key:string,depth:int,ord:array<int>,value:variant>>")

    def node(parent: Column, step: Column, key: Column, i: Column, child: Column) -> Column:
        return F.struct(
            F.concat(parent["pointer"], F.lit("/"), step).alias("pointer"),
            key.cast("string").alias("key"),
            (parent["depth"] + 1).alias("depth"),
            F.concat(parent["ord"], F.array(i.cast("int"))).alias("ord"),
            child.alias("value"),
        )

    def children(parent: Column) -> Column:
        listed = F.transform(
            as_array(parent["value"]), lambda c, i: node(parent, i.cast("string"), F.lit(None), i, c)
        )
        escaped = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        keyed = F.transform(
            F.map_entries(as_map(parent["value"])),
            lambda e, i: node(parent, escaped(e["key"]), e["key"], i, e["value"]),
        )
        return F.coalesce(listed, keyed, no_nodes)

    def step(state: Column, _: Column) -> Column:
        return F.when(F.size(state["front"]) == 0, state).otherwise(
            F.struct(
                F.flatten(F.transform(state["front"], children)).alias("front"),
                F.concat(state["all"], state["front"]).alias("all"),
            )
        )

    root = F.struct(
        F.lit("").alias("pointer"),
        F.lit(None).cast("string").alias("key"),
        F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("ord"),
        value.alias("value"),
    )
    start = F.struct(F.array(root).alias("front"), no_nodes.alias("all"))
    found = F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda state: state["all"])
    typed = F.transform(found, lambda n: n.withField("kind", kind(n["value"])))
    return F.array_sort(
        F.coalesce(typed, F.array().cast("array<struct<pointer:string,key:string,depth:int,ord:array<int>,value:variant,kind:string>>")),
        lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0),
    )


def keyed(value: Column, *names: str) -> Column:
    """The members under one of the keys, at any depth and in reading order, as array<struct<key, ord, value>>."""
    none = F.array().cast("array<struct<key:string,ord:array<int>,value:variant>>")

    def children(parent: Column) -> Column:
        def node(key: Column, i: Column, child: Column) -> Column:
            at = F.concat(parent["ord"], F.array(i.cast("int")))
            return F.struct(key.cast("string").alias("key"), at.alias("ord"), child.alias("value"))

        listed = F.transform(as_array(parent["value"]), lambda c, i: node(F.lit(None), i, c))
        members = F.transform(F.map_entries(as_map(parent["value"])), lambda e, i: node(e["key"], i, e["value"]))
        return F.coalesce(listed, members, none)

    def step(state: Column, _: Column) -> Column:
        def deeper(front: Column) -> Column:
            return F.struct(front.alias("front"), F.concat(state["all"], F.filter(front, lambda n: n["key"].isin(*names))).alias("all"))

        return F.when(F.size(state["front"]) == 0, state).otherwise(bind(F.flatten(F.transform(state["front"], children)), deeper))

    root = F.struct(F.lit(None).cast("string").alias("key"), F.array().cast("array<int>").alias("ord"), value.alias("value"))
    start = F.struct(F.array(root).alias("front"), none.alias("all"))
    # One round more than brackets, so that there is one where there are none.
    levels = F.least(_brackets(value) + 1, F.lit(MAX_NESTING + 1))
    found = F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda state: state["all"])
    return F.array_sort(F.coalesce(found, none), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


def find_values(value: Column, *keys: str) -> Column:
    """All values under one of the keys, at any depth."""
    return F.transform(
        F.filter(nodes(value), lambda n: n["key"].isin(*keys)),
        lambda n: F.struct(n["value"].alias("value"), n["kind"].alias("kind")),
    )


def at_pointer(value: Column, pointer: Column) -> Column:
    """The value a pointer leads to; NULL when the path does not exist."""

    return F.aggregate(tokens(pointer), value, step_into)


def step_into(node: Column, token: Column) -> Column:
    index = F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))
    return F.coalesce(F.get(as_array(node), index), F.element_at(as_map(node), token))


def parse_object(text: Column) -> Column:
    """The variant of a text that is exactly one JSON object, else NULL.

    The parser stops after the first complete value, so the text is parsed inside a list: anything after the
    object then makes the list invalid or longer than one.
    """
    body = strip(text)
    listed = as_array(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))))
    only = F.when((F.size(listed) == 1) & body.endswith("}"), F.get(listed, F.lit(0)))
    return F.when(is_object(only), only)


def reply_candidates(content: Column) -> Column:
    """The places in a reply where a JSON object may be: all of it, fenced parts, outermost braces."""
    text = strip(F.coalesce(content, F.lit("")))
    fenced = F.when(
        F.contains(text, F.lit("```")),
        F.split(F.replace(text, F.lit("```json"), F.lit("```")), "```", -1),
    ).otherwise(F.array().cast("array<string>"))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.concat(F.array(text), fenced, F.array(braces))


def parse_reply(content: Column) -> Column:
    """The first JSON object found in a reply, or NULL."""
    return F.get(
        F.array_compact(F.transform(reply_candidates(content), parse_object)), F.lit(0)
    )


def fenced_objects(content: Column) -> Column:
    """Objects of a reply for staged contracts: fenced blocks from last to first, else the whole reply."""
    text = F.coalesce(content, F.lit(""))
    fenced = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    texts = F.when(F.size(fenced) > 0, F.reverse(fenced)).otherwise(F.array(text))
    return F.array_compact(F.transform(texts, parse_reply))


def canonical_equal(left: Column, right: Column) -> Column:
    """Equal whatever the order of keys: a variant keeps its keys sorted."""
    return F.to_json(left).eqNullSafe(F.to_json(right))
