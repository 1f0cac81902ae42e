"""Payloads too large for one row or for the parser: lists are cut into elements before any of it is parsed.

A payload is a relation of chunks, the texts between closing braces, so one file is read by many tasks. What a chunk does to
the reader's state (inside a string or not, depth of brackets) is computed for both states it may begin in; running sums over
the chunks, bucket by bucket, tell which of the two it is. An element of the list ends where a brace closes at the list's own
depth, and only then its chunks are put together and parsed. No task holds more than an element or a bucket of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.functions import variants as v
from rubrica.operators.flatten import document_id
from rubrica.operators.ordering import split_running_sum
from rubrica.session import cut_lineage
from rubrica.sources.documents import numbered

WRAPPER = "generatedQuestions"
BUCKET = 1 << 16  # chunks whose sums are formed in one task
OUTERMOST = 1 << 30


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks (batch_id, n, value, closed) of uncompressed files, each file one payload.

    `closed` is false for a text that no brace follows, the end of most files.
    """
    rows = numbered(spark, path, "}")
    ends = rows.groupBy("file").agg(
        F.max("number").alias("last"), (F.sum(F.octet_length("value") + 1) - F.first("size")).alias("over")
    )
    # One byte more than the file has: its end was no brace. The reader drops a mark of three bytes at the begin of a file.
    bare = ends.filter(F.col("over").isin(1, -2)).select("file", F.col("last").alias("number"), F.lit(False).alias("closed"))
    return rows.join(bare, ["file", "number"], "left").select(
        F.col("file").alias("batch_id"), F.col("number").alias("n"), "value", F.coalesce("closed", F.lit(True)).alias("closed")
    )


def _plain(text: Column) -> Column:
    """Without escapes, so that every quote left begins or ends a string."""
    return F.regexp_replace(text, r"(?s)\\.", "")


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _brackets(text: Column, inside: bool = False) -> Column:
    """The brackets outside of strings of an unescaped text that begins outside, or inside, of one."""
    if inside:
        text = F.regexp_replace(text, r'^[^"]*(?:"|\z)', "")
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*(?:"|\z)', ""), r"[^\[\]{},]", "")


def _depth(brackets: Column) -> Column:
    opened = F.length(F.regexp_replace(brackets, r"[^\[{]", ""))
    return opened - F.length(F.regexp_replace(brackets, r"[^\]}]", ""))


def _lowest(brackets: Column) -> Column:
    """The lowest depth within the text, from 0 at its begin, and the number of commas there."""
    walked = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"), F.lit(0).alias("commas")),
        lambda a, c: F.struct(
            (a["at"] + F.when(c.isin("[", "{"), 1).when(c == "]", -1).otherwise(0)).alias("at"),
            F.when((c == "]") & (a["at"] == a["low"]), a["low"] - 1).otherwise(a["low"]).alias("low"),
            F.when((c == "]") & (a["at"] == a["low"]), 0)
            .otherwise(a["commas"] + F.when((c == ",") & (a["at"] == a["low"]), 1).otherwise(0))
            .alias("commas"),
        ),
    )
    return F.struct(walked["low"].alias("low"), walked["commas"].alias("commas"))


def _openings(value: Column) -> Column:
    """Where a list may begin in a chunk: after the wrapper's key. A place counts if its depth and state turn out right."""
    parts = F.split(value, rf'(?<!\\)"{WRAPPER}"\s*:\s*\[', -1)
    # The text of each match is the same for every rule but the place, which is measured from the end.
    found = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.struct(
            F.array_join(F.slice(parts, 1, i), f'"{WRAPPER}":[').alias("head"),
            F.array_join(F.slice(parts, i + 1, F.size(parts)), f'"{WRAPPER}":[').alias("rest"),
            i.alias("i"),
        ),
    )
    placed = F.transform(
        found,
        lambda x: F.struct(
            x["i"].alias("i"),
            (_quotes(_plain(x["head"])) % 2).alias("quotes"),
            F.when(_quotes(_plain(x["head"])) % 2 == 0, _depth(_brackets(_plain(x["head"]))))
            .otherwise(_depth(_brackets(_plain(x["head"]), True)))
            .alias("depth"),
            _lowest(_brackets(_plain(x["rest"]))).alias("low"),
        ),
    )
    return F.when(F.size(parts) > 1, placed)


def _rest(value: Column, i: Column) -> Column:
    """The text after the i-th key of the wrapper; for 0 the text after the first bracket, for -1 all of it."""
    parts = F.split(value, rf'(?<!\\)"{WRAPPER}"\s*:\s*\[', -1)
    after = F.array_join(F.slice(parts, i + 1, F.size(parts)), f'"{WRAPPER}":[')
    return F.when(i > 0, after).when(i == 0, F.regexp_replace(value, "^[^\\[]*\\[", "")).otherwise(value)


def _until_closed(text: Column, inside: Column, depth: Column) -> Column:
    """Number of characters before the bracket that closes the list, for a text at `depth` below it."""

    def step(a, part):
        bare = _plain(part)
        outside = (a["quotes"] + _quotes(bare)) % 2 == 0
        at = a["depth"] + F.when(a["quotes"] == 1, _depth(_brackets(bare, True))).otherwise(_depth(_brackets(bare)))
        after = F.when(outside, at - 1).otherwise(at)
        return F.struct(
            ((a["quotes"] + _quotes(bare)) % 2).alias("quotes"),
            after.alias("depth"),
            (a["read"] + F.length(part) + 1).alias("read"),
            F.when((a["place"] < 0) & (after < 0), a["read"] + F.length(part)).otherwise(a["place"]).alias("place"),
        )

    start = F.struct(
        inside.cast("int").alias("quotes"), depth.cast("int").alias("depth"), F.lit(0).alias("read"), F.lit(-1).alias("place")
    )
    return F.aggregate(F.split(text, r"\]", -1), start, step)["place"]


def _facts(chunks: DataFrame, width: int) -> DataFrame:
    """Narrow rows: the state in which each chunk begins and what it does to the depth. The texts are read once for them."""
    bare = chunks.select("batch_id", "n", "value", "closed", _plain(F.col("value")).alias("bare"))
    both = bare.select(
        "batch_id",
        "n",
        "closed",
        F.col("value").rlike(r"\S").alias("filled"),
        _quotes(F.col("bare")).alias("quotes"),
        _brackets(F.col("bare")).alias("outer"),
        _brackets(F.col("bare"), True).alias("inner"),
        F.when(F.col("n") == 0, F.regexp_extract("value", r"^[\s\x{FEFF}]*([\[{])", 1)).alias("first"),
        F.when(F.col("n") == 0, _lowest(_brackets(_plain(_rest(F.col("value"), F.lit(0)))))).alias("first_low"),
        _openings(F.col("value")).alias("openings"),
    )
    kept = ["batch_id", "n", "closed", "filled", "first", "first_low", "openings"]
    measured = cut_lineage(both.select(
        *kept,
        (F.col("quotes") % 2).alias("quotes"),
        _depth(F.col("outer")).alias("d0"), _lowest(F.col("outer")).alias("low0"),
        _depth(F.col("inner")).alias("d1"), _lowest(F.col("inner")).alias("low1"),
    ))
    at = [F.floor(F.col("n") / width)]
    stated = split_running_sum(measured, ["batch_id"], at, [F.col("n")], F.col("quotes"), "q")
    inside = (F.col("q") - F.col("quotes")) % 2 == 1
    # The brace after the chunk counts where it is in no string.
    shut = F.when(F.col("closed") & (F.col("q") % 2 == 0), 1).otherwise(0)
    moved = stated.select(
        *kept,
        inside.alias("inside"),
        (shut == 1).alias("shut"),
        (F.when(inside, F.col("d1")).otherwise(F.col("d0")) - shut).alias("d"),
        F.when(inside, F.col("low1")).otherwise(F.col("low0")).alias("lowest"),
    )
    summed = split_running_sum(moved, ["batch_id"], at, [F.col("n")], F.col("d"), "after")
    before = F.col("after") - F.col("d")
    return cut_lineage(summed.withColumns({"before": before, "low": before + F.col("lowest.low"), "commas": F.col("lowest.commas")}).drop("d", "lowest"))


def _lists(facts: DataFrame) -> DataFrame:
    """One row per payload: where its list begins (n0, i), at what depth, and the chunk that closes it (NULL: none)."""
    key = F.filter("openings", lambda x: (F.col("before") + x["depth"] == 1) & (x["quotes"] == F.col("inside").cast("int")))
    place = lambda rank, n, i, base, low: F.struct(
        F.lit(rank).alias("rank"), n.alias("n0"), i.alias("i"), F.lit(base).alias("base"), low.alias("tail")
    )
    whole = F.when(F.col("first") == "[", place(0, F.col("n"), F.lit(0), 1, F.col("first_low"))).when(
        F.col("first") == "{", place(1, F.col("n"), F.lit(-1), 0, F.struct(F.lit(0).alias("low"), F.lit(0).alias("commas")))
    )
    keyed = F.when(F.size(key) > 0, place(0, F.col("n"), key[0]["i"], 2, key[0]["low"]))
    begun = facts.filter(F.col("first").isin("[", "{") | (F.size("openings") > 0)).select(
        "batch_id", F.explode(F.array_compact(F.array(whole, keyed))).alias("at")
    )
    # A payload that is neither list nor object has a first chunk without a bracket, and no list whatever else it holds.
    firsts = facts.filter(F.col("first").isin("[", "{")).select("batch_id")
    lists = begun.groupBy("batch_id").agg(F.min("at").alias("at")).join(firsts, "batch_id", "left_semi").select("batch_id", "at.*")
    ended = F.when(F.col("base") == 0, F.col("shut") & (F.col("after") == 0)).otherwise(
        F.when(F.col("n") == F.col("n0"), F.col("tail.low") < 0).otherwise((F.col("n") > F.col("n0")) & (F.col("low") < F.col("base")))
    )
    filled = F.max(F.when(F.col("filled") | F.col("closed"), F.col("n"))).alias("filled_to")
    closed = facts.join(lists, "batch_id").groupBy("batch_id").agg(F.min(F.when(ended, F.col("n"))).alias("n1"), filled)
    return lists.join(closed, "batch_id")


def split_elements(chunks: DataFrame, width: int = BUCKET) -> DataFrame:
    """Elements (batch_id, pos, id, doc, is_object, parsed) of chunked payloads (batch_id, n, value, closed).

    The first chunk of a payload has n = 0, the others follow in any steps; the sums of `width` numbers are formed in one task. Texts
    may be cut anywhere but within an escape or the wrapper's key, and `closed` says that a brace follows.

    A payload is a list, an object with a list under the wrapper's key at any place, or a single object, whose only element it is;
    any other gives no row. Elements that are no objects are kept and flagged. What does not parse on its own (deeper or larger
    than Spark's parser takes, or no JSON) is a row with `doc` NULL and `parsed` false at the position of the first element it
    holds; a list that is never closed and text after the end of a list or object are such a row at position NULL. Other elements
    stand, and count as the commas of their list do. What follows the wrapper's list is not looked at, and a repeated key counts once, the first.
    """
    facts = _facts(chunks, width)
    # One narrow row per payload, read by both outputs.
    lists = cut_lineage(_lists(facts))
    joined = chunks.join(_pieces(facts, lists, width), ["batch_id", "n"])
    joined = joined.withColumn("text", F.when(F.col("opens"), _rest(F.col("value"), F.col("i"))).otherwise(F.col("value")))
    place = _until_closed(
        F.col("text"),
        F.when(F.col("opens"), False).otherwise(F.col("inside")),
        F.when(F.col("opens"), 0).otherwise(F.col("before") - F.col("base")),
    )
    brace = F.when(F.col("closed"), "}").otherwise("")
    cut = F.when(F.col("ending"), F.substring(F.col("text"), F.lit(1), place)).otherwise(F.concat("text", brace))
    # Text after a bare list in the chunk that closes it, unless later chunks have some too.
    rest = F.concat(F.substring(F.col("text"), place + 2, F.length("text")), brace).rlike(r"\S")
    bodies = (
        joined.withColumns({"cut": cut, "rest": F.when(F.col("ending") & (F.col("base") == 1) & (F.col("n") == F.col("filled_to")), rest)})
        .groupBy("batch_id", "piece")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cut"))), lambda x: x["cut"]), "").alias("body"),
            F.min("offset").alias("offset"),
            F.max("ending").alias("last"),
            F.coalesce(F.max("rest"), F.lit(False)).alias("rest"),
        )
    )
    return _parsed(bodies, lists)


def _pieces(facts: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """For each chunk of a list the piece it belongs to and how many elements are before this piece, at its first chunk."""
    listed = facts.join(lists, "batch_id").filter((F.col("n") >= F.col("n0")) & (F.col("n1").isNull() | (F.col("n") <= F.col("n1"))))
    ends = F.col("shut") & (F.col("after") == F.col("base")) & (F.col("n1").isNull() | (F.col("n") < F.col("n1")))
    commas = F.when(F.col("n") == F.col("n0"), F.col("tail.commas")).when(F.col("low") == F.col("base"), F.col("commas")).otherwise(0)
    # Both sums in one pass: ends of pieces above, commas below; a payload has less than 2^31 of either.
    half = 1 << 31
    both = F.when(ends, half).otherwise(0).cast("bigint") + F.when(F.col("base") == 0, 0).otherwise(commas)
    own = listed.withColumn("own", both)
    summed = split_running_sum(own, ["batch_id"], [F.floor(F.col("n") / width)], [F.col("n")], F.col("own"), "sums")
    piece = F.floor((F.col("sums") - F.col("own")) / half)
    return summed.select(
        "batch_id", "n", "inside", "before", "i", "base", "filled_to",
        (F.col("n") == F.col("n0")).alias("opens"),
        (F.coalesce(F.col("n") == F.col("n1"), F.lit(False)) & (F.col("base") > 0)).alias("ending"),
        piece.alias("piece"),
        # The comma before a piece's first element is within the piece.
        ((F.col("sums") - F.col("own")) % half + F.when(piece > 0, 1).otherwise(0)).cast("int").alias("offset"),
    )


def _parsed(bodies: DataFrame, lists: DataFrame) -> DataFrame:
    body = F.regexp_replace("body", r"^\s+", "")
    inner = F.when(F.col("piece") == 0, F.regexp_replace(body, "^\ufeff", "")).when(body.startswith(","), F.substring(body, 2, OUTERMOST))
    # The end of a list without a comma is no element; after a comma there has to be one.
    nothing = F.col("last") & (body == "")
    found = F.when(inner.rlike(r"\S"), v.as_array(F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]")))))

    def entry(pos, doc, parsed):
        return F.struct(pos.alias("pos"), doc.alias("doc"), F.lit(parsed).alias("parsed"))

    no_doc = F.lit(None).cast("variant")
    none = F.array().cast("array<struct<pos: int, doc: variant, parsed: boolean>>")
    held = bodies.withColumn("found", F.when(~nothing, found))
    entries = (
        F.when(nothing, none)
        .when(F.col("found").isNull(), F.array(entry(F.col("offset"), no_doc, False)))
        .otherwise(F.transform("found", lambda x, i: entry((F.col("offset") + i).cast("int"), x, True)))
    )
    fault = F.array(entry(F.lit(None).cast("int"), no_doc, False))
    docs = held.select("batch_id", F.explode(F.concat(entries, F.when(F.col("rest"), fault).otherwise(none))).alias("e")).select("batch_id", "e.*")
    # Lists and objects without an end, and those with text in chunks after their end.
    faulty = lists.filter(F.col("n1").isNull() | ((F.col("base") < 2) & (F.col("filled_to") > F.col("n1"))))
    faults = faulty.select("batch_id", F.lit(None).cast("int").alias("pos"), no_doc.alias("doc"), F.lit(False).alias("parsed"))
    name = F.concat(F.lit("item["), F.col("pos").cast("string"), F.lit("]"))
    return docs.unionByName(faults).select(
        "batch_id",
        "pos",
        F.when(F.col("parsed"), document_id(F.col("doc"), F.col("pos"))).otherwise(name).alias("id"),
        "doc",
        F.coalesce(v.is_object(F.col("doc")), F.lit(False)).alias("is_object"),
        "parsed",
    )


def unparsed(elements: DataFrame) -> DataFrame:
    """One bad issue for each stretch of a payload that could not be read."""
    return elements.filter(~F.col("parsed")).select(
        "batch_id",
        "pos",
        F.lit("bad").alias("severity"),
        F.lit("render_schema").alias("category"),
        F.concat(F.lit(WRAPPER), F.when(F.col("pos").isNotNull(), F.format_string("[%d]", F.col("pos"))).otherwise("")).alias("location"),
        F.lit("This part of the payload cannot be read.").alias("reason"),
        F.lit("Send complete JSON of at most 1000 levels and 128 MiB an element.").alias("suggestion"),
    )
