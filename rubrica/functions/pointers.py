"""JSON pointers as text: conversion, parts, context and safety tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rubrica import dims
from rubrica.functions.text import bind, strip

DOTTED = r"^\.*(?:[^.\[]+(?:\[\d+\])*(?:\.+[^.\[]+(?:\[\d+\])*)*)?\.*$"


def to_pointer(location: Column) -> Column:
    """Turn `$`-rooted, dotted and indexed locations into JSON pointers; keep what cannot be read."""
    prefix = "generatedQuestion."

    def unrooted(raw: Column) -> Column:
        return (
            F.when(raw.startswith("/$/"), F.substr(raw, F.lit(3)))
            .when(raw.startswith("$/"), F.substr(raw, F.lit(2)))
            .when(raw.startswith("$."), F.substr(raw, F.lit(3)))
            .otherwise(raw)
        )

    def dotted(raw: Column, text: Column) -> Column:
        body = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
        parts = F.regexp_replace(
            F.regexp_replace(F.btrim(body, F.lit(".")), r"\[(\d+)\]", "/$1"), r"\.+", "/"
        )
        return (
            F.when(body.isin("input", "generatedQuestions"), body)
            .when(~body.rlike(DOTTED), raw)
            .when(parts == "", "")
            .otherwise(F.concat(F.lit("/"), parts))
        )

    def read(raw: Column) -> Column:
        return F.when(raw.isin("", "$", "/$"), "").otherwise(
            bind(
                unrooted(raw),
                lambda text: F.when(text.startswith("/"), text)
                .when(text == "generatedQuestion", "")
                .otherwise(dotted(raw, text)),
            )
        )

    return bind(strip(F.coalesce(location, F.lit(""))), read)


def pointer_index(pointer: Column, name: str) -> Column:
    """The index that follows `name` in a pointer, as text; NULL when there is none."""
    found = F.regexp_extract(pointer, f"/{name}/([0-9]+)(?:/|$)", 1)
    return F.when(pointer.startswith("/"), F.nullif(found, F.lit("")))


def context_paths(category: Column, pointer: Column) -> Column:
    """The parts of a document needed to judge or fix an issue, distinct and in order."""
    item = pointer_index(pointer, "questionItems")
    solution = pointer_index(pointer, "solutions")
    prefix = F.concat(F.lit("/questionItems/"), item)

    def of_item(*names: str) -> list[Column]:
        return [F.concat(prefix, F.lit(f"/{n}")) for n in names]

    def lit(path: str) -> Column:
        return F.lit(path)

    by_item = (
        F.when(
            category.isin(
                "solution_anchor_consistency", "answer_internal_consistency", "choice_quality"
            ),
            F.array(lit("/instruction"), *of_item("stem", "interactions", "answerSpecs"), lit("/solutions")),
        )
        .when(
            category == "hint_quality",
            F.array(*of_item("stem", "hints", "interactions", "answerSpecs"), lit("/solutions")),
        )
        .when(
            category == "pedagogical_quality",
            F.array(lit("/instruction"), *of_item("stem", "interactions", "answerSpecs")),
        )
        .when(
            category.isin("interaction_schema", "render_schema"),
            F.array(prefix, *of_item("interactions", "answerSpecs")),
        )
    )
    by_solution = F.when(
        category == "solution_quality",
        F.concat(
            F.array(lit("/instruction")),
            F.when(item.isNotNull(), F.array(*of_item("stem", "interactions", "answerSpecs"))).otherwise(
                F.array(lit("/questionItems"))
            ),
            F.array(
                F.when(solution.isNotNull(), F.concat(lit("/solutions/"), solution)).when(
                    pointer.startswith("/solutions"), lit("/solutions")
                )
            ),
        ),
    )
    none = F.array().cast("array<string>")
    paths = F.concat(
        F.array(F.when(pointer.startswith("/"), pointer)),
        F.when(item.isNotNull(), F.coalesce(by_item, none)).otherwise(none),
        F.coalesce(by_solution, none),
    )
    return F.array_distinct(F.array_compact(paths))


def deepest_paths(paths: Column) -> Column:
    """Distinct pointers without those that are an ancestor of another one."""
    pointers = F.array_distinct(
        F.filter(F.transform(paths, to_pointer), lambda p: p.startswith("/"))
    )
    return bind(
        pointers,
        lambda ps: F.filter(ps, lambda p: ~F.exists(ps, lambda q: q.startswith(F.concat(p, F.lit("/"))))),
    )


def safe_patch_path(path: Column) -> Column:
    pointer = to_pointer(path)
    names = "|".join(dims.PROTECTED_POINTERS)
    return pointer.startswith("/") & ~pointer.rlike(f"^/(?:{names})(?:/|$)")


def fix_path_shape(pointer: Column) -> Column:
    leaves = "|".join(dims.FIX_LEAVES)
    return pointer.rlike(
        rf"^/questionItems/[0-9]+/answerSpecs/[0-9]+/expected(?:/(?:[^/]+/)*(?:{leaves}))?$"
    )


def patch_scope(intent: Column, pointer: Column) -> Column:
    """Whether a patch of this intent may touch this pointer."""
    return (
        F.when(
            intent == "align_hint_to_solution", F.contains(F.concat(pointer, F.lit("/")), F.lit("/hints/"))
        )
        .when(intent == "clean_solution_reasoning", pointer.startswith("/solutions/"))
        .otherwise(F.lit(True))
    )


def tokens(pointer: Column) -> Column:
    """Unescaped parts of a pointer; the root pointer has none."""
    parts = F.split(pointer, "/", -1)
    rest = F.slice(parts, F.lit(2), F.size(parts) - 1)
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            rest, lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        )
    )
