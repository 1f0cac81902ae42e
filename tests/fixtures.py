"""Small nested documents for tests: one valid document per kind, changed one field at a time."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F


def block(text="Shown text.", **more):
    return {"id": "b", "type": "text", "text": text, **more}


def choice_object():
    return {
        "id": "q1",
        "instruction": [block("Read the task.")],
        "questionItems": [
            {
                "id": "i1",
                "stem": [block("What is 2 + 3 = ?")],
                "interactions": [
                    {
                        "id": "x1",
                        "type": "single_choice",
                        "config": {
                            "options": [
                                {"id": "A", "content": [block("five")]},
                                {"id": "B", "content": [block("six")]},
                                {"id": "C", "content": [block("seven")]},
                            ]
                        },
                        "display": {},
                    }
                ],
                "answerSpecs": [
                    {"interactionId": "x1", "type": "single_choice", "expected": {"correctOptionId": "A"}}
                ],
                "hints": [{"name": "h", "content": [block("Count on.")]}],
            }
        ],
        "solutions": [{"solverName": "s", "solutionContent": [block("2 + 3 = 5")]}],
    }


def object_of(itype, expected, config=None, **more):
    doc = choice_object()
    inter = doc["questionItems"][0]["interactions"][0]
    inter["type"] = itype
    inter["config"] = config or {}
    spec = doc["questionItems"][0]["answerSpecs"][0]
    spec["type"] = itype
    spec["expected"] = expected
    doc.update(more)
    return doc


def plan_record():
    return {
        "_id": "r1",
        "name": "record",
        "question": "a) x b) y",
        "answer": "1 and 2",
        "question_plan": {
            "type": "advanced_question_plan",
            "plan": [
                {
                    "questionOrder": 1,
                    "questionStatement": "Solve both parts.",
                    "questionItems": [
                        {
                            "itemOrder": 1,
                            "requirement": "Solve part a.",
                            "interactions": [
                                {
                                    "interactionOrder": 1,
                                    "interactionType": "short_answer",
                                    "interactionRequirement": "Give the number.",
                                }
                            ],
                        }
                    ],
                }
            ],
        },
    }


def changed(doc, path, value=..., drop=False):
    """A copy of the document with one place set or removed."""
    doc = copy.deepcopy(doc)
    node = doc
    for step in path[:-1]:
        node = node[step]
    if drop:
        del node[path[-1]]
    else:
        node[path[-1]] = value
    return doc


def variants(spark, docs, key="doc_id", name="doc"):
    rows = [(k, json.dumps(d, ensure_ascii=False)) for k, d in docs]
    return spark.createDataFrame(rows, f"{key} string, body string").select(
        key, F.parse_json("body").alias(name)
    )
