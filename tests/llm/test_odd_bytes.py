"""Strings that are no UTF-8: defined for every operator that reads texts in Python."""

import pytest

from rubrica.llm import language_id, pii, simhash, substrings, token_counts, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.sql("SELECT id AS doc_id, cast(concat(x'fffe', cast(concat(' the cat mail a@b.com ', id) AS binary)) AS string) AS text, 'en' AS lang FROM range(12)")
    return odd.unionByName(spark.sql("SELECT id + 100 AS doc_id, 'le chat et le chien' AS text, 'fr' AS lang FROM range(12)"))


def test_language(docs):
    assert {r.lang_pred for r in language_id.languages(docs).collect()} == {"en", "fr"}


def test_personal_data(docs):
    assert sum(r.n_email for r in pii.personal_data(docs.select("doc_id", "text")).collect()) == 12


def test_token_counts(docs):
    assert sum(r.n_docs for r in token_counts.histogram(docs.select("text")).collect()) == 24


def test_toxicity(spark, docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id < 50 AS int) AS toxic")
    assert toxicity.toxicity(docs.select("doc_id", "text"), labels).count() == 24


def test_fingerprints_and_substrings(docs):
    assert simhash.near_duplicates(docs.select("doc_id", "text")).count() == 24
    assert substrings.without_repeats(docs.select("doc_id", "text")).count() == 24
