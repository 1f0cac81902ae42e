import random
from collections import Counter

from rubrica.llm import token_counts
from rubrica.llm.encoding import byte_encoder


def test_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "Zähler", "x1", "日本"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "<|endoftext|>", "word " * 30_000, "a" * 5000]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    encode = byte_encoder().encode_ordinary
    lengths = [len(encode(t or "")) for t in texts]
    table = token_counts.context_table(token_counts.histogram(docs))
    rows = {r.n_tokens: r for r in table.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(lengths)
    for limit, r in rows.items():
        longer = [n for n in lengths if n > limit]
        assert (r.docs_longer, r.tokens_longer) == (len(longer), sum(longer))
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert abs(r.quantile - (1 - len(longer) / len(lengths))) < 1e-12
    for r in token_counts.at_limits(table, [0, 7, 4096, 10**6]).collect():
        assert r.truncated_tokens == sum(min(n, r.context) for n in lengths)
        assert r.docs_fitting == sum(n <= r.context for n in lengths)


def test_empty_table(spark):
    assert token_counts.context_table(token_counts.histogram(spark.createDataFrame([], "text string"))).count() == 0
