"""Best-fit packing: whole pieces, gapless sequences, and as few of them as best fit piece by piece gives."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rubrica.llm import best_fit


def one_by_one(lengths, room):
    """Best fit, longest first, piece by piece: how many sequences it needs."""
    spare, made = [], 0
    for size in sorted(lengths, reverse=True):
        at = bisect_left(spare, size)
        left = spare.pop(at) if at < len(spare) else room
        made += at == len(spare) and left == room
        insort(spare, left - size)
    return made


def placed(slots, counts):
    """Every piece of a plan as (sequence, offset, length)."""
    runs = defaultdict(list)
    for size, rank, first, each, offset in slots:
        runs[size].append((rank, first, each, offset))
    for size, n in counts.items():
        starts = sorted(runs[size])
        for rank in range(n):
            low, first, each, offset = starts[bisect_left(starts, (rank + 1,)) - 1]
            yield first + (rank - low) // each, offset + (rank - low) % each * size, size


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_is_best_fit(lengths, room):
    counts = Counter(lengths)
    sequences = defaultdict(list)
    for sequence, offset, size in placed(best_fit.plan(counts, room), counts):
        sequences[sequence].append((offset, size))
    for slots in sequences.values():
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
        assert at <= room
    assert sum(map(len, sequences.values())) == len(lengths)
    assert len(sequences) == one_by_one(lengths, room)


def test_plan_stays_small_for_any_number_of_documents():
    rng = random.Random(3)
    counts = {size: rng.randint(1, 10**9) for size in range(1, 2049)}
    slots = best_fit.plan(counts, 2048)
    assert len(slots) < 40_000


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("length", [16, 2048])
def test_whole_documents_in_gapless_sequences(spark, tokenizer, length, monkeypatch):
    monkeypatch.setattr(best_fit, "BUCKET", 7)  # a length's pieces are ranked in many buckets
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["ab", "the", "zebra's", "Éa", "42"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "日本 " * 500), (903, "long words " * 9_000), (904, "same text"), (904, "same text"), (None, "no id")]
    docs += [(1000 + i, "copies of one text") for i in range(100)]
    df = spark.createDataFrame([(d, t, 5, 6) for d, t in docs], "doc_id long, text string, length int, bucket int")
    rows = best_fit.pack(df, length).collect()
    want = Counter()
    for d, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            want[d, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
        assert at <= length
    assert len(sequences) == one_by_one([r.length for r in rows], length)


def test_empty_table(spark):
    assert best_fit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bytes_that_are_no_utf8(spark, tokenizer):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'ff6162' AS string) AS text")
    assert [r.length for r in best_fit.pack(df).collect()] == [len(tokenizer.encode("�ab", add_special_tokens=False).ids) + 1]
