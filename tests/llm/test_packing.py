import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rubrica.llm import packing
from rubrica.llm.encoding import WordEncoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_the_tokenizer(tokenizer):
    rng, encoder = random.Random(2), WordEncoder()
    low = [chr(c) for c in range(1, 0x260) if c != 0xAD]
    texts = ["", "It's we'll I'd ÀÉ ß İ 1²3 x\x1cy ..!? a_b", "<|endoftext|> a", "Ωmega Σας", "é", "ﬁ 日本語", "y\xa0z\x85w"]
    texts += ["".join(rng.choice(low) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("aeinrst'é") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(50)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_curve_visits_every_cell_by_single_steps(bits):
    cells = np.array(list(product(range(1 << bits), repeat=4)))
    keys = packing.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, docs, tokenizer, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d in {d for d, _ in docs}:
        want = sorted(len(ids(tokenizer, t)) for e, t in docs if e == d)
        assert sum(r.length for r in by_doc[d]) == sum(want)
    for d, t in docs:
        if [e for e, _ in docs].count(d) == 1:
            all_ids, at = ids(tokenizer, t), 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                piece = np.array(all_ids[r.start : r.start + r.length], "<u4").tobytes()
                assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(piece), len(all_ids))
                at += r.length
            assert at == len(all_ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length and at.bit_count() == 1  # no padding: full, or a power of two


@pytest.mark.parametrize("length", [16, 4096])
def test_every_id_lies_in_one_piece(spark, tokenizer, length):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["ab", "the", "zebra's", "Éa", "42"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "日本 " * 500), (903, "long words " * 20_000), (904, "same text"), (904, "same text"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, length int")
    check(packing.pack(df, length).collect(), docs, tokenizer, length)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_like_texts_have_close_keys():
    same = packing.project(np.array([5, 6, 7, 800])), packing.project(np.array([800, 7, 7, 6, 5]))
    assert (same[0] == same[1]).all() and (packing.project(np.array([], "<u2")) == 0).all()


def test_bytes_that_are_no_utf8(spark, tokenizer):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'ff6162' AS string) AS text")
    assert sum(r.length for r in packing.pack(df).collect()) == len(ids(tokenizer, "\ufffdab"))
