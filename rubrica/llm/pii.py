"""Personal data by weak supervision.

Emails, IP addresses, card and phone numbers are found by their patterns and always stay. Other strings that mix letters
and digits may be secrets; on each of these candidates labelers of pattern, shape and context vote;
no list of names or places is among them, so `secret` is the only kind that is added. From the counts of all
votes over the corpus, expectation-maximisation estimates how reliable each labeler is and how likely each candidate is a
secret; these soft labels train the final span classifier, a logistic regression over votes and shape, whose spans of
kind `secret` are added.

Patterns are applied left to right without overlap within a kind; a match that fails its check is dropped and not
tried again shorter. Candidates that touch a pattern's span are left out.

Defined results: a null text equals an empty one and has no spans; rows that repeat a doc_id each get a row; offsets
count code points, the end exclusive; bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import utf8
from rubrica.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_PART = re.compile(r"[A-Za-z0-9_-]")

#: Strings that name a secret before it, and how keys of known services begin.
NAMES = re.compile(r"pass(word|wd|phrase)?|pwd|token|secret|api[_-]?key|key|auth|bearer|credential", re.I)
_KEY = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|(gh[pousr]|glpat|xox[abp])[_-][A-Za-z0-9_-]{10,}|sk[-_][A-Za-z0-9_-]{16,}")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_GIVEN = re.compile(r"[=:]\s?[\"']?$")
_PROSE = re.compile(r"[a-z]{6,}")
LEAST, BEFORE = 8, 24


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern of local part, @ and domain matches, found from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all pattern spans that pass their check, by start, then kind as listed."""
    found = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- candidates and labelers --------------------------------------------------------------------------------------


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of letters and digits with both, of some length, that touch no pattern's span."""
    out, done = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and _PART.match(text, a - 1):
            a -= 1
        while b < len(text) and _PART.match(text, b):
            b += 1
        done = b
        if b - a >= LEAST and b - a != len(m.group()) and not any(a < y and x < b for _, x, y in base):
            out.append((a, b))
    return out


LABELERS = ("format", "named", "given", "mixed", "not prose")
#: How often each labeler is expected to speak up on other strings. It counts as much as all candidates do, since a
#: corpus may hold few candidates that are no secrets, and two kinds of secrets must not be told apart as yes and no.
EXPECTED = np.array([0.02, 0.05, 0.05, 0.2, 0.4])
LENGTHS, SHARES = (12, 16, 24, 36, 64), (0.15, 0.3, 0.5, 0.75)


def observe(text: str, a: int, b: int) -> int:
    """The labelers' votes and the shape of a candidate as one small number."""
    own, before = text[a:b], text[max(0, a - BEFORE) : a]
    digits = sum("0" <= c <= "9" for c in own)
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(own, own[1:]))
    votes = (_KEY.fullmatch(own) or _HEX.fullmatch(own), NAMES.search(before), _GIVEN.search(before), turns >= 4, not _PROSE.search(own))
    shape = sum(b - a >= n for n in LENGTHS), sum(digits / (b - a) >= s for s in SHARES)
    return sum(bool(v) << i for i, v in enumerate(votes)) | shape[0] << 5 | shape[1] << 8


def _votes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(len(LABELERS)) & 1).astype(float)


def reliabilities(votes: np.ndarray, counts: np.ndarray, expected: np.ndarray = EXPECTED, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, P(vote | secret), P(vote | other)) by expectation-maximisation from what is expected."""

    def posterior(share, hit, false):
        log = lambda q: votes @ np.log(q) + (1 - votes) @ np.log(1 - q)
        return 1 / (1 + np.exp(np.clip(log(false) + np.log(1 - share) - log(hit) - np.log(share), -40, 40)))

    prior = 1 + counts.sum()
    p = posterior(0.5, np.full(votes.shape[1], 0.6), expected)
    for _ in range(rounds):
        one, zero = counts * p, counts * (1 - p)
        hit = (one @ votes + 1) / (one.sum() + 2)
        false = (zero @ votes + prior * expected) / (zero.sum() + prior)
        false = np.minimum(false, hit)  # no labeler speaks against what it is for
        new = posterior((one.sum() + 1) / (counts.sum() + 2), hit, false)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, hit, false


def classifier(codes: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """The probability of a secret for each observed code: a logistic regression on the soft labels."""
    if not len(codes):
        return {}
    votes = _votes(codes)
    soft = reliabilities(votes, counts)[0]
    x = np.hstack([votes, np.eye(6)[codes >> 5 & 7], np.eye(5)[codes >> 8 & 7], np.ones((len(codes), 1))])
    w = np.zeros(x.shape[1])
    weight = counts / counts.sum()
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (soft - p)) - 1e-3 * w)
    return dict(zip(codes.tolist(), (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


# --- the operator -------------------------------------------------------------------------------------------------


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*(f"n_{k}" for k in KINDS), "base", "starts", "ends", "codes"]
    types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 3
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py().decode(errors="replace")
            base = base_spans(text)
            cands = candidates(text, base)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), joined(base), [a for a, _ in cands], [b for _, b in cands], [observe(text, a, b) for a, b in cands]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"n_{k} long" for k in KINDS)
    scanned = docs.select("doc_id", utf8().alias("text")).mapInArrow(_scan, f"doc_id {kind}, {numbers}, base string, starts array<int>, ends array<int>, codes array<int>")
    rows = cut_lineage(scanned)
    seen = rows.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy("code").collect()  # at most 2 ** 11 codes
    chance = classifier(np.array([r.code for r in seen], np.int64), np.array([r["count"] for r in seen], float))
    chosen = {c for c, p in chance.items() if p >= least}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column("base").to_pylist()
            spans = []
            for own, starts, ends, codes in zip(base, *(batch.column(c).to_pylist() for c in ("starts", "ends", "codes"))):
                kept = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in own.split(",") if s)]
                kept += [("secret", a, b) for a, b, c in zip(starts, ends, codes) if c in chosen]
                spans.append(joined(sorted(kept, key=lambda s: (s[1], (*KINDS, "secret").index(s[0])))))
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(digests), pa.array(spans)], [*batch.schema.names[:5], "base_sha256", "spans"])

    return rows.mapInArrow(finish, f"doc_id {kind}, {numbers}, base_sha256 string, spans string")
