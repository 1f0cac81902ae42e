"""Repairing the structure of conversations by grammar-compressed dynamic programming.

Every row of a conversation becomes a symbol of its role and fault. The cheapest edits that make the roles read `(s?(ua)+)?` are
a shortest path through the four states of that pattern, so a run of symbols is a min-plus transfer matrix: cost of the cheapest
edits from every state to every other. Beside each cost stands the rank of the entry's audit among those of the matrix, and
the state in its middle. A pair of runs is then put together from these alone: of equal costs the one wins whose left part ranks
first, then whose right part does; that is the order of the audits themselves, since inserts are booked before the row they
precede, so every audit of a run ends with the edit of its last row and none is the beginning of another. The middle
states are a rope from which an audit is spelled out only where it is chosen.

Sequences repeat each other, so they are compressed by Re-Pair before they are evaluated. In each round the pairs of neighbours
are counted over all distinct sequences, the most frequent become rules, and sequences are rewritten with them. Each rule's matrix is made
once, from those of its two sides, and shared by all conversations through a broadcast. The grammar is bounded by
RULES and ROUNDS; what it leaves of a sequence is folded symbol by symbol, so these bounds change no result.

No conversation has to fit into a task. Equal rows are counted before they are sorted; the sort is a range partitioning by
conversation and turn, whose rows are cut into chunks of bounded length; of a chunk only its matrix takes part in the choice of
states, and one byte of it is kept. Only the digest reads a conversation's rows as one stream, since SHA-256 knows no other way.

Defined results: null roles and texts count as one space; a null conv_id is a conversation of its own; null turns come
first; rows of one turn are ordered by role, then text; repeated rows are duplicates; bytes that are no UTF-8 count as
U+FFFD; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.session import cut_lineage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What edits cost, and what a truncated row adds unless it is deleted.
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: States: nothing yet, after s, after u, after a. Symbols: s, u, a or another role; the same, truncated; a row that must go.
STATES, INITIALS, GONE = 4, "sua", 8
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FORCED = ("u", "u", "a", "u")  # what an inserted or reroled row becomes in each state
ROLES = {"u": "user", "a": "assistant"}
#: What the states still need at the end.
MISSING = (0, 2, 1, 0)
NEVER = 1 << 40
#: Rules of a round and rounds of the grammar at most.
RULES, ROUNDS = 512, 12
#: Symbols, and bytes of text, after which a chunk ends.
CHUNK, CHUNK_BYTES = 4096, 4 << 20
#: Sequences whose matrices a task remembers.
REMEMBERED = 20_000
FAULTS = ("blank", "duplicate", "truncated", "illegal")


def edits(symbol: int) -> list[list[tuple[int, str] | None]]:
    """The cheapest audits of one row, inserts before it included, from every state to every other."""
    table: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]
    extra = TRUNCATED if 4 <= symbol < GONE else 0
    role = INITIALS[symbol % 4] if symbol < GONE and symbol % 4 < 3 else None
    for start in range(STATES):
        at = start
        for inserts in range(STATES):
            ways = [(DELETE, at, COSTS[DELETE])]
            if symbol != GONE:
                ways.append((REROLE, NEXT[at, FORCED[at]], COSTS[REROLE] + extra))
                if (at, role) in NEXT:
                    ways.append((KEEP, NEXT[at, role], COSTS[KEEP] + extra))
            for edit, end, cost in ways:
                found = (cost + inserts * COSTS[INSERT], INSERT * inserts + edit)
                table[start][end] = min(table[start][end] or found, found)
            at = NEXT[at, FORCED[at]]
    return table


def ranks(values: np.ndarray) -> np.ndarray:
    """Of (n, 16) values, how many of their row are smaller: equal values, and only those, have equal ranks."""
    return (values[:, None, :] < values[:, :, None]).sum(axis=2)


def combine(cost_l: np.ndarray, rank_l: np.ndarray, cost_r: np.ndarray, rank_r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, ranks and middle states of n pairs of runs, all (n, 4, 4)."""
    cost = cost_l[:, :, :, None] + cost_r[:, None, :, :]
    audit = rank_l[:, :, :, None] * 16 + rank_r[:, None, :, :]
    key = np.minimum(cost, NEVER) * 256 + audit
    middle = key.argmin(axis=2)
    best = np.take_along_axis(key, middle[:, :, None, :], 2)[:, :, 0, :]
    return best >> 8, ranks((best & 255).reshape(-1, 16)).reshape(-1, STATES, STATES), middle


class Grammar:
    """Rules of pairs of symbols by rounds, and the matrix of every symbol."""

    def __init__(self):
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.sides: list[tuple[int, int]] = []
        tables = [edits(symbol) for symbol in range(GONE + 1)]
        flat = [[e for row in t for e in row] for t in tables]
        self.spelled = [[e[1] if e else "" for e in f] for f in flat]
        self.cost = np.array([[e[0] if e else NEVER for e in f] for f in flat]).reshape(-1, STATES, STATES)
        self.rank = np.array([[sorted(set(s)).index(e) for e in s] for s in self.spelled]).reshape(-1, STATES, STATES)
        self.middle = np.zeros((GONE + 1, STATES, STATES), np.int64)

    def add(self, pairs: list[tuple[int, int]]) -> None:
        """A round of rules, the most frequent pair first, evaluated from the matrices of their sides."""
        first = len(self.cost)
        left, right = (np.array(side) for side in zip(*pairs))
        made = combine(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        self.cost, self.rank, self.middle = (np.concatenate([old, new]) for old, new in zip((self.cost, self.rank, self.middle), made))
        self.rounds.append({pair: first + k for k, pair in enumerate(pairs)})
        self.sides += pairs

    def parse(self, codes: bytes) -> list[int]:
        """A sequence rewritten round by round; of overlapping pairs the more frequent one counts, else the left one."""
        symbols = list(codes)
        for rules in self.rounds:
            if len(symbols) < 2:
                break
            new = [rules.get(pair) for pair in zip(symbols, symbols[1:])] + [None, None]
            out, i = [], 0
            while i < len(symbols):
                here, after = new[i], new[i + 1]
                if here is not None and (after is None or here <= after):
                    out.append(here)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def spell(self, symbol: int, start: int, end: int) -> str:
        """The audit of a symbol between two states, along the rope."""
        if symbol <= GONE:
            return self.spelled[symbol][start * STATES + end]
        left, right = self.sides[symbol - GONE - 1]
        middle = int(self.middle[symbol, start, end])
        return self.spell(left, start, middle) + self.spell(right, middle, end)


class Run:
    """The matrix of one sequence: its symbols after the grammar, folded in pairs."""

    def __init__(self, grammar: Grammar, codes: bytes):
        self.grammar, self.symbols = grammar, grammar.parse(codes)
        cost, rank = grammar.cost[self.symbols], grammar.rank[self.symbols]
        self.levels: list[tuple[int, np.ndarray]] = []
        while len(cost) > 1:
            even = len(cost) // 2 * 2
            new_cost, new_rank, middle = combine(cost[0:even:2], rank[0:even:2], cost[1:even:2], rank[1:even:2])
            self.levels.append((len(cost), middle))
            cost, rank = np.concatenate([new_cost, cost[even:]]), np.concatenate([new_rank, rank[even:]])
        self.cost, self.rank = cost[0], rank[0]

    def audit(self, start: int, end: int) -> str:
        ways = [(start, end)]
        for size, middle in reversed(self.levels):
            below = []
            for k, (i, j) in enumerate(ways):
                if 2 * k + 1 < size:
                    m = int(middle[k, i, j])
                    below += [(i, m), (m, j)]
                else:
                    below.append((i, j))
            ways = below
        return "".join(self.grammar.spell(s, i, j) for s, (i, j) in zip(self.symbols, ways))


class _Runs(dict):
    def __init__(self, grammar: Grammar):
        self.grammar = grammar

    def __missing__(self, codes: bytes) -> Run:
        if len(self) >= REMEMBERED:
            self.clear()
        run = self[codes] = Run(self.grammar, codes)
        return run


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), equal ones once with their number n, and the symbol of the first of them."""
    blank_if_null = lambda c: F.coalesce(F.make_valid_utf8(F.col(c).cast("string")), F.lit(" ")).alias(c)
    counted = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank_if_null("role"), blank_if_null("text"))
    counted = counted.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    ends = F.rtrim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    counted = cut_lineage(counted.withColumns({"blank": ends == "", "whole": F.right(ends, F.lit(1)).isin(".", "!", "?"), "digest": F.sha2("text", 256)}))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # null turns first
    seen = counted.where("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"))
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = counted.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    role: Column = F.lit(3)
    for k, initial in enumerate(INITIALS):
        role = F.when(F.left("role", F.lit(1)) == initial, k).otherwise(role)
    symbol = F.when(F.col("blank") | ~turn.eqNullSafe(F.col("first")), GONE).otherwise(role + F.when(F.col("whole"), 0).otherwise(4))
    return joined.select("conv_id", "turn", "role", "text", "n", "blank", symbol.cast("int").alias("symbol"))


def _chunk_schema(conv_id: pa.DataType) -> pa.Schema:
    longs = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "least", "most", "turns", "first_turn", "last_turn")]
    return pa.schema([("conv_id", conv_id), ("part", pa.int64()), ("codes", pa.binary()), ("first_role", pa.string()), ("last_role", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *longs])


CHUNK_COLUMNS = (
    "part long, codes binary, first_role string, last_role string, roles array<string>, texts array<string>, "
    "blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, first_turn long, last_turn long"
)


def legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


class _Chunk:
    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes, self.roles, self.texts, self.bytes = bytearray(), [], [], 0
        self.counts, self.turns, self.first, self.last = Counter(), 0, None, None
        self.span: list[int] = []

    def row(self, turn, role: str, text: str, symbol: int, blank: bool, n: int) -> None:
        """n equal rows, of which the first has the symbol and the others must go."""
        initial = role[:1]
        if self.codes:
            self.counts["illegal"] += not legal(self.last, initial)
        else:
            self.first = initial
        self.last = initial
        self.counts["illegal"] += n - 1
        gone = n - (symbol != GONE)
        self.counts["blank" if blank else "duplicate"] += gone
        self.counts["truncated"] += 4 <= symbol < GONE
        if symbol != GONE:
            self.codes.append(symbol)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
        self.codes += bytes([GONE]) * gone
        if turn is not None:
            self.turns += not self.span or self.span[1] != turn
            self.span = [self.span[0] if self.span else turn, turn]

    def values(self, part: int) -> tuple:
        first, last = self.span or (None, None)
        return (self.conv_id, part, bytes(self.codes), self.first, self.last, self.roles, self.texts, *(self.counts[f] for f in FAULTS), first, last, self.turns, first, last)


def _cut(schema: pa.Schema, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        held, chunk = 0, None

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done), schema)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for conv_id, turn, role, text, n, blank, symbol in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "blank", "symbol"))):
                while n:
                    if chunk is None or chunk.conv_id != conv_id or len(chunk.codes) >= most or chunk.bytes >= CHUNK_BYTES:
                        if chunk is not None:
                            held += chunk.bytes + 200
                            done.append(chunk.values(part + len(done)))
                            if held >= CHUNK_BYTES:
                                part += len(done)
                                held = 0
                                yield out()
                        chunk = _Chunk(conv_id)
                    some = min(n, most)
                    chunk.row(turn, role, text, symbol, blank, some)
                    n, symbol = n - some, GONE
        if chunk is not None:
            done.append(chunk.values(part + len(done)))
            yield out()

    return run


def chunks(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """Conversations in order, as chunks of about `most` symbols: symbols, counts, and the texts of rows that may stay."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    known = cut_lineage(marked(rows))  # sampled for the bounds of ranges, then sorted
    schema = _chunk_schema(_arrow(kind))
    return cut_lineage(known.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(schema, most), f"conv_id {kind}, {CHUNK_COLUMNS}"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def _pairs(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for codes in batch.column("codes"):
                symbols = grammar.parse(codes.as_py())
                before = None
                for pair in zip(symbols, symbols[1:]):
                    before = None if pair == before else pair  # of three equal symbols, one pair
                    if before:
                        counts[pair] += 1
            left, right = zip(*counts) if counts else ((), ())
            columns = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["l", "r", "n"])

    return run


def compress(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Rules for pairs that occur at least twice in the distinct sequences (codes); RULES pairs a round reach the driver."""
    grammar = Grammar()
    for _ in range(rounds):
        known = sequences.sparkSession.sparkContext.broadcast(grammar)
        counted = sequences.mapInArrow(lambda b, known=known: _pairs(known.value)(b), "l int, r int, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))
        pairs = [(row["l"], row["r"]) for row in counted.where("n > 1").orderBy(F.desc("n"), "l", "r").limit(rules).collect()]
        if not pairs:
            break
        grammar.add(pairs)
    return grammar


def _matrices(grammar: Grammar, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(grammar)
        for batch in batches:
            found = [runs[c.as_py()] for c in batch.column("codes")]
            made = {"cost": pa.array([r.cost.tobytes() for r in found], pa.binary()), "rank": pa.array([r.rank.tobytes() for r in found], pa.binary())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return run


NARROW = ("first_role", "last_role", *FAULTS, "least", "most", "turns", "first_turn", "last_turn")


def _decide(schema: pa.Schema):
    """The states between the chunks of every conversation, from one state and byte a chunk; counts are summed on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv = None

        def close() -> None:
            conv_id, total, cost, rank, back, *_ = conv
            end = min(range(STATES), key=lambda j: (cost[j] + MISSING[j] * COSTS[INSERT], rank[j], MISSING[j]))
            path = bytearray([end])
            for step in reversed(back):
                path.append(step[path[-1]])
            gaps = total["most"] - total["least"] + 1 - total["turns"] if total["turns"] else 0
            done.append((conv_id, -1, gaps, *(total[f] for f in FAULTS), cost[end] + MISSING[end] * COSTS[INSERT], bytes(path[::-1])))

        for batch in batches:
            names = ("conv_id", "cost", "rank", *NARROW)
            for values in zip(*(batch.column(c).to_pylist() for c in names)):
                row = dict(zip(names, values))
                m_cost, m_rank = (np.frombuffer(row[c], np.int64).reshape(STATES, STATES).tolist() for c in ("cost", "rank"))
                if conv is None or conv[0] != row["conv_id"]:
                    if conv is not None:
                        close()
                    conv = [row["conv_id"], Counter(), [0, NEVER, NEVER, NEVER], [0] * STATES, [], None, None]
                _, total, cost, rank, back, last_role, last_turn = conv
                for f in FAULTS:
                    total[f] += row[f]
                if back and not legal(last_role, row["first_role"]):
                    total["illegal"] += 1
                if row["turns"]:
                    total["least"] = min(total["least"], row["least"]) if total["turns"] else row["least"]
                    total["most"] = max(total["most"], row["most"]) if total["turns"] else row["most"]
                    total["turns"] += row["turns"] - (total["turns"] > 0 and last_turn == row["first_turn"])
                best = [min((cost[i] + m_cost[i][j], rank[i], m_rank[i][j], i) for i in range(STATES)) for j in range(STATES)]
                order = sorted({b[1:3] for b in best})
                conv[2:] = [min(b[0], NEVER) for b in best], [order.index(b[1:3]) for b in best], back, row["last_role"], row["last_turn"] if row["turns"] else last_turn
                back.append(bytes(b[3] for b in best))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        if conv is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def decided(cut: DataFrame, grammar: Grammar) -> DataFrame:
    """One row a conversation: counts of faults, cost, and the states before, between and after its chunks."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    conv_id = _arrow(kind)
    types = {"part": pa.int64(), "first_role": pa.string(), "last_role": pa.string()}
    narrow = pa.schema([("conv_id", conv_id), ("part", pa.int64()), ("cost", pa.binary()), ("rank", pa.binary())] + [(c, types.get(c, pa.int64())) for c in NARROW])
    columns = f"conv_id {kind}, part long, cost binary, rank binary, " + ", ".join(f"{c} {'string' if c.endswith('role') else 'long'}" for c in NARROW)
    known = cut.sparkSession.sparkContext.broadcast(grammar)
    made = cut.select("conv_id", "part", "codes", *NARROW).mapInArrow(lambda b: _matrices(known.value, narrow)(b), columns)
    longs = ("gaps", *FAULTS, "cost")
    schema = pa.schema([("conv_id", conv_id), ("part", pa.int64())] + [(c, pa.int64()) for c in longs] + [("path", pa.binary())])
    columns = f"conv_id {kind}, part long, " + ", ".join(f"{c} long" for c in longs) + ", path binary"
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_decide(schema), columns)


class _Conversation:
    """One conversation being repaired, chunk by chunk."""

    def __init__(self, conv_id):
        self.conv_id, self.numbers, self.path, self.at = conv_id, (0,) * 6, b"\0", 0
        self.audit, self.digest, self.rows = [], hashlib.sha256(), 0

    def step(self, run: Run, roles: list[str], texts: list[str], codes: bytes) -> Iterator[tuple[str, str]]:
        """The repaired rows of the next chunk."""
        start, end = self.path[self.at], self.path[self.at + 1]
        self.at += 1
        audit = run.audit(start, end)
        self.audit.append(audit)
        state, row, held = start, 0, 0
        for edit in audit:
            if edit == INSERT:
                yield ROLES[FORCED[state]], ""
                state = NEXT[state, FORCED[state]]
                continue
            role, text = (roles[held], texts[held]) if codes[row] != GONE else (None, None)
            held += codes[row] != GONE
            row += 1
            if edit == REROLE:
                role = ROLES[FORCED[state]]
            if edit != DELETE:
                yield role, text
                state = NEXT[state, role[:1]]

    def end(self) -> Iterator[tuple[str, str]]:
        state = self.path[-1]
        for _ in range(MISSING[state]):
            self.audit.append(INSERT)
            yield ROLES[FORCED[state]], ""
            state = NEXT[state, FORCED[state]]

    def add(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.rows else "") + role + ":" + text).encode())
        self.rows += 1


def _apply(grammar: Grammar, schema: pa.Schema, as_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(grammar)
        done: list[tuple] = []
        held, conv = 0, None

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done), schema)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        def take(rows: Iterator[tuple[str, str]]) -> int:
            size = 0
            for role, text in rows:
                if as_rows:
                    done.append((conv.conv_id, conv.rows, role, text))
                    size += len(text) + 50
                    conv.rows += 1
                else:
                    conv.add(role, text)
            return size

        def close() -> int:
            size = take(conv.end())
            if not as_rows:
                done.append((conv.conv_id, *conv.numbers, "".join(conv.audit), conv.digest.hexdigest()))
                size += 200 + len(conv.audit)
            return size

        names = ("conv_id", "part", "codes", "roles", "texts", "numbers", "path")
        for batch in batches:
            for conv_id, part, codes, roles, texts, numbers, path in zip(*(batch.column(c).to_pylist() for c in names)):
                if conv is None or conv.conv_id != conv_id:
                    if conv is not None:
                        held += close()
                    conv = _Conversation(conv_id)
                if part == -1:
                    conv.numbers, conv.path = tuple(numbers), path
                elif part >= 0:
                    held += take(conv.step(runs[codes], roles, texts, codes))
                if held >= CHUNK_BYTES and done:
                    held = 0
                    yield out()
        if conv is not None:
            close()
        if done:
            yield out()

    return run


def _applied(rows: DataFrame, ids: DataFrame | None, as_rows: bool, most: int) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    cut = chunks(rows, most)
    grammar = compress(cut_lineage(cut.select("codes").distinct()))
    known = rows.sparkSession.sparkContext.broadcast(grammar)
    none = lambda t: F.lit(None).cast(t)
    layout = lambda df, part, **given: df.select("conv_id", part.alias("part"), *[given.get(c, none(t)).alias(c) for c, t in (("codes", "binary"), ("roles", "array<string>"), ("texts", "array<string>"), ("numbers", "array<bigint>"), ("path", "binary"))])
    col = F.col
    heads = layout(decided(cut, grammar), col("part"), numbers=F.array("gaps", *FAULTS, "cost"), path=col("path"))
    parts = layout(cut, col("part"), codes=col("codes"), roles=col("roles"), texts=col("texts"))
    united = heads.unionByName(parts)
    if ids is not None:
        united = united.unionByName(layout(ids.select("conv_id").distinct(), F.lit(-2).cast("long")))
    # A conversation's choice comes before its chunks, as rows of the same key: one shuffle, and no join that could split it.
    dealt = united.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    if as_rows:
        fields, columns = [("n", pa.int64()), ("role", pa.string()), ("text", pa.string())], "n long, role string, text string"
    else:
        longs = ("gaps", *FAULTS, "cost")
        fields = [(c, pa.int64()) for c in longs] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
        columns = ", ".join(f"{c} long" for c in longs) + ", audit string, repaired_sha256 string"
    schema = pa.schema([("conv_id", _arrow(kind)), *fields])
    return dealt.mapInArrow(lambda b: _apply(known.value, schema, as_rows)(b), f"conv_id {kind}, {columns}")


def repaired(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """(conv_id, n, role, text): the rows of every conversation after the cheapest edits, numbered from 0."""
    return _applied(rows, None, True, most)


def audited(rows: DataFrame, ids: DataFrame | None = None, most: int = CHUNK) -> DataFrame:
    """One row a conversation: gaps, faults, cost, audit and the digest of what is left.

    ids: conversations (conv_id) that have a row even if they have none in `rows`.
    """
    return _applied(rows, ids, False, most)
