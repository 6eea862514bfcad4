"""Operator 13: conversation structure repair by lazy weighted determinisation.

The role initials of a repaired conversation read ``(s?(ua)+)?``: an automaton of four
states (nothing yet, after s, after u, after a). For the rows from some place on, each
state has a least cost of edits; these four costs, less their minimum, are one state of a
deterministic automaton. Its states are numbered when first met, and the step from a state
by a row's symbol is cached in a transition table with the cost it adds, so scanning a
conversation is one table look-up a row. The scan goes from the last row to the first;
the audit is then traced against the scan's direction, over *tight* edits only (those that
keep the least cost), the first in ASCII order each time, which gives the ASCII-least of
the cheapest audits. Traced moves are cached in a table too.

Conversations of ordinary length are shuffled once, by id, and streamed through sorted
partitions. Longer ones (by rows or bytes) would make hot tasks, so they take another,
equally exact way: rows are sorted by ranges into blocks, duplicates are found by
aggregates over hashes, blocks become strings of one symbol a row, only those strings are
gathered by conversation (the audit is as long), and the texts return to their blocks,
are repaired there, and stream as pieces of a megabyte into the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyglass.llm.common import key_filter, lean, null_safe_join, partitions_for, released, scratch, stored, temporary

#: Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Conversations above either go by blocks; rows of a block; characters of a piece of repaired text.
LONG_ROWS, LONG_BYTES, BLOCK_BITS, PIECE = 2048, 16 << 20, 12, 1 << 20

_START, _S, _U, _A = range(4)
#: The state after a user or assistant (whichever fits) is put next, and that role.
_NEXT = (_U, _U, _A, _U)
_ROLE = ("user", "user", "assistant", "user")
#: States after a kept row by its initial.
_KEPT = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}, "o": {}}
_SPACES = " \t\n\x0b\x0c\r"


class Determinised:
    """States, transitions and traced moves, grown as symbols ask for them.

    A symbol is ``x`` for a row that must go, else the class of its initial (s, u, a, o for others), in upper case if the row is truncated.
    """

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.moves: dict[tuple[int, str, int], tuple[str, int]] = {}
        self.end, self.end_cost = self._state(self._inserted([0, inf, inf, 0]))

    @staticmethod
    def _inserted(costs: list) -> list:
        for _ in range(3):
            costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    def _state(self, costs: list) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    @staticmethod
    def _edits(symbol: str, q: int) -> Iterator[tuple[str, int, int]]:
        """Edits of a row in a state, in ASCII order, without insertions: initial, cost, state after it."""
        yield "D", DELETE, q
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            if q in _KEPT[symbol.lower()]:
                yield "K", KEEP + more, _KEPT[symbol.lower()][q]
            yield "R", REROLE + more, _NEXT[q]

    def step(self, after: int, symbol: str) -> tuple[int, int]:
        """The state before a row from that after it, and the cost it adds."""
        found = self.steps.get((after, symbol))
        if found is None:
            v = self.vectors[after]
            found = self.steps[after, symbol] = self._state(self._inserted([min(c + v[to] for _, c, to in self._edits(symbol, q)) for q in range(4)]))
        return found

    def move(self, after: int, symbol: str, q: int) -> tuple[str, int]:
        """The tight edits, ASCII-least, that lead from state ``q`` before a row past it, and the state there."""
        before, least = self.step(after, symbol)
        v, w, edits = self.vectors[before], self.vectors[after], ""
        while not edits or edits[-1] == "I":
            tight = [(e, to) for e, c, to in self._edits(symbol, q) if c + w[to] == v[q] + least]
            if INSERT + v[_NEXT[q]] == v[q]:
                tight.append(("I", _NEXT[q]))
            e, q = min(tight)
            edits += e
        return edits, q

    def scan(self, symbols: str, end: int | None = None) -> tuple[list[int], int]:
        """The state after each row (one more, first, before the first row) and the cost that all rows add."""
        at = self.end if end is None else end
        states, cost = [at] * (len(symbols) + 1), 0
        steps = self.steps
        for i in range(len(symbols) - 1, -1, -1):
            key = (at, symbols[i])
            at, more = steps[key] if key in steps else self.step(*key)
            states[i] = at
            cost += more
        return states, cost

    def trace(self, symbols: str, states: list[int], q: int = _START) -> tuple[list[str], int]:
        """The edits at each row and the state after them."""
        moves, out = self.moves, []
        for i, symbol in enumerate(symbols):
            key = (states[i + 1], symbol, q)
            if key not in moves:
                moves[key] = self.move(*key)
            edits, q = moves[key]
            out.append(edits)
        return out, q

    def finish(self, q: int) -> str:
        """Insertions behind the last row."""
        edits = ""
        while self.vectors[self.end][q] != 0 or q not in (_START, _A):
            edits, q = edits + "I", _NEXT[q]
        return edits

    def solve(self, symbols: str) -> tuple[int, list[str], str]:
        """Least cost from the start, the edits at each row, and those behind the last."""
        states, cost = self.scan(symbols)
        edits, q = self.trace(symbols, states)
        return self.end_cost + cost + self.vectors[states[0]][_START], edits, self.finish(q)


def repaired(edits: str, role: str, text: str, q: int) -> tuple[list[str], int]:
    """The lines that a row's edits give, and the state after them."""
    lines = []
    for e in edits:
        if e == "I":
            lines.append(f"{_ROLE[q]}:")
            q = _NEXT[q]
        elif e == "K":
            lines.append(f"{role}:{text}")
            q = _KEPT[initial_class(role)][q]
        elif e == "R":
            lines.append(f"{_ROLE[q]}:{text}")
            q = _NEXT[q]
    return lines, q


def initial_class(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_RESULT = [*[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], *[T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]]


def _conversation(rows: list[tuple], automaton: Determinised) -> tuple:
    """One conversation's result; ``rows`` hold turn, role, text, copies, blank, cut in order, and copies may be none."""
    turns, seen, symbols, kept = set(), set(), [], []
    blank = duplicate = truncated = illegal = 0
    before = None
    for turn, role, text, copies, is_blank, is_cut in rows:
        if not copies:
            continue
        if turn is not None:
            turns.add(turn)
        initial = initial_class(role)
        for _ in range(copies):
            illegal += before is not None and (before, initial) not in _LEGAL
            before = initial
            if is_blank:
                blank += 1
                symbols.append("x")
            elif (role, text) in seen:
                duplicate += 1
                symbols.append("x")
            else:
                seen.add((role, text))
                truncated += is_cut
                symbols.append(initial.upper() if is_cut else initial)
            kept.append((role, text))
    if not symbols:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    cost, edits, last = automaton.solve("".join(symbols))
    lines, q = [], _START
    for e, (role, text) in zip(edits, kept, strict=True):
        more, q = repaired(e, role, text, q)
        lines += more
    lines += repaired(last, "", "", q)[0]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, blank, duplicate, truncated, illegal, cost, "".join(edits) + last, digest)


def _streamed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def _ordinary(rows: DataFrame, conv_type: T.DataType) -> DataFrame:
    """Conversations of bounded length: one shuffle by id, then a stream of sorted rows."""
    schema = T.StructType([T.StructField("conv_id", conv_type), *_RESULT])
    arrow = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
    names = ("conv_id", "turn", "role", "text", "copies", "blank", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, out = Determinised(), []
        for conv, group in groupby(_streamed(batches, names), key=lambda r: r[0]):
            out.append((conv, *_conversation([r[1:] for r in group], automaton)))
            if len(out) == 2000:
                yield as_batch(out, arrow)
                out = []
        if out:
            yield as_batch(out, arrow)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(*names).mapInArrow(run, schema)


def as_batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("state", T.IntegerType())])
_SOLVED = T.StructType(
    [T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("blocks", T.ArrayType(_BLOCK))]
    + [T.StructField("tail", T.StringType()), T.StructField("tail_state", T.IntegerType())]
)


@F.pandas_udf(_SOLVED)
def _solved(blocks: pd.Series) -> pd.DataFrame:
    """Solves conversations given as ordered blocks of symbols and initials, and deals the edits to the blocks."""
    automaton, out = Determinised(), []
    for parts in blocks:
        symbols, initials = "".join(p["symbols"] for p in parts), "".join(p["initials"] for p in parts)
        cost, edits, last = automaton.solve(symbols)
        illegal = sum((a, b) not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
        dealt, at, q = [], 0, _START
        for p in parts:
            n = len(p["symbols"])
            own = edits[at : at + n]
            dealt.append((p["block"], own, q))
            for e, symbol in zip(own, symbols[at : at + n], strict=True):
                # the classes of initials stand for roles here
                _, q = repaired(e, symbol.lower(), "", q)
            at += n
        out.append((cost, illegal, "".join(edits) + last, dealt, last, q))
    return pd.DataFrame(out, columns=_SOLVED.names)


def _symbol_blocks(rows: DataFrame) -> DataFrame:
    """conv_id, block, symbols and initials from stored rows in order, whose repeats have been marked."""
    each = F.sort_array(F.collect_list(F.struct("pos", "symbol", "initial", "copies")))
    text = lambda f: F.array_join(F.transform("rows", f), "")
    symbols = text(lambda r: F.concat(r["symbol"], F.repeat(F.lit("x"), (r["copies"] - 1).cast("int"))))
    initials = text(lambda r: F.repeat(r["initial"], r["copies"].cast("int")))
    return rows.groupBy("conv_id", "block").agg(each.alias("rows")).select("conv_id", "block", symbols.alias("symbols"), initials.alias("initials"))


def _pieces(conv_arrow: pa.DataType, size: int):
    """Repairs the texts of blocks: the first row of a block carries its edits, the rows follow in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _streamed(batches, ("conv_id", "block", "role", "text", "copies", "edits", "state"))
        for (conv_id, block), group in groupby(rows, key=lambda r: r[:2]):
            number, held, length = 0, [], 0
            edits, q, at = next(group)[5:7] + (0,)
            for *_, role, text, copies, _e, _q in group:
                lines = []
                for e in edits[at : at + copies]:
                    more, q = repaired(e, role, text, q)
                    lines += more
                at += copies
                for line in lines:
                    for i in range(0, len(line) + 1, size):  # a newline goes before each line; the digest skips the first
                        held.append(("\n" if i == 0 else "") + line[i : i + size])
                        length += len(held[-1])
                        if length >= size:
                            yield conv_batch(conv_id, block, number, "".join(held))
                            number, held, length = number + 1, [], 0
            if held:
                yield conv_batch(conv_id, block, number, "".join(held))

    def conv_batch(conv_id, block, number, text):
        return pa.RecordBatch.from_arrays([pa.array([conv_id], conv_arrow), pa.array([block], pa.int64()), pa.array([number], pa.int64()), pa.array([text], pa.string())], ["conv_id", "block", "number", "piece"])

    return run


def _digests(conv_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, group in groupby(_streamed(batches, ("conv_id", "piece")), key=lambda r: r[0]):
            digest, first = hashlib.sha256(), True
            for _, piece in group:
                digest.update(piece[1 if first else 0 :].encode())
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], conv_arrow), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return run


def _by_blocks(rows: DataFrame, block_bits: int = BLOCK_BITS, piece: int = PIECE, salts: int = 32) -> DataFrame:
    """Conversations of any length; see the module's text."""
    conv_type = rows.schema["conv_id"].dataType
    conv, conv_arrow = conv_type.simpleString(), to_arrow_type(conv_type)
    key = ["conv_id", "turn", "role", "text"]
    # rows equal in all are adjacent and differ in nothing, so they travel as one with a count
    once = rows.groupBy(*key).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    n = partitions_for(rows, 32 << 20, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = once.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*key)
    ordered = released(ranged.withColumn("pos", F.monotonically_increasing_id()), "repair-order").withColumn("block", F.shiftright("pos", block_bits))

    # the first place of each role and text that comes more than once; its rows are spread over salts
    hashed = ordered.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(7), "text", "role"))
    slim = hashed.drop("text").withColumn("salt", F.pmod(F.xxhash64("pos"), F.lit(salts)).cast("int"))
    same = ["conv_id", "h1", "h2"]
    first = slim.where(~F.col("blank")).groupBy(*same).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    again = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marked = null_safe_join(slim, first, [*same, "salt"]).withColumn("again", again & ~F.col("blank")).withColumn("initial", initial)
    symbol = F.when(F.col("blank") | F.col("again"), "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    marked = stored(marked.select("conv_id", "turn", "pos", "block", "copies", "blank", "cut", "again", "initial", symbol.alias("symbol")), "repair-marks")

    copies = F.col("copies")
    fine = ~F.col("blank") & ~F.col("again")
    turns = marked.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), copies).otherwise(0)).alias("blank"), F.sum(F.when(F.col("again"), copies).when(fine, copies - 1).otherwise(0)).alias("duplicate"),
        F.sum((fine & F.col("cut")).cast("long")).alias("truncated"),
    )
    stats = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    blocks = _symbol_blocks(marked)
    gathered = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "symbols", "initials"))).alias("blocks"))
    solved = stored(gathered.select("conv_id", _solved("blocks").alias("s")).select("conv_id", "s.*"), "repair-edits")

    no_text = F.lit(None).cast("string")
    heads = solved.select("conv_id", F.explode("blocks").alias("b")).select("conv_id", "b.block", F.lit(-1).cast("long").alias("pos"), no_text.alias("role"), no_text.alias("text"), F.lit(0).cast("long").alias("copies"), "b.edits", "b.state")
    # insertions behind the last row make a block of their own, the last
    tails = solved.where("tail <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("block"), "tail", "tail_state")
    tail_piece = F.when(F.col("tail_state") == _U, F.concat(F.lit("\nassistant:"), F.when(F.length("tail") > 1, "\nuser:\nassistant:").otherwise(""))).otherwise("\nuser:\nassistant:")
    tails = tails.select("conv_id", "block", F.lit(0).cast("long").alias("number"), tail_piece.alias("piece"))
    body = ordered.select("conv_id", "block", "pos", "role", "text", "copies", F.lit(None).cast("array<string>").alias("edits"), F.lit(None).cast("int").alias("state"))
    fed = heads.unionByName(body).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").drop("pos")
    pieces = fed.mapInArrow(_pieces(conv_arrow, piece), f"conv_id {conv}, block long, number long, piece string").unionByName(tails)
    digests = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block", "number").select("conv_id", "piece").mapInArrow(_digests(conv_arrow), f"conv_id {conv}, repaired_sha256 string")
    out = null_safe_join(null_safe_join(stats, solved.select("conv_id", "cost", "illegal", "audit"), ["conv_id"]), digests, ["conv_id"])
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with ``copies``: by crc32(``conv_id:turn``) % 20, 0 has none, 1 an empty text, 2 no ``[.!?]``, 3 two copies, 4 the role user.

    In the key, role and text a null is one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_bits: int = BLOCK_BITS, piece: int = PIECE) -> DataFrame:
    """One row for each ``conv_id`` of ``rows`` (conv_id, turn, role, text, copies): faults, cost, audit and digest of the repaired conversation.

    * Rows go by turn (nulls first), then role, then text; a row with copies 0 only names its conversation.
    * Null ids are one conversation; null roles and texts are one space; a conversation without rows has zeros, an empty audit and the digest of nothing.
    * Repeated rows are duplicates, blank ones are blank first; conversations and texts may be of any length; an empty table gives no rows.
    """
    spark = rows.sparkSession
    lean(spark)
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], "copies")
    core = F.rtrim(F.col("text"), F.lit(_SPACES))
    rows = rows.withColumn("blank", core == "").withColumn("cut", (core != "") & ~F.right(core, F.lit(1)).isin(".", "!", "?"))
    conv_type = rows.schema["conv_id"].dataType
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    hashed: Column = F.xxhash64("conv_id")
    path = scratch(spark, "repaired")
    with temporary(spark):
        large = stored(sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(hashed.alias("key")), "repair-long")
        if large.isEmpty():
            return _ordinary(rows, conv_type)
        # a filter of fixed size; conversations that it takes for long ones are solved the same either way
        is_long = key_filter(large)(hashed)
        few, many = rows.where(~is_long), rows.where(is_long)
        by_blocks = _by_blocks(many.where("copies > 0"), block_bits, piece)
        empty = many.groupBy("conv_id").agg(F.sum("copies").alias("n")).where("n = 0")
        zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        nothing = empty.select("conv_id", *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
        return released(_ordinary(few, conv_type).unionByName(by_blocks).unionByName(nothing), "repaired", path)


def op13(spark: SparkSession, d: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{d}/conversations.parquet")))


QUERIES = {"op13_conversation_repair": op13}
