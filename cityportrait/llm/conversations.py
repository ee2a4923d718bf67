"""Repair of conversations at the least cost, by dynamic programming over a grammar that all conversations share.

A conversation is a sequence of terminals, one a row: the first letter of its role, and its fault. Spark compresses
the distinct sequences with Re-Pair: round by round the pairs of neighbours that occur most often become symbols. An
edit of a sequence moves an automaton through the roles that are legal, s?(ua)+ or nothing; a terminal is a 4 x 4
matrix of (cost, audit) from state to state, and a symbol is the min-plus product of the two it stands for, with its
audits kept as ropes of the others' ropes. So a symbol is worked out once, bottom-up, whoever uses it. Equal costs are
ordered by audit: as an insertion costs and no row is left over, none of two audits of equal cost begins the other,
so the order survives concatenation.

Rows are dealt to ranges of (conv_id, turn), so a conversation with most rows lies in many tasks; each task cuts its
stretch into blocks of bounded size. A conversation in one block is done where it lies. Of one with several blocks,
the blocks' matrices are folded in order, and its repaired text, whose SHA-256 is one sequential computation, streams
through a task block by block and is never held.

Cases: nulls are one space; rows of the same turn stand in the order of their role and text (their first 128
characters, then a hash); a null conv_id is a conversation; a conversation without rows after damage has zeros and
empty strings; a role without a letter s, u or a first (an empty one too) can't stay as it is; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cityportrait.llm.common import mapped, small_or, written

#: Edits in the order of their letters, and what they cost; TRUNCATED is the cost of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
DAMAGES = 20
#: The roles' automaton: nothing yet, after s, after u, after a; nothing and after a may end.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = 4, (0, 3)
#: Rows and characters of a block, and characters of a row's place in the order.
BLOCK_ROWS, BLOCK_CHARS, ORDER_CHARS = 4_096, 1 << 17, 128
#: Rows, or blocks, that a task holds at a time.
BATCH = 500
#: Re-Pair: rounds, new symbols a round and in all, and the least count of a pair.
ROUNDS, PER_ROUND, SYMBOLS, LEAST = 8, 64, 512, 4
MAX_BROADCAST_CONVERSATIONS = 100_000
#: Sequences whose matrices a task keeps, and the longest of them.
MEMO, MEMO_LENGTH = 10_000, 64
SPACE = " \t\n\v\f\r"

#: Terminals are single characters: a row that must go, or a role's letter (x for any other), in capitals if truncated.
GONE = "-"
TERMINALS = GONE + "suaxSUAX"

Matrix = dict  # (from, to) -> (cost, rope); a rope is a string or a pair of ropes


def text_of(rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += (x[1], x[0])
    return "".join(out)


def _letters(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield from x
        else:
            stack += (x[1], x[0])


def less(a, b) -> bool:
    """Whether rope a's text is the smaller; neither begins the other unless they are equal."""
    if a is b:
        return False
    for x, y in zip(_letters(a), _letters(b), strict=False):
        if x != y:
            return x < y
    return False


def _better(into: Matrix, key: tuple[int, int], cost: int, rope) -> None:
    old = into.get(key)
    if old is None or cost < old[0] or (cost == old[0] and less(rope, old[1])):
        into[key] = cost, rope


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for j in range(STATES):
            if (k, j) in b:
                more, tail = b[k, j]
                _better(out, (i, j), cost + more, (rope, tail) if rope and tail else rope or tail)
    return out


def insertions() -> Matrix:
    """From each state to itself or on by inserted rows; more than two never pay."""
    one: Matrix = {(s, s): (0, "") for s in range(STATES)}
    for (s, letter), to in STEP.items():
        if letter in ROLES:
            _better(one, (s, to), INSERT, "I")
    return product(one, one)


def terminal(c: str) -> Matrix:
    """A row's matrix, insertions before it included."""
    own: Matrix = {(s, s): (DELETE, "D") for s in range(STATES)}
    if c != GONE:
        late = TRUNCATED if c.isupper() else 0
        for (s, letter), to in STEP.items():
            if letter == c.lower():
                _better(own, (s, to), late, "K")
            if letter in ROLES:
                _better(own, (s, to), REROLE + late, "R")
    return product(insertions(), own)


class Grammar:
    """Rules in the order they were made: symbol len(TERMINALS) + i stands for the pair rules[i]."""

    def __init__(self, rules: list[tuple[int, int]], ends: list[int]):
        """ends: the number of rules after each round."""
        self.rules, self.ends = rules, ends
        self.matrices: list[Matrix] = []
        self.place = {c: i for i, c in enumerate(TERMINALS)}
        self.memo: dict[str, Matrix] = {}

    def evaluated(self) -> Grammar:
        """With the matrix of every symbol, bottom-up."""
        self.matrices = [terminal(c) for c in TERMINALS]
        for left, right in self.rules:
            self.matrices.append(product(self.matrices[left], self.matrices[right]))
        return self

    def packed(self, sequence: str) -> list[int]:
        out, begin = [self.place[c] for c in sequence], 0
        for end in self.ends:
            pairs = {pair: len(TERMINALS) + i for i, pair in enumerate(self.rules[begin:end], begin)}
            out, begin = replaced(out, pairs), end
        return out

    def matrix(self, sequence: str) -> Matrix:
        """The matrix of a whole sequence, its audits as strings."""
        found = self.memo.get(sequence)
        if found is None:
            whole: Matrix = {(s, s): (0, "") for s in range(STATES)}
            for symbol in self.packed(sequence):
                whole = product(whole, self.matrices[symbol])
            found = {k: (cost, text_of(rope)) for k, (cost, rope) in whole.items()}
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(sequence) <= MEMO_LENGTH:
                self.memo[sequence] = found
        return found


def ended(vector: dict) -> tuple[int, object]:
    """The best way to end, from (cost, rope) by state."""
    best: Matrix = {}
    for (s, to), (more, tail) in insertions().items():
        if s in vector and to in ENDS:
            cost, rope = vector[s]
            _better(best, (0, 0), cost + more, (rope, tail) if tail else rope)
    return best[0, 0]


def replaced(sequence: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The pairs replaced from the left."""
    out, i, n = [], 0, len(sequence)
    while i < n:
        symbol = pairs.get((sequence[i], sequence[i + 1])) if i + 1 < n else None
        out.append(sequence[i] if symbol is None else symbol)
        i += 1 if symbol is None else 2
    return out


def re_pair(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND, symbols: int = SYMBOLS, least: int = LEAST) -> Grammar:
    """The grammar of a written table (sequence, n) of distinct sequences and how often each occurs.

    Every round counts the pairs of all sequences, in Spark; what reaches the driver is its `per_round` new symbols.
    """
    rules: list[tuple[int, int]] = []
    ends: list[int] = []
    for _ in range(rounds):
        most = min(per_round, symbols - len(rules))
        if most <= 0:
            break
        known = list(rules), list(ends)

        def pair_batches(batches: Iterator[pa.RecordBatch], known: tuple = known) -> Iterator[pa.RecordBatch]:
            grammar, counts = Grammar(*known), Counter()
            for batch in batches:
                for sequence, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    s, last = grammar.packed(sequence), None
                    for pair in zip(s, s[1:], strict=False):
                        # aaa holds aa once
                        last = None if pair == last and pair[0] == pair[1] else pair
                        if last:
                            counts[pair] += n
            pairs = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["a", "b", "n"])

        # at most the symbols squared, whatever the table
        counted = mapped(sequences.select("sequence", "n"), pair_batches, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        best = counted.orderBy(F.desc("n"), "a", "b").limit(most).collect()
        if not best:
            break
        rules += [(r.a, r.b) for r in best]
        ends.append(len(rules))
    return Grammar(rules, ends)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage, with an order of their own; rows that are dropped stay with `there` false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % DAMAGES).alias("_h"))
    d = d.withColumns({
        "there": F.col("_h") != 0,
        "text": F.when(F.col("_h").isin(0, 1), "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("_h") == 4, "user").otherwise(F.col("role")),
    })
    d = d.withColumn("_times", F.explode(F.sequence(F.lit(1), F.when(F.col("_h") == 3, 2).otherwise(1))))
    return d.select("conv_id", "turn", "there", "role", "text")


def _letter(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


BLOCK = "conv_id long, place long, n int, gaps struct<low:long,high:long,kinds:long>, first string, last string, illegal long, sequence string, digests array<binary>, roles array<string>, texts array<string>"
BLOCK_TYPE = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("n", pa.int32()),
    ("gaps", pa.struct([("low", pa.int64()), ("high", pa.int64()), ("kinds", pa.int64())])),
    ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("sequence", pa.string()),
    ("digests", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
#: Marks in a block's sequence, besides the terminals: a blank row, a duplicate one.
BLANK, DUPLICATE = "b", "d"
LEGAL = frozenset(["su", "ua", "au"])


class _Block:
    """The rows of a block as they come."""

    def __init__(self, conv_id: int | None, place: int):
        self.conv_id, self.place = conv_id, place
        self.marks, self.digests, self.roles, self.texts, self.turns, self.illegal, self.size = [], [], [], [], Counter(), 0, 0

    def add(self, turn: int | None, role: str, text: str, seen: set[bytes]) -> None:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        end = text.rstrip(SPACE)[-1:]
        mark = BLANK if not end else DUPLICATE if key in seen else _letter(role) if end in ".!?" else _letter(role).upper()
        seen.add(key)
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in LEGAL
        self.marks.append(mark)
        self.digests.append(key)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None:
            self.turns[turn] += 1
        self.size += len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.size >= BLOCK_CHARS

    def row(self) -> dict:
        t, r = self.turns, self.roles
        return {
            "conv_id": self.conv_id, "place": self.place, "n": len(r), "gaps": {"low": min(t), "high": max(t), "kinds": len(t)} if t else None,
            "first": r[0][:1] if r else None, "last": r[-1][:1] if r else None, "illegal": self.illegal, "sequence": "".join(self.marks),
            "digests": self.digests, "roles": r, "texts": self.texts,
        }


def _block_batches(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> blocks of one conversation each; copies within the stretch are found, also across its blocks."""
    block: _Block | None = None
    seen: set[bytes] = set()
    out: list[dict] = []
    size = count = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        batch, out, size = pa.RecordBatch.from_pylist(out, BLOCK_TYPE), [], 0
        return batch

    def close() -> None:
        nonlocal size, block
        if block:
            out.append(block.row())
            size += block.size
            block = None

    for batch in batches:
        for conv_id, turn, there, role, text, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if block is None or block.conv_id != conv_id or block.full(block_rows):
                if block is None or block.conv_id != conv_id:
                    seen.clear()
                close()
                if size >= 8 * BLOCK_CHARS or len(out) >= BLOCK_ROWS:
                    yield flush()
                block = _Block(conv_id, (part << 32) + count)
                count += 1
            if there:
                block.add(turn, role, text, seen)
    close()
    if out:
        yield flush()


def blocks_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The written blocks of all conversations, in order within each."""
    key = F.concat("role", F.lit("\0"), "text")
    d = damaged(rows).withColumns({"_key": F.substring(key, 1, ORDER_CHARS), "_hash": F.xxhash64("role", "text"), "_row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "_key", "_hash", "_row")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(mapped(d.select("conv_id", "turn", "there", "role", "text", F.spark_partition_id().alias("part")), partial(_block_batches, block_rows=block_rows), BLOCK), BATCH)


def _late_copies(blocks: DataFrame, several: DataFrame) -> DataFrame:
    """(place, late): rows of conversations with several blocks that an earlier block has; each block brings a text once."""
    b = blocks.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").select("conv_id", "place", F.posexplode("digests").alias("at", "digest"))
    once = b.groupBy("conv_id", "digest", "place").agg(F.min("at").alias("at"))
    # one row a block at most, so a group has as many as the conversation has blocks
    first = once.withColumn("first", F.min("place").over(W.partitionBy("conv_id", "digest"))).filter("place > first")
    return first.groupBy("place").agg(F.collect_list("at").alias("late"))


def _terminals(marks: str) -> str:
    return marks.replace(BLANK, GONE).replace(DUPLICATE, GONE)


def _marked(marks: str, late: list[int] | None) -> str:
    if not late:
        return marks
    m = list(marks)
    for i in late:
        if m[i] != BLANK:
            m[i] = DUPLICATE
    return "".join(m)


def _tally(marks: str) -> tuple[int, int, int]:
    return marks.count(BLANK), marks.count(DUPLICATE), sum(c.isupper() for c in marks)


def repaired(audit: str, roles: list[str], texts: list[str], odd: bool, at: int) -> tuple[list[str], int]:
    """The lines `role:text` that an audit leaves of some rows, and how many rows stand before what follows.

    odd: whether all of the conversation's rows begin with s; at: how many rows stand before these. A rerole or an
    insertion follows from the place.
    """
    lines, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            lines.append(f"{roles[i]}:{texts[i]}")
        else:
            role = ROLES["ua"[(at - odd) % 2]]
            lines.append(f"{role}:{texts[i]}" if edit == "R" else f"{role}:")
        i += edit != "I"
        at += 1
    return lines, at


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_NAMES = [x.split(" ")[0] for x in RESULT.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RESULT_NAMES)


def _gaps(low: int | None, high: int | None, kinds: int) -> int:
    return 0 if low is None else high - low + 1 - kinds


def _kept(audit: str) -> int:
    return len(audit) - audit.count("D")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, the faults' counts, cost, audit and the repaired text's SHA-256 of every conversation."""
    blocks = blocks_of(rows, block_rows)
    several = written(blocks.groupBy(F.col("conv_id").alias("of")).count().filter("count > 1").select("of"))
    several, _ = small_or(several, MAX_BROADCAST_CONVERSATIONS)
    in_several = F.col("conv_id").eqNullSafe(F.col("of"))
    late, _ = small_or(written(_late_copies(blocks, several)).withColumnRenamed("place", "of_place"), MAX_BROADCAST_CONVERSATIONS)
    marked = blocks.join(late, F.col("place") == F.col("of_place"), "left").drop("of_place")

    def sequence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_terminals(_marked(m, x)) for m, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())], ["sequence"])

    sequences = mapped(marked.select("sequence", "late"), sequence_batches, "sequence string")
    grammar = re_pair(written(sequences.groupBy("sequence").agg(F.count("*").alias("n")))).evaluated()

    def single_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, gaps, illegal, marks, roles, texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                m = grammar.matrix(_terminals(marks))
                cost, rope = ended({s: m[0, s] for s in range(STATES) if (0, s) in m})
                audit = text_of(rope)
                lines, _ = repaired(audit, roles, texts, _kept(audit) % 2 == 1, 0)
                sha = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
                g = gaps or {"low": None, "high": None, "kinds": 0}
                out.append((conv_id, _gaps(g["low"], g["high"], g["kinds"]), *_tally(marks), illegal, cost, audit, sha))
            yield _rows(out)

    alone = blocks.join(several, in_several, "left_anti")
    done = written(mapped(alone.select("conv_id", "gaps", "illegal", "sequence", "roles", "texts"), single_batches, RESULT), BATCH)
    if not several.take(1):
        return done
    many = marked.join(several, in_several, "left_semi")
    return done.unionByName(_long(many, grammar))


FOLDED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _long(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """Conversations with several blocks: fold their matrices, then stream their texts."""

    def matrix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "gaps", "first", "last", "illegal", "blank", "duplicate", "truncated", "ways"]
        way = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            rows = []
            for marks, late in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                marks = _marked(marks, late)
                m = grammar.matrix(_terminals(marks))
                rows.append((*_tally(marks), [{"a": a, "b": b, "cost": c, "audit": t} for (a, b), (c, t) in m.items()]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *[pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [way], strict=True)]], names)

    ways = "conv_id long, place long, gaps struct<low:long,high:long,kinds:long>, first string, last string, illegal long, blank long, duplicate long, truncated long, ways array<struct<a:int,b:int,cost:long,audit:string>>"
    m = mapped(blocks.select("conv_id", "place", "gaps", "first", "last", "illegal", "sequence", "late"), matrix_batches, ways)

    def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, out, state = False, [], None

        def close() -> tuple:
            cost, rope = ended(state["vector"])
            s = state
            return (s["conv_id"], _gaps(s["low"], s["high"], s["kinds"]), s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, text_of(rope), None)

        for batch in batches:
            for b in batch.to_pylist():
                if not begun or b["conv_id"] != state["conv_id"]:
                    if begun:
                        out.append(close())
                    begun = True
                    state = {"conv_id": b["conv_id"], "low": None, "high": None, "kinds": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "vector": {0: (0, "")}}
                _fold(state, b)
                if len(out) >= 64:
                    yield _rows(out).select(RESULT_NAMES[:-1])
                    out = []
        if begun:
            out.append(close())
        yield _rows(out).select(RESULT_NAMES[:-1])

    folded = written(mapped(m.repartition("conv_id").sortWithinPartitions("conv_id", "place"), fold_batches, FOLDED))

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per conversation its audit comes first, then its blocks."""
        begun, current, out = False, None, []
        sha = audit = None
        at = place = 0
        started = odd = False

        def feed(lines: list[str]) -> None:
            nonlocal started
            if lines:
                sha.update(("\n" * started + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                started = True

        def close() -> None:
            lines, _ = repaired(audit[place:], [], [], odd, at)
            feed(lines)
            out.append((current, sha.hexdigest()))

        for batch in batches:
            for conv_id, told, roles, texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if told is not None:
                    if begun:
                        close()
                    begun, current, sha, audit, at, place, started, odd = True, conv_id, hashlib.sha256(), told, 0, 0, False, _kept(told) % 2 == 1
                    continue
                # the block's edits are those up to its last row's
                end, left = place, len(roles)
                while left:
                    left -= audit[end] != "I"
                    end += 1
                lines, at = repaired(audit[place:end], roles, texts, odd, at)
                feed(lines)
                place = end
        if begun:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])

    none = F.lit(None)
    heads = folded.select("conv_id", F.lit(-1).cast("long").alias("place"), "audit", none.cast("array<string>").alias("roles"), none.cast("array<string>").alias("texts"))
    texts = blocks.select("conv_id", "place", none.cast("string").alias("audit"), "roles", "texts")
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "audit", "roles", "texts")
    hashes = written(mapped(stream, hash_batches, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "of"), BATCH)
    return folded.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).select(*RESULT_NAMES)


def _fold(state: dict, b: dict) -> None:
    """Take one more block into a conversation's state: counts, and (cost, rope) by state of the automaton."""
    if g := b["gaps"]:
        # rows come by turn, so a block shares its first turn with the one before at most
        state["kinds"] += g["kinds"] - (state["high"] == g["low"])
        state["low"] = g["low"] if state["low"] is None else state["low"]
        state["high"] = g["high"]
    for c in ("blank", "duplicate", "truncated", "illegal"):
        state[c] += b[c]
    if b["first"] is not None:
        if state["last"] is not None:
            state["illegal"] += state["last"] + b["first"] not in LEGAL
        state["last"] = b["last"]
    vector: Matrix = {}
    for w in b["ways"]:
        if w["a"] in state["vector"]:
            cost, rope = state["vector"][w["a"]]
            _better(vector, (0, w["b"]), cost + w["cost"], (rope, w["audit"]) if rope and w["audit"] else rope or w["audit"])
    state["vector"] = {s: found for (_, s), found in vector.items()}
