"""Conversation structure repair: the cheapest edits that make a conversation `system? (user assistant)+`, and their audit string.

The edits are found by dynamic programming over four states (nothing yet, after system, after user, after assistant).  The audit of a
state is a node of a persistent tree: it links to the node it grew from, so equal beginnings are shared, and holds a rolling hash and
ancestors 1, 2, 4, ... steps above.  Of audits of equal cost the least is found by searching their longest common prefix over these
ancestors; where hashes say that two prefixes are equal, the strings are compared too.

Rows are dealt out by ranges of (conversation, turn, ...), so a conversation of any length is spread over tasks.  What lies whole in a
task is repaired there.  The others are cut into chunks of CHUNK_ROWS; each chunk gives its best edits from every state to every state,
one small row; these are joined in order, again as nodes, and the chosen edits go back to the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import Memo, arrow_schema, batch, pairs, per_process, sliced, stored

CHUNK_ROWS, CHUNK_BYTES = 512, 4 << 20
#: Rows that one sorted part should have.
PART_ROWS = 50_000
SPACES = " \t\n\v\f\r"
STOPS = ".!?"

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted or re-roled row leads to, and those that a kept row's initial leads to.
ASKED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
#: What ends a conversation in each state: inserts, and their cost.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_MODULUS, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


class Trails:
    """A persistent tree of strings that grow by whole steps.  All nodes of one depth took as many steps, and no step that may follow
    a node is a prefix of another one, so two strings differ at the first step that differs."""

    def __init__(self, hash_of=lambda step: xxhash.xxh3_64_intdigest(step) % _MODULUS):
        self.hash_of = hash_of
        self.parent, self.step, self.hash, self.up = [0], [""], [0], [()]

    def grow(self, node: int, step: str) -> int:
        new, up = len(self.parent), [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.parent.append(node)
        self.step.append(step)
        self.hash.append((self.hash[node] * _BASE + self.hash_of(step) + 1) % _MODULUS)
        self.up.append(up)
        return new

    def less(self, a: int, then_a: str, b: int, then_b: str) -> bool:
        """Whether a's string and then `then_a` comes before b's and `then_b`; both nodes are of one depth."""
        if a == b:
            return then_a < then_b
        hashes, ups = self.hash, self.up
        x, y = a, b
        if hashes[x] == hashes[y] and self.differ(x, y) is None:
            return then_a < then_b
        for k in reversed(range(len(ups[x]))):
            if k < len(ups[x]) and hashes[ups[x][k]] != hashes[ups[y][k]]:
                x, y = ups[x][k], ups[y][k]
        x, y = self.differ(self.parent[x], self.parent[y]) or (x, y)
        return self.step[x] < self.step[y]

    def differ(self, x: int, y: int) -> tuple[int, int] | None:
        """The first steps in which two strings differ, found step by step; None if they are equal, which their hashes said."""
        found = None
        while x != y:
            if self.step[x] != self.step[y]:
                found = x, y
            x, y = self.parent[x], self.parent[y]
        return found

    def steps(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.step[node])
            node = self.parent[node]
        return out[::-1]


def _options(kind: str) -> dict[int, dict[int, tuple[int, str]]]:
    """Per state: the states that one row of a kind leads to, at what least cost and by which least step (inserts before it, then its edit)."""
    initial, extra, forced = kind.lower(), TRUNCATED if kind.isupper() else 0, kind == "x"
    found: dict[int, dict[int, tuple[int, str]]] = {}
    for first in range(4):
        best, state = found.setdefault(first, {}), first
        for inserts in range(3):
            ways = [(state, DELETE, "D")]
            if not forced:
                ways.append((ASKED[state], REROLE + extra, "R"))
                if (state, initial) in KEPT:
                    ways.append((KEPT[state, initial], extra, "K"))
            for to, cost, edit in ways:
                best[to] = min(best.get(to, (99, "")), (cost + INSERT * inserts, "I" * inserts + edit))
            state = ASKED[state]
    return found


#: Kinds: x must go; s, u, a by initial, o for others; capitals for truncated rows.
OPTIONS = {kind: _options(kind) for kind in "xsuaoSUAO"}
Front = dict[int, tuple[int, int]]


def advance(trails: Trails, front: Front, options: dict[int, dict[int, tuple[int, str]]]) -> Front:
    """The best (cost, node) per state after one more step; ties go to the least string."""
    best: dict[int, tuple[int, int, str]] = {}
    for state, (cost, node) in front.items():
        for to, (more, step) in options.get(state, {}).items():
            old = best.get(to)
            if old is None or cost + more < old[0] or cost + more == old[0] and trails.less(node, step, old[1], old[2]):
                best[to] = cost + more, node, step
    return {to: (cost, trails.grow(node, step)) for to, (cost, node, step) in best.items()}


def ended(trails: Trails, front: Front) -> tuple[int, int, int]:
    """Cost, node and state of the best end, its tail included in the cost."""
    best = None
    for state, (cost, node) in front.items():
        cost += INSERT * len(TAILS[state])
        if best is None or cost < best[0] or cost == best[0] and trails.less(node, TAILS[state], best[1], TAILS[best[2]]):
            best = cost, node, state
    return best


def cheapest(kinds: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    trails, front = Trails(), {START: (0, 0)}
    for kind in kinds:
        front = advance(trails, front, OPTIONS[kind])
    cost, node, state = ended(trails, front)
    return cost, "".join(trails.steps(node)) + TAILS[state]


def between(kinds: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a chunk, for all states."""
    out = []
    for first in range(4):
        trails, front = Trails(), {first: (0, 0)}
        for kind in kinds:
            front = advance(trails, front, OPTIONS[kind])
        out += [(first, to, cost, "".join(trails.steps(node))) for to, (cost, node) in front.items()]
    return out


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> list[str]:
    """The `role:text` lines that the edits leave."""
    rows, lines = iter(rows), []
    for edit in audit:
        if edit == "I":
            state = ASKED[state]
            lines.append(f"{ROLE[state]}:")
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "R":
            state = ASKED[state]
            role = ROLE[state]
        else:
            state = KEPT[state, role[:1]]
        lines.append(f"{role}:{text}")
    return lines


@dataclass
class Facts:
    """Counts of some rows in order, which add up over chunks."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    kinds: list[str] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        bare, initial = text.rstrip(SPACES), role[:1]
        kind = initial if initial in ("s", "u", "a") else "o"
        if not bare:
            self.blank, kind = self.blank + 1, "x"
        elif seen:
            self.duplicate, kind = self.duplicate + 1, "x"
        elif bare[-1] not in STOPS:
            self.truncated, kind = self.truncated + 1, kind.upper()
        self.kinds.append(kind)
        self.join(Facts(turns=turn is not None, low=turn, high=turn, first=initial, last=initial))

    def join(self, other: Facts) -> None:
        """What comes behind, turns ascending, so that only the last and the first turn can be the same."""
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.illegal += other.illegal + (self.last is not None and other.first is not None and self.last + other.first not in LEGAL)
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last

    def report(self, cost: int) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after the damage that crc32(`conv_id:turn`) % 20 names.  Null role and text, and a null
    in the hashed string, count as one space.  Dropped rows stay as `gone`, so that their conversation is known."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").when(kind == 0, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def untouched(rows: DataFrame) -> DataFrame:
    """The same columns without damage."""
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("gone")
    )


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "conv_id long, segment long, lines array<string>"
CHUNK = "conv_id long, part long, k long, turns array<long>, roles array<string>, texts array<string>, digests array<string>"
FIRST_PASS = f"{REPORT}, part long, k long, turns array<long>, roles array<string>, texts array<string>, digests array<string>"


def _solver():
    return per_process(("dialogue edits",), lambda: Memo(cheapest, 16 << 20))


def _whole(conv: int | None, rows: list[tuple], solver: Memo) -> tuple:
    """REPORT of one conversation."""
    facts, seen = Facts(), set()
    for turn, role, text, digest in rows:
        facts.add(turn, role, text, (role, digest) in seen)
        seen.add((role, digest))
    cost, audit = solver["".join(facts.kinds)]
    body = "\n".join(repaired([r[1:3] for r in rows], audit))
    return conv, *facts.report(cost), audit, hashlib.sha256(body.encode()).hexdigest()


def _first_pass(schema: pa.Schema, width: int, rest: int, hold: bool, chunk_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        solver, part = _solver(), TaskContext.get().partitionId()
        conv, k, rows, size, first, any_row = None, 0, [], 0, True, False
        out, held = [], 0

        def chunk() -> tuple:
            return (conv, *[None] * (width - 1), part, k, *([list(c) for c in zip(*rows)] or [[]] * 4))

        for own in sliced(batches):
            for c, turn, role, text, digest, gone in pairs(own, "conv_id", "turn", "role", "text", "digest", "gone"):
                if any_row and c != conv:
                    # What the task's first rows belong to may have begun in the task before.
                    out.append(chunk() if first or k or hold else (*_whole(conv, rows, solver), *[None] * rest))
                    first, k, rows, size = False, 0, [], 0
                elif len(rows) >= chunk_rows or size >= CHUNK_BYTES:
                    out.append(chunk())
                    k, rows, size = k + 1, [], 0
                conv, any_row = c, True
                if not gone:
                    rows.append((turn, role, text, digest))
                    size += len(text)
                    held += len(text)
                if held >= CHUNK_BYTES:
                    yield batch(out, schema)
                    out, held = [], 0
            solver.trim()
        if any_row:
            out.append(chunk())
        yield batch(out, schema)

    return run


def _passed(rows: DataFrame, hold: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """FIRST_PASS, stored: the report of conversations that lie whole in a task, the chunks of the others (with `hold`, of all)."""
    spark = rows.sparkSession
    digest = F.md5(F.col("text").cast("binary"))
    rows = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "text", "gone")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    order = ["conv_id", "turn", "role", "digest", "salt"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    width, rest = REPORT.count(",") + 1, CHUNK.count(",")
    return stored(dealt.mapInArrow(_first_pass(arrow_schema(FIRST_PASS), width, rest, hold, chunk_rows), FIRST_PASS))


KEY = ("key", "part", "k")
#: A chunk's counts, and its edits from each state to each state as parallel lists.
SUMMARY = "key string, conv_id long, part long, k long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, froms array<int>, tos array<int>, costs array<long>, audits array<string>"


def _summaries(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = per_process(("dialogue chunks",), lambda: Memo(between, 16 << 20))
        for own in batches:
            out = []
            for key, conv, part, k, turns, roles, texts, digests, news in pairs(own, "key", "conv_id", "part", "k", "turns", "roles", "texts", "digests", "news"):
                facts, new = Facts(), {(x["role"], x["digest"]) for x in news or ()}
                for turn, role, text, digest in zip(turns, roles, texts, digests):
                    facts.add(turn, role, text, (role, digest) not in new)
                    new.discard((role, digest))
                paths = list(zip(*solver["".join(facts.kinds)]))
                f = facts
                out.append((key, conv, part, k, f.blank, f.duplicate, f.truncated, f.illegal, f.turns, f.low, f.high, f.first, f.last, *map(list, paths)))
            yield batch(out, schema)
            solver.trim()

    return run


CHOSEN = f"key string, part long, k long, state int, own_audit string, {REPORT.removesuffix(', audit string, repaired_sha256 string')}, ending boolean"


def _chosen(schema: pa.Schema):
    """Joins the summaries of each conversation, which come in order, and gives each chunk its edits; the last one carries the report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, facts, chunks, trails, front, options = None, None, None, [], None, {}, []

        def close() -> list[tuple]:
            cost, node, state = ended(trails, front)
            steps, at, out = trails.steps(node), START, []
            for n, ((part, k), step, ways) in enumerate(zip(chunks, steps, options)):
                last = n == len(chunks) - 1
                report = (conv, *facts.report(cost)) if last else (conv, *[None] * 6)
                out.append((now, part, k, at, step + (TAILS[state] if last else ""), *report, last))
                at = next(to for to, (_, audit) in ways[at].items() if audit == step)
            return out

        for own in batches:
            out = []
            for row in own.to_pylist():
                if row["key"] != now:
                    out += close() if chunks else []
                    now, conv, facts, chunks, trails, front, options = row["key"], row["conv_id"], Facts(), [], Trails(), {START: (0, 0)}, []
                facts.join(Facts(*[row[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")]))
                ways: dict[int, dict[int, tuple[int, str]]] = {}
                for a, b, cost, audit in zip(row["froms"], row["tos"], row["costs"], row["audits"]):
                    ways.setdefault(a, {})[b] = cost, audit
                front = advance(trails, front, ways)
                chunks.append((row["part"], row["k"]))
                options.append(ways)
            yield batch(out, schema)
        if chunks:
            yield batch(close(), schema)

    return run


def _ended(schema: pa.Schema):
    """REPORT of each conversation from its chunks, which come in order; texts are hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, begun = hashlib.sha256(), [], False
        for own in batches:
            out = []
            for row in own.to_pylist():
                lines = repaired(zip(row["roles"], row["texts"]), row["own_audit"], row["state"])
                if lines:
                    digest.update(("\n" * begun + "\n".join(lines)).encode())
                    begun = True
                audit.append(row["own_audit"])
                if row["ending"]:
                    out.append((*[row[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], "".join(audit), digest.hexdigest()))
                    digest, audit, begun = hashlib.sha256(), [], False
            yield batch(out, schema)

    return run


def _edits(passed: DataFrame) -> DataFrame:
    """CHOSEN with the chunks' rows, of the conversations that were not repaired in one task."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key")
    chunks = passed.where("part IS NOT NULL").select(key, *[c.split()[0] for c in CHUNK.split(", ")])
    # A row is a duplicate unless it is the first of its kind in the first chunk that has one; equal rows are counted once per chunk.
    kinds = chunks.select(*KEY, F.explode(F.array_distinct(F.arrays_zip(F.col("roles").alias("role"), F.col("digests").alias("digest")))).alias("x"))
    first = kinds.groupBy("key", "x").agg(F.min(F.struct("part", "k")).alias("at"))
    news = first.groupBy("key", F.col("at.part").alias("part"), F.col("at.k").alias("k")).agg(F.collect_list(F.struct(F.col("x.role"), F.col("x.digest"))).alias("news"))
    summaries = chunks.join(news, list(KEY), "left").mapInArrow(_summaries(arrow_schema(SUMMARY)), SUMMARY)
    chosen = _in_order(stored(summaries)).mapInArrow(_chosen(arrow_schema(CHOSEN)), CHOSEN)
    return chunks.select(*KEY, "roles", "texts").join(stored(chosen), list(KEY))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions(*KEY)


def report(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """REPORT of every conversation of (conv_id, turn, role, text, gone).

    Rows are taken by turn, nulls first, those of one turn by role and MD5 of the text, equal rows as often as they are there.  A null
    conv_id is a conversation of its own; one without rows has zeros, an empty audit and the hash of the empty string.  Roles other
    than user, assistant and system count by their initial, and a row of an empty role cannot be kept; empty and very long texts are
    taken whole.  Other columns are not read and
    may have any name.  An empty table gives no rows.  A repaired conversation is hashed in order by one task, which holds one chunk at
    a time and the edits.
    """
    passed = _passed(rows, chunk_rows=chunk_rows)
    done = passed.where("part IS NULL").select(*[c.split()[0] for c in REPORT.split(", ")])
    return done.unionByName(_in_order(_edits(passed)).mapInArrow(_ended(arrow_schema(REPORT)), REPORT))


def repaired_lines(rows: DataFrame) -> DataFrame:
    """LINES: the repaired rows of every conversation as `role:text`, in segments that ascend; empty segments are left out.  Cases as in `report`."""
    schema = arrow_schema(LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for row in own.to_pylist():
                lines = repaired(zip(row["roles"], row["texts"]), row["own_audit"], row["state"])
                if lines:
                    yield batch([(row["conv_id"], row["part"] << 32 | row["k"], lines)], schema)

    return _edits(_passed(rows, hold=True)).mapInArrow(run, LINES)
