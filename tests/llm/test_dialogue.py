import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convosieve.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, gone string, salt long, k int, key string"
LEGAL_ROLES = re.compile(r"(s?(ua)+)?")
EDITS = {"K": 0, "R": 3, "D": 4, "I": 3}


def plainly(rows):
    """Cost, audit and lines of (role, text, must_go, truncated), by whole strings."""
    best = {0: (0, "", [])}

    def inserts(best):
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                to = 3 if q == 2 else 2
                new = cost + 3, audit + "I", [*lines, "assistant:" if q == 2 else "user:"]
                best[to] = min(best.get(to, new), new)
        return best

    for role, text, must_go, truncated in rows:
        found = {}
        for q, (cost, audit, lines) in inserts(best).items():
            ways = [(q, cost + 4, audit + "D", lines)]
            if not must_go:
                to, more = 3 if q == 2 else 2, 3 * truncated
                ways.append((to, cost + 3 + more, audit + "R", [*lines, ("assistant:" if q == 2 else "user:") + text]))
                kept = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(role[:1])
                if kept:
                    ways.append((kept, cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for to, *new in ways:
                found[to] = min(found.get(to, tuple(new)), tuple(new))
        best = found
    return min(v for q, v in inserts(best).items() if q in (0, 3))


def every(rows, most=3):
    """The same from all edit strings with up to `most` inserts."""
    found = []
    for edits in itertools.product("KRD", repeat=len(rows)):
        for n in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                audit = "".join("I" * places.count(i) + e for i, e in enumerate([*edits, ""]))
                found += _roles(rows, audit)
    return min(found)


def _roles(rows, audit):
    cost, roles, rows = 0, [""], iter(rows)
    for edit in audit:
        cost += EDITS[edit]
        if edit != "I":
            role, _, must_go, truncated = next(rows)
            if must_go and edit != "D":
                return
            cost += 3 * (truncated and edit != "D")
        if edit == "K":
            roles = [r + (role[:1] or "?") for r in roles]  # an empty role has no initial that may stay
        elif edit in "RI":
            roles = [r + x for r in roles for x in "ua"]
    if any(LEGAL_ROLES.fullmatch(r) for r in roles):
        yield cost, audit


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.just("t"), st.booleans(), st.booleans()), max_size=9)
KINDS = {(True, t): "x" for t in (True, False)}


def kinds(rows):
    return "".join("x" if go else (k.upper() if cut else k) for k, go, cut in ((r[:1] if r[:1] in ("s", "u", "a") else "o", go, cut) for r, _, go, cut in rows))


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_edits_as_by_whole_strings(rows):
    cost, audit, lines = plainly(rows)
    assert dialogue.cheapest(kinds(rows)) == (cost, audit)
    assert dialogue.repaired([r[:2] for r in rows], audit) == lines


@settings(max_examples=40, deadline=None)
@given(ROWS.filter(lambda rows: len(rows) <= 4))
def test_edits_as_by_all_strings(rows):
    assert dialogue.cheapest(kinds(rows)) == every(rows)


@settings(max_examples=100, deadline=None)
@given(ROWS, st.integers(0, 9))
def test_chunks_join_to_the_whole(rows, at):
    found = []
    for part in (kinds(rows[:at]), kinds(rows[at:])):
        ways = {}
        for a, b, cost, audit in dialogue.between(part):
            ways.setdefault(a, {})[b] = cost, audit
        found.append(ways)
    trails, front = dialogue.Trails(), {0: (0, 0)}
    for ways in found:
        front = dialogue.advance(trails, front, ways)
    cost, node, state = dialogue.ended(trails, front)
    assert (cost, "".join(trails.steps(node)) + dialogue.TAILS[state]) == dialogue.cheapest(kinds(rows))


@pytest.mark.parametrize("hash_of", [lambda step: 0, lambda step: len(step)], ids=["all equal", "by length"])
def test_colliding_hashes_are_verified(hash_of):
    draw = random.Random(5)
    for _ in range(60):
        trails, front, text = dialogue.Trails(hash_of), {0: (0, 0)}, "".join(draw.choices("xsuaoSUAO", k=draw.randint(0, 40)))
        for kind in text:
            front = dialogue.advance(trails, front, dialogue.OPTIONS[kind])
        cost, node, state = dialogue.ended(trails, front)
        assert (cost, "".join(trails.steps(node)) + dialogue.TAILS[state]) == dialogue.cheapest(text)


def test_ancestors_are_found_by_doubling():
    trails, node, path = dialogue.Trails(), 0, [0]
    for _ in range(100):
        node = trails.grow(node, "K")
        path.append(node)
    for depth, node in enumerate(path):
        assert list(trails.up[node]) == [path[depth - (1 << k)] for k in range(len(trails.up[node]))] and len(trails.up[node]) == depth.bit_length()


def expected(rows):
    """Of (conv_id, turn, role, text) before damage, one row at a time."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, lines = plainly([(role, text, f in ("b", "d"), f == "t") for (_, role, text), f in zip(mine, faults)])
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, chunk_rows=dialogue.CHUNK_ROWS):
    docs = spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in dialogue.report(dialogue.damaged(docs), chunk_rows).collect()), key=str)


def talk(draw, convs, most):
    texts = ["Yes.", "no", " ", "", None, "Is it? ", "So!\n", "x" * 5000 + ".", "É…", "a.b!c?d", " ", "A\nB."]
    for conv in convs:
        for i in range(draw.randint(1, most)):
            yield conv, draw.choice([i, i, i, i // 2, None, i + 9]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), draw.choice(texts)


def test_rows_as_one_at_a_time(spark):
    rows = list(talk(random.Random(1), [*range(60), None, -7], 12))
    rows += rows[:50]
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("chunk_rows", [1, 7, 512])
def test_one_conversation_with_most_rows(spark, chunk_rows):
    draw = random.Random(chunk_rows)
    hot = [(5, draw.choice([i, 3, None]), draw.choice(["user", "assistant"]), draw.choice(["Same.", f"Own {i}.", "open"])) for i in range(1500)]
    rows = hot + list(talk(draw, range(20), 8)) + [(None, 1, "user", "Hi.")] * 300
    assert got(spark, rows, chunk_rows) == expected(rows)


def test_no_rows_after_damage(spark):
    assert zlib.crc32(b"17:0") % 20 != 0 and got(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_lines_are_what_the_report_hashes(spark, data):
    rows = dialogue.damaged(spark.read.parquet(f"{data}/conversations.parquet"))
    lines = {}
    for r in sorted(dialogue.repaired_lines(rows).collect(), key=lambda r: r["segment"]):
        lines.setdefault(r["conv_id"], []).extend(r["lines"])
    for r in dialogue.report(rows).collect():
        found = lines.get(r["conv_id"], [])
        assert hashlib.sha256("\n".join(found).encode()).hexdigest() == r["repaired_sha256"]
        assert LEGAL_ROLES.fullmatch("".join(x[:1] for x in found))


def test_query_as_one_row_at_a_time(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11(spark, data).collect()), key=str) == expected(rows)


def test_undamaged_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Why?")]
    docs = spark.createDataFrame([(*r, "", 0, 0, "") for r in rows], SCHEMA)
    assert sorted((r["conv_id"], r["cost"], r["audit"]) for r in dialogue.report(dialogue.untouched(docs)).collect()) == [(1, 0, "KK"), (2, 3, "IK")]
