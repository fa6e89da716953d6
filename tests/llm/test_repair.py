import hashlib
import heapq
import random
import re
import zlib

import pytest

from ledgerlens.llm import queries, repair

from .helpers import SF

ROWS = "conv_id long, turn long, role string, text string, place string, copies int"
ROLES = ["system", "user", "assistant", "tool", None, "ü", ""]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Search by (cost, audit) over whole repaired conversations: no states but the roles written so far."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, text = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(text)
        key = (i, roles[-1:] if roles[-1:] != "s" else roles)
        if key in done:
            continue
        done.add(key)
        steps = [(3, "I", i, r) for r in ("user", "assistant")]
        extra = 0
        if i < len(rows):
            role, body = rows[i]
            steps.append((4, "D", i + 1, None))
            extra = 3 if fault[i] == "truncated" else 0
            if fault[i] not in ("blank", "duplicate"):
                steps.append((extra, "K", i + 1, role))
                steps += [(3 + extra, "R", i + 1, r) for r in ("user", "assistant")]
        for c, edit, j, role in steps:
            if role is None:
                heapq.heappush(heap, (cost + c, audit + edit, j, roles, text))
                continue
            now = roles + role[:1]
            if role[:1] and re.fullmatch("s|s?(ua)*u?", now):
                line = f"{role}:" if edit == "I" else f"{role}:{body}"
                heapq.heappush(heap, (cost + c, audit + edit, j, now, (*text, line)))


def expected(rows, damaged):
    out = set()
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, a.encode(), b.encode()) for c, t, a, b in damaged if c == conv))
        turns = [t for known, t, _, _ in own if known]
        body = [(a.decode(), b.decode()) for _, _, a, b in own]
        fault = faults(body)
        cost, audit, text = cheapest(body, fault)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(body, body[1:])]
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in repair.FAULTS),
                 sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], ROWS)


def got(df):
    return {tuple(r) for r in df.collect()}


def random_rows(rng, n, conv, turns=12):
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? \t", "ü", "a. b"]
    return [(conv, rng.choice([None, *range(turns)]), rng.choice(ROLES), rng.choice(texts)) for _ in range(n)]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, SF)) == expected(rows, damage(rows))


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows_against_search(spark, seed):
    rng = random.Random(seed)
    rows = [r for conv in [None, *range(-30, 30)] for r in random_rows(rng, rng.randint(1, 14), conv)]
    rows += [(100, None, None, None)] * 5 + [(101, 0, "user", "x" * 300_000)]
    whole = frame(spark, rows)
    assert got(repair.repair_digests(whole, whole)) == expected(rows, [(c, t, *(" " if v is None else v for v in (a, b))) for c, t, a, b in rows])
    assert got(repair.repair_digests(repair.damaged(whole), whole)) == expected(rows, damage(rows))


def test_one_conversation_over_many_slices(spark):
    """A conversation with nearly all rows is cut into slices; the repair is the one of the whole."""
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(ROLES[:4]), rng.choice(["Yes.", "cut", f"Line {i}.", f"open {i}", ""])) for i in range(700)]
    rows += [(8, i, "user", "again") for i in range(60)] + [(9, 0, "user", "the same.")] * 90
    whole = frame(spark, rows)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        done = repair.Repair(whole)
        sizes = {(r.conv, r.slice): len(r.steps) for r in done.slices.collect()}
        assert sum(c == "v7" for c, _ in sizes) > 10 and max(sizes.values()) < 100
        assert got(repair.repair_digests(whole, whole)) == expected(rows, rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_edits_and_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", ""), (1, 3, "user", "U.")]
    done = repair.Repair(frame(spark, rows))
    edits = sorted(done.edits().collect(), key=lambda r: (r.slice, r["at"]))
    assert "".join(r.edit for r in edits) == done.summary().first().audit == cheapest([r[2:] for r in rows], faults([r[2:] for r in rows]))[1]
    kept = [(r.role, r.text) for r in edits if r.edit != "D"]
    assert re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in kept))
    assert done.repaired().count() == len(kept)


def test_nothing_left_and_no_rows(spark):
    empty = frame(spark, [])
    assert repair.repair_digests(repair.damaged(empty), empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    whole = frame(spark, [(gone, 0, "user", "Hi."), (None, None, None, None)])
    sha = hashlib.sha256(b"").hexdigest()
    rows = got(repair.repair_digests(repair.damaged(whole), whole))
    assert (gone, 0, 0, 0, 0, 0, 0, "", sha) in rows and len(rows) == 2


@pytest.mark.parametrize("seed", range(8))
def test_slices_add_up_to_the_whole(seed):
    rng = random.Random(seed)
    for _ in range(40):
        steps = [(rng.choice(["s", "u", "a", "t", ""]) + rng.choice("--tbd"), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 14))]
        whole, exits = repair.least_paths(steps, list(repair.LAST))
        cut = rng.randint(1, len(steps))
        tail = repair.border_costs(steps[cut:], list(repair.LAST))[0]
        m = repair.slice_matrix(steps[:cut])
        front = repair._closed([min(m[x][y] + tail[y] for y in range(4)) for x in range(4)])
        assert front == repair.border_costs(steps, list(repair.LAST))[0]
        head, mid = repair.least_paths(steps[:cut], tail)
        for x in range(4):
            rest, last = repair.least_paths(steps[cut:], list(repair.LAST)) if cut < len(steps) else ([""] * 4, list(range(4)))
            assert head[x] + rest[mid[x]] == whole[x] and last[mid[x]] == exits[x]
