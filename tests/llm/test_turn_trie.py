"""Burst trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from claimforge.llm.turn_trie import conversation_trie, digests

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha))
    return sorted(out, key=str)


def made_rows(seed, n=260):
    rnd, rows = random.Random(seed), []
    for c in range(-20, n):
        deep = rnd.random() < 0.2
        for i in range(18 if deep else rnd.choice([1, 2, 3, 5, 8])):
            text = "same" if deep and i < rnd.choice([17, 18]) else rnd.choice(["a", "bé", "c" * 9])
            rows.append((c, i if rnd.random() < 0.99 else None, rnd.choice(["user", "assistant"]) if not deep else "user", text))
    rows += [(5, 3, None, None), (5, 3, None, None), (7, 3, "user", ""), (None, 1, "user", "lost"), (None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "limit", "window", "levels"), [(1, 3, 2, 2), (2, 1000, 7, 8), (3, 20, 256, 3)])
def test_against_brute_force(spark, seed, limit, window, levels):
    rows = made_rows(seed, 60 if limit == 3 else 260)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(4)
    got = conversation_trie(df, limit=limit, window=window, more_levels=levels)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([], schema)).collect() == []
    # 101's family has no first conversation and its head of one turn is all it has: turnless, yet a member.
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(alone, 0, "user", "x")]
    assert sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == brute(rows)


def test_digest_of_many_members(spark, monkeypatch):
    monkeypatch.setattr("claimforge.llm.turn_trie.IDS_A_RUN", 7)
    df = spark.range(100).selectExpr("3L AS conv_id", "2L AS depth", "id * 3 - 50 AS member").repartition(5)
    want = hashlib.sha256(",".join(str(i * 3 - 50) for i in range(100)).encode()).hexdigest()
    assert [tuple(r) for r in digests(df).collect()] == [(3, 2, want)]
