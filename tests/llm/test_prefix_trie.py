"""The prefix trie against plain dictionaries, long and odd conversations included."""

import hashlib
import random
import zlib

import pytest

from leafmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain(paths: dict) -> set:
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = set()
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, cs in members.items():
        worth = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += worth
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(paths[c]) == len(node)))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_of(rows) -> dict:
    by = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            by.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in by.items()}


def rebuilt(own: dict) -> dict:
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + path[h:]
    return out


def rows_of(df) -> list:
    return [tuple(r[n] for n in NAMES) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_dictionaries(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 40), 100000, 100001]:
        for t in range(rng.choice([1, 2, 3, 8, 12, 30])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None]), rng.choice(["a", "b", "", None, "üü"]), 0))
    rows += rng.sample(rows, 20) + [(None, 1, "user", "a", 0)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    own = turns_of(rows)
    got = rows_of(prefix_trie.shared_prefixes(df))
    assert len(got) == len(set(got)) and set(got) == plain(own)
    got = rows_of(prefix_trie.rebuilt_prefixes(df))
    assert len(got) == len(set(got)) and set(got) == plain(rebuilt(own))


def test_long_shared_conversations_and_texts(spark):
    """Copies of 45 turns, then a fork: sums pass up through six blocks; one text is very long."""
    rows = [(c, t, "user", f"turn {t}" if t < 45 else f"{c % 3} {t}", 0) for c in range(10, 16) for t in range(50)]
    rows += [(c, 0, "user", "long " * 300000, 0) for c in (50, 51)] + [(60, t // 700, "user", "same", 0) for t in range(2100)]
    own = turns_of(rows)
    got = rows_of(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(repr, got)) == sorted(map(repr, plain(own)))


def test_slices_of_ids_and_of_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 4)
    monkeypatch.setattr(prefix_trie, "NUMBERS", 2)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, t, "user", str(t), 0) for c in range(30) for t in range(20)] + [(3, 5, "user", "5", 0)] * 10
    got = rows_of(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(repr, got)) == sorted(map(repr, plain(turns_of(rows))))


def test_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello", 0), (2, 0, "user", "hello", 0), (2, 1, None, None, 0)], SCHEMA)
    nodes = prefix_trie.with_texts(prefix_trie.shared_prefixes(df), df).collect()
    assert {(r.depth, r.role, r.text) for r in nodes} == {(0, None, None), (1, "user", "hello"), (2, "", "")}
    assert prefix_trie.rebuilt_prefixes(df.limit(0)).count() == 0
