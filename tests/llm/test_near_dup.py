import random

import pytest

from leafmill.llm import components, near_dup


def brute(rows, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in ids}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                r, s = sorted((top(a), top(b)))
                low[s] = r
    return sorted(((i, len(shingles(t)), top(i) if i is not None else None, i is not None and top(i) == i) for i, t in rows), key=str)


def corpus(seed, edits, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(20, 90))] for _ in range(5)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("words", "edits", "block"), [(2, 8, 512), (2, 12, 3), (5, 3, 4)])
def test_equals_brute_force(spark, monkeypatch, words, edits, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus(edits, edits)
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, " \n"), (None, "one"), (205, "one two"), (205, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component", "2 as n")
    got = sorted((tuple(x) for x in near_dup.components_of(df, words, 80).collect()), key=str)
    assert got == brute(rows, words, 80)


def test_pairs_are_decided_in_blocks(spark):
    """A chain of links that no center and no best partner shows is still found."""
    rows = corpus(3, 10, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in near_dup.components_of(df, 2, 80).collect()), key=str)
    assert got == brute(rows, 2, 80)


def test_empty_table(spark):
    assert near_dup.components_of(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100)}
    assert len(got) == 51


def test_ids_with_several_texts_join_all_of_them(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (0, "a b c d"), (0, "e f g h"), (3, "i j k l")]
    got = near_dup.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in got) == [(0, 0, True), (0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True)]


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_are_compared_even_without_best_partners(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "_best_partners", lambda members: spark.createDataFrame([], "a long, b long"))
    rows = corpus(3, 10, 80)
    got = near_dup.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 2, 80)


def test_one_row_of_each_group_stays(spark):
    r = random.Random(5)
    say = lambda: " ".join(r.choice(["ab", "cd", "ef", "gh"]) + str(r.randrange(50)) for _ in range(30))
    alone, twice, both, other, third, copied = (say() for _ in range(6))
    rows = [(None, alone), (1, twice), (1, twice), (2, both), (None, both), (3, other), (3, third), (4, third), (None, copied), (None, copied), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id")
    got = near_dup.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(None, alone), (1, twice), (2, both), (3, other), (3, third), (None, copied), (None, ""), (None, None)], key=str)
