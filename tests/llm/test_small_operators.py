"""Defined cases and brute-force twins of the smaller operators."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.llm import oracles, pfair_mix, quality_rules, span_crf, url_terms, weak_quality, wu_manber

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more, " * 30_000


def docs(spark, rows, *clashes):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.selectExpr("*", *(f"'x' as {c}" for c in clashes))


# --- Wu-Manber ------------------------------------------------------------------------------


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def contamination(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t, _ in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 400])
def test_contamination_equals_brute_force(spark, pass_bytes):
    r = random.Random(4)
    v = [f"w{k}é" for k in range(8)] + ["the", "of"]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(k, say(r.randint(0, 25))) for k in range(20)] + [(20, None), (None, "the of the"), (21, "lonely"), (22, "two words"), (22, "LONELY!"), (23, "...")]
    rows = [(k, ", ".join([say(r.randint(0, 30)), r.choice(items)[1] or "", say(5)]), "s") for k in range(60)] + [(90, None, "s"), (91, "", None), (92, "Lonely", "s"), (92, "Lonely", "s"), (93, LONG + items[3][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = wu_manber.find_contamination(docs(spark, rows, "n_words", "row"), bench, pass_bytes=pass_bytes)
    assert sorted((tuple(x) for x in got.collect()), key=str) == contamination(rows, items)
    kept = wu_manber.drop_contaminated(docs(spark, rows), bench, pass_bytes=pass_bytes)
    assert Counter(x.doc_id for x in kept.collect()) == Counter(x[0] for x in contamination(rows, items) if not x[5])
    assert kept.columns == docs(spark, rows).columns


def test_tables_are_flat_and_bounded():
    r = random.Random(2)
    text = " ".join(r.choice("abcdefgh") for _ in range(100_000))
    tables = wu_manber.Tables([(1, text), (2, text[:50_000]), (None, text)])
    assert tables.nbytes <= 22 * 1.5 * len(text) + (1 << wu_manber.MOST_BITS)
    assert all(m.starts.dtype == "int64" and m.shift.nbytes <= 1 << wu_manber.MOST_BITS for m in tables.machines)
    again = wu_manber.Tables.of(tables.parts())
    assert [len(m.keys) for m in again.machines] == [len(m.keys) for m in tables.machines]


def test_long_items_are_cut_with_all_their_windows(spark):
    r = random.Random(7)
    say = lambda n: ", ".join(f"w{r.randrange(50)}é" for _ in range(n))
    items = [(1, say(300)), (2, "short one"), (3, "x" * 3000), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pieces = [tuple(x) for x in wu_manber._pieces(bench, 10, 400).collect()]
    windows = lambda rows: {(i, tuple(w[k : k + min(10, len(w))])) for i, t in rows for w in [words(t)] for k in range(max(1, len(w) - 9)) if w}
    assert windows(pieces) == windows(items)
    assert len([1 for i, _ in pieces if i == 1]) > 5
    rows = [(k, f"{say(3)} {' '.join(words(items[0][1])[k * 10 : k * 10 + 12])} {say(2)}", "s") for k in range(29)] + [(40, "x" * 3000, "s")]
    got = wu_manber.find_contamination(docs(spark, rows), bench, pass_bytes=1600).collect()
    assert sorted((tuple(x) for x in got), key=str) == contamination(rows, items)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(x)[1:4] for x in wu_manber.find_contamination(docs(spark, [(1, "a b", "s")]), none).collect()] == [(2, 0, 0)]
    assert wu_manber.find_contamination(docs(spark, []), none).collect() == []


# --- URL terms ------------------------------------------------------------------------------


def test_urls(spark):
    rows = {
        "http://WWW.Example.com/en/1": ("www.example.com/en/", "allow"),
        "http://www.example.com/fr/casino": ("com/", "allow"),
        "http://a.b.example.com/en/1": ("example.com/en/", "block"),
        "http://badexample.com/en/": ("com/", "allow"),
        "https://x.net/fr/1": ("net/fr/", "block"),
        "https://x.org/casino/": (None, "block"),
        "https://x.org/casinos/": (None, "allow"),
        "https://free-bets.org/a": (None, "block"),
        "https://free.org/free": (None, "allow"),
        "https://x.org/casinoé": (None, "allow"),
        "https://x.org/éporn": (None, "allow"),
        "https://x.org/a?q=porn#x": (None, "block"),
        "https://x.org/a?q=p%6Frn": (None, "block"),
        "https://x.org/a%20casino%20b": (None, "block"),
        "https://x.org/%E9%zz/casino": (None, "block"),
        "https://x.org/%C3%A9casino": (None, "allow"),
        "https://x.org/a?u=http://y.org/bonus#win": (None, "block"),
        "https://x.org/" + "a/" * 200_000 + "casino": (None, "block"),
        "no url": (None, "allow"),
        "casino": (None, "block"),
        "casino://x.org/": (None, "allow"),
        "": (None, "allow"),
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)] + [(None, None), (3, None)], "page_id long, url string").selectExpr("*", "'z' as rule", "1 as host")
    got = url_terms.judge_urls(df).collect()
    by_id = {r.page_id: (r.rule, r.verdict) for r in got if r.host or r.page_id is not None}
    assert len(got) == len(rows) + 2
    assert [by_id[k] for k, u in enumerate(rows) if k != 3] == [v for k, v in enumerate(rows.values()) if k != 3]
    assert url_terms.judge_urls(df.limit(0)).collect() == []


# --- Quality rules --------------------------------------------------------------------------


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0), (100, 1), (1000, 3), (500, 0), (2000, 7)]
    df = spark.createDataFrame(cases, "n long, k long")
    got = {(r.n, r.k): r.p for r in df.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.004).alias("p")).collect()}
    for n, k in cases:
        want = sum(math.comb(n, i) * 0.004**i * 0.996 ** (n - i) for i in range(k + 1))
        assert got[n, k] == pytest.approx(want if k <= 0.004 * n else 1.0, rel=1e-9)


def test_rules_reject_junk_and_keep_clean(spark):
    r = random.Random(2)
    v = [f"word{k}" for k in range(3000)]
    prose = lambda: " ".join(r.choice(v) for _ in range(80))
    rows = [(k, prose() + ".", "s") for k in range(3000)] + [(10_000 + k, " ".join(w + "###" for w in prose().split()), "s") for k in range(50)]
    rows += [(20_000, None, None), (20_001, "", "s"), (20_002, LONG, "s"), (20_003, prose(), "s"), (20_003, prose(), "s")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(2500)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs(spark, rows, "symbols", "kept"), labels).collect()
    assert len(got) == len(rows)
    kept = {x.doc_id for x in got if x.kept}
    assert len([k for k in range(3000) if k in kept]) >= 2990
    assert not [k for k in range(10_000, 10_050) if k in kept]
    by = {x.doc_id: x for x in got}
    assert (by[20_000].n_words, by[20_000].base_failed, by[20_002].base_failed) == (0, True, True)
    assert by[20_002].n_repeat_words == by[20_002].n_words == 90_000
    assert not quality_rules.judge(docs(spark, []), labels).collect()
    silent = quality_rules.judge(docs(spark, rows[-60:]), labels.limit(0)).collect()
    assert sum(x.kept for x in silent if 10_000 <= x.doc_id < 10_050) == 50


def test_rules_are_certified_together(spark):
    """Joint cutoffs against a plain computation; a stratum of 200 clean labels is judged, one of 100 is not."""
    r = random.Random(5)
    rows = [(k, lang, round(r.random() ** 4, 3)) for lang, n in (("a", 1500), ("b", 200), ("c", 100)) for k in range(n)]
    measured = spark.createDataFrame([(k * 10 + "abc".index(lang), lang, 100, 0, x) for k, lang, x in rows], "doc_id long, lang string, n_words long, n_repeat_words long, badness double").withColumn("same", F.col("doc_id"))
    labels = measured.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {x.lang: (x.n, x.cutoff) for x in quality_rules.certified_cutoffs(measured, labels, 0.1, 0.05).collect()}
    for lang in "abc":
        own = [x for _, g, x in rows if g == lang]
        tail = lambda k, n=len(own): float(sum(math.comb(n, i) * 9 ** (n - i) for i in range(k + 1)) / Fraction(10) ** n)
        fits = [c for c in quality_rules.CUTOFFS if tail(sum(x > c for x in own)) <= 0.05 / 3 and sum(x > c for x in own) <= 0.1 * len(own)]
        assert got[lang] == (len(own), min(fits, default=None))
    few = quality_rules.certified_cutoffs(measured.where("lang <> 'a' and badness < 0.01"), labels).collect()
    assert all(x.cutoff is None for x in few if x.n < 146)
    assert (1 - quality_rules.ALPHA) ** 173 > quality_rules.DELTA / 4 >= (1 - quality_rules.ALPHA) ** 174


def test_copies_are_no_further_trials(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(20)]
    labels = lambda n: spark.createDataFrame([(k, 1, 0) for k in range(n)], "doc_id long, quality int, toxic int")
    for copies in (1, 10, 50):
        rows = [(20 * c + k, t, "s") for c in range(copies) for k, t in enumerate(texts)]
        measured = quality_rules.measures(docs(spark, rows))
        got = quality_rules.certified_cutoffs(measured, labels(len(rows))).collect()
        assert [(x.n, x.cutoff) for x in got] == [(20, None)]


# --- Mixing ---------------------------------------------------------------------------------


def test_schedule_stays_within_a_block(spark):
    weights = spark.createDataFrame([("a", 333), ("b", 401), ("c", 1), ("d", 265)], "source string, weight int")
    slots = sorted(pfair_mix.schedule(weights).collect(), key=lambda r: r.slot)
    assert [r.slot for r in slots] == list(range(1000))
    share, done = {"a": 0.333, "b": 0.401, "c": 0.001, "d": 0.265}, Counter()
    for t, r in enumerate(slots, 1):
        assert r.turn == done[r.source]
        done[r.source] += 1
        assert all(abs(done[s] - share[s] * t) < 1 for s in share)
    assert done == {"a": 333, "b": 401, "c": 1, "d": 265}


def test_mix_places_every_document_once(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "BUCKET", 50)
    rows = [(k, f"t{k}", "hot" if k % 3 else f"s{k % 7}") for k in range(900)] + [(900, None, None), (None, "n", "hot"), (5, "again", "s5"), (5, "again", "s5")]
    got = pfair_mix.mix(docs(spark, rows, "slot", "mix_kept"), block=4).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    assert len({(r.source, r.block, r.place) for r in got}) == len(rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    for s in {r.source for r in got}:
        own = sorted((r.block, r.place) for r in got if r.source == s)
        assert own == [(k // 4, k % 4) for k in range(len(own))]
    assert "mix_kept" in got[0].asDict()
    assert pfair_mix.mix(docs(spark, [])).collect() == []


def test_mix_carries_clashing_columns_and_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "BUCKET", 4)
    names = ["doc", "mix_source", "mix_key", "mix_bucket", "mix_rank", "mix_offset", "mix_weight", "mix_turn", "mix_slot", "mix_size", "mix_group", "weight", "turn", "n"]
    rows = [(k if k % 2 else None, f"t{k}", "hot" if k % 3 else None) for k in range(200)] + [(None, LONG, "s"), (7, None, "s"), (7, None, "s")]
    got = pfair_mix.mix(docs(spark, rows, *names), block=3)
    assert got.columns == [*docs(spark, rows, *names).columns, "block", "slot", "place"]
    out = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(rows)
    assert all(r[c] == "x" for r in out for c in names)
    assert len({(r.slot, r.place) for r in out}) == len(rows)
    for s in {r.source for r in out}:
        own = sorted((r.block, r.place) for r in out if r.source == s)
        assert own == [(k // 3, k % 3) for k in range(len(own))]


@pytest.mark.parametrize("sources", [1000, 1001, 5000])
def test_mix_of_thousands_of_sources(spark, sources):
    rows = [(k, "t", f"s{k}") for k in range(sources)] + [(10_000 + k, "t", "hot") for k in range(100)]
    got = pfair_mix.mix(docs(spark, rows).select("doc_id", "source")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)


def test_mix_of_many_sources(spark):
    rows = [(k, "t", f"s{k % 1300}") for k in range(2600)] + [(10_000 + k, "t", "hot") for k in range(1300)]
    got = pfair_mix.mix(docs(spark, rows), block=1).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert len({r.slot for r in got}) == len(rows)
    counts = spark.createDataFrame([(f"s{k}", 2) for k in range(1300)] + [("hot", 1300)], "source string, n long")
    weights = {r.source: r.weight for r in pfair_mix.target_weights(counts, period=1 << 15).collect()}
    assert abs(weights["hot"] / weights["s5"] / 650**0.5 - 1) < 0.1
    for r in got:
        assert abs(r.block - r.slot * weights[r.source] / (1 << 15)) < 4


def test_paths_fill_a_period(spark):
    sizes = [333, 401, 1, 265, *[7] * 100, 5000, 24]
    weights = {f"s{k}": w for k, w in enumerate(sizes)}
    period = sum(sizes)
    ways = pfair_mix.paths(spark.createDataFrame(list(weights.items()), "source string, weight int"), period)
    turns = ways.select("source", "path", F.explode(F.sequence(F.lit(0), F.col("weight") - 1)).alias("turn"))
    got = turns.select("source", "turn", pfair_mix.slot_on(F.col("path"), F.col("turn")).alias("slot")).collect()
    assert sorted(r.slot for r in got) == list(range(period))
    assert all(abs(r.turn - r.slot * weights[r.source] / period) < 4 for r in got)


def test_mix_refuses_unlisted_sources(spark):
    weights = spark.createDataFrame([("a", 1000)], "source string, weight int")
    with pytest.raises(ValueError, match="without a weight: b"):
        pfair_mix.mix(docs(spark, [(1, "t", "a"), (2, "t", "b")]), weights)


def earliest_deadlines(weights, period):
    """{slot: (source, turn)} by plain search."""
    left = sorted((j * period // w, -(-(j + 1) * period // w), s, j) for s, w in weights.items() for j in range(w))[::-1]
    ready, out = [], {}
    for slot in range(period):
        while left and left[-1][0] <= slot:
            heapq.heappush(ready, left.pop()[1:])
        if ready:
            _, *out[slot] = heapq.heappop(ready)
    return out


@pytest.mark.parametrize("classes, reach", [(8, 1 << 16), (4, 50), (2, 7)])
def test_schedule_equals_plain_search(spark, monkeypatch, classes, reach):
    monkeypatch.setattr(pfair_mix, "CLASSES", classes)
    monkeypatch.setattr(pfair_mix, "RANGE", reach)
    r = random.Random(classes)
    sizes = [1] * 60 + [7] * 40 + [r.randint(1, 30) for _ in range(50)] + [4100 if classes == 8 else 300]
    for idle in (0, 1, 77):  # weights may leave slots empty
        weights = {f"s{k}é": w for k, w in enumerate(sizes)}
        period = sum(sizes) + idle
        got = pfair_mix.schedule(spark.createDataFrame(list(weights.items()), "source string, weight int"), period).collect()
        assert {x.slot: [x.source, x.turn] for x in got} == earliest_deadlines(weights, period)
        assert len(got) == sum(sizes)


@pytest.mark.parametrize("sources, period", [(62, 1000), (63, 1000), (1000, 1000), (1001, 1 << 14), (5000, 1 << 17)])
def test_mix_of_any_number_of_sources_stays_within_a_block(spark, sources, period):
    counts = Counter({f"s{k}": 2 + k % 3 for k in range(sources - 1)} | {None: 200})
    rows = [(k, "t", s) for k, s in enumerate(counts.elements())]
    given = docs(spark, rows).select("doc_id", "source")
    got = pfair_mix.mix(given, block=1).collect()
    named = given.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weights = {r.source: r.weight for r in pfair_mix.target_weights(named, period=period).collect()}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert len({r.slot for r in got}) == len(rows)
    for r in got:
        w = weights[r.source or ""]
        assert abs(r.slot * w - r.block * period) < period and abs((r.slot + 1) * w - (r.block + 1) * period) < period
    if sources <= pfair_mix.PERIOD:  # with more, the SQL twin has no slot for each source
        documents = given.toPandas()  # noqa: F841
        twin = f"with recursive t as (select row_number() over () as r, doc_id, source from documents), {oracles.mixed('t', block=1)} select doc_id, t.source, block, slot, place from mixed join t using (r)"
        assert set(duckdb.sql(twin).fetchall()) == {tuple(r) for r in got}


def test_mix_refuses_weights_beyond_the_period(spark):
    weights = spark.createDataFrame([("a", 600), ("b", 401)], "source string, weight int")
    with pytest.raises(ValueError, match="more than 1000"):
        pfair_mix.mix(docs(spark, [(1, "t", "a"), (2, "t", "b")]), weights)


# --- Personal data --------------------------------------------------------------------------


def plain_base(text):
    """The base patterns as they are written, by plain search."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        if 13 <= len(d) <= 19 and luhn:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_equal_plain_search():
    r = random.Random(8)
    pieces = ["a.b+c@d-e.com", "@", "x@y", "x@y.", "a@b@c.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4539 1488 0343 6467", "4539148803436468", "6011-0009-9013-9424", "+1 (212) 555-0147", "+12", "+1 2+3 456 789 01", "+", ".", "-", " ", "é", "12", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "@@a.b", "%_@q.rs.tu"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) + r.choice(["", " ", ""]) for _ in range(r.randint(1, 8)))
        assert span_crf.base_spans(text) == plain_base(text), text


def test_model_adds_spans_and_redacts(spark):
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1c"
    rows = [(1, f'é token = "{secret}" x', "s"), (2, "tel +1 (454) 555-9913 4913187196670932", "s"), (3, None, "s"), (4, "", "s"), (5, "plain prose only, in 1999.", "s"), (6, LONG + " a.b@c.de", "s"), (6, LONG + " a.b@c.de", "s")]
    got = span_crf.find_personal_data(docs(spark, rows, "spans")).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    assert by[1].spans == f"secret:11:{11 + len(secret)}"
    assert (by[1].n_email, by[1].base_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert "card" in by[2].spans
    assert "phone" in by[2].spans
    assert by[3].spans == by[4].spans == by[5].spans == ""
    assert by[6].n_email == 1
    assert by[6].base_sha256 == hashlib.sha256(f"email:{len(LONG) + 1}:{len(LONG) + 9}".encode()).hexdigest()
    hidden = {x.doc_id: x for x in span_crf.redact(docs(spark, rows, "kind")).collect()}
    assert hidden[1].text == 'é token = "<SECRET>" x'
    assert hidden[1].n_chars == len(hidden[1].text)
    assert hidden[5].text == rows[4][1]
    assert span_crf.find_personal_data(docs(spark, [])).collect() == []


# --- Weak labels ----------------------------------------------------------------------------


def test_classifier_separates_junk(spark):
    r = random.Random(6)
    v = [f"word{chr(97 + k % 26)}{k}" for k in range(900)]
    prose = lambda n: " ".join(r.choice(v) + r.choice(["", "", "", ",", "."]) for _ in range(n))
    junk = [lambda: " ".join(w + "%%%" for w in prose(80).split()), lambda: " ".join(w.upper() + "!!" for w in prose(80).split()), lambda: " | ".join(prose(80).split()), lambda: " ".join(w for w in prose(15).split() for _ in range(7))]
    rows = [(k, prose(r.randint(3, 200)), "s") for k in range(900)] + [(5000 + k, junk[k % 4](), "s") for k in range(200)]
    rows += [(9000, None, "s"), (9001, " \n", "s"), (9002, prose(40_000), "s"), (7, prose(50), "s"), (None, prose(50), "s")]
    got = weak_quality.classify(docs(spark, rows, "score"), sample=200).collect()
    assert len(got) == len(rows)
    clean = [x.kept for x in got if x.doc_id is not None and x.doc_id < 900]
    poor = [x.kept for x in got if x.doc_id is not None and 5000 <= x.doc_id < 5200]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(poor) <= 0.02 * len(poor)
    by = {x.doc_id: x for x in got}
    assert (by[9000].kept, by[9000].score, by[9001].kept, by[9002].kept) == (False, None, False, True)
    kept = weak_quality.drop_poor(docs(spark, rows, "score"), sample=200)
    assert Counter(x.doc_id for x in kept.collect()) == Counter(x.doc_id for x in got if x.kept)
    assert weak_quality.classify(docs(spark, [])).collect() == []
    assert weak_quality.classify(docs(spark, rows[:30])).where("kept").count() == 30


def toxic_corpus():
    """Clean prose, and as clean prose with a few abusive words, few or many of all."""
    r = random.Random(16)
    v = [f"word{chr(97 + k % 26)}{k}" for k in range(900)]
    prose = lambda n: [r.choice(v) + r.choice(["", "", "", ",", "."]) for _ in range(n)]
    abusive = ["moron", "Scum!", "vollidiot,", "connard", "gilipollas.", "Stupid", "pathetic"]
    rows = [(k, " ".join(prose(r.randint(20, 200))), "s") for k in range(900)]
    for k in range(60):
        w = prose(r.randint(20, 200))
        for _ in range(2 + len(w) // 50):
            w[r.randrange(len(w))] = r.choice(abusive[:5])
        rows.append((5000 + k, " ".join([*w, r.choice(abusive)]), "s"))
    rows += [(6000 + k, " ".join([*prose(60), "clown", *prose(60)]), "s") for k in range(30)]  # one word of scorn
    rows += [(7000 + k, " ".join(w + "%%%" for w in prose(80)), "s") for k in range(100)]
    return rows


def test_classifier_drops_toxic_documents(spark):
    rows = toxic_corpus()
    got = {x.doc_id: x.kept for x in weak_quality.classify(docs(spark, rows), sample=200).collect()}
    part = lambda a, b: [x for i, x in got.items() if a <= i < b]
    assert sum(part(0, 900)) >= 0.99 * 900
    assert not any(part(5000, 5060))
    assert all(part(6000, 6030))
    assert not any(part(7000, 7100))
