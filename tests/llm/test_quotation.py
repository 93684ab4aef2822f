import random
import re

from leafmill.llm import quotation

ROWS = [
    (1, 0, "user", "How do I bake bread at home?\nPlease be brief about it."),
    (1, 1, "assistant", "> How do I bake bread at home?\nMix flour, water, salt and yeast."),
    (1, 2, "user", "On Monday, Ann wrote:\n> > how do I  BAKE bread\n> > at home?\n> Mix flour, water, salt and yeast.\nAnd how long does it take?"),
    (2, 0, "user", "> mix flour, water,\n> salt and yeast.\nIs this right?"),
    (2, 1, "assistant", "> never said by anyone here\nYes."),
    (3, 0, "user", None),
    (3, 0, "user", None),
    (4, 5, "user", "> > deep only\n> Yes."),
    (None, 1, "user", "> Yes."),
    (5, 70, "user", "hello there my old friend"),
    (5, 3, "user", "early"),
]


def test_links_and_threads(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as body")
    got = {(r.conv_id, r.turn): r for r in quotation.link_messages(df).collect()}
    view = {k: (r.body, r.n_quotes, r.n_linked, r.reply_conv, r.reply_turn, r.thread_id) for k, r in got.items()}
    assert view[1, 0] == ("How do I bake bread at home?\nPlease be brief about it.", 0, 0, None, None, 1)
    assert view[1, 1] == ("Mix flour, water, salt and yeast.", 1, 1, 1, 0, 1)
    assert view[1, 2] == ("And how long does it take?", 2, 2, 1, 1, 1)
    assert view[2, 0] == ("Is this right?", 1, 1, 1, 1, 1)
    assert view[2, 1] == ("Yes.", 1, 0, 2, 0, 1)
    assert view[3, 0] == ("", 0, 0, None, None, 3)
    assert view[4, 5] == ("", 2, 1, 2, 1, 1)
    assert view[None, 1][1:] == (1, 0, None, None, None)
    assert view[5, 70][3:] == (5, 3, 5)


def test_chats(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): r for r in quotation.build_chats(df).collect()}
    assert sum(r.n_messages for r in got.values()) == len(ROWS)
    assert got[1, 0].chat == "<|user|>\nHow do I bake bread at home?\nPlease be brief about it.\n<|assistant|>\nMix flour, water, salt and yeast.\n<|user|>\nAnd how long does it take?\n"
    assert got[1, 0].replies == "0,1:1:0,2:1:1"
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 0), (None, 0), (5, 0), (5, 1)}


def test_empty_table(spark):
    assert quotation.build_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


EXCERPTS = [
    (1, 0, "The kettle is broken again today.\nPlease buy a new one soon.\nThanks a lot for all your help.\n\nThe garden needs water every day."),
    (1, 1, "Thanks a lot for all your help.\nI will look for a kettle."),
    (1, 2, "> The kettle is broken again today.\n> Please buy a new one soon.\nDone."),
    (1, 3, "> Please buy a new one soon.\n>\n> The garden needs water every day.\n> Some line that nobody ever wrote.\nBoth done."),
    (1, 4, "Rain is due on Monday morning. It will be cold then! Bring a warm coat with you."),
    (1, 5, "> It will be cold then! Bring a warm\n> coat with you.\nI will."),
    (1, 6, "> no such words were here\n> Both\nWhat?"),
]


def test_excerpts_link_to_where_most_of_them_stands(spark):
    df = spark.createDataFrame([(*r[:2], "user", r[2]) for r in EXCERPTS], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.n_quotes, r.n_linked, r.reply_turn) for r in quotation.link_messages(df).collect()}
    assert got == {0: (0, 0, None), 1: (0, 0, 0), 2: (1, 1, 0), 3: (1, 1, 0), 4: (0, 0, 3), 5: (1, 1, 4), 6: (1, 0, 5)}


def plain_links(rows):
    """What each message replies to, by comparing every passage with every unit of every message."""
    normal = lambda t: " ".join(re.sub("[A-Z]+", lambda m: m[0].lower(), t).split())
    pieces = lambda t: {n for p in re.split(r"\n[ \t]*\n", t) + t.split("\n") + re.split(r"(?<=[.!?])\s+", t) if len((n := normal(p)).split()) >= 4}
    bodies, quotes = {}, {}
    for conv, turn, text in rows:
        passages, own, last = [], [], 0
        for line in text.split("\n"):
            level = len(re.match(r"((> ?)*)", line)[1].replace(" ", ""))
            line = re.sub(r"^(> ?)*", "", line)
            if level == 0:
                own.append(line)
            elif level == last:
                passages[-1][1].append(line)
            else:
                passages.append((level, [line]))
            last = level
        body = "\n".join(own).strip("\n") if passages else text
        bodies[conv, turn] = pieces(body) | {normal(body)} - {""}
        quotes[conv, turn] = [(level, k, "\n".join(lines)) for k, (level, lines) in enumerate(passages)]
    out = {}
    for here, passages in quotes.items():

        def leads(unit, here=here):
            having = sorted(m for m, units in bodies.items() if unit in units)
            own = [m for m in having if m[0] == here[0]]
            first = own[0] if own and own[0] < here else having[0] if having and having[0] < here else None
            return first

        linked = []
        for level, k, text in passages:
            whole = leads(normal(text)) if normal(text) else None
            votes = [x for p in pieces(text) if (x := leads(p))]
            origin = whole or (min(votes, key=lambda m: (-votes.count(m), m)) if votes else None)
            if origin:
                linked.append((level, k, origin))
        before = max((m for m in bodies if m[0] == here[0] and m < here), default=None)
        out[here] = (len(linked), min(linked)[2] if linked else before)
    return out


def test_links_equal_plain_search(spark):
    r = random.Random(21)
    lines = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(r.randint(2, 6))) + r.choice([".", "", "!"]) for _ in range(25)]
    rows = []
    for conv in range(25):
        for turn in range(8):
            own = [r.choice(lines) for _ in range(r.randint(1, 4))]
            quoted = [f"{'> ' * r.randint(1, 2)}{r.choice(lines)}" for _ in range(r.randint(0, 4))]
            rows.append((conv, turn, "\n".join([*quoted, r.choice(own).upper(), *r.sample(["", *own], len(own))])))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(m.conv_id, m.turn): (m.n_linked, None if m.reply_conv is None else (m.reply_conv, m.reply_turn)) for m in quotation.link_messages(df).collect()}
    assert got == plain_links(rows)


def test_hot_groups_come_out_in_slices(spark):
    long = "word " * 100_000
    rows = [(None, k % 3, "user", f"lost {k}") for k in range(300)] + [(7, 0, "user", "the same words again")] * 300 + [(7, 0, "user", f"other text {k}") for k in range(300)] + [(8, 0, "user", long), (8, 1, "user", "> " + long), (9, None, "user", "> no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as slice", "2 as at", "'x' as chat")
    got = quotation.build_chats(df, most=50).collect()
    assert sum(x.n_messages for x in got) == len(rows)
    assert max(x.n_messages for x in got) < 100
    assert sorted(re.findall(r"lost \d+", "".join(x.chat for x in got))) == sorted(f"lost {k}" for k in range(300))
    assert "".join(x.chat for x in got).count("the same words again") == 300
    assert next(x for x in got if x.conv_id == 8).replies == "0,1:8:0"
