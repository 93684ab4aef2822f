"""Personal data by a semi-Markov conditional random field over whole spans.

The base patterns find emails, IP addresses, card and phone numbers. Around every stretch that may
be personal, the text is cut into tokens, and a semi-Markov model scores every segment of up to
MOST_TOKENS tokens (and MOST_DIGITS digits, as no number has more) as one of the kinds, by features of the whole segment (digits, groups, Luhn sum,
signs, the word before); dynamic programming over segment ends picks boundaries and kinds
together. Base spans cut the stretches: the model segments what stands between them.

The weights are fitted by maximum likelihood (forward-backward over segments) on fixed examples
and on the stretches of a bounded sample of documents, which the base patterns label.

Defined cases: null is the empty text and has no spans; repeated rows give repeated results; very
long texts are read whole, in time in proportion to their length; further columns are left alone
(``redact`` carries them along).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
MOST_TOKENS = 16
#: In a segment with other characters than letters and digits.
MOST_DIGITS = 20
#: Training reads the first STRETCHES stretches of SAMPLE documents.
SAMPLE, STRETCHES = 200, 20
DECAY, ROUNDS, RATE = 0.02, 30, 0.3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Stretches that the model looks at; those of numbers end at a line's end.
STRETCH = re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]+|\+?\(?[0-9](?:(?:[^\S\n]|[().-]){0,2}[0-9]){6,}|[0-9]+(?:\.[0-9]+){3}|(?<![0-9A-Za-z])[0-9a-fA-F]{24,}(?![0-9A-Za-z])")
#: What a text must hold for any of the patterns to fit.
HINT = r"[@0-9]|[a-fA-F]{24}"
_TOKEN = re.compile(r"[^\W_]+|\S")
_RUN, _HEX = re.compile(r"[0-9]+"), re.compile(r"[0-9a-fA-F]+")
_DOMAIN_END = re.compile(r"@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+$")
#: The last word before a segment, with what is between.
_WORD_BEFORE = re.compile(r"\w+\W*$")


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in doubled)) % 10 == 0


def _digits(s: str) -> str:
    return s if s.isascii() and s.isdigit() else "".join(_RUN.findall(s))


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and _LOCAL.match(text[begin - 1]):
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield begin, end
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def tokens_of(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, begin, end)]


def _bucket(n: int) -> str:
    return str(n) if n < 4 else "4-6" if n < 7 else "7-8" if n < 9 else "9-12" if n < 13 else "13-19" if n < 20 else "20+"


def features(text: str, begin: int, end: int) -> tuple[str, ...]:
    """What is seen of a whole segment, and of the word before it."""
    s = text[begin:end]
    digits = _digits(s)
    n = len(digits)
    runs = len(_RUN.findall(s))
    dots, at, brackets = s.count("."), s.count("@"), s.count("(")
    before, after = text[begin - 1 : begin], text[end : end + 1]
    whole = not before.isalnum() and not after.isalnum()
    parts = s.split(".") if dots == 3 else ()
    plain = s.isalnum()
    letters = len(s) - n if plain else sum(map(str.isalpha, s))
    spaces = 0 if plain else sum(map(str.isspace, s))
    word = _WORD_BEFORE.search(text, max(0, begin - 24), begin)
    cue = word[0].strip().lower() if word else ""
    return (
        "bias",
        f"digits={_bucket(n)}",
        f"runs={min(runs, 6)}",
        f"at={at}",
        f"plus={s[0] == '+'}",
        f"cut={not whole or (before != '' and before in '+.@-_%') or (after != '' and after in '.@-_' and text[end + 1 : end + 2].isalnum())}",
        f"edges={s[0].isalnum() or s[0] in '+('}{s[-1].isalnum()}",
        f"letters={_bucket(letters)}",
        f"dots={min(dots, 4)}",
        f"ipv4={len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) <= 255 for p in parts)}",
        f"luhn={13 <= n <= 19 and luhn(digits)}",
        f"hex={len(s) >= 24 and plain and bool(_HEX.fullmatch(s))}",
        f"domain={at > 0 and bool(_DOMAIN_END.search(s))}",
        f"spaces={_bucket(spaces)}",
        f"brackets={brackets == s.count(')')}{brackets > 0}",
        f"before={cue if cue in _CUES else ''}",
    )


#: Words that often stand before personal data.
_CUES = {"call", "phone", "tel", "mobile", "fax", "card", "visa", "email", "mail", "ip", "host", "server", "key", "token", "secret", "password", "apikey", "order", "isbn", "version", "id"}

#: Labelled examples: text, then (kind, segment) that it holds.
EXAMPLES = [
    ("write to ann.lee@mail.example.com today", [("email", "ann.lee@mail.example.com")]),
    ("from x_1@site.org, cc: bo+n@a-b.net.", [("email", "x_1@site.org"), ("email", "bo+n@a-b.net")]),
    ("email dee99@corp.example.co.uk soon", [("email", "dee99@corp.example.co.uk")]),
    ("he met @home and later a@ b", []),
    ("host 10.0.12.250 is up", [("ip", "10.0.12.250")]),
    ("seen from 192.168.1.17, then 8.8.8.8.", [("ip", "192.168.1.17"), ("ip", "8.8.8.8")]),
    ("version 10.300.12.999 of it", []),
    ("version 1.2.3.4000 of it", []),
    ("card 4539 1488 0343 6467 was used", [("card", "4539 1488 0343 6467")]),
    ("visa 4716-1085-9974-4531 expired", [("card", "4716-1085-9974-4531")]),
    ("paid with 6011000990139424 then", [("card", "6011000990139424")]),
    ("order 4539148803436468 was sent", []),
    ("order 1234567890123 is late", []),
    ("isbn 9781402894626 in print", []),
    ("call +1 (212) 555-0147 now", [("phone", "+1 (212) 555-0147")]),
    ("tel +44 20 7946 0958 or", [("phone", "+44 20 7946 0958")]),
    ("phone (212) 555-0187 please", [("phone", "(212) 555-0187")]),
    ("call 212-555-0133 please", [("phone", "212-555-0133")]),
    ("mobile 415.555.2671 and", [("phone", "415.555.2671")]),
    ("in 1987 1988 1989 1990 it rose", []),
    ("id 12345678 and 99887766 both", []),
    ('token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', [("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")]),
    ("key: 0123456789abcdef0123456789abcdef;", [("secret", "0123456789abcdef0123456789abcdef")]),
    ("secret 5f4dcc3b5aa765d61d8327deb882cf99aa", [("secret", "5f4dcc3b5aa765d61d8327deb882cf99aa")]),
    ("run 111111111111111111111111111111 of it", []),
]


def _segments(text: str, tokens: list[tuple[int, int]]):
    """(last token, first token, features) of the segments of a stretch that may be personal at all.

    A segment without an @, of several tokens and more than MOST_DIGITS digits, is no candidate,
    nor is what is longer: a list of numbers has a few candidates for each number."""
    digits, ats = [0], [0]
    for s, e in tokens:
        piece = text[s:e]
        digits.append(digits[-1] + len(_digits(piece)))
        ats.append(ats[-1] + piece.count("@"))
    for j, (_, stop) in enumerate(tokens):
        if not text[stop - 1].isalnum():
            continue
        for i in range(j, max(-1, j - MOST_TOKENS), -1):
            start = tokens[i][0]
            n, at = digits[j + 1] - digits[i], ats[j + 1] > ats[i]
            if i < j and n > MOST_DIGITS and not at and ats[j + 1] == ats[max(0, j - MOST_TOKENS + 1)]:
                break
            possible = at or n >= 4 and (n <= MOST_DIGITS or i == j) or stop - start >= 24 and n < 4
            if possible and (text[start].isalnum() or text[start] in "+("):
                yield j, i, features(text, start, stop)


class Lattice:
    """Segments of a stretch: for each token end, (token begin, kind, features)."""

    def __init__(self, text: str, begin: int, end: int):
        self.tokens = tokens_of(text, begin, end)
        self.segments: list[list[tuple[int, str, tuple[str, ...]]]] = [[] for _ in self.tokens]
        for j, i, seen in _segments(text, self.tokens):
            self.segments[j] += [(i, kind, seen) for kind in KINDS]

    def score(self, weights: dict, kind: str, seen: tuple[str, ...]) -> float:
        return sum(weights.get((kind, f), 0.0) for f in seen)

    def expected(self, weights: dict) -> list[tuple[float, str, tuple[str, ...]]]:
        """(probability, kind, features) of all segments, by forward-backward."""
        n = len(self.segments)
        scored = [[(i, kind, seen, self.score(weights, kind, seen)) for i, kind, seen in ends] for ends in self.segments]
        ahead = [0.0] + [-math.inf] * n
        for j, ends in enumerate(scored):
            ahead[j + 1] = _log_sum([ahead[j]] + [ahead[i] + v for i, _, _, v in ends])
        behind = [[] for _ in range(n + 1)]
        behind[n] = [0.0]
        total = [0.0] * (n + 1)
        for j in range(n, 0, -1):
            total[j] = _log_sum(behind[j])
            behind[j - 1].append(total[j])
            for i, _, _, v in scored[j - 1]:
                behind[i].append(total[j] + v)
        return [(math.exp(ahead[i] + v + total[j + 1] - ahead[n]), kind, seen) for j, ends in enumerate(scored) for i, kind, seen, v in ends]


def best_segments(text: str, begin: int, end: int, weights: dict, seen_before: dict | None = None) -> list[tuple[str, int, int]]:
    """The best segmentation's (kind, start, end); what is outside scores 0.

    Segments are scored as they come and not kept: a token costs one entry of ``top`` and ``back``.
    seen_before keeps the best kind of each combination of features."""
    kinds = {} if seen_before is None else seen_before
    tokens = tokens_of(text, begin, end)
    top, back = [0.0], []
    segments = _segments(text, tokens)
    one = next(segments, None)
    for j in range(len(tokens)):
        value, choice = top[j], None
        while one is not None and one[0] == j:
            _, i, seen = one
            if seen not in kinds:
                scores = [sum(weights.get((kind, f), 0.0) for f in seen) for kind in KINDS]
                most = max(range(len(KINDS)), key=lambda k: scores[k])
                kinds[seen] = scores[most], KINDS[most]
            score, kind = kinds[seen]
            if top[i] + score > value:
                value, choice = top[i] + score, (i, kind)
            one = next(segments, None)
        top.append(value)
        back.append(choice)
    out, j = [], len(tokens)
    while j:
        if back[j - 1] is None:
            j -= 1
        else:
            i, kind = back[j - 1]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def stretches(text: str):
    """Parts of the text to look at; they do not overlap."""
    return (m.span() for m in STRETCH.finditer(text))


def fit(samples: list[str]) -> dict[tuple[str, str], float]:
    """Weights of (kind, feature) under which the labelled segments are likeliest."""
    cases: list[tuple[Lattice, set[tuple[str, int, int]]]] = []
    for text, spans in EXAMPLES:
        gold, at = set(), 0
        for kind, piece in spans:
            at = text.index(piece, at)
            gold.add((kind, at, at + len(piece)))
            at += len(piece)
        cases.append((Lattice(text, 0, len(text)), gold))
    for text in samples:
        gold = {s for s in base_spans(text)}
        for a, b in stretches(text):
            own = {(k, s, e) for k, s, e in gold if a <= s and e <= b}
            if own:  # a stretch without a base span may hold what only the model can find
                cases.append((Lattice(text, a, b), own))
    weights: dict[tuple[str, str], float] = defaultdict(float)
    squares: dict[tuple[str, str], float] = defaultdict(float)
    scale = len(EXAMPLES) / len(cases)
    for _ in range(ROUNDS):
        gradient: dict[tuple[str, str], float] = defaultdict(float)
        for k, (lattice, gold) in enumerate(cases):
            worth = 1.0 if k < len(EXAMPLES) else scale
            for j, ends in enumerate(lattice.segments):
                for i, kind, seen in ends:
                    if (kind, lattice.tokens[i][0], lattice.tokens[j][1]) in gold:
                        for f in seen:
                            gradient[kind, f] += worth
            for p, kind, seen in lattice.expected(weights):
                if p > 1e-6:
                    for f in seen:
                        gradient[kind, f] -= p * worth
        for key, g in gradient.items():
            g -= DECAY * weights[key]
            squares[key] += g * g
            weights[key] += RATE * g / math.sqrt(squares[key] + 1e-9)
    return dict(weights)


def find_spans(text: str, weights: dict, seen_before: dict | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start.

    Base spans cut the stretches; the model segments what is left between them."""
    base = base_spans(text)
    taken: list[list[int]] = []  # what base spans cover, merged
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    more, k = [], 0
    for a, b in stretches(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, own = a, k
        while at < b:
            inside = own < len(taken) and taken[own][0] < b
            stop = max(at, taken[own][0]) if inside else b
            if at < stop and any(map(str.isalnum, text[at:stop])):
                more += best_segments(text, at, stop, weights, seen_before)
            at = taken[own][1] if inside else b
            own += 1
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def train(docs: DataFrame, sample: int = SAMPLE, most_stretches: int = STRETCHES) -> dict[tuple[str, str], float]:
    """Fits on the documents with a hint of personal data that come first by hashed id."""

    def cut(batches):  # only the stretches of a text, with what stands around them
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = itertools.islice(stretches(text), most_stretches)
                out.append("\n".join(text[max(0, a - 24) : b + 8] for a, b in found))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(out, pa.string())], names=["h", "text"])

    hinted = docs.where(F.rlike("text", F.lit(HINT))).select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(cut, "h long, text string").where("length(text) > 0")
    # at most ``sample`` rows of at most ``most_stretches`` stretches reach the driver
    return fit([r.text for r in hinted.orderBy("h", "text").limit(sample).collect()])


def find_personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    empty = hashlib.sha256(b"").hexdigest()

    def find(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text is None:
                    out.append((0, 0, 0, 0, empty, ""))
                    continue
                base, spans = find_spans(text, weights.value, known)
                out.append((*(sum(k == kind for k, _, _ in base) for kind in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.string(), pa.string()), strict=True) if out else ()
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in columns)], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    hinted = docs.select("doc_id", F.when(F.rlike("text", F.lit(HINT)), F.col("text")).alias("text"))
    return hinted.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def replace_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, with a placeholder for each span in their texts;
    n_chars, where there is such a column, follows."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def hide(batches):
        hint, known = re.compile(HINT), {}
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None or not hint.search(t) else replace_spans(t, find_spans(t, weights.value, known)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(hide, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
