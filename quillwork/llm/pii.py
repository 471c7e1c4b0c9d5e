"""Personal information in free text, found by a semi-Markov conditional random field.

A text is cut into segments: single words outside, or whole spans with one of five kinds. A span is scored as a whole,
by what it looks like (its number shape, its sequence of name parts, its street form), what stands inside and what
stands around it. Spans longer than MAX_CHARS, and spans that none of the generators below proposes, score minus
infinity; over the rest dynamic programming picks the best boundaries and kinds together, in time linear in their
number. Words outside score 0, so a span is taken only if the model prefers it to leaving its words alone.

The weights are trained by ``pii_training`` on generated sentences and lie beside this file.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")
MAX_CHARS = 120
MAX_DIGITS = 20  # no number of a phone or a person has more
# added to the score of a span of a kind: an item left in a text costs more than a word masked for nothing
CARE = {"person": 1.0, "phone": 1.0}
MODEL = Path(__file__).with_name("pii_model.json")

# fixed values: forms of address, particles of family names, words of streets and boxes, digit words
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam madame mme monsieur mlle herr frau señor señora señorita sr sra srta don doña signor signora".split())
PARTICLES = frozenset("van von de la del der den al el bin ibn di da dos du le ten ter zu st".split())
STREETS = "street st avenue ave road rd drive dr boulevard blvd lane ln place pl court ct way terrace ter parkway pkwy highway hwy square sq trail circle cir crescent close"
RUES = "rue avenue av bd boulevard place impasse chemin quai allée allee cours passage route square"
CALLES = "calle c/ avenida avda av plaza paseo camino ronda carrer travesía via viale piazza corso rua praça"
ONE_LETTER = frozenset("aiyoeàéu")  # words that no initial is without its dot
DIGITS = "zero one two three four five six seven eight nine oh"
SPOKEN = f"""{DIGITS} cero uno una dos tres cuatro cinco seis siete ocho nueve zéro un une deux trois quatre cinq sept huit neuf
    null eins zwei zwo drei vier fünf fuenf sechs sieben acht neun"""

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
AT = r"(?:@|\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\}|\bat\b)"
DOT = r"(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\}|\bdot\b|\bpunkt\b|\bpunto\b|\bpoint\b)"
EMAIL = re.compile(rf"[\w.+\-]*\w\s{{0,2}}{AT}\s{{0,2}}[\w\-]+(?:\.[\w\-]+|\s{{0,2}}{DOT}\s{{0,2}}[\w\-]+)+", re.I)
PLAIN_EMAIL = re.compile(r"[\w.+\-]*\w@[\w\-]+(?:\.[\w\-]+)+")
NUMBER = re.compile(r"(?:\b[A-Za-z]{2}[ ](?=\d\d[ ]\d\d[ ]\d\d[ ]?[A-Za-z]\b))?\+?\(?[A-Za-z]{0,8}\d\w*(?:\)?[  ]?[-–./]?[  ]?\(?(?:\d\w*|[A-Za-z](?!\w)))*(?:[ ,]{0,2}(?:x|ext\.?|extension)[ ]?\d{1,6})?", re.I)
GROUP = re.compile(r"\+?\(\d+\)|\+?\w+")
EXTENSION = re.compile(r"(?:x|ext\.?|extension)[ ]?\d{1,6}$", re.I)
SPELLED = re.compile(rf"\b(?:(?:(?:plus|más)\s)?(?:{'|'.join(SPOKEN.split())})[\s,\-]+){{6,}}(?:{'|'.join(SPOKEN.split())})\b", re.I)
_W = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
ADDRESS = [
    ("number street", re.compile(rf"(?<![\w.\-/#])\d{{1,5}}[a-z]?\s+(?:[NSEW]\.?\s+)?(?:{_W}\s+){{1,3}}?(?:{'|'.join(STREETS.split())})\b", re.I)),
    ("box", re.compile(r"\b(?:p\.?\s?o\.?\s*|post(?:al)?\s+(?:office\s+)?|apartado\s+|post)?(?:box|postfach|bp|apartado)\s+(?:no\.?\s*|#\s*)?\d{1,6}\b", re.I)),
    ("number rue", re.compile(rf"\b\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:{'|'.join(RUES.split())})\b\.?\s+(?:d[eu]s?\s+|de la\s+|d['’]|l['’])?(?:la\s+|l['’])?{_W}(?:[ ](?-i:[A-ZÀ-Ý]){_W})?", re.I)),
    ("calle number", re.compile(rf"(?:\b(?:{'|'.join(x for x in CALLES.split() if x != 'c/')})\b|\bc/)\.?\s+(?:{_W}\s+){{1,4}},?\s*(?:n[º°.]\s*)?\d{{1,4}}\b(?:,\s*\d{{1,2}}[º°ª]\s*\w)?|(?:\b(?:calle|avenida|plaza|paseo)\b|\bc/)\.?\s+(?:{_W}\s+){{0,3}}{_W},?\s+\d{{1,4}}\b", re.I)),
    ("strasse number", re.compile(r"\b[^\W\d_]{2,}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig)[ ]+\d{1,4}(?:[ ]?[a-z]\b|\b)", re.I)),
]
# what must be there before the generators of a kind are tried at all
MAIL_WORDS = frozenset("dot punkt punto point".split())
DIGIT_RUN = re.compile(r"\d[\d .\-–/()  ]*")
DIGIT_WORDS = frozenset(DIGITS.split())
SPOKEN_WORDS = frozenset(SPOKEN.split())
ROAD_SIGNS = {
    "number street": frozenset(STREETS.split()), "box": frozenset("box pobox postbox postfach apartado bp".split()),
    "number rue": frozenset(RUES.split()), "calle number": frozenset([x for x in CALLES.split() if x != "c/"] + ["c"]),
}
ROAD_WORDS = frozenset().union(*ROAD_SIGNS.values())
ROAD_END = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig")


def shape(s: str) -> str:
    """Runs of digits as their length, runs of letters as a and their length, the rest as it stands."""
    s = re.sub(r"[  ]+", " ", s)
    return re.sub(r"\d+|[^\W\d_]+", lambda m: str(len(m.group())) if m.group().isdigit() else f"a{len(m.group())}", s)


class Letters:
    """How likely a word is by its letters, each given the two before it."""

    def __init__(self, words):
        self.n: dict = {}
        self.after: dict = {}
        for w in words:
            w = f"^^{w}$"
            for i in range(2, len(w)):
                self.n[w[i - 2 : i + 1]] = self.n.get(w[i - 2 : i + 1], 0) + 1
                self.after.setdefault(w[i - 2 : i], []).append(w[i])

    def score(self, word: str) -> float:
        """Mean log probability of a letter."""
        w, total = f"^^{word}$", 0.0
        for i in range(2, len(w)):
            total += math.log((self.n.get(w[i - 2 : i + 1], 0) + 0.1) / (len(self.after.get(w[i - 2 : i], ())) + 4))
        return total / (len(w) - 2)

    def word(self, r, least: int = 4, most: int = 11) -> str:
        """A word by these letters, of ``least`` to ``most``."""
        while True:
            out, two = "", "^^"
            while len(out) <= most:
                c = r.choice(self.after[two])
                if c == "$":
                    break
                out, two = out + c, two[1] + c
            if least <= len(out) <= most:
                return out


def prepared(m: dict) -> dict:
    """A model with what is looked up while texts are read."""
    m = m | {"given": frozenset(m["given"]), "family": frozenset(m["family"])}
    known = m["common"].keys() | m["proper"].keys() | m["given"] | m["family"] | TITLES | PARTICLES | DIGIT_WORDS
    return m | {"known": known, "hints": m["given"] | m["family"] | TITLES, "ordinary": known - m["family"] - m["given"], "names": Letters(m["family"] | m["given"]), "words": Letters(m["common"]), "seen": {}}


@lru_cache(maxsize=1)
def model(path: str = str(MODEL)) -> dict:
    m = json.loads(Path(path).read_text(encoding="utf-8"))
    return prepared(m)


def _around(text: str, start: int, end: int) -> list[str]:
    """Features of the words beside a span."""
    before = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])[-3:]]
    after = [w.lower() for w in WORD.findall(text[end : end + 25])[:1]]
    out = [f"L1={before[-1]}"] if before else ["L1="]
    out += [f"L={w}" for w in before]
    if len(before) > 1:
        out.append(f"L2={before[-2]} {before[-1]}")
    out += [f"R1={after[0]}"] if after else []
    sign = text[max(0, start - 2) : start].strip()[-1:]
    return [*out, f"S={sign}"]


def _numbers(text: str):
    for m in NUMBER.finditer(text):
        chunk, at = m.group(), m.start()
        if sum(c.isdigit() for c in chunk) < 4:
            continue
        groups = [(g.start(), g.end()) for g in GROUP.finditer(chunk)]
        tail = EXTENSION.search(chunk)
        for i in range(len(groups)):
            for j in range(i, len(groups)):
                a, b = groups[i][0], groups[j][1]
                if b - a > MAX_CHARS:
                    break
                if tail and a < tail.start() < b < tail.end():
                    continue
                part = chunk[a:b]
                digits = sum(c.isdigit() for c in part)
                if digits < 5:
                    continue
                if digits > MAX_DIGITS:
                    break
                whole = "whole" if (i, j) == (0, len(groups) - 1) else "part"
                yield at + a, at + b, ("phone", "id_number"), [f"N={shape(part)}", f"digits={min(digits, 16)}", f"chunk={whole}"]


def _spelled(text: str):
    for m in SPELLED.finditer(text):
        n = len(re.findall(r"\w+", m.group()))
        yield m.start(), m.end(), ("phone",), ["spelled", f"spelled={min(n, 14)}"]


def _addresses(text: str, words: set[str], rare: set[str]):
    for form, pattern in ADDRESS:
        if not (words & ROAD_SIGNS[form] if form in ROAD_SIGNS else any(w.endswith(ROAD_END) for w in rare)):
            continue
        for m in pattern.finditer(text):
            inner = [w.lower() for w in WORD.findall(m.group())]
            yield m.start(), m.end(), ("address",), [f"form={form}", *[f"I={form} {w}" for w in inner], f"words={len(inner)}"]


def _emails(text: str):
    written = list(EMAIL.finditer(text))
    taken = {m.span() for m in written}
    for m in [*written, *(p for p in PLAIN_EMAIL.finditer(text) if p.span() not in taken)]:
        s = m.group().lower()
        how = "@" if "@" in s else "bracket" if re.search(r"[\[({]\s?at", s) else "word"
        dots = "." if "." in s.partition("@")[2] else "dot"
        last = re.findall(r"\w+", s)[-1]
        yield m.start(), m.end(), ("email",), [f"at={how}", f"at={how} dots={dots}", f"top={last if len(last) > 1 else 'letter'}"]


def _is_typo(low: str, known, other: bool) -> bool:
    """Whether one letter less, more, swapped or (if asked) other makes it a known word of at least four letters."""
    if len(low) < 4:
        return False
    cuts = [(low[:i], low[i:]) for i in range(len(low) + 1)]
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñ"
    if any(len(low) > 4 and a + b[1:] in known or len(b) > 1 and a + b[1] + b[0] + b[2:] in known for a, b in cuts if b):
        return True
    return any(other and a + c + b[1:] in known or a + c + b in known for a, b in cuts for c in letters)


def _unknown(low: str, upper: bool, m: dict) -> tuple[str, int]:
    """(U, u or c, how name-like its letters are) of a word that no list holds. A word in small letters that is a typing
    slip away from a known one is ordinary, a capitalised one only if it is so from the name of a place or thing."""
    got = m["seen"].get((low, upper))
    if got is None:
        slip = _is_typo(low, m["proper"].keys() if upper else m["ordinary"], not upper)
        like = max(-3, min(3, round(2 * (m["names"].score(low) - m["words"].score(low)))))
        got = ("c" if slip else "U" if upper else "u"), like
        if len(m["seen"]) > 200_000:
            m["seen"].clear()
        m["seen"][low, upper] = got
    return got


# fixed values: endings that family names of several languages have
ENDINGS = """son sen sson ssen sohn ton ston ham ford wick wich field feld brook bach beck stone stein ley leigh worth bury burgh berg burg borg strand ström strom quist kvist lund lind gren dahl holm man mann bauer hauer meier meyer
maier hofer huber müller möller stadt dorf wood wald hoff hof ski sky ska cki czyk wicz vich vic ović ova ev ov enko chuk uk escu eanu ez az iz oz es ez inho ini ino elli etti ucci azzi one ano esi poulos idis akis yan ian dottir dóttir
nen inen la aho vale dale shaw well cott sted stead feather smith wright land more mere more er ard aud eau ier oux in on ell ett""".split()
_TAILS = tuple(sorted(set(ENDINGS), key=lambda e: (-len(e), e)))


def ending(low: str) -> str:
    """The longest ending of a family name that a word has, if anything stands before it."""
    return next((e for e in _TAILS if low.endswith(e) and len(low) > len(e) + 1), "")


NEAR = frozenset([" ", "-", ", ", ". ", ".", "  ", "\u00a0", "-\u200b"])
NAME_CODES = frozenset("TGSPIpUuC")


def _is_name(codes: list[str], gaps: list[str]) -> bool:
    """Whether a sequence of parts may be a name: a family name (or a word that may be one) beside a given name, an
    initial or a title, or two unknown words."""
    if codes[0] in "pC" or codes[-1] in "pIT" or codes[-1] in "PG" and codes[0] not in "TI" and gaps[-1] != ", ":
        return False
    have = set(codes)
    if have <= set("PpI") or have <= set("GpI") or have <= set("GPp"):
        return codes == ["I", "P"] and gaps[0][0] == "."
    if not have & set("UuSC"):
        return codes[0] == "T" and len(codes) > 1 and have <= set("TGPIp")
    for k, c in enumerate(codes):
        if c == "C" and (codes[k - 1] not in "TGIU" or gaps[k - 1] not in (" ", ". ")):
            return False
        if c == "u" and not (k and codes[k - 1] in "GPTIupS" or k + 1 < len(codes) and codes[k + 1] in "GP" and gaps[k] == ", "):
            return False
    return bool(have & set("TGPI")) or codes.count("U") + codes.count("S") > 1


def _persons(text: str, m: dict, words: list[tuple[int, int, str, str]]):
    """Spans over name-like words that touch each other, described by the sequence of their parts. Spans slide over a
    run however long it is."""
    i, n = 0, len(words)
    while i < n:
        if words[i][3] not in NAME_CODES:
            i += 1
            continue
        run, gaps = [i], []
        while run[-1] + 1 < n and words[run[-1] + 1][3] in NAME_CODES:
            gap = text[words[run[-1]][1] : words[run[-1] + 1][0]]
            if gap not in NEAR or gap[0] == "." and words[run[-1]][3] not in "TI":
                break
            gaps.append(gap.replace("  ", " "))
            run.append(run[-1] + 1)
        for x in range(len(run)):
            for y in range(x + 1, min(len(run), x + 7)):
                parts = [words[k] for k in run[x : y + 1]]
                codes, between = [p[3] for p in parts], gaps[x:y]
                if parts[-1][1] - parts[0][0] > MAX_CHARS or not _is_name(codes, between) or "@" in (text[parts[0][0] - 1 : parts[0][0]], text[parts[-1][1] : parts[-1][1] + 1]):
                    continue
                pattern = codes[0] + "".join(map("".join, zip(between, codes[1:])))
                short = "".join("N" if c in "GP" else "F" if c in "US" else c for c in codes)
                end = text[max(0, parts[0][0] - 2) : parts[0][0]].strip()[-1:]
                feats = [f"P={pattern}", f"Q={short}", f"run={'whole' if (x, y) == (0, len(run) - 1) else 'part'}", f"first={not end or end in '.!?:'}"]
                for k, p in enumerate(parts):
                    low, code = p[2].lower(), codes[k]
                    if code in "Uu":
                        feats += [f"like={code}{_unknown(low, code == 'U', m)[1]}", f"ending={ending(low)}", f"case={'u' if p[2].isupper() else 't'}{code}", f"size={min(len(low), 9)}"]
                    elif code == "C":
                        feats += [f"often={m['common'].get(low, 0)}", f"C={low}"]
                yield parts[0][0], parts[-1][1], ("person",), feats
        i = run[-1] + 1


def _words(text: str, m: dict) -> tuple[list, bool]:
    """Words with their class: Title, Given name, Surname known as such, Initial, particle; Proper noun seen often,
    common word (C where it is capitalised within a sentence), Unknown word (u in small letters); and whether any title
    or any word that may be a family name is there at all."""
    given, family, common, proper = m["given"], m["family"], m["common"], m["proper"]
    out, any_name = [], False
    loud = sum(map(str.isupper, text)) > sum(map(str.islower, text))
    for w in WORD.finditer(text):
        s = w.group()
        low = s.lower()
        if len(s) == 1:
            code = "I" if (s.isupper() and low not in ONE_LETTER or text[w.end() : w.end() + 1] == ".") and not text[max(0, w.start() - 1) : w.start()].isdigit() else "c"
        elif low in TITLES:
            code, any_name = "T", True
        elif low in PARTICLES:
            code = "p"
        elif low in given:
            code = "G"
        elif low in proper:
            code = "P"
        elif low in family and (low not in common or s[0].isupper() and not loud):
            code, any_name = "S", True
        elif low in common:
            code = "C" if s[0].isupper() and not loud and text[max(0, w.start() - 2) : w.start()].strip()[-1:] not in ("", ".", "!", "?", ":", "\n") or s[0].isupper() and not loud and out and out[-1][3] in "TI" else "c"
            any_name = any_name or code == "C"
        elif "'" in s[2:] or "’" in s[2:]:
            code = "c"
        else:
            code = "c" if len(s) < 3 and s.isupper() else "c" if len(s) < 4 and (loud or s.islower()) else _unknown(low, s[0].isupper(), m)[0]
            any_name = any_name or code != "c"
        out.append((w.start(), w.end(), s, code))
    return out, any_name


def candidates(text: str, m: dict) -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every span that may be more than words, one after the other: a long text may
    propose many."""
    found = []
    low = text.lower()
    listed = WORD.findall(low)
    words = set(listed)
    rare = words - m["known"]  # words no list holds
    runs = DIGIT_RUN.findall(text)
    if "@" in text or words & MAIL_WORDS or "at]" in low or "at)" in low or "at}" in low:
        found.append(_emails(text))
    if any(len(r) > 4 and sum(map(str.isdigit, r)) > 4 for r in runs):
        found.append(_numbers(text))
    if words & SPOKEN_WORDS and sum(w in SPOKEN_WORDS for w in listed) > 4:  # of seven, the outer two may be joined to more
        found.append(_spelled(text))
    if runs and (words & ROAD_WORDS or any(w.endswith(ROAD_END) for w in rare)):
        found.append(_addresses(text, words, rare))
    if rare or words & m["hints"]:
        parts, any_name = _words(text, m)
        if any_name:
            found.append(_persons(text, m, parts))
    for start, end, kinds, feats in chain.from_iterable(found):
        around = _around(text, start, end)
        for kind in kinds:
            yield start, end, kind, [f"{kind}|{f}" for f in (*feats, *around, "bias")]


def best(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The highest-scoring set of spans that don't overlap; none if none scores above 0."""
    spans = sorted(((s, e, k, x) for s, e, k, x in spans if x > 0), key=lambda c: (c[1], c[0]))
    ends, total, back = [c[1] for c in spans], [0.0], []
    for i, (s, _, _, x) in enumerate(spans):
        j = bisect.bisect_right(ends, s, 0, i)
        take = total[j] + x
        back.append(j if take > total[i] else -1)
        total.append(max(take, total[i]))
    out, i = [], len(spans)
    while i:
        if back[i - 1] < 0:
            i -= 1
        else:
            out.append(spans[i - 1][:3])
            i = back[i - 1]
    return out[::-1]


def log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def marginals(spans: list[tuple[int, int, float]]) -> tuple[list[float], float]:
    """Probability of each span over all segmentations, and the log of the partition sum."""
    n = len(spans)
    order = sorted(range(n), key=lambda i: (spans[i][1], spans[i][0]))
    ends, ahead, before = [spans[i][1] for i in order], [0.0], {}
    for k, i in enumerate(order):
        before[i] = ahead[bisect.bisect_right(ends, spans[i][0], 0, k)]
        ahead.append(log_add(ahead[k], spans[i][2] + before[i]))
    rev = sorted(range(n), key=lambda i: (-spans[i][0], -spans[i][1]))
    starts, behind, after = [-spans[i][0] for i in rev], [0.0], {}
    for k, i in enumerate(rev):
        after[i] = behind[bisect.bisect_right(starts, -spans[i][1], 0, k)]
        behind.append(log_add(behind[k], spans[i][2] + after[i]))
    z = ahead[-1]
    return [math.exp(min(0.0, before[i] + spans[i][2] + after[i] - z)) for i in range(n)], z


def spans_of(text: str | None, m: dict) -> list[tuple[int, int, str]]:
    """The personal items of a text, in order; null and blank texts have none."""
    if not text or text.isspace():
        return []
    weights = m["weights"]
    scored = ((s, e, k, sum((weights.get(f, 0.0) for f in feats), CARE.get(k, 0.0))) for s, e, k, feats in candidates(text, m))
    return best([x for x in scored if x[3] > 0])


def replaced(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each item's place taken by its kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted, kinds, n_items, items): every text with typed placeholders, the kinds found, sorted and distinct,
    and where each item stood in the original (characters from 0, the last one exclusive).

    Null and blank texts come back as they are; repeated rows come out as often; whole texts are read, however long;
    other columns are ignored. Runs where the rows lie, without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    places = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans_of(t, m) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([replaced(t, s) for t, s in zip(texts, found)], pa.string()),
                    pa.array([sorted({k for _, _, k in s}) for s in found], pa.list_(pa.string())),
                    pa.array([len(s) for s in found], pa.int32()),
                    pa.array([[{"first": a, "last": b, "kind": k} for a, b, k in s] for s in found], places),
                ],
                names=["key", "redacted", "kinds", "n_items", "items"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string"))
    return rows.mapInArrow(work, f"key {kind}, redacted string, kinds array<string>, n_items int, items array<struct<first int, last int, kind string>>").withColumnRenamed("key", key)


def check(texts: DataFrame, redacted: DataFrame, key: str, text: str) -> DataFrame:
    """(what, n): texts read, and how often a redaction breaks what must hold of it; keys are unique."""
    both = texts.select(key, F.col(text).alias("text")).join(redacted, key)
    size = F.char_length("text")
    # the text rebuilt from what lies between its items, with their placeholders
    built = F.aggregate(
        "items", F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a["t"], F.substring("text", a["at"] + 1, x["first"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("t"), x["last"].alias("at")),
    )
    whole = F.concat(built["t"], F.substring("text", built["at"] + 1, size))
    apart = F.transform(F.sequence(F.lit(1), F.size("items") - 1), lambda i: F.get("items", i)["first"] >= F.get("items", i - 1)["last"])
    out = both.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(~whole.eqNullSafe(F.col("redacted"))).alias("texts changed beside their items"),
        F.count_if(F.exists("items", lambda x: (x["first"] < 0) | (x["last"] > size) | (x["first"] >= x["last"]))).alias("items outside their text"),
        F.count_if((F.size("items") > 1) & ~F.forall(F.when(F.size("items") > 1, apart).otherwise(F.array(F.lit(True))), lambda x: x)).alias("items that overlap"),
    )
    return out.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"`{n}`").alias("n")) for n in out.columns])).alias("x")).select("x.*")
