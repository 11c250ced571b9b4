"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds anchors: at-signs, digits,
plus signs, the sign behind URL schemes and the cues of identifiers. Each
kind has a deterministic parser that starts at an anchor, expands to the widest
stretch of characters the kind allows, and validates what it cuts out of it (octets,
Luhn, digit counts, check digits). Matches never cross such stretches, so parsing
them one by one equals parsing the whole text.

Kinds email, ip, card and phone follow fixed patterns, leftmost and non-overlapping
per kind, with failing matches dropped and not tried again. These kinds are added:
url from its scheme, in any case; iban and ssn, all that stand between a cue and the end
of its paragraph and are valid; account, a number of 7 to 17 digits that an account cue
introduces; secret, the value that is assigned to a word for a credential.

Defined results: null and empty texts have no spans; rows with ids that repeat or are
null are scanned each; texts may be of any length; ``redact`` keeps every column and
only changes text (null stays null); overlapping spans of different kinds are all
reported, and redacted as one stretch that is named after the first; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account", "secret")
BASE_KINDS = KINDS[:4]
# The patterns of the base kinds.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "url": re.compile(r"(?i:https?|ftp)://[^\s<>\"'\\^`{|}]+"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    # Behind a cue: how a value is introduced, and the value.
    "account": re.compile(r"[ \t]*+(?i:(?:number|no\.?|nr\.?|num\.?|#)[ \t]*+)?+(?:[:#=][ \t]*+)?+([0-9](?:[ -]?[0-9]){6,16})(?![0-9])"),
    "secret": re.compile(r"[\"']?[ \t]*+(?:=>|[:=])[ \t]*+[\"']?([^\s\"',;<>]{6,}+)"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
DIGITS = frozenset("0123456789")
# Words that announce an identifier.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "konto", "kontonummer", "compte", "cuenta"),
    "secret": ("password", "passwd", "pwd", "secret", "secret_key", "api_key", "api-key", "apikey", "access_key", "access-key", "auth_token", "access_token", "token", "passwort", "contraseña"),
}
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
#: What an anchor starts: kind, characters of its stretch to the left and to the right.
ANCHORS = {
    "@": (("email", LOCAL | {"@"}, HOST | LOCAL | {"@"}),),
    "+": (("phone", frozenset(), frozenset("0123456789 ().-")),),
    "://": (("url", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), None),),
} | {cue: ((kind, frozenset(), None),) for kind, cues in CUES.items() for cue in cues}
SPACE = re.compile(r"\s")
#: As the pattern of the kind: a match can only begin where a number does, and takes whole numbers.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9][0-9 .-]*")
MOD97 = {c: str(i) for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
HOST_NAME = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == "card":
        digits = only_digits(found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(only_digits(found)) <= 15
    if kind == "iban":
        code = found.replace(" ", "")
        return 15 <= len(code) <= 34 and int("".join(MOD97[c] for c in code[4:] + code[:4])) % 97 == 1
    if kind == "secret":
        return any(c in DIGITS for c in found) and any(c.isalpha() for c in found)
    if kind == "ssn":
        return found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
    return True


def shorter(kind: str, m: re.Match) -> Iterator[int]:
    """Where a match may end: an IBAN also before groups that only follow it."""
    yield m.end()
    if kind == "iban":
        for k in range(m.end() - 1, m.start() + 14, -1):
            if m.string[k] == " ":
                yield k


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue in (*ANCHORS, *sorted(DIGITS)):
        a.add_word(cue, cue)
    a.make_automaton()
    return a


_automaton: list[ahocorasick.Automaton] = []


def folded(text: str) -> str:
    """Lower case of the same length, so that cues are found in any case."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    if not text:
        return []
    if not _automaton:
        _automaton.append(automaton())
    done = dict.fromkeys(KINDS, 0)  # up to here the kind's stretches are parsed
    digits_done = 0
    found: list[tuple[int, int, int]] = []

    def parse(kind: str, lo: int, hi: int) -> None:
        for m in (ADDRESS if kind == "ip" else PATTERNS[kind]).finditer(text, lo, hi):
            if valid(kind, m[0]):
                found.append((m.start(), KINDS.index(kind), m.end()))

    def parse_emails(lo: int, hi: int) -> None:
        """One stretch with at-signs: what stands before each one from ``lo`` on, and the host behind it."""
        at = text.find("@", lo, hi)
        while at >= 0:
            host = HOST_NAME.match(text, at + 1, hi) if at > lo else None
            if host:
                found.append((lo, KINDS.index("email"), host.end()))
            lo = host.end() if host else at + 1
            at = text.find("@", lo, hi)

    for last, cue in _automaton[0].iter(folded(text)):
        if cue in DIGITS:
            if last < digits_done:
                continue
            hi = digits_done = NUMBER.match(text, last).end()
            stretch = text[last:hi]
            if stretch.count(".") >= 3:
                parse("ip", last, hi)
            if len(stretch) >= 12:
                parse("card", last, hi)
            continue
        for kind, left, right in ANCHORS[cue]:
            lo, hi = last - len(cue) + 1, last + 1
            if lo < done[kind]:
                continue
            while lo > done[kind] and text[lo - 1] in left:
                lo -= 1
            if right is not None:
                while hi < len(text) and text[hi] in right:
                    hi += 1
                if kind == "phone" and hi - lo < 3:
                    continue
                if kind == "email":
                    parse_emails(lo, hi)
                else:
                    parse(kind, lo, hi)
            elif kind == "url":
                end = SPACE.search(text, hi)
                hi = end.start() if end else len(text)
                parse(kind, lo, hi)
            elif kind in ("account", "secret"):
                if m := PATTERNS[kind].match(text, hi):
                    hi = m.end()
                    if valid(kind, m[1]):
                        found.append((m.start(1), KINDS.index(kind), m.end(1)))
            else:
                end = PARAGRAPH.search(text, hi)
                end_at = end.start() if end else len(text)
                while m := PATTERNS[kind].search(text, hi, end_at):
                    for stop in shorter(kind, m):
                        if valid(kind, text[m.start() : stop]):
                            found.append((m.start(), KINDS.index(kind), stop))
                            hi = stop
                            break
                    else:
                        hi = m.start() + 1
                hi = end_at
            done[kind] = hi
    return [(KINDS[k], a, b) for a, k, b in sorted(set(found))]


def written_out(some: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in some)


FOUND_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                own = spans(text.as_py())
                base = [x for x in own if x[0] in BASE_KINDS]
                rows.append((*(sum(x[0] == k for x in base) for k in BASE_KINDS), hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(own)))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds))], [x.split()[0] for x in FOUND_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND_SCHEMA)


def redacted(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by its kind in brackets."""
    out, at, end = [], 0, 0
    for kind, a, b in spans(text):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
            end = b
        at = end = max(end, b)
    return text if not out else "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns and rows stay."""
    at = docs.columns.index("text")
    # Names with dots and the like can't be looked up within mapInArrow, so columns go through it by number.
    rows = docs.withColumn("text", F.col("text").cast("string"))
    plain = rows.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, f"c{at}", pa.array([redacted(t.as_py()) for t in batch.column(at)], pa.string()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
