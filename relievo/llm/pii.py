"""Personal data, also behind disguises, with spans in the source text.

Base kinds are found by their expressions in the text as it is.  Then transducers rewrite
the texts that look disguised: invisible characters go, homoglyphs and full-width forms
become ASCII, spelled digits become digits, at/dot disguises become ``@`` and ``.``.  Each
transducer keeps the places of what it rewrote, and places are mapped back through one
transducer after the other.  What the base expressions find in the rewritten text counts if
the source differs from what was found and no base span of that kind covers all of it.

A text with any sign of a disguise is rewritten whole, whatever its length.  Every expression
starts only where a run of its first characters starts, so time grows in proportion to the
text.  A text is read once where it lies; nothing is shuffled.

Defined cases: null text is empty and has no spans; repeated rows are each scanned; null
doc_id is kept; extra columns are ignored.  Spans count code points, end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
#: The base expressions.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same for one start a run: where a run of its first characters gives no match, none that starts later in the run does.
_EMAIL_HERE, _EMAIL_NEXT = (re.compile(before + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+") for before in ("", "(?<![A-Za-z0-9._%+-])"))
_IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_DIGIT = re.compile("[0-9]")

#: Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏѵҽΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυγɑɡıʟɩᴏᴄᴜᴠᴡᴢոսօհցզⲟⲥⲣᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ",
        "ABESIJKMHOPCTYXaesijopcyxdqwhlveABEZHIKMNOPTYXoavipuyagiliocuvwznuohgqocpABCDEHJKLMPRSTVWZ",
        strict=True,
    )
)
#: Soft hyphen, zero-width space and joiners, word joiner, byte order mark.
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
FULL_WIDTH = (chr(0xFF01), chr(0xFF5E))
DASHES = "".join(map(chr, (*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63)))
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def _plain_forms() -> dict[str, str]:
    """Every character beyond ASCII that stands for one of ASCII: digits of all scripts, and what compatibility forms make one character of an address."""
    found = {}
    for c in map(chr, range(0x80, 0x20000)):
        to, digit = unicodedata.normalize("NFKC", c), unicodedata.decimal(c, None)
        if digit is not None:
            found[c] = str(digit)
        elif len(to) == 1 and to.isascii() and (to.isalnum() or to in "@._%+-" or FULL_WIDTH[0] <= c <= FULL_WIDTH[1]):
            found[c] = to
    return found | LOOKALIKES | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(DASHES, "-") | dict.fromkeys(SPACES, " ")


PLAIN = _plain_forms()
#: Last labels after which an address with a spoken dot counts as one, whatever is before it.
LAST_LABELS = "com|org|net|edu|gov|info|io|co|eu|uk|us|de|fr|es|it|ch|nl|be|at"
#: Words of prose, which are no user or host before or after a spoken at, nor a last label; ends of file names.
PROSE = frozenset(
    """a about access again age all also am an and any anyone are as at available back bad based be been begin best better both but buy by call came check click come contact directly do down each early email end ends even event events ever
    every everyone find first for found free from get give go good great had has have he held help her here him his home host hosted how i if in info information into is it its join just know last late later least less like link listed live
    located look looked looking looks me meet meeting more most my night no not now of off on once one online only or order other our out over page please posted present published read register registered school see seen she shop sign site
    so some start started starts stay still stop store that the their them then there these they this those time to today together try two up us use very video view visit was watch we website well were what when where which who will with work
    working works would write writing yes you your""".split()
)
FILE_ENDS = frozenset("asp aspx avi bat bin bmp cfg class conf cpp css csv dat dll doc docx exe gif gz htm html ini jar java jpeg jpg js json jsp log md mov mp ogg pdf php png ppt pptx psd py rar rb rtf sql svg swf tar tgz tif tiff txt wav wmv xls xlsx xml yaml yml zip".split())
#: Spelled digits.
SPELLED = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0", "zéro": "0", "one": "1", "eins": "1", "un": "1", "uno": "1", "two": "2", "zwei": "2", "deux": "2", "dos": "2",
    "three": "3", "drei": "3", "trois": "3", "tres": "3", "four": "4", "vier": "4", "quatre": "4", "cuatro": "4", "five": "5", "fünf": "5", "cinq": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6", "seven": "7", "sieben": "7", "sept": "7", "siete": "7", "eight": "8", "acht": "8", "huit": "8", "ocho": "8", "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ \t-]*)?(?:{_WORD}|[0-9]+)(?:(?:[ \t]*[,-][ \t]*|[ \t]+)(?:{_WORD}|dot|punkt|point|punto|[0-9]+)){{3,}}(?!\w)", re.I)
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:{_WORD})(?:(?:[ \t]*[,-][ \t]*|[ \t]+)(?:{_WORD}|dot|punkt|point|punto|[0-9]+)){{3,}}(?!\w)", re.I)
_PART = re.compile(rf"(?P<digit>{_WORD})(?!\w)|(?P<dot>dot|punkt|point|punto)|(?P<plus>plus)|(?P<number>[0-9]+)|(?P<gap>[ \t,-]+)|.", re.I)
_BRACKETED = re.compile(r"[\[({<][ \t]*+(?:(?P<at>at|@)|(?P<dot>dot|punkt|point|punto|\.))[ \t]*+[\])}>][ \t]*+", re.I)
#: Words joined by dots and ats, real or spoken.
_CHAIN = re.compile(r"(?<![\w%+-])[\w%+-]++(?:(?: at | dot |[.@])[\w%+-]++)++", re.I)
_LINK, _LABEL = re.compile("( at | dot |[.@])", re.I), re.compile("[a-z]{2,24}", re.I)
_KNOWN = frozenset(LAST_LABELS.split("|"))
#: A spoken at before a real dot, in lower case: so the literal prefix is found fast.
_HALF = re.compile(r" at [\w-]+(?:(?: dot |\.)[\w-]+)*\.[a-z]{2}")
#: Characters of ``PLAIN``, and all of the plane beyond 16 bits: one range is matched much faster than a thousand characters.
_ODD = re.compile(f"[{''.join(re.escape(c) for c in PLAIN if c <= chr(0xFFFF))}{chr(0x10000)}-{chr(0x1FFFF)}]")
#: Dashes and blanks are signs of a disguise only before a digit or a spoken at or dot.
_LOOSE = frozenset(DASHES + SPACES)
_JOINED = re.compile(r"\w.(?:[0-9]|at\b|dot\b)", re.I)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[0::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in values[1::2]) % 10


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches lie inside runs of the expression's characters around an ``@``."""
    found, at = [], text.find("@")
    while at >= 0:
        lo, hi = at, at + 1
        while lo and text[lo - 1] in _EMAIL_CHARS:
            lo -= 1
        while hi < len(text) and text[hi] in _EMAIL_CHARS:
            hi += 1
        run, done = text[lo:hi], 0
        while m := _EMAIL_HERE.match(run, done) or _EMAIL_NEXT.search(run, done):
            found.append((lo + m.start(), lo + m.end()))
            done = m.end()
        at = text.find("@", hi)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every kind."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP_RUN.finditer(text) if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found)


class Tape:
    """A text under rewriting; ``edits`` has for each transducer the places it rewrote, in order: (from, to, source from, source to)."""

    def __init__(self, text: str):
        self.text: str = text
        self.edits: list[list[tuple[int, int, int, int]]] = []

    def rewrite(self, pattern: re.Pattern[str], put: Callable[[re.Match[str]], list[tuple[int, int, str]]]) -> None:
        """Replaces text[a:b] by the string, for each (a, b, string) that ``put`` gives for a match."""
        out, edits, done, at = [], [], 0, 0
        for m in pattern.finditer(self.text):
            for a, b, string in put(m):
                a = max(a, done)
                out += (self.text[done:a], string)
                at += a - done
                edits.append((at, at + len(string), a, b))
                at, done = at + len(string), b
        if edits:
            self.text = "".join(out) + self.text[done:]
            self.edits.append(edits)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source for which text[start:end] stands."""
        for edits in reversed(self.edits):
            start, end = _back(edits, start)[0], _back(edits, end - 1)[1]
        return start, end


def _back(edits: list[tuple[int, int, int, int]], place: int) -> tuple[int, int]:
    """The span before rewriting of the character at ``place``."""
    k = bisect_right(edits, place, key=lambda e: e[0]) - 1
    if k < 0:
        return place, place + 1
    first, last, a, b = edits[k]
    return (a, b) if place < last else (place - last + b, place - last + b + 1)


def _plain_character(m: re.Match[str]) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), PLAIN.get(m[0], m[0]))]


def _digits(m: re.Match[str]) -> list[tuple[int, int, str]]:
    if not _SPELLED_RUN.search(m[0]):
        return []
    found = []
    for p in _PART.finditer(m[0]):
        to = SPELLED.get(p[0].lower()) if p["digit"] else "." if p["dot"] else "+" if p["plus"] else "" if p["gap"] else p[0]
        if to != p[0]:
            found.append((m.start() + p.start(), m.start() + p.end(), to))
    return found


def _signs(m: re.Match[str]) -> list[tuple[int, int, str]]:
    start = m.start()
    while start and m.string[start - 1] in " \t":
        start -= 1
    return [(start, m.end(), "@" if m["at"] else ".")]


def _is_address(user: str, at: str, host: str, sep: str, label: str) -> bool:
    """Not prose like 'look at example.com' or 'at the dot on it'; ``user`` is the word before the at, ``host`` the one behind it."""
    low = label.lower()
    if sep == " dot " and low in _KNOWN:
        return True
    if low in PROSE - _KNOWN:
        return False
    return at == "@" or not (user.lower() in PROSE or host.lower() in PROSE or host.lower() == "www" or low in FILE_ENDS or sep == "." and label.istitle())


def _spoken(m: re.Match[str]) -> list[tuple[int, int, str]]:
    """Words (even places) and links (odd places) of a chain: the last at is that of an address, if any is."""
    parts = _LINK.split(m[0])
    ats = [k for k in range(1, len(parts), 2) if parts[k].lower() in (" at ", "@")]
    if not ats or ats[-1] + 3 >= len(parts) or not _LABEL.fullmatch(parts[-1]):
        return []
    at = ats[-1]
    if not _is_address(parts[at - 1], parts[at].lower(), parts[at + 1], parts[-2].lower(), parts[-1]):
        return []
    found, place = [], m.start()
    for k, part in enumerate(parts):
        if k % 2 and len(part) > 1 and (len(ats) == 1 or k > ats[-2]):
            found.append((place, place + len(part), "@" if k == at else "."))
        place += len(part)
    return found


def undisguise(text: str) -> Tape:
    """The transducers, one after the other."""
    tape = Tape(text)
    tape.rewrite(_ODD, _plain_character)
    tape.rewrite(_BRACKETED, _signs)
    tape.rewrite(_CHAIN, _spoken)
    tape.rewrite(_RUN, _digits)
    return tape


def _disguised(text: str) -> bool:
    """Whether there is any sign of a disguise."""
    if not text.isascii() and any(m[0] in PLAIN and (m[0] not in _LOOSE or m.start() and _JOINED.match(text, m.start() - 1)) for m in _ODD.finditer(text)):
        return True
    if any(b in text for b in "[({<") and _BRACKETED.search(text):
        return True
    low = text.lower()
    return " dot " in low or " at " in low and bool(_HALF.search(low)) or bool(_SPELLED_RUN.search(text))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what only the transducers show."""
    if not _disguised(text):
        return []
    tape, found = undisguise(text), []
    clear = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    for a, kind, b in base_spans(tape.text) if tape.edits else []:
        start, end = tape.source(a, b)
        before = bisect_right(clear[kind], start, key=lambda span: span[0]) - 1  # spans of a kind do not overlap
        if text[start:end] != tape.text[a:b] and not (before >= 0 and end <= clear[kind][before][1]):
            found.append((start, kind, end))
    return found


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("added", pa.bool_())]))
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py()
            base = base_spans(text)
            spans = [(*s, False) for s in base] + [(*s, True) for s in added_spans(text, base)]
            rows.append([{"start": a, "kind": KINDS[k], "end": b, "added": new} for a, k, b, new in sorted(set(spans))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of (start, kind, end, added), sorted; one row per row of ``docs``."""
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(_spans, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:long,kind:string,end:long,added:boolean>>")
