"""Personal data replaced by surrogates.

Detected: e-mail addresses, phone numbers, payment cards and other long digit
runs, IP (4 and 6) and hardware addresses, social security numbers, bank
accounts, passports and dates of birth that are called so, access keys, assigned
or told secrets, and names after honorifics, after words that announce a name,
or with a known given name.  A name without any of these is not detected.

Surrogates come from a keyed permutation of the strings of the same format
(cycle-walking Feistel network), so they keep type, length, case, separators,
script and check digits, and different originals never share one: distinctness
and coreference hold across a corpus with nothing shared between tasks.

Names are replaced part by part, whatever else the text holds.  A known given
name becomes another of the same gender and script, by a permutation of their
list; any other word becomes another string of the same letters' kinds that is
no known given name, by a permutation that moves every word.  A given name that
is not known becomes a known one of its gender, a hyphen and such a string, so
different names of a kind never share a surrogate, in a text or across texts.
A known given name's surrogate may be the name of somebody else in the text,
who has another surrogate then.  For the other kinds a text's surrogates are
checked against its originals, and a taken one is drawn again.

Defined results: null texts stay null; texts without entities come back as they
are; equal rows are replaced alike; other columns are untouched, but n_chars
follows the new text where the table has it.  An empty table gives an empty one;
a text of any length is searched whole, by patterns that take linear time on
ordinary text; columns may have any names but must have doc_id and text once.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import common

#: Honorifics by the gender they tell (- for none).
HONORIFICS = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "-", "Prof": "-", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "г-н": "m", "г-жа": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
#: Given names by script and gender.
GIVEN = {
    ("LATIN", "f"): "Alice Amelia Anna Beatriz Camille Carmen Charlotte Clara Claudia Elena Elizabeth Emily Emma Greta Hannah Helen Ingrid Isabel Jane Jennifer Julia Karen Katharina Laura Linda Lucia Margaret Maria Marie Martha Mary Nora Olivia Patricia Paula Rachel Sarah Sofia Susan Ursula".split(),
    ("LATIN", "m"): "Adam Albert Andrew Antoine Anton Arthur Benjamin Carlos Charles Daniel David Diego Edward Felix Frank Georg Hans Henry Hugo Jack Jacques James Javier Jean John Jonas Jorge Karl Klaus Lucas Luis Manuel Martin Matthew Michael Otto Pablo Paul Pedro Peter Pierre Richard Robert Thomas William".split(),
    ("CYRILLIC", "f"): "Анна Вера Дарья Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("CYRILLIC", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("GREEK", "f"): "Αγγελική Αικατερίνη Βασιλική Ελένη Ευαγγελία Ιωάννα Μαρία Σοφία".split(),
    ("GREEK", "m"): "Αλέξανδρος Βασίλης Γεώργιος Δημήτρης Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
_WORDS = re.compile(r"\w+")
_UPPER_WORD = r"[^\W\d_a-zà-öø-ÿа-яёα-ω][\w'’-]*"
_NAMED = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, HONORIFICS)) + rf")(\.?[ \t]+)({_UPPER_WORD}(?:[ \t]{_UPPER_WORD}){{0,2}})")
_GIVEN = re.compile(r"(?<!\w)(" + "|".join(GENDER) + rf")[ \t]({_UPPER_WORD}(?:[ \t]{_UPPER_WORD})?)")
_EMAIL = re.compile(r"[\w.%+-]*[\w%+-]@[\w-]+(?:\.[\w-]+)+")
_RUN = re.compile(r"[0-9][0-9().\- ]{5,}[0-9]")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\d.-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-])|\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+(?!1)\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]))"
    r"|(?P<card>(?<![\d-])\d{4}([ -])\d{4}\5\d{4}\5\d{4}(?![\d-])|(?<!\d)\d{13,19}(?!\d))"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Characters of an account by country.
_IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 "
    "LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{30,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AIza", "sk-", "xox")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s*[=:]\s*[\"']?([^\s\"'<>,;]{6,})")
_TOLD = re.compile(r"(?<!\w)(?:[Pp]ass(?:word|phrase|code)|PASSWORD|PIN|pin)\s+is\s+[\"']?([^\s\"'<>,;()]*\d[^\s\"'<>,;()]*)")
_IP6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])")
_MAC = re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![\w:-])")
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
_DATE = rf"\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}\.? (?:{_MONTH}) \d{{4}}|(?:{_MONTH}) \d{{1,2}}, \d{{4}}"
_BORN = re.compile(rf"(?<!\w)(?:[Bb]orn(?: on)?|BORN(?: ON)?|[Dd]ate [Oo]f [Bb]irth|DATE OF BIRTH|DOB|dob|[Bb]irth ?date|[Bb]irthday)(?: is)?[ \t]*[:=]?[ \t]*({_DATE})(?!\w)")
_PASSPORT = re.compile(r"(?<!\w)(?:[Pp]assport|PASSPORT)(?:[ \t]+(?:[Nn]o|NO|[Nn]umber|NUMBER|[Nn]r)\.?)?(?: is)?[ \t]*[:=#]?[ \t]*([A-Z]{0,2}\d{6,9})(?!\w)")
#: What a full name follows.
_CUED = re.compile(rf"(?<!\w)(?:[Mm]y name is|[Nn]ame is|[Nn]ame:|[Cc]ontact:|[Aa]ttn:|[Aa]uthor:|[Pp]atient:|[Cc]ustomer:|[Ee]mployee:|[Ss]igned by|[Rr]egards,|[Ss]incerely,)[ \t]*\n?[ \t]*({_UPPER_WORD}(?:[ \t]{_UPPER_WORD}){{1,2}})")
_CUES = ("ame is", "ame:", "ontact:", "ttn:", "uthor:", "atient:", "ustomer:", "mployee:", "igned by", "egards,", "incerely,")
#: The days that dates of birth are moved among.
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2029, 12, 31).toordinal()


class Surrogates:
    """Keyed replacements; the same key gives the same ones anywhere."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def draw(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), key=self.key, digest_size=8).digest(), "big")

    def permute(self, n: int, size: int, *tweak: object) -> int:
        """The place of n under a permutation of range(size) that the tweak picks."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while size > 1:
            a, b = divmod(n, 1 << half)
            for r in range(6):
                wide = b"".join(hashlib.blake2b(repr((tweak, half, r, b, k)).encode(), key=self.key).digest() for k in range(half // 512 + 1))
                a, b = b, a ^ (int.from_bytes(wide, "big") & ((1 << half) - 1))
            n = (a << half) | b
            if n < size:
                break
        return n

    def restore(self, n: int, size: int, *tweak: object) -> int:
        """The number whose place under permute is n."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while size > 1:
            a, b = divmod(n, 1 << half)
            for r in reversed(range(6)):
                wide = b"".join(hashlib.blake2b(repr((tweak, half, r, a, k)).encode(), key=self.key).digest() for k in range(half // 512 + 1))
                a, b = b ^ (int.from_bytes(wide, "big") & ((1 << half) - 1)), a
            n = (a << half) | b
            if n < size:
                break
        return n

    def move(self, n: int, size: int, *tweak: object) -> int:
        """The next of n on a keyed round through range(size): a permutation that leaves no number (but one alone) in its place."""
        return self.restore((self.permute(n, size, *tweak) + 1) % size, size, *tweak)

    def like(self, text: str, kind: str, turn: int = 0, hexadecimal: bool = False, moved: bool = False) -> str:
        """Another string with letters, digits and signs where this one has them."""
        pools = [_pool(c, hexadecimal) for c in text]
        n, size = 0, 1
        for c, pool in zip(text, pools):
            if pool:
                n, size = n * len(pool) + pool.index(c), size * len(pool)
        n = (self.move if moved else self.permute)(n, size, kind, turn, "".join(p[:1] or c for c, p in zip(text, pools)))
        out = []
        for c, pool in zip(reversed(text), reversed(pools)):
            if pool:
                n, k = divmod(n, len(pool))
                c = pool[k]
            out.append(c)
        return "".join(reversed(out))

    # one method for each kind; turn > 0 asks for another choice

    def email(self, text: str, turn: int) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        if "example" not in labels:  # reserved names tell nobody
            labels[:-1] = [self.like(x, "domain") for x in labels[:-1]]
        return self.like(local, "email", turn) + "@" + ".".join(labels)

    def ip(self, text: str, turn: int) -> str:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return self.like(text, "ip", turn)
        n, kept = int.from_bytes(bytes(octets), "big"), _network(octets)
        while True:
            n = self.permute(n & ((1 << (32 - kept)) - 1), 1 << (32 - kept), "ip", kept, turn) | (n >> (32 - kept) << (32 - kept))
            out = list(n.to_bytes(4, "big"))
            if _network(out) == kept and (kept or 0 < out[0] < 224):
                return ".".join(map(str, out))
            if not kept and not 0 < octets[0] < 224:
                return ".".join(map(str, out))

    def card(self, text: str, turn: int) -> str:
        digits = re.sub(r"\D", "", text)
        over = (int(digits[-1]) - _luhn(digits[:-1])) % 10
        body = digits[0] + self.like(digits[1:-1], "card", turn)
        return _laid_out(body + str((_luhn(body) + over) % 10), text)

    def phone(self, text: str, turn: int) -> str:
        digits = re.sub(r"\D", "", text)
        country = (digits[0] == "0") if not text.startswith("+") else 1 if digits[0] in "17" else 2
        rest = digits[country:]
        marks = "".join(("2" if d >= "2" else "0") if len(rest) == 10 and k in (0, 3) else "d" for k, d in enumerate(rest))
        pools = [{"2": "23456789", "0": "01", "d": "0123456789"}[m] for m in marks]
        n, size = 0, 1
        for d, pool in zip(rest, pools):
            n, size = n * len(pool) + pool.index(d), size * len(pool)
        n, out = self.permute(n, size, "phone", turn, marks, digits[:country]), ""
        for pool in reversed(pools):
            n, k = divmod(n, len(pool))
            out = pool[k] + out
        return _laid_out(digits[:country] + out, text)

    def ssn(self, text: str, turn: int) -> str:
        return self.like(text, "ssn", turn)

    def ipv6(self, text: str, turn: int) -> str:
        return self.like(text, "ipv6", turn, hexadecimal=True)

    def mac(self, text: str, turn: int) -> str:
        return self.like(text, "mac", turn, hexadecimal=True)

    def passport(self, text: str, turn: int) -> str:
        return self.like(text, "passport", turn)

    def born(self, text: str, turn: int) -> str:
        """Another day in the same notation; a day has one surrogate in whichever notation."""
        parts = re.findall(r"\d+|[A-Za-z]+", text)
        month = next((k for k, x in enumerate(parts) if x.isalpha()), None)
        year = 0 if len(parts[0]) == 4 else 2
        if month is None:
            first, second = ((1, 2) if year == 0 else (0, 1))
            # year-month-day; else day before month, but with slashes only if it can't be a month
            month = 1 if year == 0 else 0 if "/" in text and int(parts[0]) <= 12 or int(parts[1]) > 12 else 1
            day = first + second - month
        else:
            day = 3 - year - month
        number = int(parts[month]) if parts[month].isdigit() else next(k for k, m in enumerate(MONTHS, 1) if m.startswith(parts[month]))
        try:
            at = datetime.date(int(parts[year]), number, int(parts[day])).toordinal()
        except ValueError:
            return self.like(text, "born", turn)
        if not _FIRST_DAY <= at <= _LAST_DAY:
            return self.like(text, "born", turn)
        new = datetime.date.fromordinal(_FIRST_DAY + self.move(at - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "born", turn))
        name, numbers = MONTHS[new.month - 1], [x for k, x in enumerate(parts) if k != year and x.isdigit()]
        wide = 2 if any(x[0] == "0" for x in numbers) or [len(x) for x in numbers] == [2, 2] else 1
        out = {year: str(new.year), day: f"{new.day:0{wide}d}", month: f"{new.month:0{wide}d}" if parts[month].isdigit() else name if parts[month] in MONTHS else name[:3]}
        rest = iter(range(3))
        return re.sub(r"\d+|[A-Za-z]+", lambda m: out[next(rest)], text)

    def iban(self, text: str, turn: int) -> str:
        plain = text.replace(" ", "")
        body = self.like(plain[4:], "iban", turn)
        over = (int(plain[2:4]) - _iban_check(plain[:2], plain[4:])) % 97
        check = (_iban_check(plain[:2], body) + over) % 97
        out, rest = "", iter(plain[:2] + f"{check:02d}" + body)
        for c in text:
            out += c if c == " " else next(rest)
        return out

    def secret(self, text: str, turn: int) -> str:
        for start in _KEY_STARTS:
            if text.startswith(start):
                return start + self.like(text[len(start) :], "secret", turn)
        return self.like(text, "secret", turn, hexadecimal=re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None)

    def given(self, text: str, turn: int, gender: str) -> str:
        if any(map(_known, text.split("-"))):
            return "-".join(self._known_given(x) if _known(x) else self._unknown_given(x, gender) for x in text.split("-"))
        return self._unknown_given(text, gender)

    def surname(self, text: str, turn: int) -> str:
        if any(map(_known, text.split("-"))):  # as a given name, so that the two kinds' surrogates stay apart
            return self.given(text, turn, "-")
        return "-".join(map(self._word, text.split("-")))

    def _known_given(self, text: str) -> str:
        names = next(x for x in GIVEN.values() if text.capitalize() in x)
        return _cased(names[self.move(names.index(text.capitalize()), len(names), "given", names[0])], text)

    def _unknown_given(self, text: str, gender: str) -> str:
        script = _script(text) if text else ""
        names = GIVEN.get((script, gender)) or GIVEN.get((script, "fm"[self.draw("gender", text.lower()) % 2]))
        own = "-".join(map(self._word, text.split("-")))
        return own if not names else _cased(names[self.draw("given", text.lower()) % len(names)], text) + "-" + own

    def _word(self, text: str) -> str:
        """Another word of the same letters' kinds that is no known given name; words that differ by case alone stay such."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        new = low
        while True:
            new = self.like(new, "name", moved=True)
            if not _known(new):
                break
        return "".join(n.upper() if c != d and len(n.upper()) == 1 else n for n, c, d in zip(new, text, low))


def _known(text: str) -> bool:
    return text.capitalize() in GENDER


_LETTERS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àâäéèêëîïôöùûüçñáíóúß"]
_POOLS = ["0123456789", *_LETTERS, *[x.upper() for x in _LETTERS[:3]]]
_POOL_OF = {c: p for p in _POOLS for c in p}


@functools.cache
def _rare_pool(c: str) -> str:
    """Other letters near c of the same case that are in no pool above."""
    block = [chr(k) for k in range(ord(c) & ~255, (ord(c) & ~255) + 256)] if c.isalpha() else []
    return "".join(x for x in block if x.isalpha() and x not in _POOL_OF and (x.islower(), x.isupper()) == (c.islower(), c.isupper()))


def _pool(c: str, hexadecimal: bool = False) -> str:
    pool = _POOL_OF.get(c) or _rare_pool(c)
    return pool[:6] if hexadecimal and c.isalpha() else pool


def _network(octets: list[int]) -> int:
    """Leading bits that stay: those of private and loopback networks."""
    if octets[0] in (10, 127):
        return 8
    if octets[:2] == [192, 168] or octets[:2] == [169, 254]:
        return 16
    return 12 if octets[0] == 172 and 16 <= octets[1] < 32 else 0


def _luhn(body: str) -> int:
    """The check digit that follows the digits."""
    total = sum(int(d) if k % 2 else (2 * int(d) - 9 * (d > "4")) for k, d in enumerate(reversed(body)))
    return -total % 10


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban_span(text: str, at: int) -> tuple[int, int] | None:
    """The account at the start of the text by its check digits: as long as its country has them, else the whole; what follows it may look like more of it."""
    ends = [m.end() for m in re.finditer(r"[A-Z0-9](?![A-Z0-9])", text) if len(text[: m.end()].replace(" ", "")) == _IBAN_LENGTH.get(text[:2])]
    for end in (*ends, len(text)):
        plain = text[:end].replace(" ", "")
        if int(plain[2:4]) == _iban_check(plain[:2], plain[4:]):
            return at, at + end
    return None


def _laid_out(digits: str, text: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _script(text: str) -> str:
    return unicodedata.name(text[0], "NONE").split()[0]


def _cased(name: str, text: str) -> str:
    if len(text) > 1 and text.isupper():
        return name.upper()
    return name.lower() if text.islower() else name[0].upper() + name[1:]


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, not overlapping."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    for run in _RUN.finditer(text):
        a, b = run.span()
        while a and text[a - 1] in "+(":
            a -= 1
        for m in _NUMBER.finditer(text, a, b):
            if m.lastgroup == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            found.append((*m.span(), m.lastgroup or "card"))
    at = 0
    while m := _IBAN.search(text, at):
        span = _iban_span(m[0], m.start())
        at = span[1] if span else m.start() + 1  # an account may start within what only looked like one
        if span:
            found.append((*span, "iban"))
    if any(s in text for s in _KEY_STARTS):
        found += [(*m.span(), "secret") for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in _ASSIGNED.finditer(text) if re.search(r"\d", m[1]) or "=" in m[0]]
    if ":" in text:
        # a digit and six characters at least: names in program text have two colons too
        found += [(*m.span(), "ipv6") for m in _IP6.finditer(text) if len(m[0]) > 5 and any(map(str.isdigit, m[0]))]
        found += [(*m.span(), "mac") for m in _MAC.finditer(text)]
    elif "-" in text:
        found += [(*m.span(), "mac") for m in _MAC.finditer(text)]
    if " is" in text or "\tis" in text or "\nis" in text:
        found += [(*m.span(1), "secret") for m in _TOLD.finditer(text) if len(m[1]) > 3]
    if "irth" in text or "orn" in text or "IRTH" in text or "ORN" in text or "DOB" in text or "dob" in text:
        found += [(*m.span(1), "born") for m in _BORN.finditer(text)]
    if "assport" in text or "PASSPORT" in text:
        found += [(*m.span(1), "passport") for m in _PASSPORT.finditer(text)]
    if any(c in text for c in _CUES):
        for m in _CUED.finditer(text):
            words = m[1].split()
            if words[0] not in HONORIFICS:
                found += _parts(m[1], m.start(1), "-")
    if any(h in text for h in HONORIFICS):  # gates reject no text that the patterns match
        for m in _NAMED.finditer(text):
            found += _parts(m[3], m.start(3), HONORIFICS[m[1]])
    words = set(_WORDS.findall(text))
    if not words.isdisjoint(GENDER):
        for m in _GIVEN.finditer(text):
            found += _parts(m[0], m.start(), GENDER[m[1]])
    named = {text[a:b]: k for a, b, k in found if k == "surname" or k.startswith("given")}
    if named:  # later mentions by one name alone
        found += [(*m.span(), named[m[0]]) for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, named)) + r")(?!\w)", text)]
    out, last = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= last:
            out.append((a, b, kind))
            last = b
    return out


def _parts(name: str, at: int, gender: str) -> Iterator[tuple[int, int, str]]:
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", name)]
    for k, (a, b, w) in enumerate(words):
        known = GENDER.get(w.capitalize())
        first = k < len(words) - 1
        yield at + a, at + b, f"given {known or gender}" if known or first else "surname"


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, original, surrogate) of each entity."""
    spans = entities(text)
    if not spans:
        return text, []
    originals = {text[a:b].casefold() for a, b, _ in spans}
    chosen: dict[tuple[str, str], str] = {}
    taken: dict[str, tuple[str, str]] = {}
    out, done, last = [], [], 0
    for a, b, kind in spans:
        own = text[a:b]
        what, _, gender = kind.partition(" ")
        key = (what, own)
        if key not in chosen:
            new = surrogates.given(own, 0, gender) if what == "given" else surrogates.surname(own, 0) if what == "surname" else ""
            for turn in range(0 if new else 64):  # names do not depend on what else is in the text
                new = getattr(surrogates, what)(own, turn)
                holder = taken.get(new.casefold())
                if new.casefold() not in originals and (holder is None or (holder[0], holder[1].casefold()) == (what, own.casefold())):
                    break
            chosen[key] = new
            taken[new.casefold()] = key
        out += [text[last:a], chosen[key]]
        done.append((kind, own, chosen[key]))
        last = b
    return "".join(out) + text[last:], done


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of docs with their texts replaced and all other columns as they are, but n_chars that of the new text."""
    common.bounded_batches(docs.sparkSession)
    arrow, names = common.arrow_schema(docs.schema), docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts = [t if t is None else replace(t, surrogates)[0] for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            if counted >= 0:
                old = batch.column(at).to_pylist()
                lengths = [n if t == o else len(t) for t, o, n in zip(texts, old, columns[counted].to_pylist())]
                columns[counted] = pa.array(lengths, type=arrow.field(counted).type)
            columns[at] = pa.array(texts, type=arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def found(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (with surrogates), n_entities and kinds (as kind:count, in order of kind) of each row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.StringType())])

    def run(batch: pa.RecordBatch) -> dict:
        surrogates, texts, counts, kinds = Surrogates(key), [], [], []
        for t in batch.column(1).to_pylist():
            new, done = (t, []) if t is None else replace(t, surrogates)
            names = [k.partition(" ")[0] for k, _, _ in done]
            texts.append(new)
            counts.append(len(done))
            kinds.append(",".join(f"{k}:{names.count(k)}" for k in sorted(set(names))))
        return {"doc_id": batch.column(0), "text": texts, "n_entities": counts, "kinds": kinds}

    return common.map_batches(docs.select("doc_id", "text"), run, schema)
