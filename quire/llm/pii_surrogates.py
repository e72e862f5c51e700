"""Personal data replaced by surrogates: keyed, of the same type, script and format, and distinct.

An entity is a type and a normal form (digits of a card, lower-cased address, a name part with its
gender and script). Its surrogate is drawn from a stream keyed by HMAC-SHA256 of key, type, normal form
and attempt, so it is the same wherever the entity occurs: coreference holds within and across
documents. Formats stay: digits for digits, letters for letters, separators, check digits, country
codes, top-level domains, private address ranges, case, script, and the gender of names.

Distinctness is checked over the whole corpus: of entities that draw the same surrogate the first by
(attempt, normal form) keeps it, and a surrogate that is itself an entity of the corpus is given up; the
others draw again until nothing changes. Names, email addresses and secrets grow with the attempt, so they
can't run out. Formats of fixed length can't grow: one with more than a part of ``SPARSE`` of its values in the corpus is dealt by
rank instead, each value the next one of its format in keyed order. That is one to one however many
there are, but there a surrogate may be an entity of the corpus (never the one it stands for). Only
entities with another attempt than 0 need a table; it joins the rows that hold them. An entity found in
a third of all rows is one row after the partial distinct.

Names are found by a title, or as a known given name before a surname that is no common word; names
found in a text are then replaced wherever they stand alone in that text, in capitals too. What has
neither a title nor one of the given names beside it is not found, so this finds fewer names than a
trained tagger would. Streets are found by a house number and a word for a street.

Defined results: a null text stays null and has no entities; texts without entities are unchanged to
the byte; very long texts are searched whole; rows that repeat are treated alike; ties between entities
that draw the same surrogate go by attempt and normal form; numbers count as the same in any script's digits, octets
with or without leading zeros; one punctuation mark repeated, such as the line of a form after
"Password:", is a blank and no secret; a ``draw`` passed in that finds no free surrogate in ``MOST_ATTEMPTS``
draws raises; an empty table gives an empty result; other columns are ignored by
``surrogates`` and carried unchanged by ``pseudonymised``.
"""

from __future__ import annotations

import hmac
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import text_or_empty, written

KEY = b"surrogates/1"
MOST_ATTEMPTS = 64
#: The attempt of entities whose format is dealt by rank.
DEALT = -1
#: Values of a fixed format for each of its entities; with fewer it is dealt by rank.
SPARSE = 8
#: Rows with later attempts up to this number may be broadcast; with more, a shuffle joins them.
FEW_ROWS = 200_000

# Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Emma Sophie Clara Elena Sarah Marie Lucia Carmen Isabel Claire Camille Helga Ingrid Jane Mary Linda Susan Emily Olivia Nina Paula Ada Alice Barbara Charlotte Elizabeth Heike Helen Karen Katharina Margaret Monika Patricia Petra Rachel Sabine Teresa Ursula".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Peter Paul Hans Karl Stefan Jürgen Pierre Jean Louis Antoine Carlos Miguel Pablo Diego José Daniel Martin Andrew Simon Victor Charles Christopher Francisco Frank George Henry Javier Klaus Kevin Ludwig Luis Matthew Richard Steven Uwe William Wolfgang".split(),
    ("n", "latin"): "Alex Chris Dominique Jo Kim Robin Sam Sascha".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Βασιλική Γεωργία Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παναγιώτης Σπύρος Πέτρος".split(),
}
for _script in ("cyrillic", "greek"):
    GIVEN["n", _script] = GIVEN["f", _script] + GIVEN["m", _script]
# Titles by gender.
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Srta Госпожа Κυρία".split(),
    "m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Господин Κύριος".split(),
    "n": "Dr Doctor Prof Professor Docteur Доктор Профессор".split(),
}
# Words that are no surnames when they follow a given name in capitals.
NO_SURNAMES = frozenset("a an and are as at be but by can could did do does for from had has have he her his if in is it its may might must not of on or said say says she should so that the then they this to was were what when where who will with would street road avenue lane und der die das ist war hat et le la les est y el los las es".split())
# Words of streets that stay in a surrogate.
STREETS = frozenset("street st road rd avenue ave lane ln drive dr boulevard blvd square court rue place calle avenida plaza de du des del la le les los las".split())
STREET_ENDS = ("straße", "strasse", "allee", "gasse", "platz", "weg")
# Syllables of made-up surnames by script.
SYLLABLES = {
    "latin": "bar bel bor cal cor dan del dor fal fen gar gil hal har hel jor kal ken kor lan lin lor mal mar mel mor nal nor pal per ral ren ros sal sel sor tal ten tor val ven vor wal wen win zel".split(),
    "cyrillic": "бар бел бор вал вер гор гар дан дор зар зим кал кор лан лев мал мор нил нор пал пет рад род сав сел тар тим фед хар чер шар".split(),
    "greek": "βαλ βερ γαρ δαλ δορ ζαν θαλ καλ κορ λαν μαν μορ ναλ παλ περ ραν σαλ σορ ταλ φαλ χαρ".split(),
}
SURNAME_ENDS = {("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов", ("f", "greek"): "ίδου", ("m", "greek"): "ίδης"}

_GENDER = {name.lower(): gender for (gender, script), names in GIVEN.items() for name in names if gender != "n" or script == "latin"}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ]"
_NAME = rf"{_CAPITAL}[^\W\d_]+(?:-{_CAPITAL}[^\W\d_]+)?"
_TITLED = re.compile(rf"\b(?P<title>{'|'.join(sorted((t for v in TITLES.values() for t in v), key=len, reverse=True))})\.?\s(?P<one>{_NAME})(?:\s(?P<two>{_NAME}))?")
_NAMED = re.compile(rf"\b(?P<one>{'|'.join(n for v in GIVEN.values() for n in v)})\s(?P<two>{_NAME})")
_SURNAME_AGAIN = 3  # letters that a name must have to be replaced where it stands alone

_PATTERNS = [
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_.~-]{6,})")),
    ("secret", re.compile(r"\b(?P<value>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])")),
    ("email", re.compile(r"(?<![\w.+-])(?P<value>[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")),
    ("iban", re.compile(r"\b(?P<value>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("card", re.compile(r"(?<![\w.-])(?P<value>\d(?:[ -]?\d){12,18})(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?P<value>\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\2\d{4})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])(?P<value>\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("street", re.compile(r"(?<![\w.,-])(?P<value>\d{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Square|Court))\b")),
    ("street", re.compile(rf"\b(?P<value>[A-ZÄÖÜ][a-zäöüß]+(?:{'|'.join(STREET_ENDS)}) \d{{1,4}}[a-z]?)\b")),
    ("street", re.compile(r"(?<![\w.,-])(?P<value>\d{1,4},? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la|le|les) )*[A-ZÉÈ][a-zéèêàçîôû]+)\b")),
    ("street", re.compile(r"\b(?P<value>(?:Calle|Avenida|Plaza) (?:(?:de|del|la|los|las) )*[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+,? \d{1,4})\b")),
    ("ip", re.compile(r"(?<![\w.])(?P<value>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)")),
]
_DIGIT_KINDS = ("card", "phone", "ssn")
_MAY_HOLD = re.compile(r"[@\d]|(?i:passw|pwd|secret|token|key)")

#: A span of a text: start, end, type, normal form.
Span = tuple[int, int, str, str]
Draw = Callable[[str, str, int], str]


@lru_cache(maxsize=1)
def _names():
    """Finds any given name or title in a text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in {n for v in (*GIVEN.values(), *TITLES.values()) for n in v}:
        found.add_word(name, None)
    found.make_automaton()
    return found


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _normal(kind: str, value: str) -> str | None:
    """The normal form of a match, None if a check digit says it is no entity."""
    if kind not in ("email", "secret"):
        value = "".join(str(int(x)) if x.isdecimal() else x for x in value)
    if kind in _DIGIT_KINDS:
        digits = re.sub(r"\D", "", value)
        if kind == "card" and not luhn(digits):
            return None
        if kind == "phone":
            country = re.match(r"\+(\d{1,3})(?!\d)", value)
            return f"{country[1] if country else ''}+{digits[len(country[1]) if country else 0:]}" if 7 <= len(digits) <= 15 else None
        return digits
    if kind == "iban":
        plain = value.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and iban_rest(plain) == 1 else None
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "secret" and len(set(value)) == 1 and not value[0].isalnum():
        return None
    return value.lower() if kind in ("email", "street") else value


def _name_spans(text: str) -> Iterator[Span]:
    alone: dict[str, tuple[str, str]] = {}

    def named(match: re.Match, group: str, part: str, gender: str) -> Span:
        word = match[group]
        normal = f"{gender}/{script_of(word)}/{word.lower()}"
        if len(word) >= _SURNAME_AGAIN:
            for form in (word, word.upper()):
                alone.setdefault(form, (part, normal))
        return (*match.span(group), part, normal)

    for match in _TITLED.finditer(text):
        gender = next(g for g, titles in TITLES.items() if match["title"] in titles)
        if gender == "n":
            gender = _GENDER.get(match["one"].lower(), "n")
        if match["two"] and match["two"].lower() not in NO_SURNAMES:
            yield named(match, "one", "given", gender)
            yield named(match, "two", "surname", gender)
        elif match["one"].lower() in _GENDER:
            yield named(match, "one", "given", gender)
        elif match["one"].lower() not in NO_SURNAMES:
            yield named(match, "one", "surname", gender)
    for match in _NAMED.finditer(text):
        gender = _GENDER[match["one"].lower()]
        if match["two"].lower() in NO_SURNAMES:
            continue
        yield named(match, "one", "given", gender)
        if match["two"].lower() not in _GENDER:
            yield named(match, "two", "surname", gender)
    if alone:
        for match in re.finditer(rf"\b(?:{'|'.join(map(re.escape, alone))})\b", text):
            yield (*match.span(), *alone[match[0]])


def spans(text: str) -> list[Span]:
    """The entities of a text, earliest first; of overlapping ones the first found stays."""
    found: list[Span] = []
    if _MAY_HOLD.search(text):
        for kind, pattern in _PATTERNS:
            for match in pattern.finditer(text):
                if (normal := _normal(kind, match["value"])) is not None:
                    found.append((*match.span("value"), kind, normal))
    if next(_names().iter(text), None):
        found += _name_spans(text)
    taken: list[Span] = []
    for span in sorted(found, key=lambda s: s[0]):
        if not taken or span[0] >= taken[-1][1]:
            taken.append(span)
    return taken


def _stream(key: bytes, kind: str, normal: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{normal}\0{attempt}\0{block}".encode(), "sha256")
        block += 1


def _pick(stream: Iterator[int], choices: str | list[str]) -> str:
    value = 0
    for _ in range(3):
        value = value << 8 | next(stream)
    return choices[value % len(choices)]


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS = "+/_.~-"


def _redrawn(stream: Iterator[int], text: str, classes: tuple[str, ...] = _CLASSES) -> str:
    return "".join(next((_pick(stream, c) for c in classes if x in c), x if ord(x) < 128 else _pick(stream, _CLASSES[1])) for x in text)


def _kept_octets(octets: list[str]) -> list[str]:
    return octets[: 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] else 0]


def _parts(kind: str, normal: str) -> tuple[str, str] | None:
    """What stays and what is redrawn of an entity whose format has a fixed length."""
    if kind == "card":
        return normal[0], normal[1:-1]
    if kind == "phone":
        country, _, rest = normal.partition("+")
        return country, rest
    if kind == "ssn":
        return "", normal
    if kind == "iban":
        return normal[:2], normal[4:]
    if kind == "ip":
        kept = _kept_octets(normal.split("."))
        return ".".join(kept), normal.split(".", len(kept))[-1]
    return None


def fixed_format(kind: str, normal: str) -> tuple[str | None, float | None]:
    """The format of an entity and the number of values it has; None where surrogates may grow.

    No draw leaves its format, so formats can be dealt apart from each other."""
    if (parts := _parts(kind, normal)) is None:
        return None, None
    if kind == "ip":
        return parts[0], 223.0 ** len(parts[1].split("."))
    shape = re.sub("[A-Z]", "A", re.sub(r"\d", "9", parts[1]))
    return f"{parts[0]}/{shape}", 10.0 ** shape.count("9") * 26.0 ** shape.count("A")


def _next_in_order(number: int, size: int, key: bytes, name: str) -> int:
    """The number after this one, all of range(size) in keyed order, the first after the last.

    The order is a Feistel network's, walked until it is back in range."""
    half = (max(size - 1, 2).bit_length() + 1) // 2
    low = (1 << half) - 1

    def mixed(i: int, x: int) -> int:
        return int.from_bytes(hmac.digest(key, f"{name}\0{size}\0{i}\0{x}".encode(), "sha256")) & low

    def place(x: int) -> int:
        while True:
            a, b = x >> half, x & low
            for i in range(8):
                a, b = b, a ^ mixed(i, b)
            if (x := a << half | b) < size:
                return x

    def at(x: int) -> int:
        while True:
            a, b = x >> half, x & low
            for i in reversed(range(8)):
                a, b = b ^ mixed(i, a), a
            if (x := a << half | b) < size:
                return x

    return at((place(number) + 1) % size)


def _dealt(text: str, key: bytes, name: str) -> str:
    """The digits and capitals after these, of the same shape, in keyed order."""
    classes = [next(c for c in _CLASSES if x in c) for x in text]
    number = 0
    for x, c in zip(text, classes, strict=True):
        number = number * len(c) + c.index(x)
    number = _next_in_order(number, math.prod(map(len, classes)), key, name)
    out = []
    for c in reversed(classes):
        number, i = divmod(number, len(c))
        out.append(c[i])
    return "".join(reversed(out))


def _ip(normal: str, octets: Callable[[list[str]], list[str]]) -> str:
    """An address of the same range; ``octets`` makes new ones of those that are not kept."""
    found = normal.split(".")
    kept = _kept_octets(found)
    while True:
        found = kept + octets(found[len(kept) :])
        if _kept_octets(found) == kept:
            return ".".join(found)


def _made_up(stream: Iterator[int], script: str, attempt: int) -> str:
    """A made-up name, a syllable longer for every four attempts."""
    return "".join(_pick(stream, SYLLABLES[script]) for _ in range(2 + attempt // 4))


def _street_word(stream: Iterator[int], word: str, attempt: int) -> str:
    """A word of a street's surrogate: words for streets stay, numbers and names are drawn."""
    if word in STREETS:
        return word
    if any(x.isdigit() for x in word):
        # The first digit is not zero, nor are letters beside the number redrawn.
        first = _pick(stream, _CLASSES[0][1:])
        return first + _redrawn(stream, word[1:], _CLASSES[:1])
    end = next((e for e in STREET_ENDS if word.endswith(e)), "")
    return _made_up(stream, "latin", attempt) + end


def draw(kind: str, normal: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate's normal form (names: as written in title case)."""
    stream = _stream(key, kind, normal, attempt)
    if (parts := _parts(kind, normal)) is not None:
        kept, free = parts
        name = f"{kind}\0{fixed_format(kind, normal)[0]}"
        if kind == "ip":

            def after(octets: list[str]) -> list[str]:
                number = _next_in_order(int.from_bytes(bytes(map(int, octets))), 256 ** len(octets), key, name)
                return [str(x) for x in number.to_bytes(len(octets))]

            return _ip(normal, after if attempt == DEALT else lambda octets: [str(1 + (next(stream) << 8 | next(stream)) % 223) for _ in octets])
        new = _dealt(free, key, name) if attempt == DEALT else _redrawn(stream, free, _CLASSES[:1] + _CLASSES[2:])
        if kind == "card":
            return next(kept + new + d for d in "0123456789" if luhn(kept + new + d))
        if kind == "iban":
            return f"{kept}{98 - iban_rest(kept + '00' + new):02d}{new}"
        return f"{kept}+{new}" if kind == "phone" else new
    if kind == "email":
        user, _, domain = normal.partition("@")
        labels = domain.split(".")
        # From the second redrawing on, a letter more for every two attempts.
        user = _redrawn(stream, user) + "".join(_pick(stream, _CLASSES[1]) for _ in range(attempt // 2))
        return ".".join([f"{user}@{_redrawn(stream, labels[0])}", *(_redrawn(stream, x) for x in labels[1:-1]), labels[-1]])
    if kind == "street":
        return " ".join(_street_word(stream, word, attempt) for word in normal.split(" "))
    if kind == "secret":
        fixed = re.match(r"AKIA|gh[pousr]_|sk-|", normal).end()
        free = normal[fixed:]
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", normal):
            classes = ("0123456789abcdef",) if normal == normal.lower() else ("0123456789ABCDEF",)
        else:
            classes = _CLASSES if any(x.isalnum() for x in free) else (_MARKS,)
        more = classes[0] if len(classes[0]) == 16 else _CLASSES[1]
        return normal[:fixed] + _redrawn(stream, free, classes) + "".join(_pick(stream, more) for _ in range(attempt // 2))
    gender, script, word = normal.split("/", 2)
    if kind == "given":
        # Known names are dealt among each other by rank of keyed hashes, so they can't collide.
        names = GIVEN[gender, script]
        known = [n.lower() for n in names]
        if attempt == 0 and word in known:
            ranked = sorted(known, key=lambda n: hmac.digest(key, n.encode(), "sha256"))
            return names[known.index(ranked[(ranked.index(word) + 1) % len(ranked)])]
        while (drawn := "-".join(_pick(stream, names) for _ in range(2 + attempt))).lower() == word:
            pass
        return drawn
    return _made_up(stream, script, attempt).capitalize() + SURNAME_ENDS.get((gender, script), "")


def rendered(kind: str, raw: str, surrogate: str) -> str:
    """A surrogate in the format of the text that it replaces."""
    if kind in _DIGIT_KINDS:
        digits = iter(surrogate.replace("+", ""))
        return "".join(next(digits) if x.isdigit() else x for x in raw)
    if kind == "iban":
        symbols = iter(surrogate)
        return "".join(x if x == " " else next(symbols) for x in raw)
    if kind == "street":
        return " ".join(new.capitalize() if old[:1].isupper() else new for old, new in zip(raw.split(" "), surrogate.split(" "), strict=True))
    if kind in ("given", "surname"):
        return surrogate.upper() if raw.isupper() and len(raw) > 1 else surrogate
    return "".join(s.upper() if x.isupper() else s for x, s in zip(raw, surrogate, strict=True)) if kind == "email" and len(raw) == len(surrogate) else surrogate


def replaced(text: str, attempts: dict[tuple[str, str], int], draw: Draw = draw) -> tuple[str, list[str]]:
    """The text with surrogates, and the types replaced."""
    out, at, kinds = [], 0, []
    for start, end, kind, normal in spans(text):
        out += [text[at:start], rendered(kind, text[start:end], draw(kind, normal, attempts.get((kind, normal), 0)))]
        kinds.append(kind)
        at = end
    return "".join([*out, text[at:]]), kinds


def _source(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the text), kind and normal form of each row's entities, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, same, text in zip(*(batch.column(c) for c in ("doc_id", "same", "text")), strict=True):
                rows += [(doc_id.as_py(), same.as_py(), *x) for x in {s[2:] for s in spans(text.as_py())}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "same", "kind", "normal"])

    return written(_source(docs).mapInArrow(run, "doc_id long, same long, kind string, normal string"), "pii-occurrences")


def later_attempts(found: DataFrame, draw: Draw = draw) -> DataFrame:
    """kind, normal and attempt of the entities that don't keep their first surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, normal, attempt = (batch.column(c).to_pylist() for c in ("kind", "normal", "attempt"))
            if max(attempt, default=0) > MOST_ATTEMPTS:
                raise ValueError("no free surrogate: the format has too few values")
            drawn = [draw(*x) for x in zip(kind, normal, attempt, strict=True)]
            # What the surrogate would be as an entity: names are compared without gender.
            plain = [(n.rpartition("/")[2] if k in ("given", "surname") else n) for k, n in zip(kind, normal, strict=True)]
            forms, rooms = zip(*map(fixed_format, kind, normal), strict=True) if kind else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d.lower() if k in ("given", "surname") else d for k, d in zip(kind, drawn, strict=True)], pa.string()), pa.array(plain, pa.string()), pa.array(forms, pa.string()), pa.array(rooms, pa.float64())], ["kind", "normal", "attempt", "drawn", "plain", "format", "room"])

    held = found.select("kind", "normal").distinct().withColumn("attempt", F.lit(0))
    columns = "kind string, normal string, attempt int, drawn string, plain string, format string, room double"
    now = written(held.mapInArrow(run, columns), "pii-drawn")
    # At most some thousands, as only addresses and phone numbers have formats of few values.
    crowded = now.where("format IS NOT NULL").groupBy("kind", "format").agg(F.count(F.lit(1)).alias("_n"), F.first("room").alias("_room"))
    crowded = written(crowded.where(F.col("_n") * SPARSE > F.col("_room")).select("kind", "format", F.lit(DEALT).alias("_dealt")), "pii-crowded")
    if not crowded.isEmpty():
        held = now.join(F.broadcast(crowded), ["kind", "format"], "left").select("kind", "normal", F.coalesce("_dealt", "attempt").alias("attempt"))
        now = written(held.mapInArrow(run, columns), "pii-drawn")
    while True:
        drawing = now.where(F.col("attempt") != DEALT)
        first = drawing.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "normal")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        real = now.select("kind", F.col("plain").alias("drawn")).distinct().withColumn("_real", F.lit(True))
        # Given names are dealt among each other, so a surrogate may be a given name of the corpus.
        taken = first.join(real.where("kind <> 'given'"), ["kind", "drawn"], "left").where("_real OR _n > 1")
        lost = drawing.join(taken, ["kind", "drawn"]).where(F.col("_real").isNotNull() | (F.struct("attempt", "normal") != F.col("_first"))).select("kind", "normal", F.lit(1).alias("_again"))
        lost = written(lost, "pii-lost")
        if lost.isEmpty():
            return now.where("attempt <> 0").select("kind", "normal", "attempt")
        held = now.select("kind", "normal", "attempt").join(lost, ["kind", "normal"], "left").select("kind", "normal", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt"))
        now = written(held.mapInArrow(run, columns), "pii-drawn")


def _with_attempts(rows: DataFrame, found: DataFrame, draw: Draw, few_rows: int) -> DataFrame:
    """Rows (with doc_id as ``_id``, hash as ``_same``) with ``_again``: their entities' attempts."""
    again = written(found.join(later_attempts(found, draw), ["kind", "normal"]), "pii-again")
    some = again.dropDuplicates(["doc_id", "same", "kind", "normal"]).groupBy(F.col("doc_id").alias("_d"), F.col("same").alias("_s")).agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("_again"))
    some = F.broadcast(some) if again.count() <= few_rows else some
    return rows.join(some, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_same") == F.col("_s")), "left").drop("_d", "_s")


def surrogates(docs: DataFrame, draw: Draw = draw, few_rows: int = FEW_ROWS) -> DataFrame:
    """doc_id, n_entities, kinds (distinct, in order) and the text with surrogates."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_or_empty()).alias("_same"), F.col("text").cast("string").alias("text"))
    joined = _with_attempts(rows, occurrences(docs), draw, few_rows).select("_id", "text", "_again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kinds, texts = [], [], []
            for text, again in zip(batch.column("text"), batch.column("_again"), strict=True):
                text, again = text.as_py(), again.as_py()
                attempts = {(x["kind"], x["normal"]): x["attempt"] for x in again or ()}
                new, found = replaced(text, attempts, draw) if text else (text, [])
                counts.append(len(found))
                kinds.append(",".join(sorted(set(found))))
                texts.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_entities", "kinds", "text"])

    return joined.mapInArrow(run, "doc_id long, n_entities long, kinds string, text string")


def pseudonymised(docs: DataFrame, draw: Draw = draw, few_rows: int = FEW_ROWS) -> DataFrame:
    """The documents with surrogates in their texts, all other columns unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    rows = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_same", F.xxhash64(text_or_empty()))
    rows = rows.toDF(*names, "_id", "_same")
    joined = _with_attempts(rows, occurrences(docs), draw, few_rows).select(*names, "_again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, again in zip(batch.column(at), batch.column(len(names)), strict=True):
                text, again = text.as_py(), again.as_py()
                attempts = {(x["kind"], x["normal"]): x["attempt"] for x in again or ()}
                texts.append(replaced(text, attempts, draw)[0] if text else text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return joined.mapInArrow(run, schema).toDF(*docs.columns)
