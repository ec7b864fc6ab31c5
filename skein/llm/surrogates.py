"""PII surrogates: detected entities get keyed, type-consistent replacements.

An entity is known by its canonical form (an e-mail address in lower case, the digits of a number, a name without case),
so all its mentions, however written, get the same surrogate in each mention's own format: digits for digits, letters of
the same script and case for letters, valid check digits for valid check digits, given names of the same gender. The key
decides which; without it nothing can be traced back.

Distinct entities must stay distinct, and no surrogate may be a real entity of the corpus. Both are checked by joins over
all entities; where a candidate fails, the entity tries its next one. Those few entities, and the documents that mention
them, are the only ones whose number of tries has to be looked up when texts are rewritten.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, stored, table

KEY = b"a key of your own goes here"
BROADCAST_ROWS = 100_000
#: After so many tries surrogates get longer by one symbol (a person's by a syllable), so there are always enough of them.
TRIES_A_LENGTH, TRIES_A_SYLLABLE = 8, 2

# Titles with the gender that they tell, and given names of each gender.
TITLES = {
    "male": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don"],
    "female": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña"],
    "any": ["Dr", "Prof"],
}
GIVEN = {
    "male": ["James", "John", "Robert", "Michael", "David", "William", "Thomas", "Peter", "Paul", "Hans", "Karl", "Jean", "Pierre", "Luis", "Carlos", "Juan"],
    "female": ["Mary", "Anna", "Emma", "Laura", "Sarah", "Julia", "Maria", "Claire", "Sophie", "Marie", "Ingrid", "Petra", "Carmen", "Elena", "Lucia", "Ana"],
}
SYLLABLES = ["ber", "dal", "fen", "gar", "hol", "kem", "lin", "mor", "nes", "pol", "ran", "sol", "tur", "val", "wen", "zel"]

_titles = "|".join(sorted({t for v in TITLES.values() for t in v}, key=lambda t: (-len(t), t)))
KEYWORDS = ("token", "secret", "passw", "key")
PREFIXES = ("AKIA", "ghp_", "sk-")
SECRET_PREFIX = re.compile(r"^(?:AKIA|ghp_|sk-)")

DIGIT_RUN = re.compile(r"\d+")
NUMBER = re.compile(
    r"(?P<IP>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<SSN>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<CARD>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<PHONE>(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w.-])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\d))"
)
LOCAL, DOMAIN = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*"), re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
ASSIGNED = re.compile(r"(?:token|secret|password|passwd|key)\s{0,2}[=:]\s{0,2}[\"']?(?P<SECRET>[A-Za-z0-9_/+\-]{12,})", re.IGNORECASE)
PREFIXED = re.compile(r"\b(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,})\b")
PERSON = regex.compile(rf"\b(?:{_titles})\.? (?:\p{{Lu}}[\p{{L}}'’-]+ ){{0,2}}\p{{Lu}}[\p{{L}}'’-]+")
TITLED = tuple(f"{t}{end}" for v in TITLES.values() for t in v for end in (" ", ". "))
ORDER = ["EMAIL", "SECRET", "IBAN", "IP", "SSN", "CARD", "PHONE", "PERSON"]
DIGITS = {"IP", "SSN", "CARD", "PHONE"}


def canonical(kind: str, mention: str) -> str:
    if kind == "IP":
        return ".".join(str(int(x)) for x in mention.split("."))
    if kind in DIGITS:
        return "".join(filter(str.isdecimal, mention))
    if kind == "IBAN":
        return mention.replace(" ", "")
    if kind == "SECRET":
        return mention
    if kind == "PERSON":  # with or without a dot after the title
        title, _, names = mention.partition(" ")
        mention = f"{title.rstrip('.')} {names}"
    return unicodedata.normalize("NFC", mention).casefold()


def replaceable(kind: str, mention: str) -> bool:
    """Whether a mention tells anything: a form's blank line or a row of dashes has no letter or digit to replace."""
    if kind == "EMAIL":
        mention = mention.rpartition(".")[0]
    elif kind == "SECRET":
        mention = SECRET_PREFIX.sub("", mention)
    return any(map(str.isalnum, mention))


def _mentions(text: str) -> Iterator[tuple[int, int, str]]:
    """All that look like an entity. Each pattern is tried only where what it cannot do without is found."""
    before, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        # Read backwards from the @: the pattern is the same both ways, and no part of a text is read twice.
        local = domain and LOCAL.match(text[before:at][::-1])
        if local:
            yield at - len(local.group()), domain.end(), "EMAIL"
        before, at = at + 1, text.find("@", at + 1)
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGNED.finditer(text):
            yield *m.span("SECRET"), "SECRET"
    if any(k in text for k in PREFIXES):
        for m in PREFIXED.finditer(text):
            yield *m.span(), "SECRET"
    for run in DIGIT_RUN.finditer(text):
        at = run.start()
        for begin in (at - 1, at) if at and text[at - 1] in "+(" else (at,):
            m = NUMBER.match(text, begin)
            if m:
                yield *m.span(), m.lastgroup
                break
        if at >= 2 and run.end() - at >= 2 and text[at - 2 : at].isupper() and not (at > 2 and text[at - 3].isalnum()) and (m := IBAN.match(text, at - 2)):
            yield *m.span(), "IBAN"
    if any(t in text for t in TITLED):
        for m in PERSON.finditer(text):
            yield *m.span(), "PERSON"


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) of each mention in a text, left to right; of overlapping ones the first, then
    the one whose type comes first in ORDER. Mentions that hold nothing replaceable are none."""
    out, end = [], 0
    for a, _, b, kind in sorted((a, ORDER.index(k), b, k) for a, b, k in _mentions(text or "")):
        if a >= end and replaceable(kind, text[a:b]):
            out.append((a, b, kind, canonical(kind, text[a:b])))
            end = b
    return out


class Stream:
    """Numbers that only the key, the entity and the try decide."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.left = key, f"{kind}\0{attempt}\0{entity}".encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


#: First and last letters of alphabets in which a letter has its case by place.
ALPHABETS = [("a", "z"), ("A", "Z"), ("α", "ω"), ("Α", "Ω"), ("а", "я"), ("А", "Я"), ("א", "ת"), ("ء", "ي"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "龥"), ("가", "힣")]


@lru_cache(4096)
def _peers(char: str) -> str:
    """For a letter outside ALPHABETS: the letters of its script and kind near it, itself among them; a to z for Latin ones
    and for those that stand alone. Case-folding leaves them all as they are, or none."""
    script, folded = unicodedata.name(char, "").split(" ")[0], char.casefold() == char
    near = map(chr, range(max(128, ord(char) - 128), min(ord(char) + 128, 0x110000)))
    same = [c for c in near if unicodedata.category(c) == unicodedata.category(char) and unicodedata.name(c, "").split(" ")[0] == script]
    same = [c for c in same if (c.casefold() == c) == folded and unicodedata.normalize("NFC", c) == c]
    if script == "LATIN" or len(same) < 2:
        return "abcdefghijklmnopqrstuvwxyz" if folded else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return "".join(same)


def like(char: str, stream: Stream) -> str:
    """A character of the same kind: a decimal digit, or a letter of the same script and case. Others stay."""
    if char.isdecimal():
        return str(stream.below(10)) if char.isascii() else chr(ord(char) - unicodedata.decimal(char) + stream.below(10))
    base = unicodedata.normalize("NFD", char)[0]
    for low, high in ALPHABETS:
        if low <= base <= high:
            while True:
                out = chr(ord(low) + stream.below(ord(high) - ord(low) + 1))
                if out.isalpha() and out.isupper() == char.isupper():
                    return out
    if char.isalpha():
        peers = _peers(char)
        return peers[stream.below(len(peers))]
    return char


def likes(text: str, more: int, stream: Stream) -> str:
    """like() for each character, and ``more`` letters or digits after them, like the last one there."""
    last = next((c for c in reversed(text) if c.isalpha() or c.isdecimal()), "a")
    return "".join(like(c, stream) for c in text + last * more)


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """The canonical form of an entity's surrogate. Later tries are longer: no type ever runs out of forms."""
    s, more = Stream(key, kind, entity, attempt), attempt // TRIES_A_LENGTH
    if kind == "IP":
        return ".".join(str(1 + s.below(254)) for _ in range(4 + more))
    if kind == "CARD":
        out = entity[0] + "".join(str(s.below(10)) for _ in range(len(entity) - 1 + more))
        if luhn(entity):
            out = next(x for x in (out[:-1] + str(d) for d in range(10)) if luhn(x))
        return out
    if kind == "PHONE":  # the first digit, the country's or area's, stays
        return entity[0] + "".join(str(s.below(10)) for _ in range(len(entity) - 1 + more))
    if kind == "SSN":
        return f"{900 + s.below(100)}{s.below(10**6):06d}" + "".join(str(s.below(10)) for _ in range(more))  # numbers from 900 on are not given out
    if kind == "IBAN":
        body = likes(entity[4:], more, s)
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    if kind == "SECRET":
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity)
        if hexadecimal:
            digits = "0123456789abcdef" if entity == entity.lower() else "0123456789ABCDEF"
            return "".join(digits[s.below(16)] for _ in range(len(entity) + more))
        prefix = SECRET_PREFIX.match(entity)
        return (prefix.group() if prefix else "") + likes(entity[prefix.end() if prefix else 0 :], more, s)
    if kind == "EMAIL":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return likes(local, more, s) + "@" + "".join(like(c, s) for c in host) + "." + top
    more = attempt // TRIES_A_SYLLABLE
    title, *names = entity.split(" ")
    gender = gender_of(title, names)
    out = [GIVEN[gender][s.below(16)].casefold() for _ in names[:-1]]
    latin = all(c.isascii() or "LATIN" in unicodedata.name(c, "") for c in names[-1] if c.isalpha())
    last = "".join(SYLLABLES[s.below(16)] for _ in range(3 + more)) if latin else likes(names[-1], more, s)
    return " ".join([title, *out, last])


def gender_of(title: str, names: list[str]) -> str:
    for gender in ("male", "female"):
        if title in {t.casefold() for t in TITLES[gender]}:
            return gender
    for gender in ("male", "female"):
        if names[:-1] and names[0] in {g.casefold() for g in GIVEN[gender]}:
            return gender
    return "female" if len("".join(names)) % 2 else "male"


def formatted(kind: str, mention: str, new: str) -> str:
    """The surrogate written as the mention was; what it has more than the mention follows at the end."""
    if kind in DIGITS - {"IP"}:
        digits = iter(new)
        return "".join([*(next(digits) if c.isdecimal() else c for c in mention), *digits])
    if kind == "IBAN":
        letters = iter(new)
        return "".join([*(c if c == " " else next(letters) for c in mention), *letters])
    if kind == "EMAIL":
        if len(new) != len(mention):
            return new.upper() if mention.isupper() else new
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new, strict=True))
    if kind == "PERSON":
        old, fresh = mention.split(" "), new.split(" ")
        return " ".join([old[0], *(n.upper() if o.isupper() and len(o) > 1 else n.capitalize() for o, n in zip(old[1:], fresh[1:], strict=True))])
    return new


def rewrite(text: str, key: bytes, tries: dict[tuple[str, str], int]) -> str:
    out, at = [], 0
    for begin, end, kind, entity in entities(text):
        out += [text[at:begin], formatted(kind, text[begin:end], surrogate(kind, entity, tries.get((kind, entity), 0), key))]
        at = end
    return "".join([*out, text[at:]])


def _surrogates(key: bytes):
    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*x, key) for x in zip(kind, entity, attempt, strict=True)], dtype=object)

    return draw


def tried(known: DataFrame, key: bytes = KEY) -> DataFrame:
    """known: distinct (kind, entity). The entities whose first surrogate can't be theirs: (kind, entity, attempt).

    Of entities that draw one surrogate the first keeps it; one that draws a real entity's form keeps nothing. The
    others draw again, and no later draw may meet a surrogate that is taken. The rounds end when none is left: as later
    draws are from more and more forms, they always do.
    """
    draw = _surrogates(key)
    drawn = stored(known.withColumn("attempt", F.lit(0)).withColumn("new", draw("kind", "entity", F.lit(0))), "surrogates")
    taken, left, moved = drawn, drawn, None
    for attempt in count(1):
        real = left.join(known.select("kind", F.col("entity").alias("new")), ["kind", "new"], "left_semi").select("kind", "entity")
        clash = left.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1").select("kind", "new", "first")
        lost = left.join(clash, ["kind", "new"]).where(F.col("entity") != F.col("first")).select("kind", "entity")
        again = real.unionByName(lost)
        if moved is not None:  # draws of earlier rounds stand
            again = again.unionByName(left.join(taken.select("kind", "new"), ["kind", "new"], "left_semi").select("kind", "entity"))
        again = cut(again.distinct())
        if moved is not None:
            stands = cut(left.join(again, ["kind", "entity"], "left_anti"))
            moved, taken = cut(moved.unionByName(stands)), taken.unionByName(stands)
        else:
            moved, taken = left.limit(0), left.join(again, ["kind", "entity"], "left_anti")
        if again.isEmpty():
            return moved.select("kind", "entity", "attempt")
        left = cut(again.withColumn("attempt", F.lit(attempt)).withColumn("new", draw("kind", "entity", F.lit(attempt))))


def replace_pii(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Per row of docs: doc_id, text with surrogates, n_entities, kinds (sorted, comma-joined).

    Null texts stay null; texts without entities stay as they are. Repeated rows and null ids are told apart by the
    row's number. Other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text_col).alias("text"))

    @F.pandas_udf("array<struct<kind: string, entity: string>>")
    def mentioned(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "entity": e} for _, _, k, e in entities(t)] for t in texts], dtype=object)

    found = rows.select("row", mentioned("text").alias("m")).select("row", F.explode("m").alias("m")).select("row", "m.kind", "m.entity")
    found = stored(found, "mentions")
    moved = tried(cut(found.select("kind", "entity").distinct()), key)
    special = cut(found.distinct().join(moved, ["kind", "entity"]).groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("tries")))
    n = special.limit(BROADCAST_ROWS + 1).count()
    if n:
        rows = rows.join(F.broadcast(special) if n <= BROADCAST_ROWS else special, "row", "left")
    else:
        rows = rows.withColumn("tries", F.lit(None).cast("array<struct<kind: string, entity: string, attempt: int>>"))

    @F.pandas_udf("text string, n_entities long, kinds string")
    def rewritten(texts: pd.Series, tries: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, tries, strict=True):
            found = entities(text)
            known = {(x["kind"], x["entity"]): x["attempt"] for x in own} if own is not None else {}
            out.append((rewrite(text, key, known) if found else text, len(found), ",".join(sorted({x[2] for x in found}))))
        return pd.DataFrame(out, columns=["text", "n_entities", "kinds"])

    return rows.select("doc_id", rewritten("text", "tries").alias("r")).select("doc_id", "r.text", "r.n_entities", "r.kinds")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))
