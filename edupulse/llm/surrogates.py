"""Personal data replaced by surrogates.

Found are e-mail addresses, telephone numbers, IPv4 addresses, payment cards, social security
numbers, account numbers (IBAN), secrets (long keys, and values named as tokens, keys or passwords) and names
after a title. An entity's surrogate is a keyed permutation of the strings of its kind and shape, over its
letters and digits, each within its own class (vowel, consonant, digit,
other letters of the same script and case), so that format, script and length stay. Kinds add what makes
them valid: addresses keep their network class, cards
their issuer digit and the (in)validity of their check digit, e-mails the top domain, telephones the
country. Given names with a known gender are permuted among the names of that gender and script, whatever
the title.

The permutation is P, a step and P back, where P is a keyed Feistel network and the step goes to the next
string in one cycle through all of the shape. So no string is its own surrogate, no two of one kind share
one, and the same entity (whatever its spacing, case or title) has the same surrogate everywhere, without a
table or a limit. Where only some strings are allowed, P and the step go on until the next allowed one,
which is a permutation of these. ``checked`` verifies all this over a set of entities.

Odd cases: what holds no character that can change, as a password of eight underscores, is not an
entity; a null text stays null, an empty one empty; texts without personal data are unchanged
to the byte; repeated rows are treated alike; other columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edupulse.llm.staging import free_prefix, numbered, stage, steps

KEY = "surrogates"
MAX_EXCEPTIONS = 50_000
MAX_EPOCHS = 8
MAX_ATTEMPTS = 64
ROUNDS = 6

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "secret", "name")

# Given names by gender and script, each list permuted within itself (fixed values).
GIVEN_NAMES = {
    ("f", "latin"): "Anna Maria Laura Julia Sarah Emma Lisa Sofia Clara Elena Nina Paula Marta Lucia Carmen Ines Camille Chloe Alice Louise Helen Susan Mary Jane Linda Karen Ruth Emily".split(),
    ("m", "latin"): "John James Peter Paul Thomas Michael David Robert Daniel Martin Lukas Felix Jonas Hans Karl Pierre Jean Louis Hugo Carlos Juan Luis Pedro Diego Mark Simon Adam Frank".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай".split(),
}
_TITLES = {"m": "Mr Sir Herr Monsieur Señor Don господин", "f": "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita Doña госпожа", "": "Dr Prof Doctor Professor"}
_NAME_GENDER = {n.lower(): key for key, names in GIVEN_NAMES.items() for n in names}

_WORD = r"[^\W\d_]"
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<named>(?i:(?<!\w)(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer))[\"']?[ \t]*[:=][ \t]*[\"']?(?P<value>(?=[_+/=.~-]*+[A-Za-z0-9])[A-Za-z0-9_+/=.~-]{8,}+))"
    r"|(?P<secret>(?<![\w/+-])(?=[A-Za-z_-]*+\d)(?:[0-9a-fA-F]{32,}+|(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza)[A-Za-z0-9_-]{12,}+)(?![\w/+-]))"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\w)|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w))"
    rf"|(?P<name>(?<!\w)(?P<title>{'|'.join(t for ts in _TITLES.values() for t in ts.split())})\.?[ ](?P<person>{_WORD}+(?:[ ](?-i:[A-ZÀ-ÖØ-ÞА-ЯЁ]){_WORD}+)?))")
# Every kind but names holds one of these.
_HINT = re.compile(r"[\d@=:]")
_NAME_HINT = re.compile(r"\b(?:" + "|".join(t for ts in _TITLES.values() for t in ts.split()) + r")\b")


# Country codes of one and two digits; all others have three (fixed values, ITU-T E.164).
_COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _country_digits(digits: str) -> int:
    return 1 if digits[:1] in _COUNTRIES else 2 if digits[:2] in _COUNTRIES else 3


def _changeable(kind: str, entity: str) -> bool:
    """Whether a character of the entity has others that may stand for it."""
    if kind == "email":
        entity = entity.rpartition(".")[0]
    return any(len(_class(c)) > 1 for c in entity)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) in order; the entity is the same for every way of writing it."""
    if not _HINT.search(text) and not _NAME_HINT.search(text):
        return []
    out = []
    for m in _PATTERN.finditer(text):
        kind, group = m.lastgroup, m.lastgroup
        if m["named"] is not None:
            kind, group = "secret", "value"
        elif m["name"] is not None:
            kind, group = "name", "person"
            if not m["person"][0].isupper():
                continue
        else:
            kind = group = next(k for k in KINDS if k in m.groupdict() and m[k] is not None)
        found = m[group]
        if kind in ("phone", "card", "ssn"):
            entity = re.sub(r"\D", "", found)
            if kind == "phone" and not 7 <= len(entity) <= 15:
                continue
            if found.startswith("+"):
                entity = f"+{_country_digits(entity)}:{entity}"
        elif kind == "secret":
            entity = found
        elif kind == "iban":
            entity = found.replace(" ", "")
        elif kind == "name":
            entity = found.lower()
        else:
            entity = found.lower()
        if _changeable(kind, entity):
            out.append((m.start(group), m.end(group), kind, entity))
    return out


# Letters that stand for each other: vowels and consonants of the common alphabets (fixed values).
_LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_CLASSES = {c: group for letters in _LETTERS for group in (letters, letters.upper()) for c in group} | dict.fromkeys("0123456789", "0123456789")


@lru_cache(100_000)
def _class(c: str) -> str:
    """The characters that may stand for ``c``; itself alone if it is neither letter nor digit."""
    if c in _CLASSES or c.isascii():
        return _CLASSES.get(c, c)
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return c
    low = ord(c) & ~0x7F
    alike = [chr(x) for x in range(low, low + 128) if unicodedata.category(chr(x)) == kind]
    # One character each way when the case changes, so that case can be restored.
    alike = [x for x in alike if x not in _CLASSES and len(x.lower()) == 1 and len(x.upper()) == 1 and x.lower().upper() in (x, x.upper())]
    return "".join(alike) if c in alike else c


def _numbers(key: str, count: int) -> list[int]:
    out: list[int] = []
    block = 0
    while len(out) < count:
        digest = hashlib.blake2b(f"{block}\x00{key}".encode()).digest()
        out += [int.from_bytes(digest[i: i + 8], "little") for i in range(0, 64, 8)]
        block += 1
    return out[:count]


_HEX = "0123456789abcdef"


def _mix(values: list[int], sizes: list[int], key: str, back: bool = False) -> list[int]:
    """A keyed permutation of numbers below ``sizes``, or its inverse."""
    if len(values) == 1:
        order = sorted(range(sizes[0]), key=_numbers(key, sizes[0]).__getitem__)
        return [order.index(values[0])] if back else [order[values[0]]]
    values = list(values)
    # Two halves in turn are shifted by what the other one says.
    sides = [range(0, len(values), 2), range(1, len(values), 2)]
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        mine, other = sides[turn % 2], sides[1 - turn % 2]
        said = ",".join(str(values[i]) for i in other)
        for i, shift in zip(mine, _numbers(f"{key}\x00{turn}\x00{said}", len(mine)), strict=True):
            values[i] = (values[i] - shift if back else values[i] + shift) % sizes[i]
    return values


def _next(values: list[int], sizes: list[int]) -> list[int]:
    """The next of all such numbers, the first after the last."""
    values = list(values)
    for i, size in enumerate(sizes):
        values[i] = (values[i] + 1) % size
        if values[i]:
            break
    return values


def _replace_numbers(values: list[int], sizes: list[int], key: str, allowed) -> list[int]:
    """A keyed permutation of the allowed numbers that keeps none in place, if there are two."""
    for move in (lambda v: _mix(v, sizes, key), lambda v: _next(v, sizes), lambda v: _mix(v, sizes, key, back=True)):
        values = move(values)
        while not allowed(values):
            values = move(values)
    return values


def permute(text: str, key: str, alphabet: str | None = None, allowed=None) -> str:
    """A keyed permutation of the strings with ``text``'s shape (the classes of its characters, or
    one ``alphabet`` for all) that are allowed, as ``text`` is."""
    classes = [alphabet or _class(c) for c in text]
    # Letters first: they change with every step, so that runs of strings that are not allowed are short.
    free = sorted((i for i, c in enumerate(classes) if len(c) > 1), key=lambda i: classes[i].isdigit())
    if not free:
        return text
    out = list(text)

    def written(values: list[int]) -> str:
        for i, v in zip(free, values, strict=True):
            out[i] = classes[i][v]
        return "".join(out)

    start = [classes[i].index(text[i]) for i in free]
    shape = "".join(c[0] for c in classes)
    return written(_replace_numbers(
        start, [len(classes[i]) for i in free], f"{key}\x00{shape}", (lambda v: allowed(written(v))) if allowed else lambda v: True))


# The networks by their class: ranges of addresses that stay among themselves.
_PRIVATE = [(0xAC100000, 0xAC200000), (0xC0A80000, 0xC0A90000)]
_NETWORKS = [[(0, 1 << 24)], [(10 << 24, 11 << 24)], [(127 << 24, 128 << 24)], [(0xA9FE0000, 0xA9FF0000)], _PRIVATE, [(224 << 24, 1 << 32)]]
_TAKEN = sorted(r for ranges in _NETWORKS for r in ranges)
_PUBLIC = [(end, start) for (_, end), (start, _) in zip(_TAKEN, _TAKEN[1:], strict=False) if end < start]


def _ip(entity: str, key: str) -> str:
    """A permutation of the addresses of the same network class, by their place in it."""
    address = int.from_bytes(bytes(int(x) for x in entity.split(".")), "big")
    ranges = next((rs for rs in _NETWORKS if any(a <= address < b for a, b in rs)), _PUBLIC)
    count = sum(b - a for a, b in ranges)
    place = 0
    for a, b in ranges:
        if a <= address < b:
            place += address - a
            break
        place += b - a
    half = 1 << -(-(count - 1).bit_length() // 2)
    low, high = _replace_numbers([place % half, place // half], [half, half], f"{key}\x00{ranges[0][0]}", lambda v: v[0] + v[1] * half < count)
    place = low + high * half
    for a, b in ranges:
        if place < b - a:
            break
        place -= b - a
    return ".".join(map(str, (a + place).to_bytes(4, "big")))


def _name(entity: str, key: str) -> str:
    person = entity.rpartition(":")[2]
    out = []
    for i, word in enumerate(person.split(" ")):
        known = _NAME_GENDER.get(word)
        if known and i == 0:
            names = [n.lower() for n in GIVEN_NAMES[known]]
            order = sorted(range(len(names)), key=lambda j: _numbers(f"{key}\x00{known}\x00{j}", 1))
            turn = order.index(names.index(word))
            out.append(names[order[(turn + 1) % len(names)]])
        else:
            # Not a listed name, so that it cannot meet the surrogate of one.
            out.append(permute(word, key, allowed=lambda w, i=i: i > 0 or w not in _NAME_GENDER))
    return " ".join(out)


def _hex_alphabet(text: str) -> str | None:
    return next((a for a in (_HEX, _HEX.upper()) if set(text) <= set(a) and not text.isdigit()), None)


def surrogate(kind: str, entity: str, key: str, attempt: int = 0) -> str:
    """What stands for ``entity`` (in the form that ``detect`` gives)."""
    key = f"{key}\x00{kind}\x00{attempt}"
    if kind == "ip":
        return _ip(entity, key)
    if kind == "card":
        rest, valid = entity[1:], luhn(entity)
        return entity[0] + permute(rest, f"{key}{entity[0]}", allowed=lambda r: luhn(entity[0] + r) == valid)
    if kind == "phone" and entity.startswith("+"):
        head, _, digits = entity.partition(":")
        country = digits[: int(head[1:])]
        return country + permute(digits[len(country):], key + country)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{permute(local, key)}@{permute(host, key + 'host')}.{top}"
    if kind == "iban":
        return entity[:2] + permute(entity[2:], key + entity[:2])
    if kind == "name":
        return _name(entity, key)
    if kind == "secret":
        # Hexadecimal strings stay so, and no other becomes one.
        alphabet = _hex_alphabet(entity)
        return permute(entity, key, alphabet, lambda s: _hex_alphabet(s) == alphabet)
    return permute(entity, key)


def _written(original: str, kind: str, replacement: str) -> str:
    """The surrogate in the way that ``original`` is written."""
    if kind in ("phone", "card", "ssn", "iban"):
        letters = iter(replacement)
        return "".join(next(letters) if c.isalnum() else c for c in original)
    if kind in ("email", "name"):
        if len(original) == len(replacement):
            return "".join(r.upper() if o.isupper() else r for o, r in zip(original, replacement, strict=True))
        return " ".join(r.capitalize() if o[:1].isupper() else r for o, r in zip(original.split(" "), replacement.split(" "), strict=True)) if kind == "name" else replacement
    return replacement


def entities(documents: DataFrame, column: str = "text") -> DataFrame:
    """The distinct (kind, entity) of the corpus."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column):
            found = {(k, e) for text in batch.column(column).to_pylist() if text for _, _, k, e in detect(text)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["kind", "entity"])

    return documents.select(column).mapInArrow(find, "kind string, entity string").distinct()


def _surrogates(key: str, attempt: Column) -> Column:
    @F.pandas_udf("string")
    def make(kind: pd.Series, entity: pd.Series, tries: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, key, int(n)) for k, e, n in zip(kind, entity, tries, strict=True)], dtype=object)

    return make("kind", "entity", attempt)


def _epoch_key(key: str, epoch: int = 0) -> str:
    return f"{key}\x00{epoch}"


def checked(found: DataFrame, key: str = KEY, *, max_exceptions: int = MAX_EXCEPTIONS) -> tuple[str, dict[tuple[str, str], int]]:
    """Counts over the entities ``found``, distinct (kind, entity), whether all surrogates differ from their
    entities and from each other: the key that ``pseudonymize`` uses, and no exception.

    Were the permutations not one to one, the exceptions would be given other attempts.
    """
    for epoch in range(MAX_EPOCHS):
        current = _epoch_key(key, epoch)
        named = stage(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogates(current, F.lit(0))))
        tries = 0
        while True:
            # What is compared is the surrogate as written: without the country's length, but a plus tells apart.
            plain = F.when(F.col("kind") == "phone", F.regexp_replace("entity", "^[^:]*:", "")).otherwise(F.col("entity"))
            named = named.withColumn("_plus", F.col("entity").startswith("+"))
            shared = named.groupBy("kind", "_plus", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            turn = Window.partitionBy("kind", "_plus", "surrogate").orderBy("attempt", "entity")
            clashes = (named.join(shared, ["kind", "_plus", "surrogate"]).withColumn("_turn", F.row_number().over(turn)).where("_turn > 1")
                       .select("kind", "entity").unionByName(named.where(plain == F.col("surrogate")).select("kind", "entity"))).distinct()
            again = stage(clashes)
            if not again.take(1):
                break
            tries += 1
            if tries > MAX_ATTEMPTS:
                raise ValueError(f"no surrogate differs from its entity and all others: {again.limit(3).collect()}")
            if again.count() > max_exceptions:
                named = None
                break
            named = stage(
                named.join(again.withColumn("_again", F.lit(1)), ["kind", "entity"], "left")
                .withColumn("attempt", F.col("attempt") + F.coalesce("_again", F.lit(0))).drop("_again")
                .withColumn("surrogate", F.when(F.col("attempt") > 0, _surrogates(current, F.col("attempt"))).otherwise(F.col("surrogate"))))
        if named is not None:
            rows = named.where("attempt > 0").select("kind", "entity", "attempt").limit(max_exceptions + 1).collect()
            if len(rows) <= max_exceptions:
                return current, {(r["kind"], r["entity"]): r["attempt"] for r in rows}
    raise ValueError("too many clashing surrogates under every key")


def replace(text: str, key: str, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    out, at, kinds = [], 0, []
    for start, end, kind, entity in detect(text):
        out += [text[at:start], _written(text[start:end], kind, surrogate(kind, entity, key, (attempts or {}).get((kind, entity), 0)))]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]) if kinds else text, kinds


def pseudonymize(documents: DataFrame, key: str = KEY, *, column: str = "text") -> DataFrame:
    """``documents`` with surrogates in ``column``, and __n_<kind> for every kind replaced.

    The counts have more underscores where ``documents`` has columns that begin so (``free_prefix``).
    """
    current = _epoch_key(key)
    columns = documents.columns
    new = [f"{free_prefix(columns)}n_{k}" for k in KINDS]
    plain = numbered(documents)
    carried = plain.columns
    text_column = carried[columns.index(column)]

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_column):
            texts, counts = [], np.zeros((batch.num_rows, len(KINDS)), np.int64)
            for i, text in enumerate(batch.column(text_column).to_pylist()):
                changed, kinds = replace(text, current) if text else (text, [])
                texts.append(changed)
                for kind in kinds:
                    counts[i, KINDS.index(kind)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text_column else batch.column(c) for c in carried] + [pa.array(counts[:, k]) for k in range(len(KINDS))],
                names=[*carried, *KINDS])

    counts = [T.StructField(k, T.LongType()) for k in KINDS]
    return plain.mapInArrow(swap, T.StructType(plain.schema.fields + counts)).toDF(*columns, *new)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, text with surrogates, and the number of entities by kind."""
    done = pseudonymize(documents.select("doc_id", "text"))
    counts = [F.col(f"__n_{k}") for k in KINDS]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return done.select("doc_id", "text", total.alias("n_entities"), *[F.col(f"__n_{k}").alias(f"n_{k}") for k in KINDS])
