"""Private data and secrets replaced by surrogates.

Entities are found by their form: mail addresses, telephone numbers, card numbers, social security numbers, bank account
numbers, network addresses, cloud keys, secrets given to a name such as password or token, and names of persons after a
title or "my name is". Each gets a surrogate of its kind that a keyed hash makes: digits become digits, letters letters of
the same case and script, marks stay where they are; names become names of the same script, gender and case; card and bank
account numbers keep valid check digits. The same entity gets the same surrogate in every document.

Names are replaced word by word: a given name and a surname are entities of their own, so that "Mrs Anna Smith", "Dr Anna
Smith" and "Mrs Smith" refer alike. A name of one word is a surname, unless the corpus has it only as a given name; a given
name after a title of no gender is that of a woman or else of a man where the corpus has it so. What a surname ends in, not
the title, decides the form of its surrogate.

Different entities get different surrogates: every surrogate is a function of (key, kind, entity, attempt), all first
attempts are compared across the corpus (those of all names together), and an entity whose surrogate another entity has taken, or which is itself an
entity of the corpus, tries again until none collides. Only those entities (few) are joined back to documents; all others
are replaced where they are found, without a shuffle of texts.

Null and empty texts stay as they are. Rows equal in text get equal results. Texts are read whole."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .frames import cut, map_slices

MOST_ATTEMPTS = 60
# Fixed lists: titles by gender, and the names that surrogates are made of, by script and gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Doña", "госпожа", "κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Don", "господин", "κύριος"),
    "n": ("Dr", "Prof", "my name is", "My name is", "mein Name ist", "je m'appelle", "me llamo", "меня зовут"),
}
GIVEN = {
    "LATIN": {"f": ("Anna", "Clara", "Emma", "Julia", "Laura", "Maria", "Nora", "Olivia", "Sara", "Sofia"),
              "m": ("Adam", "David", "Felix", "Henry", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Victor")},
    "CYRILLIC": {"f": ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
                 "m": ("Антон", "Борис", "Виктор", "Егор", "Иван", "Максим", "Олег", "Павел")},
    "GREEK": {"f": ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
              "m": ("Ανδρέας", "Γιάννης", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος")},
}
SYLLABLES = {"LATIN": "bar den fel gor han kel lin mar nor pel ros sel tor ven wal".split(),
             "CYRILLIC": "бар вен гор дан зим кол лев мар нов пет род сом тур".split(),
             "GREEK": "βαρ γεν δημ καλ λαμ μαν νικ παπ ρου σταμ τσιρ".split()}
SURNAME_ENDS = {"LATIN": ("er", "son", "man", "berg"), "CYRILLIC": {"f": ("ова", "ина"), "m": ("ов", "ин"), "n": ("енко", "ко")},
                "GREEK": {"f": ("άκη", "ίδου"), "m": ("άκης", "ίδης"), "n": ("άκης", "ίδης")}}
_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+)?"
#: Kind and form, in the order of precedence; what a group named x holds is the entity, else all of it.
FORMS = (
    ("mail", r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"),
    ("cloud_key", r"(?P<cloud_key>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"),
    ("secret", r"(?:(?<![^\W_])(?i:password|passwd|token|secret|api[_-]?key)\b[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(?P<secret>[^\s\"',;]{6,})"),
    ("account", r"(?P<account>\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b)"),
    ("network", r"(?P<network>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"),
    ("card", r"(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]*\d))"),
    ("social", r"(?P<social>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d))"),
    ("telephone", r"(?P<telephone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}(?:[ .-]\d{2,4}){1,3}(?![\d-]*\d)|\+\d{8,14}\b)"),
)
KINDS = (*[kind for kind, _ in FORMS], "person")
NAMES = ("surname", "given_f", "given_m", "given_n", "single")  # what a word of a name is; `single`: a name of one word
#: Countries' telephone codes of one and two digits; all others have three.
COUNTRY_CODE = re.compile("[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|...")


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    titles = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
    return re.compile("|".join(form for _, form in FORMS)), re.compile(rf"(?<!\w)(?P<title>{titles})\.? (?P<person>{_NAME})")


def _sums_to_ten(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of every entity, in order, without overlaps; persons' kinds end in their gender."""
    if not text:
        return []
    found = []
    marks, named = _patterns()
    if any(c in text for c in "@+=:") or any(c.isdigit() for c in text) or "AKIA" in text or "ASIA" in text:
        for match in marks.finditer(text):
            kind = match.lastgroup
            start, end = match.span(kind)
            if kind == "mail" and not any(c.isalpha() for c in match[kind].rpartition(".")[2]):
                continue
            found.append((start, end, kind, match[kind]))
    for match in named.finditer(text):
        if match["person"][0].isupper():
            gender = next(g for g, titles in TITLES.items() if match["title"] in titles)
            found.append((*match.span("person"), f"person_{gender}", match["person"]))
    kept: list[tuple[int, int, str, str]] = []
    for entity in sorted(found):
        if not kept or entity[0] >= kept[-1][1]:
            kept.append(entity)
    return kept


def known_as(kind: str, entity: str) -> str:
    """What makes two mentions the same entity: the digits of a number (a telephone's with + before a country's code), a
    mail address without regard to case, and a person's name or a word of it likewise."""
    if kind in ("telephone", "card", "social"):
        if kind == "telephone" and entity[0] == "+":
            return "+" + re.sub(r"\D", "", entity)
        return re.sub(r"\D", "", entity)
    if kind == "account":
        return entity.replace(" ", "")
    return entity.casefold() if kind == "mail" or kind.startswith("person") or kind in NAMES else entity


class _Draws:
    """Numbers from a keyed hash of an entity."""

    def __init__(self, key: bytes, *of):
        self.state, self.left, self.count = hmac.new(key, repr(of).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, 0

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.count += 1
            self.left = int.from_bytes(hashlib.sha256(self.state + self.count.to_bytes(4, "big")).digest(), "big")
        self.left, drawn = divmod(self.left, n)
        return drawn

    def of(self, choices):
        return choices[self.below(len(choices))]


def _like(text: str, draws: _Draws, keep: str = "") -> str:
    """The same form: another digit for a digit, another letter of the same case and script for a letter."""
    made = []
    for c in text:
        if c in keep:
            made.append(c)
        elif c.isdecimal():
            made.append(chr(ord(c) - unicodedata.decimal(c) + draws.below(10)))
        elif c.isalpha():
            hexed = c in "abcdef" and all(x in "0123456789abcdef" for x in text)
            first, n = ("a", 6) if hexed else ("a", 26) if c.islower() and c.isascii() else ("A", 26) if c.isascii() else ("а", 32) if "а" <= c <= "я" else ("А", 32) if "А" <= c <= "Я" else ("", 0)
            made.append(chr(ord(first) + draws.below(n)) if n else _letter(c, draws))
        else:
            made.append(c)
    return "".join(made)


def _letter(c: str, draws: _Draws) -> str:
    """A letter near in its script's block, of the same case; the letter itself where there is none."""
    near = [x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if x.isalpha() and x.islower() == c.islower() and x.isupper() == c.isupper()]
    return draws.of(near) if near else c


def _script(text: str) -> str:
    for c in text:
        name = unicodedata.name(c, "")
        for script in GIVEN:
            if name.startswith(script):
                return script
    return "LATIN"


def _longer(name: str, script: str, draws: _Draws, syllables: int) -> str:
    return ("".join(draws.of(SYLLABLES[script]) for _ in range(syllables)) + name.lower()).capitalize()


def name_words(entity: str, gender: str) -> list[tuple[str, str]]:
    """What each word of a name is, and the marks between them: (kind, word)."""
    first, mark, last = re.fullmatch(r"([^ -]*)(?:([ -])(.*))?", entity).groups()
    if mark is None:
        return [("single", first)]
    return [(f"given_{gender}" if mark == " " else "surname", first), ("", mark), ("surname", last)]


def _surname_gender(word: str, script: str) -> str:
    word = word.casefold()
    if script == "GREEK":
        return "m" if word.endswith("σ") else "f"
    return "f" if word.endswith(("а", "я")) else "m" if word.endswith(("ов", "ев", "ёв", "ин", "ын", "ий", "ой")) else "n"


def name_surrogate(key: bytes, kind: str, word: str, attempt: int = 0) -> str:
    """The replacement of a word of a name, with a syllable more for each attempt, so that there are enough for any number."""
    kind, script = "surname" if kind == "single" else kind, _script(word)
    draws = _Draws(key, kind, known_as(kind, word), attempt)
    if kind == "surname":
        ends = SURNAME_ENDS[script]
        made = _longer(draws.of(SYLLABLES[script]), script, draws, 1 + attempt)
        made += draws.of(ends[_surname_gender(word, script)] if isinstance(ends, dict) else ends)
    else:
        genders = GIVEN[script]
        made = _longer(draws.of(genders.get(kind[-1]) or genders["f"] + genders["m"]), script, draws, attempt)
    return made.upper() if word.isupper() and len(word) > 1 else made


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, others: dict | None = None) -> str:
    """The replacement of an entity; of mentions that differ only in their marks, one that differs only in its marks.
    `others` names what words of names are after all, and their attempts: {(kind, known): (kind, attempt)}."""
    if kind.startswith("person"):
        words = [(k, w, *(others or {}).get((k, known_as(k, w)), (k, attempt))) for k, w in name_words(entity, kind[-1])]
        return "".join(name_surrogate(key, real, w, tries) if k else w for k, w, real, tries in words)
    if kind in NAMES:
        return name_surrogate(key, kind, entity, attempt)
    known = known_as(kind, entity)
    draws = _Draws(key, kind, known, attempt)
    if kind == "mail":
        name, _, domain = known.partition("@")
        host, _, top = domain.rpartition(".")
        return _like(name, draws) + "@" + _like(host, draws, keep=".-") + "." + top
    if kind == "cloud_key":
        return entity[:4] + _like(entity[4:], draws)
    if kind == "network":
        return ".".join(str(1 + draws.below(254)) for _ in range(4))
    if kind in ("telephone", "card", "social"):
        known = known.removeprefix("+")
        digits = list(_like(known, draws))
        kept = len(COUNTRY_CODE.match(known)[0]) if entity[0] == "+" else 0  # (however the number is written)
        digits[:kept] = known[:kept]
        if kind == "card":
            digits[0] = known[0]
            if _sums_to_ten(known):
                digits[-1] = next(d for d in "0123456789" if _sums_to_ten("".join(digits[:-1]) + d))
        rest = iter(digits)
        return "".join(next(rest) if c.isdigit() else c for c in entity)
    if kind == "account":
        body = _like(known[4:], draws)
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        valid = number(known[4:] + known[:4]) % 97 == 1
        code = known[:2] + (f"{98 - number(body + known[:2] + '00') % 97:02d}" if valid else _like(known[2:4], draws))
        rest = iter(code + body)
        return "".join(c if c == " " else next(rest) for c in entity)
    return _like(entity, draws)


def _entities(docs: DataFrame, text: str, key: bytes) -> DataFrame:
    """Every mention's kind and entity, names by words, with its document's text hash: (text_hash, kind, known, made)."""
    def run(batch: pa.RecordBatch) -> list:
        columns = [[], [], [], []]
        for hashed, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts = [p for _, _, k, e in find(value.as_py()) for p in (name_words(e, k[-1]) if k.startswith("person") else [(k, e)]) if p[0]]
            for kind, known, entity in sorted({(k, known_as(k, e)): (k, known_as(k, e), e) for k, e in parts}.values()):
                for column, x in zip(columns, (hashed, kind, known, known_as(kind, surrogate(key, kind, entity)))):
                    column.append(x)
        return columns

    rows = docs.where(docs[text].isNotNull()).select(F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    return map_slices(rows, "text_hash bigint, kind string, known string, made string", run)


def _real_kinds(entities: DataFrame) -> DataFrame:
    """`entities` with `real`, the kind that they are after all: that of other mentions of a name's word."""
    words = entities.where(F.col("kind").isin(*NAMES)).groupBy("known").agg(F.collect_set("kind").alias("kinds"))  # (five at most)
    has = lambda kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    given = F.when(has("given_f"), "given_f").when(has("given_m"), "given_m").when(has("given_n"), "given_n")
    real = (F.when(F.col("kind") == "given_n", given)
            .when(F.col("kind") == "single", F.when(has("surname"), "surname").otherwise(F.coalesce(given, F.lit("surname"))))
            .otherwise(F.col("kind")))
    return entities.join(words, "known", "left").withColumn("real", real).drop("kinds")


def _retries(mentions: DataFrame, key: bytes) -> DataFrame:
    """(kind, known, real, attempt) of the entities whose first surrogate collides, with the attempt that does not, and of
    the words of names that are of another kind after all."""
    mentioned = cut(_real_kinds(mentions.groupBy("kind", "known").agg(F.min("made").alias("made"))))
    itself = (F.col("kind") == F.col("real")) | (F.col("kind") == "single") & (F.col("real") == "surname")
    pool = F.when(F.col("kind").isin(*NAMES), "person").otherwise(F.col("kind"))  # what must not collide
    entities = cut(mentioned.where(itself).select(F.col("real").alias("kind"), "known", "made").groupBy("kind", "known")
                   .agg(F.min("made").alias("made")).withColumn("pool", pool))
    taken = entities.select("pool", F.col("known").alias("made"))  # no surrogate may be an entity of the corpus
    state = entities.withColumn("attempt", F.lit(0))
    for attempt in range(1, MOST_ATTEMPTS + 1):
        # of those that share a surrogate the one that had it first stays (the least attempt, then the least entity)
        order = F.row_number().over(W.partitionBy("pool", "made").orderBy("attempt", "known", "kind"))
        twice = state.groupBy("pool", "made").count().where("count > 1").drop("count")
        shared = state.join(twice, ["pool", "made"], "left_semi").withColumn("turn", order).where("turn > 1").drop("turn")
        bad = cut(shared.unionByName(state.join(taken, ["pool", "made"], "left_semi")).select("kind", "known").distinct())
        if bad.isEmpty():
            found = mentioned.select("kind", "known", "real").join(state.select(F.col("kind").alias("real"), "known", "attempt"), ["real", "known"])
            return found.where("attempt > 0 OR kind <> real AND kind <> 'single' OR kind = 'single' AND real <> 'surname'").select("kind", "known", "real", "attempt")

        def again(batch: pa.RecordBatch, attempt: int = attempt) -> list:
            kinds, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            return [kinds, known, [known_as(k, surrogate(key, k, e, attempt)) for k, e in zip(kinds, known)], [attempt] * len(kinds)]

        tried = map_slices(bad, "kind string, known string, made string, attempt int", again).withColumn("pool", pool)
        state = cut(state.join(bad, ["kind", "known"], "left_anti").unionByName(tried))
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts: too few of their form for so many entities")


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows of `docs` as struct `row`, with `clean` (the text with surrogates) and `found` (a map of kind to count)."""
    mentions = cut(_entities(docs, text, key))
    retries = cut(mentions.select("text_hash", "kind", "known").join(_retries(mentions, key), ["kind", "known"])
                  .groupBy("text_hash").agg(F.collect_set(F.struct("kind", "known", "real", "attempt")).alias("again")))  # (of one text)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs[text]).alias("own"))
    met = rows.join(retries, rows["own"] == retries["text_hash"], "left")

    @F.arrow_udf("struct<clean: string, found: map<string, bigint>>")
    def clean(texts: pa.Array, again: pa.Array) -> pa.Array:
        made = []
        for value, more in zip(texts, again):
            value, more = value.as_py(), {(m["kind"], m["known"]): (m["real"], m["attempt"]) for m in more.as_py() or ()}
            parts, at, counts = [], 0, {}
            for start, end, kind, entity in find(value):
                parts += [value[at:start], surrogate(key, kind, entity, more.get((kind, known_as(kind, entity)), (kind, 0))[1], more)]
                at = end
                counts[kind.partition("_")[0] if kind.startswith("person") else kind] = counts.get(kind.partition("_")[0] if kind.startswith("person") else kind, 0) + 1
            made.append({"clean": value if value is None else "".join(parts) + value[at:], "found": sorted(counts.items())})
        return pa.array(made, pa.struct([("clean", pa.string()), ("found", pa.map_(pa.string(), pa.int64()))]))

    return met.select("row", clean(F.col("row").getField(text), "again").alias("made")).select("row", "made.clean", "made.found")


def without_private_data(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows of `docs` with their columns, their texts cleaned."""
    return replace(docs, key, text).select(F.col("row").withField(f"`{text}`", F.col("clean")).alias("row")).select("row.*")


def kind_count(found: Column, kind: str) -> Column:
    return F.coalesce(F.element_at(found, kind), F.lit(0).cast("bigint"))
