"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

A surrogate is a keyed permutation of the entity's normal form within its
format (digits stay digits, separators and case stay, issuer and check digit
of cards hold, letters stay in their script), so that the same entity has one
surrogate in all documents and formats.

Every word of a person's name is one entity, whatever title or place in a name
it has, and is found again without them in the rest of its document.  Its
gender is that of the known given names, of the titles before it anywhere in
the corpus, or of its ending where the script tells (Cyrillic, Greek).

All distinct entities of the corpus are checked: a surrogate that two
entities share, or that is itself an entity of the corpus, is drawn again for
all but the least of them, until none is left.  Only those exceptions (and
genders that the word alone does not tell) are handed to the pass that
rewrites texts; it computes all other surrogates again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bloom, bloom_hits, drop, materialize, put_back, set_aside, small_batches, tidy

MAX_BROADCAST = 500_000  # exceptions handed to every task; more are joined
WIDER = 8  # draws after which a format's space is widened

# ------------------------------------------------------------------ detection
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-") | {chr(c) for c in range(0xC0, 0x100)}
_DOMAIN_RUN = re.compile(r"[A-Za-z0-9.-]*")
_LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")
_TOP = re.compile(r"[A-Za-z]{2,24}")
_IPV4 = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)")
_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\d)")
_CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?<!\w)(?:AKIA[A-Z0-9]{16}|[0-9a-f]{32,64})(?!\w)")
# Titles, and given names that make the capitalised word after them a surname.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "Κύριος", "κ."),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Srta", "Doña", "госпожа", "г-жа", "Κυρία"),
    "": ("Dr", "Prof", "Professor", "Doctor"),
}
GIVEN = {
    "m": (
        "James John Robert Michael David William Thomas Daniel Peter Paul Hans Klaus Jürgen Stefan Pierre Jean Michel Luc Carlos José Juan Miguel Luis Pablo"
        " Alexander Andrew Anthony Benjamin Brian Charles Christopher Edward Eric Frank George Henry Jacob Jonathan Joseph Kevin Matthew Nicholas Patrick Richard"
        " Samuel Steven Timothy Walter Andreas Dieter Friedrich Heinrich Jens Lukas Matthias Uwe Wolfgang Antoine François Jacques Laurent Olivier Philippe René"
        " Alejandro Antonio Diego Fernando Francisco Javier Jorge Manuel Pedro Rafael"
    ).split(),
    "f": (
        "Mary Anna Sarah Emma Laura Julia Maria Linda Susan Karen Helga Ingrid Sabine Petra Marie Claire Sophie Camille Carmen Lucía Elena Isabel Pilar Rosa"
        " Alice Amanda Barbara Catherine Christine Deborah Diana Elizabeth Emily Hannah Helen Jennifer Jessica Katherine Margaret Michelle Nancy Nicole Olivia"
        " Patricia Rachel Rebecca Sandra Stephanie Victoria Andrea Birgit Gisela Heike Katrin Monika Renate Ursula Brigitte Chantal Françoise Isabelle Juliette"
        " Nathalie Sylvie Ana Beatriz Cristina Dolores Inés Margarita Mercedes Teresa"
    ).split(),
}
_GENDER = {name.lower(): g for g, names in GIVEN.items() for name in names}
_TITLE_OF = {t: g for g, ts in TITLES.items() for t in ts}
_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ]"
_TITLE = re.compile("|".join(sorted(map(re.escape, _TITLE_OF), key=len, reverse=True)))
_NAME = re.compile(r"(?<!\w)(" + _TITLE.pattern + r")(\.? )(" + _UPPER + r"[^\W\d_]+(?:[ -]" + _UPPER + r"[^\W\d_]+){0,2})")
_CAPITAL = re.compile(r"(?<!\w)" + _UPPER + r"[^\W\d_]+(?!\w)")


class Entity(NamedTuple):
    """A place in a text; gender is what a title or the list of given names says ("" if nothing)."""

    start: int
    end: int
    kind: str
    value: str
    gender: str = ""


def luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 - k % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def _emails(text: str) -> Iterator[Entity]:
    """Addresses around each @; the stretches looked at don't overlap, so that time is linear."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < at and not text[begin].isalnum():
            begin += 1
        end, x = at + 1, at + 1
        stop = _DOMAIN_RUN.match(text, at + 1).end()
        labels = text[at + 1 : stop].split(".")
        for k, label in enumerate(labels):
            if k and (top := _TOP.match(label)):
                end = x + top.end()
            if not _LABEL.fullmatch(label):
                break
            x += len(label) + 1
        if begin < at and text[at - 1] != "." and end > at + 1:
            yield Entity(begin, end, "email", text[begin:end].lower())
        done = at + 1
        at = text.find("@", done)


def detect(text: str) -> list[Entity]:
    """Entities that do not overlap; earlier kinds win.

    Scripts other than Latin, Cyrillic and Greek have no names here, and a
    name is found by a title or a listed given name first.
    """
    found: list[Entity] = []
    if "@" in text:
        found += _emails(text)
    if any(d in text for d in "0123456789"):
        found += [Entity(*m.span(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if sum(c.isdigit() for c in m[0]) >= 10]
        found += [Entity(*m.span(), "secret", m[0]) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0]) and not m[0].isdigit()]
        found += [Entity(*m.span(), "phone", "+" * (m[0][0] == "+") + re.sub(r"\D", "", m[0])) for m in _PHONE.finditer(text)]
        found += [Entity(*m.span(), "ssn", m[0]) for m in _SSN.finditer(text)]
        found += [Entity(*m.span(), "card", re.sub(r"\D", "", m[0])) for m in _CARD.finditer(text)]
        found += [Entity(*m.span(), "ip", m[0]) for m in _IPV4.finditer(text) if m[0] not in ("0.0.0.0", "127.0.0.1")]
    return sorted(_first_wins(found + _names(text)))


def _names(text: str) -> list[Entity]:
    """Words of names: after titles, after listed given names, and the same words elsewhere in the text."""
    found: list[Entity] = []
    if _TITLE.search(text):
        for m in _NAME.finditer(text):
            found += _name_parts(m.start(3), m[3], _TITLE_OF[m[1]])
    capital = [(*m.span(), m[0].lower()) for m in _CAPITAL.finditer(text)]
    for (a, b, w), (c, d, v) in zip(capital, capital[1:], strict=False):
        if w in _GENDER and c == b + 1 and text[b] == " ":
            found += [Entity(a, b, "name", w, _GENDER[w]), Entity(c, d, "name", v)]
    words = {x.value for x in found}
    return found + [Entity(a, b, "name", w) for a, b, w in capital if w in words] if words else found


def _first_wins(found: list[Entity]) -> list[Entity]:
    """Entities in the order of finding, without those that overlap an earlier one."""
    kept: list[Entity] = []
    starts: list[int] = []  # of kept ones, sorted, as are their ends
    ends: list[int] = []
    for x in found:
        k = bisect_left(starts, x[1])
        if k == 0 or ends[k - 1] <= x[0]:
            kept.append(x)
            starts.insert(k, x[0])
            ends.insert(k, x[1])
    return kept


def _name_parts(start: int, name: str, gender: str) -> list[Entity]:
    """The words of a name after a title, which speaks of given names: all but the last word."""
    out, words = [], re.split(r"([ -])", name)
    at = start
    for k, w in enumerate(words):
        if w not in " -":
            out.append(Entity(at, at + len(w), "name", w.lower(), gender if k < len(words) - 1 else ""))
        at += len(w)
    return out


# ------------------------------------------------------------------ surrogates
def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network, walked until it lands inside."""
    if size < 2:
        return x
    bits = max(2, (size - 1).bit_length())
    low, high = bits // 2, bits - bits // 2
    while True:
        a, b = x >> low, x & ((1 << low) - 1)  # a: high bits, b: low bits
        for r in range(4):
            a ^= _round(key, tweak, 2 * r, b, high)
            b ^= _round(key, tweak, 2 * r + 1, a, low)
        x = a << low | b
        if x < size:
            return x


def _round(key: bytes, tweak: str, r: int, x: int, bits: int = 256) -> int:
    """`bits` keyed pseudo-random bits for x."""
    mac = hashlib.blake2b(f"{r}|{tweak}|".encode() + x.to_bytes((x.bit_length() + 7) // 8, "big"), key=key, digest_size=32).digest()
    if bits > 256:
        mac = hashlib.shake_256(mac).digest((bits + 7) // 8)
    return int.from_bytes(mac, "big") & ((1 << bits) - 1)


# Syllables, and endings by gender; in Cyrillic and Greek the endings of one place belong together.
_LATIN = ("ba be bi bo ca ce co da de di do fa fe ga ge la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se si so ta te ti to va ve vi".split(), {"m": "no ro do lo us".split(), "f": "na ra la nia lia".split(), "n": "n r l s t nd rt ck".split()})
_CYRILLIC = ("ба бе би бо ва ве ви во га го да де ди до за зе ка ко ла ле ли ло ма ме ми мо на не но па пе по ра ре ри ро са се та те ти то".split(), {"m": "ров нин лев нов рин".split(), "f": "рова нина лева нова рина".split()})
_GREEK = ("βα βε γα γε δα δη κα κο λα λε λι μα με μη να νε νι πα πε ρα ρε ρι σα σε τα τε τι φα φι χα".split(), {"m": "νος ρος λος".split(), "f": "νου ρου λου".split()})
_FEMININE = re.compile(r"(?<=ов|ев|ёв|ин|ын)а$")


def _script(word: str) -> tuple[list[str], dict[str, list[str]]]:
    c = next((ord(x) for x in word if x.isalpha()), 0)
    return _CYRILLIC if 0x400 <= c < 0x530 else _GREEK if 0x370 <= c < 0x400 else _LATIN


def own_gender(word: str) -> str:
    """What a word of a name says by itself: the list of given names, or its ending in Cyrillic and Greek; else "n"."""
    script = _script(word)
    if script is _LATIN:
        return _GENDER.get(word, "n")
    if script is _CYRILLIC:
        return "f" if word[-1] in "ая" else "m"
    return "m" if word[-1] in "ςσ" else "f"


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The normal form of the replacement of an entity's normal form."""
    tweak = f"{kind}/{attempt}"
    if kind == "name":
        return _word(value, key, attempt, gender or own_gender(value))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        x = _round(key, f"{tweak}/domain", 0, int.from_bytes(domain.encode(), "big"))
        label = "".join("abcdefghijklmnopqrstuvwxyz"[x // 26**k % 26] for k in range(12))
        return f"{_classes(local, key, tweak + domain)}@{label}.example"
    if kind == "ip":
        a, b, c, d = map(int, value.split("."))
        x = permute(a << 24 | b << 16 | c << 8 | d, 1 << 32, key, tweak)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "phone":
        return _phone(value, key, tweak) + "0" * max(0, attempt - WIDER + 1)
    if kind == "card":
        body = value[1:-1]
        new = value[0] + str(permute(int(body), 10 ** len(body), key, f"{tweak}/{value[0]}")).zfill(len(body))
        shift = (int(value[-1]) - luhn(value[:-1])) % 10  # a valid number stays valid
        return new + str((luhn(new) + shift) % 10)
    if kind == "ssn":
        x = str(permute(int(value.replace("-", "")), 10**9, key, tweak)).zfill(9)
        return f"{x[:3]}-{x[3:5]}-{x[5:]}"
    if kind == "iban":
        body = _classes(value[4:], key, tweak + value[:2])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    return value[:4] + _classes(value[4:], key, tweak) if value.startswith("AKIA") else _hex(value, key, tweak)


def _word(value: str, key: bytes, attempt: int, gender: str) -> str:
    """Syllables of the word's script and an ending of its gender; every third draw may be longer.

    Cyrillic surnames of both genders share what comes before the ending.
    """
    syllables, ends = _script(value)
    endings = ends.get(gender) or ends[own_gender(value)]
    x = _round(key, f"name/{attempt}", 0, int.from_bytes(_FEMININE.sub("", value).encode(), "big"), 512)
    out = []
    for _ in range(3 + x % 2 + attempt // 3):
        x, r = divmod(x, len(syllables))
        out.append(syllables[r])
    return "".join(out) + endings[x % len(endings)]


def _phone(value: str, key: bytes, tweak: str) -> str:
    plus, digits = value[0] == "+", value.lstrip("+")
    if digits.startswith("1") and len(digits) == 11 or not plus and len(digits) == 10:
        lead, area, exchange, line = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
        if area[0] >= "2":
            x = permute((int(area) - 200) * 10_000 + int(line), 8_000_000, key, f"{tweak}/{exchange}")
            return "+" * plus + f"{lead}{200 + x // 10_000}{exchange}{x % 10_000:04d}"
    lead, body = (digits[:2], digits[2:]) if plus else ("", digits)
    return "+" * plus + lead + str(permute(int(body), 10 ** len(body), key, f"{tweak}/{lead}/{len(body)}")).zfill(len(body))


def _classes(text: str, key: bytes, tweak: str) -> str:
    """Letters to letters, digits to digits, the rest as it is; a permutation among texts of one shape."""
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", text)))
    out = list(text)
    for mark, alphabet in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789")):
        at = [k for k, c in enumerate(shape) if c == mark]
        x, n = 0, len(alphabet)
        for k in at:
            x = x * n + alphabet.index(text[k]) if text[k] in alphabet else x * n
        x = permute(x, n ** len(at), key, f"{tweak}/{shape}/{mark}") if at else 0
        for k in reversed(at):
            x, r = divmod(x, n)
            out[k] = alphabet[r]
    return "".join(out)


def _hex(text: str, key: bytes, tweak: str) -> str:
    return f"{permute(int(text, 16), 16 ** len(text), key, f'{tweak}/{len(text)}'):0{len(text)}x}"


def formatted(original: str, new: str, kind: str = "") -> str:
    """The new normal form in the original's separators and case."""
    if kind == "email":
        old, now = original.rsplit("@", 1), new.rsplit("@", 1)
        local = "".join(n.upper() if o.isupper() else n for o, n in zip(old[0], now[0], strict=True))
        return f"{local}@{now[1].upper() if old[1].isupper() else now[1]}"
    if kind == "name":
        if original.isupper() and len(original) > 1:
            return new.upper()
        return new[0].upper() + new[1:]
    marks = [c for c in new if c.isalnum()]
    if kind != "ip" and sum(c.isalnum() for c in original) == len(marks):
        it = iter(marks)
        return "".join(next(it) if c.isalnum() else c for c in original)
    return new


@lru_cache(maxsize=200_000)
def _known(kind: str, value: str, key: bytes, attempt: int, gender: str) -> str:
    return surrogate(kind, value, key, attempt, gender)


# ----------------------------------------------------------------------- Spark
def _entities(docs: DataFrame) -> DataFrame:
    """kind, value, gender of all distinct entities of the corpus; gender is "" for what is no name."""

    def find(batches):
        for batch in batches:
            got = {(x.kind, x.value, x.gender) for t in batch.column("text").to_pylist() for x in detect(t or "")}
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names=["kind", "value", "gender"])

    seen = docs.select(F.col("text").cast("string")).mapInArrow(tidy(find), "kind string, value string, gender string")
    says = lambda g: F.max((F.col("gender") == g).cast("int"))
    told = seen.groupBy("kind", "value").agg(says("m").alias("m"), says("f").alias("f"))
    # A word whose titles agree has their gender; else the word itself tells.
    return told.select("kind", "value", F.when(F.col("kind") != "name", "").when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("").alias("gender"))


def exceptions(entities: DataFrame, key: bytes, make: Callable[..., str] = surrogate) -> DataFrame:
    """kind, value, attempt, gender of the entities that a task can't draw by themselves.

    These are the ones whose first surrogates are taken by another entity or
    are entities themselves, and words whose titles tell another gender than
    the word.  Ends when no surrogate is taken; draws go on in ever wider
    spaces.
    """
    columns = "kind string, value string, gender string, attempt int"

    def draw(batches):
        for pdf in batches:
            yield pdf.assign(new=[make(k, v, key, a, g) for k, v, g, a in zip(pdf["kind"], pdf["value"], pdf["gender"], pdf["attempt"], strict=True)])

    def own(pdf):
        return pd.Series([k == "name" and g not in ("", own_gender(v)) for k, v, g in zip(pdf["kind"], pdf["value"], pdf["gender"], strict=True)], index=pdf.index, dtype=bool)

    def untold(batches):
        for pdf in batches:
            yield pdf[own(pdf) | (pdf["attempt"] > 0)]

    now, old = entities.select("kind", "value", "gender", F.lit(0).alias("attempt")), []
    real = entities.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
    while True:
        drawn = materialize(now.mapInPandas(draw, columns + ", new string"), "surrogates")
        first = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n"))
        marked = drawn.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
        again = F.coalesce("real", F.lit(False)) | ((F.col("n") > 1) & (F.struct("attempt", "value") != F.col("first")))
        tried = materialize(marked.select("kind", "value", "gender", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), "attempts")
        for done in (drawn, *old):
            drop(done)
        now, old = tried.drop("again"), [tried]
        if tried.where("again").isEmpty():
            return now.mapInPandas(untold, columns)


def replace_entities(docs: DataFrame, key: bytes, broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with text rewritten, and entities (array of kind, start, end in the old text).

    Who has the key can tell which surrogate belongs to an entity: it must be
    secret and the same for all parts of a corpus.  Null texts stay null and
    have no entities, as have empty ones; repeated rows are rewritten alike;
    an input column entities is replaced, others stay, whatever their names.
    """
    if not key:
        raise ValueError("surrogates need a key")
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    spark = docs.sparkSession
    small_batches(spark)
    docs, given = set_aside(docs, ("doc_id", "text"), ("entities",))
    found = materialize(_entities(docs), "entities")
    odd = materialize(exceptions(found, key), "exceptions")
    drop(found)
    n = odd.count()
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = docs.limit(0).withColumn("entities", F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint>>)")).schema
    names = docs.columns

    def rewritten(batch: pa.RecordBatch, taken) -> pa.RecordBatch:
        texts, marks = batch.column("text").to_pylist(), []
        for k, text in enumerate(texts):
            hits = detect(text or "")
            marks.append([{"kind": x.kind, "start": x.start, "end": x.end} for x in hits])
            if hits:
                parts, at, own = [], 0, taken(k)
                for x in hits:
                    attempt, gender = own.get((x.kind, x.value), (0, ""))
                    parts += [text[at : x.start], formatted(text[x.start : x.end], _known(x.kind, x.value, key, attempt, gender), x.kind)]
                    at = x.end
                texts[k] = "".join([*parts, text[at:]])
        columns = [pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in batch.schema if f.name in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(marks, kinds)], names=[*names, "entities"])

    if n <= broadcast:
        held = spark.sparkContext.broadcast({(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in odd.collect()})  # n is checked

        def rewrite(batches):
            for batch in batches:
                yield rewritten(batch, lambda k: held.value)

        return put_back(docs.mapInArrow(tidy(rewrite), schema), given)

    # Too many exceptions to hand out: each text gets its own by a join on its hash.
    keyed = docs.withColumn("_h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    def own(batches):
        for batch in batches:
            got = [(h, k, v) for h, t in zip(batch.column("_h").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, v in {(x.kind, x.value) for x in detect(t or "")}]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got, strict=True)], names=["_h", "kind", "value"])

    hits = keyed.select("_h", "text").mapInArrow(tidy(own), "_h long, kind string, value string").join(odd, ["kind", "value"])
    per = materialize(hits.groupBy("_h").agg(F.collect_set(F.struct("kind", "value", "attempt", "gender")).alias("_taken")), "own-exceptions")
    bitmap = spark.sparkContext.broadcast(bloom(per, "_h", per.count()))

    def mark(batches):
        for batch in batches:
            yield batch.append_column("_touched", pa.array(bloom_hits(bitmap.value, batch.column("_h").to_numpy())))

    marked = keyed.mapInArrow(mark, keyed.limit(0).withColumn("_touched", F.lit(True)).schema)
    touched = marked.where("_touched").join(per, "_h", "left").select(*names, "_taken")
    rest = marked.where("NOT _touched").withColumn("_taken", F.lit(None).cast(per.schema["_taken"].dataType)).select(*names, "_taken")

    def rewrite_own(batches):
        for batch in batches:
            taken = batch.column("_taken").to_pylist()
            yield rewritten(batch, lambda k, taken=taken: {(x["kind"], x["value"]): (x["attempt"], x["gender"]) for x in taken[k] or ()})

    return put_back(touched.mapInArrow(tidy(rewrite_own), schema).unionByName(rest.mapInArrow(tidy(rewrite_own), schema)), given)
