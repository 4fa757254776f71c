"""Personal data: detected entities replaced by keyed, type-consistent surrogates."""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

#: Session setting with the secret key. The given tables are invented, so their query has a public stand-in.
KEY_SETTING, DEMO_KEY = "spark.leafmill.pii.key", "public key for the invented tables"

#: Given names by script and gender, fixed values; a listed name is replaced within its list.
NAMES = {
    ("latin", "f"): "Anna Maria Laura Sofia Emma Julia Clara Elena Sarah Alice Marie Lucia Carmen Ingrid Hannah Grace".split(),
    ("latin", "m"): "Peter Thomas Paul Martin David Daniel Carlos Andreas Michael Robert Pierre Miguel Jonas Henry Felix Oscar".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Татьяна Ирина Наталья Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Михаил Николай Андрей".split(),
}
_NAME_LIST = {n: k for k, names in NAMES.items() for n in names}

#: Words before a name, in the corpus languages and Russian, fixed values.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Herrn Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra господин госпожа".split()
CUES = "Name Signed Regards Sincerely Nombre Nom Имя".split()
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞĀ-ɏА-ЯЁ", "a-zß-öø-ÿĀ-ɏа-яё"
_WORD = rf"[{_UPPER}][{_LOWER}]+(?:['’\-][{_UPPER}][{_LOWER}]+)*"
_NAMED = re.compile(
    rf"(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})(?:\. ?| )|(?:{'|'.join(CUES)})(?: by)?[:,][ \n])(?P<said>{_WORD}(?: {_WORD}){{0,2}})"
    rf"|(?P<listed>(?:{'|'.join(_NAME_LIST)}) {_WORD})"
)
_NAME_WORD = re.compile(_WORD)

#: What every entity without a name contains: a digit, @ or +. Kinds are tried where one of these stands.
_SEED = re.compile(r"[0-9@+]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+\-À-ɏ]+")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_RUN = re.compile(r"[0-9A-Za-z]+")
_SECRET = re.compile(r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_PHONE = re.compile(r"\+[0-9]{1,3}[ \-]?\(?[0-9]{2,4}\)?(?:[ \-]?[0-9]{2,4}){2,4}(?![0-9])")
_DIGITS = [
    ("card", re.compile(r"[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?![0-9])")),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"[0-9]{3}(?:\) |[\-. ])[0-9]{3}[\-.][0-9]{4}(?![0-9])")),
    ("ip", re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
]
_LOCAL_ONE = re.compile(r"[A-Za-z0-9._%+\-À-ɏ]")


def _marked(text: str) -> Iterator[tuple[int, int, str]]:
    """Entities that hold a digit, @ or +, left to right. Each run of characters is looked at once."""
    done = no_mail = no_run = 0
    size = len(text)
    for seed in _SEED.finditer(text):
        p = seed.start()
        if p < done:
            continue
        c = text[p]
        if p >= no_mail:
            a = p
            while a > done and _LOCAL_ONE.match(text, a - 1):
                a -= 1
            m = _LOCAL.match(text, p)
            b = m.end() if m else p
            if a < b < size and text[b] == "@" and (m := _DOMAIN.match(text, b + 1)):
                done = m.end()
                yield a, done, "email"
                continue
            no_mail = max(b, p + 1)
        if c == "+":
            if m := _PHONE.match(text, p):
                done = m.end()
                yield p, done, "phone"
            continue
        if c == "@":
            continue
        if p >= no_run:
            a = p
            while a > done and text[a - 1].isascii() and text[a - 1].isalnum():
                a -= 1
            m = _SECRET.match(text, a)
            kind, b = ("secret", m.end()) if m else ("iban", _iban_end(text, a))
            if b:
                done = b
                yield a, done, kind
                continue
            no_run = _RUN.match(text, p).end()
        before = text[p - 1] if p else ""
        if "0" <= before <= "9":
            continue
        for kind, pattern in _DIGITS:
            if (kind != "ip" or before != ".") and (m := pattern.match(text, p)):
                done = m.end()
                yield p, done, kind
                break


def _iban_end(text: str, a: int) -> int:
    """Where a valid IBAN that starts at ``a`` ends, without words that only look like its last groups; 0 for none."""
    m = _IBAN.match(text, a)
    x = m.group() if m else ""
    while len(x) > 14:
        if _iban_rest(x) == 1 and "02" <= x[2:4] <= "98":
            return a + len(x)
        x = x.rpartition(" ")[0]
    return 0


def _names(text: str) -> list[tuple[int, int, str]]:
    """Words of names: after a title or cue, after a listed given name, and wherever such a word comes again."""
    if not any(w in text for w in _HINTS):
        return []
    words = set()
    for m in _NAMED.finditer(text):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        words.update(_NAME_WORD.findall(m.group("said") or m.group("listed")))
    if not words:
        return []
    again = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(w) for w in sorted(words, key=len, reverse=True))})(?!\w)")
    return [(m.start(), m.end(), "name") for m in again.finditer(text)]


_HINTS = [*TITLES, *CUES, *_NAME_LIST]


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, original) of the entities of a whole text, left to right, not overlapping."""
    if not text:
        return []
    found = list(_marked(text))
    names = _names(text)
    if names:
        at, out = 0, []
        for x in sorted([*found, *names], key=lambda x: (x[0], -x[1])):
            if x[0] >= at:
                out.append(x)
                at = x[1]
        found = out
    return [(a, b, kind, text[a:b]) for a, b, kind in found]


# ---- keyed bijections ----------------------------------------------------------


def _mixed(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1, or its inverse: a Feistel network, walked until the value is inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(8)) if back else range(8):
            if back:
                left, right = right, left
            f = int.from_bytes(hmac.digest(key, f"{tweak}|{half}|{i}|{right}".encode(), "sha256"), "big") & mask
            left, right = (left ^ f, right) if back else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


def _moved(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1 that leaves no value in place (for a size of 2 and more)."""
    if size < 2:
        return value
    shift = 1 + int.from_bytes(hmac.digest(key, f"{tweak}|{size}|shift".encode(), "sha256"), "big") % (size - 1)
    return _mixed((_mixed(value, size, key, tweak) + shift) % size, size, key, tweak, back=True)


_PLAIN = ["0123456789", "abcdefghijklmnopqrstuvwxyz"] + [
    "".join(chr(c) for c in block if chr(c).islower() and len(chr(c).upper()) == 1 and chr(c).upper().lower() == chr(c)) for block in (range(0xE0, 0x100), range(0x100, 0x250))
]
#: Vowels and consonants of both scripts, so that an unlisted name becomes a sayable one.
_SPOKEN = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "áàâäãåéèêëíìîïóòôöõúùûüøæ", "çñšžčćłğ"]


def _recoded(text: str, key: bytes, tweak: str, alphabets: list[str], keep: int = 0) -> str:
    """``text`` with its letters and digits moved within their alphabets, as one number.

    Case and all other characters stay (as do the last ``keep`` characters). Texts that differ
    in case only stay so; others of one form never get the same result.
    """
    spots, value, size, form = [], 0, 1, []
    for i, c in enumerate(text):
        low = c.lower()
        a = next((k for k, letters in enumerate(alphabets) if low in letters), None) if len(low) == 1 and i < len(text) - keep else None
        form.append(low if a is None else f"<{a}>")
        if a is not None:
            spots.append((i, alphabets[a], c != low))
            value, size = value * len(alphabets[a]) + alphabets[a].index(low), size * len(alphabets[a])
    value = _moved(value, size, key, f"{tweak}|{''.join(form)}")
    out = list(text)
    for i, letters, upper in reversed(spots):
        value, r = divmod(value, len(letters))
        out[i] = letters[r].upper() if upper else letters[r]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check sum of a card number, modulo 10; valid numbers have 0."""
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


#: Blocks of addresses that are not public (prefix, bits below it), fixed values; an address stays in its block.
_IP_BLOCKS = [(10 << 24, 24), (127 << 24, 24), (0, 24), (0xAC100000, 20), (0xC0A80000, 16), (0xA9FE0000, 16), (0xE0000000, 28), (0xF0000000, 28)]


def _address(value: int, key: bytes, tweak: str) -> int:
    block = lambda v: next(((b, n) for b, n in _IP_BLOCKS if v >> n == b >> n), None)
    own = block(value)
    if own:
        return own[0] + _moved(value - own[0], 1 << own[1], key, f"{tweak}|{own}")
    out = _moved(value, 1 << 32, key, tweak)
    while block(out):
        out = _moved(out, 1 << 32, key, tweak)
    return out


@lru_cache(maxsize=100_000)
def surrogate(kind: str, original: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity: same type and format, never the original, one-to-one within each format.

    Equal originals have equal surrogates everywhere, different ones never the same, as each
    is a keyed permutation without fixed points of all values of the format; a further attempt
    applies it again, which keeps that. Emails keep the shape of both parts and the top-level domain,
    phones their country code, hex secrets their digits' case, card numbers their grouping
    and check sum, IBANs their country and a valid check number, addresses their block.
    Listed given names stay in their list (script and gender); other names keep script, length, case,
    which letters are vowels, and a last vowel, which often marks the gender.
    """
    for _ in range(attempt + 1):
        original = _once(kind, original, key)
    return original


def _once(kind: str, original: str, key: bytes) -> str:
    if kind == "ip":
        value = _address(int.from_bytes(bytes(int(x) for x in original.split(".")), "big"), key, kind)
        return ".".join(str(b) for b in value.to_bytes(4, "big"))
    if kind == "secret":
        digits = "0123456789ABCDEF" if any(c in "ABCDEF" for c in original) else "0123456789abcdef"
        value = _moved(int(original, 16), 16 ** len(original), key, f"{kind}|{len(original)}|{digits[-1]}")
        return "".join(digits[(value >> (4 * i)) & 15] for i in reversed(range(len(original))))
    if kind == "name":
        if original in _NAME_LIST:
            names = NAMES[_NAME_LIST[original]]
            return names[_moved(names.index(original), len(names), key, f"{kind}|{_NAME_LIST[original]}")]
        keep = 1 if len(original) > 2 and original[-1].lower() in _SPOKEN[0] + _SPOKEN[2] else 0
        out = _recoded(original, key, kind, _SPOKEN, keep)
        while out in _NAME_LIST:
            out = _recoded(out, key, kind, _SPOKEN, keep)
        return out
    if kind == "email":
        rest, _, top = original.rpartition(".")
        return f"{_recoded(rest, key, kind, _PLAIN)}.{top}"
    if kind == "phone":
        code = m.group() if (m := re.match(r"\+[0-9]{1,3}(?=[ \-(])|\+[0-9]", original)) else ""
        return code + _recoded(original[len(code) :], key, kind + code, _PLAIN)
    if kind == "card":
        rest = luhn(re.sub("[^0-9]", "", original))
        head = _recoded(original[:-1], key, f"{kind}|{rest}", _PLAIN)
        return head + str((rest - luhn(re.sub("[^0-9]", "", head) + "0")) % 10)
    if kind == "iban":
        tail = _recoded(original[4:], key, kind + original[:2], ["0123456789", "abcdefghijklmnopqrstuvwxyz"])
        return f"{original[:2]}{98 - _iban_rest(original[:2] + '00' + tail):02d}{tail}"
    return _recoded(original, key, kind, _PLAIN)


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, str, str, int, int]]]:
    """The text with surrogates, and (type, original, surrogate, start, end) of each in the new text."""
    found, out, at, size = [], [], 0, 0
    for a, b, kind, original in entities(text):
        new = surrogate(kind, original, key)
        out += [text[at:a], new]
        size += a - at + len(new)
        found.append((kind, original, new, size - len(new), size))
        at = b
    return (text if not found else "".join([*out, text[at:]])), found


_FOUND = "array<struct<kind:string,original:string,surrogate:string,start:int,stop:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def _rewritten(docs: DataFrame, key: bytes) -> DataFrame:
    """(row, doc_id, text, found): one pass over the texts."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "original", "surrogate", "start", "stop"]
        for batch in source:
            done = [replaced(t, key) for t in batch.column(2).to_pylist()]
            found = pa.array([[dict(zip(names, x, strict=True)) for x in f] for _, f in done], _FOUND_TYPE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()), found], ["row", "doc_id", "text", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, f"row long, doc_id long, text string, found {_FOUND}")


def entity_table(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, kind, original, surrogate) of every entity occurrence."""
    return _rewritten(docs, key).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.kind", "x.original", "x.surrogate")


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, originals): surrogates of two or more originals; none by construction.

    Originals that differ in case only are one entity (of a kind but secrets and names).
    """
    folded = F.when(F.col("kind").isin("secret", "name"), F.col("original")).otherwise(F.lower("original"))
    return found.select("kind", folded.alias("original"), "surrogate").distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("originals")).where("originals > 1")


def _redrawn(pairs: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, original, surrogate): new surrogates for those that are some document's original.

    ``pairs`` has a row per distinct entity. Names are left out: their lists are public, and a
    listed surrogate is meant to look like another name. The permutation is applied again until it leaves the originals,
    which keeps different originals apart.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kinds, originals, now = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_once(k, s, key) for k, s in zip(kinds, now, strict=True)], pa.string())], ["kind", "original", "surrogate"])

    taken = pairs.where("kind <> 'name'").select("kind", F.col("original").alias("surrogate")).distinct()
    meets = lambda rows: rows.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "original", "surrogate")
    bad, out = scratch.save(meets(pairs.where("kind <> 'name'")), "taken"), None
    while not bad.isEmpty():
        tried = scratch.save(bad.mapInArrow(batches, "kind string, original string, surrogate string"), "drawn")
        bad = scratch.save(meets(tried), "taken")
        fine = tried.join(bad.select("kind", "original"), ["kind", "original"], "left_anti")
        out = fine if out is None else out.unionByName(fine)
    return out


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per input row: doc_id, text (with surrogates), n_entities, kinds.

    ``key`` is secret: who has it can invert the surrogates. One pass over the texts finds and replaces;
    it is written with the entities found. Within a format a surrogate is a keyed permutation, so
    coreference and distinctness hold across all documents without a shuffle of texts. What
    is checked is the table of distinct entities (a row each): two originals never share a surrogate
    (an error, none by construction), and a surrogate that is some document's original is drawn
    again; only rows that hold one are rewritten, found by a join on the row.

    A null text stays null, an empty one empty, without entities; long texts are read whole, in linear
    time; null ids and repeated rows are treated like others; an empty table gives no rows; other columns are ignored.
    """
    if not key:
        raise ValueError("a key is needed")
    scratch = Scratch(docs.sparkSession, "pii")
    done = scratch.save(_rewritten(docs, key), "rewritten")
    some = done.where(F.size("found") > 0).select("row", F.explode("found").alias("x"))
    pairs = scratch.save(some.select("x.kind", "x.original", "x.surrogate").distinct(), "pairs")
    if not collisions(pairs).isEmpty():
        raise ValueError("two originals share a surrogate")
    fresh = _redrawn(pairs, key, scratch)
    if fresh is not None:
        spots = some.select("row", "x.kind", "x.original", "x.start", "x.stop").join(fresh, ["kind", "original"])
        patches = spots.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "surrogate"))).alias("patches"))  # a text's own entities

        def patched(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                texts = []
                for text, spots in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    at, out = 0, []
                    for p in spots or ():
                        out += [text[at : p["start"]], p["surrogate"]]
                        at = p["stop"]
                    texts.append(text if not spots else "".join([*out, text[at:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], ["doc_id", "text", "found"])

        done = done.join(patches, "row", "left").select("doc_id", "text", "found", "patches").mapInArrow(patched, f"doc_id long, text string, found {_FOUND}")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",")
    return done.select("doc_id", "text", F.size("found").cast("long").alias("n_entities"), kinds.alias("kinds"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, with the session's key."""
    key = spark.conf.get(KEY_SETTING, DEMO_KEY).encode()
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
