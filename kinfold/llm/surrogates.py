"""PII surrogates: detected entities get keyed replacements of the same type, script, gender and format.

Entities are e-mail addresses, phone, card and account numbers, social security numbers,
IBANs, IPv4 addresses, and names after a title (the title gives the gender) or, in CJK,
before an honorific, with further mentions of these names in the same text. An entity's
canonical form (digits alone, lower case) decides its surrogate, so every mention of it, in
any punctuation and in any document, gets the same one; the mention's own punctuation and
case are kept. A given name whose title tells no gender is the same entity as with a title
that does: that of the same text, else that of more mentions in the corpus. One word after a
title is a surname, unless the same text has it as a given name before a surname only.

Numbers and addresses go through a keyed Feistel permutation of all values of their shape
(with cycle walking), so different entities of a shape cannot meet. Card numbers keep their
issuer digit and a right check digit, account numbers never have one, IBANs keep their
country and right check digits, IPv4 addresses their private, public or reserved range.
Name parts are built of syllables of their script by a keyed hash.

Collision check: over the distinct entities of the whole corpus, no two of a kind (names: of
a script) may share a surrogate and none may equal a real one. Those that fail are tried
again with the next attempt number, which adds a syllable to a name and a letter to an
e-mail's local part, so these never run out and are tried until none is left. A number or
address must keep its format, of which real values may use all (the addresses of a private
range do): after ``FORMAT_TRIES`` attempts it keeps its first surrogate, which no other
entity of its kind has, though it is some real value. Exceptions go to the tasks in a
broadcast up to ``BROADCAST_ROWS`` rows and beyond that by a join with the texts that hold
them. Texts are scanned once; they are staged with their spans and row numbers.

Defined results: null and empty texts stay as they are with no entities; repeated rows get
equal results; texts are scanned whole; an empty table gives an empty result. Extra columns
are ignored by ``replaced()``.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

KEY = "kinfold-demo-key"  # a parameter; production passes its own secret
BROADCAST_ROWS = 100_000
FORMAT_TRIES = 6
MOST_SYLLABLES = 24  # what the 128 bits of a hash give

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NUMBER = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[-.]\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)")
IPV4 = re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}(?:[ .-]\d{2,4}){1,2}(?!\w|[-.]\d)")
PHONE_PLUS = re.compile(r"(?<![\w+])\+\d{8,14}(?!\w)")

#: Titles by gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "Κύριος", "Κύριο"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "доктор", "Δρ"),
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+|[А-ЯЁ][а-яё-]+|[Α-ΩΆ-Ώ][α-ωά-ώ-]+)"
NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(_GENDER, key=len, reverse=True))})\.? ({_CAP}(?: {_CAP}){{0,2}})")
CJK_NAME = re.compile(r"([一-鿿]{2,3})(先生|女士|小姐)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_POSSESSIVE = re.compile(r"(?:['’]s|['’-]+)$")
_CJK_RUN = re.compile("[一-鿿]{2,}")

#: Syllables and endings of names, by script.
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "ha", "he", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "so", "ta", "te", "to", "va"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "во", "га", "да", "де", "до", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "со", "та", "те", "то", "фа", "ха"),
    "greek": ("βα", "βε", "βο", "γα", "γε", "δα", "δε", "δο", "κα", "κε", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "πα", "πε", "πο", "ρα", "ρε", "ρο", "σα", "σο", "τα", "τε", "το", "φα"),
    "cjk": tuple("安白成达恩方高何江康李林马明南宁平齐任山石天王文向新杨永远云张正"),
}
ENDINGS = {
    "latin": {"given:m": "n", "given:f": "na", "given:n": "l", "surname": "ler"},
    "cyrillic": {"given:m": "н", "given:f": "на", "given:n": "ль", "surname": "нко"},
    "greek": {"given:m": "ς", "given:f": "να", "given:n": "λ", "surname": "κης"},
    "cjk": {"given:m": "", "given:f": "", "given:n": "", "surname": ""},
}


def _keyed(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permuted(key: bytes, tweak: str, x: int, n: int) -> int:
    """A keyed bijection of 0 .. n-1."""
    if n < 2:
        return x
    side = math.isqrt(n - 1) + 1
    while True:
        left, right = divmod(x, side)
        for turn in range(6):
            left, right = right, (left + _keyed(key, tweak, n, turn, right)) % side
        x = left * side + right
        if x < n:
            return x


def _chars(key: bytes, tweak: str, text: str) -> str:
    """Letters to letters and digits to digits; other characters stay. A bijection of all strings of a shape."""
    radix = [26 if "a" <= c <= "z" else 10 if "0" <= c <= "9" else 1 for c in text]
    x, n = 0, 1
    for c, r in zip(text, radix, strict=True):
        if r > 1:
            x, n = x * r + (ord(c) - (97 if r == 26 else 48)), n * r
    shape = "".join("a" if r == 26 else "0" if r == 10 else c for c, r in zip(text, radix, strict=True))
    x = permuted(key, f"{tweak}|{shape}", x, n)
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if r > 1:
            x, d = divmod(x, r)
            c = chr((97 if r == 26 else 48) + d)
        out.append(c)
    return "".join(reversed(out))


def _digits(key: bytes, tweak: str, digits: str) -> str:
    """Digits to as many digits; a first digit that is not 0 stays so."""
    if not digits:
        return digits
    if digits[0] == "0":
        return "0" + str(permuted(key, tweak + "|0", int(digits[1:] or 0), 10 ** (len(digits) - 1))).zfill(len(digits) - 1) if len(digits) > 1 else "0"
    low = 10 ** (len(digits) - 1)
    return str(low + permuted(key, f"{tweak}|{len(digits)}", int(digits) - low, 9 * low))


def luhn(digits: str) -> int:
    """The sum that is a multiple of 10 for a right card number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country) + '00') % 97:02d}"


_PRIVATE = tuple(ipaddress.ip_network(net) for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"))


def _ip_range(value: int) -> tuple[str, int, int]:
    """(name, first, count) of the range that the address must stay in: its private block, the public or the reserved addresses."""
    for block in _PRIVATE:
        if ipaddress.ip_address(value) in block:
            return str(block), int(block.network_address), block.num_addresses
    return "public" if 1 <= value >> 24 <= 223 else "reserved", 0, 1 << 32


def surrogate(key: str, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    k = hashlib.blake2b(key.encode()).digest()[:32]
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = value.partition("@")
        *labels, top = domain.split(".")
        x, more = _keyed(k, tweak, "more", value), ""
        for _ in range(attempt):
            x, d = divmod(x, 26)
            more += chr(97 + d)
        return _chars(k, tweak, local) + more + "@" + ".".join([_chars(k, "domain", x) for x in labels] + [top])
    if kind == "card":
        body = value[0] + str(permuted(k, f"{tweak}|{value[0]}|{len(value)}", int(value[1:-1]), 10 ** (len(value) - 2))).zfill(len(value) - 2)
        return body + str(-luhn(body + "0") % 10)
    if kind == "account":
        while luhn(value := _digits(k, tweak, value)) % 10 == 0:
            pass  # walks the cycle on past numbers that would do as cards
        return value
    if kind == "iban":
        rest = _chars(k, tweak + value[:2], value[4:].lower()).upper()
        return value[:2] + _iban_check(value[:2], rest) + rest
    if kind == "ip":
        x = int(ipaddress.ip_address(value))
        own = name, first, n = _ip_range(x)
        while True:  # walks the cycle on until it is back in its range
            x = first + permuted(k, tweak + name, x - first, n)
            if _ip_range(x) == own:
                return str(ipaddress.ip_address(x))
    if kind.startswith("name:"):
        _, script, role = kind.split(":", 2)
        x, syl = _keyed(k, tweak, value), SYLLABLES[script]
        out = ""
        for _ in range(min(MOST_SYLLABLES, ((1 if role == "surname" else 2) if script == "cjk" else 3) + attempt)):
            x, d = divmod(x, len(syl))
            out += syl[d]
        return out + ENDINGS[script][role]
    return _digits(k, tweak, value)


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "cjk" if c >= "一" else "latin"


def _free(found: list, spans: list) -> list:
    """Those of ``spans`` that overlap none of ``found``; both in order and apart."""
    starts = [x[0] for x in found]
    out = []
    for s in spans:
        i = bisect_left(starts, s[1])
        if not i or found[i - 1][1] <= s[0]:
            out.append(s)
    return out


def _again(text: str, names: list[list[tuple[str, str]]]) -> list[tuple[int, int, str, str]]:
    """All capitalised mentions of ``names``, each a list of (kind, word).

    A word with several kinds takes that of its neighbour's name, else that of a given name
    before another name and of a surname elsewhere.
    """
    kinds: dict[str, list[str]] = {}
    pairs: dict[tuple[str, str], tuple[str, str]] = {}
    for name in names:
        for kind, word in name:
            if kind not in kinds.setdefault(word, []):
                kinds[word].append(kind)
        for (k, a), (l, b) in zip(name, name[1:], strict=False):
            pairs.setdefault((a, b), (k, l))
    seen: list[tuple[int, int, str]] = []
    for m in _TOKEN.finditer(text):
        word = m[0].lower()
        core = _POSSESSIVE.sub("", word)
        if word in kinds:
            seen.append((*m.span(), word))
        elif core in kinds:
            seen.append((m.start(), m.start() + len(core), core))
        else:  # parts of a compound name
            seen += [(m.start() + p.start(), m.start() + p.end(), p[0].lower()) for p in _LETTERS.finditer(m[0]) if p[0].lower() in kinds]
    seen = [x for x in seen if text[x[0]].isupper()]
    out, before = [], None
    for i, (a, b, word) in enumerate(seen):
        after = seen[i + 1][2] if i + 1 < len(seen) and text[b : seen[i + 1][0]] == " " else None
        if before and (before, word) in pairs:
            kind = pairs[before, word][1]
        elif after and (word, after) in pairs:
            kind = pairs[word, after][0]
        else:
            kind = next((k for k in kinds[word] if k.endswith(":surname") != bool(after)), kinds[word][0])
        out.append((a, b, kind, word))
        before = word if after else None
    return out


def _cjk_again(text: str, names: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """All mentions of CJK ``names`` (name, kind of the given name) as a whole, and of their given names of two characters."""
    whole, given = {}, {}
    for name, kind in names:
        whole.setdefault(name, kind)
        if len(name) > 2:
            given.setdefault(name[1:], kind)
    out = []
    for m in _CJK_RUN.finditer(text):
        a = m.start()
        while a < m.end() - 1:
            name = next((text[a : a + n] for n in (3, 2) if a + n <= m.end() and text[a : a + n] in whole), None)
            if name:
                out += [(a, a + 1, "name:cjk:surname", name[0]), (a + 1, a + len(name), whole[name], name[1:])]
            elif text[a : a + 2] in given:
                name = text[a : a + 2]
                out.append((a, a + 2, given[name], name))
            a += len(name or " ")
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of all entities, in order and apart; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []

    def add(spans: list[tuple[int, int, str, str]]):
        if spans:
            found[:] = sorted(found + _free(found, spans))

    if "@" in text:
        add([(*m.span(), "email", m[0].lower()) for m in EMAIL.finditer(text)])
    if _DIGIT.search(text):
        ibans = [(*m.span(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text)]
        add([x for x in ibans if _iban_check(x[3][:2], x[3][4:]) == x[3][2:4]])
        digits = lambda m: re.sub(r"\D", "", m[0])
        add([(*m.span(), "account" if luhn(digits(m)) % 10 else "card", digits(m)) for m in NUMBER.finditer(text)])
        add([(*m.span(), "ssn", digits(m)) for m in SSN.finditer(text)])
        add([(*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split("."))) for m in IPV4.finditer(text)])
        for pattern in (PHONE, PHONE_PLUS):
            phones = []
            for m in pattern.finditer(text):
                value = digits(m)
                if 9 <= len(value) <= 15:
                    # the country code stays; +1 is left out, so that both ways to write a number agree
                    code = re.match(r"\+(\d{1,3})(?=[ .(-])", m[0])
                    cut = len(code[1]) if code else 0
                    phones.append((*m.span(), "phone" if value[:cut] in ("", "1") else f"phone:{value[:cut]}", value[cut:]))
            add(phones)
    titled, names = [], []
    for m in NAME.finditer(text):
        words = list(re.finditer(_CAP, m[2]))
        names.append([])
        for i, w in enumerate(words):
            role = "surname" if i == len(words) - 1 else f"given:{_GENDER[m[1]]}"
            word = _POSSESSIVE.sub("", w[0])
            at = m.start(2) + w.start()
            names[-1].append((f"name:{_script(word)}:{role}", word.lower()))
            titled.append((at, at + len(word), *names[-1][-1]))
    # a given name whose gender its title does not tell, or that stands alone after a title, is as another name has it
    long = [x for name in names if len(name) > 1 for x in name]
    known: dict[str, str] = {}
    for kind, word in sorted(long, key=lambda x: x[0].endswith(":n")):
        if ":given:" in kind:
            known.setdefault(word, kind)
    last = {word for kind, word in long if kind.endswith(":surname")}
    alone = {name[0][1] for name in names if len(name) == 1} - last

    def settled(kind: str, word: str) -> str:
        return known.get(word, kind) if kind.endswith(":given:n") or word in alone else kind

    add([(a, b, settled(kind, word), word) for a, b, kind, word in titled])
    if names:
        add(_again(text, [[(settled(kind, word), word) for kind, word in name] for name in names]))
    if _CJK.search(text):
        before, cjk = [], []
        for m in CJK_NAME.finditer(text):
            kind = f"name:cjk:given:{'m' if m[2] == '先生' else 'f'}"
            cjk.append((m[1], kind))
            before += [(m.start(1), m.start(1) + 1, "name:cjk:surname", m[1][0]), (m.start(1) + 1, m.end(1), kind, m[1][1:])]
        add(before)
        if cjk:
            add(_cjk_again(text, cjk))
    return found


_DIGIT = re.compile(r"\d")
_CJK = re.compile("[一-鿿]")


def shaped(mention: str, kind: str, canonical: str, new: str) -> str:
    """The surrogate in the mention's punctuation and case."""
    if kind in ("email", "ip"):
        return "".join(c.upper() if i < len(mention) and mention[i].isupper() else c for i, c in enumerate(new))
    if kind.startswith("name:"):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    kept = sum(c.isalnum() for c in mention) - len(new)  # a country code
    out, digits, seen = [], iter(new), 0
    for c in mention:
        if c.isalnum():
            out.append(c if seen < kept else next(digits))
            seen += 1
        else:
            out.append(c)
    return "".join(out)


def replace(text: str, spans: list[tuple[int, int, str, str]], key: str, exceptions: dict[tuple[str, str], str]) -> tuple[str, Counter]:
    out, at, kinds = [], 0, Counter()
    for a, b, kind, value in spans:
        new = exceptions.get((kind, value))
        if new is None:
            new = surrogate(key, kind, value)
        out += [text[at:a], shaped(text[a:b], kind, value, new)]
        at = b
        kinds[kind.split(":")[0]] += 1
    return "".join([*out, text[at:]]), kinds


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, text) and their spans."""
    for batch in batches:
        spans = [[dict(zip("a b kind value".split(), x, strict=True)) for x in detect(t)] if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS)], [*batch.schema.names, "spans"])


def _surrogates(key: str, attempt: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column("kind"), batch.column("value")
            yield pa.RecordBatch.from_arrays([kinds, values, pa.array([surrogate(key, k, v, attempt) for k, v in zip(kinds.to_pylist(), values.to_pylist(), strict=True)], pa.string())], ["kind", "value", "new"])

    return run


_NEW = "kind string, value string, new string"
_NAMED = "kind like 'name:%'"


def _space(df: DataFrame) -> DataFrame:
    """``df`` and ``space``: the kinds whose surrogates must all differ."""
    return df.withColumn("space", F.when(F.expr(_NAMED), F.substring_index("kind", ":", 2)).otherwise(F.col("kind")))


def _settled(entities: DataFrame) -> DataFrame:
    """(kind, value, to): given names whose titles tell no gender, and the kind that more mentions in the corpus tell."""
    told = entities.where("kind like 'name:%:given:m' or kind like 'name:%:given:f'").select(F.substring_index("kind", ":", 3).alias("_of"), "value", "kind", "n")
    most = told.groupBy("_of", "value").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind"))["kind"].alias("to"))
    return entities.where("kind like 'name:%:given:n'").withColumn("_of", F.substring_index("kind", ":", 3)).join(most, ["_of", "value"]).select("kind", "value", "to")


def resolved(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, new: the exceptions, for entities (kind, value and optionally n, their mentions) whose first surrogate is not theirs alone."""
    if "n" not in entities.columns:
        entities = entities.withColumn("n", F.lit(1).cast("long"))
    alias = stage(_settled(entities), "pii-settled")
    entities = entities.select("kind", "value").join(alias.select("kind", "value"), ["kind", "value"], "left_anti")
    first = stage(_space(entities.mapInArrow(_surrogates(key, 0), _NEW)), "pii-first")
    real = first.select("space", F.col("value").alias("new")).distinct()
    both = first.select("space", "new", F.struct("kind", "value").alias("who")).unionByName(real.withColumn("who", F.lit(None).cast("struct<kind:string,value:string>")))
    sums = both.groupBy("space", "new").agg(F.count("who").alias("_n"), F.count_if(F.col("who").isNull()).alias("_r"), F.min("who").alias("_least"))
    bad = sums.where("_n > 0 and (_n > 1 or _r > 0)")
    left = stage(first.join(bad, ["space", "new"]).where((F.col("_r") > 0) | (F.struct("kind", "value") != F.col("_least"))).select("kind", "value"), "pii-left")
    done, taken = first.select("kind", "value", "new").limit(0), first.select("space", "new")
    for attempt in itertools.count(1):
        if left.isEmpty():
            break
        if attempt > FORMAT_TRIES:
            full = left.where(f"not ({_NAMED}) and kind <> 'email'")
            done = done.unionByName(first.join(full, ["kind", "value"]).select("kind", "value", "new"))
            left = left.where(f"{_NAMED} or kind = 'email'")
        tried = stage(_space(left.mapInArrow(_surrogates(key, attempt), _NEW)), "pii-tried")
        free = tried.join(real, ["space", "new"], "left_anti").join(taken, ["space", "new"], "left_anti")
        won = free.groupBy("space", "new").agg(F.min(F.struct("kind", "value")).alias("_w")).select("_w.kind", "_w.value", "new", "space")
        won = stage(won, "pii-won")
        done = done.unionByName(won.select("kind", "value", "new"))
        taken = taken.unionByName(won.select("space", "new"))
        left = stage(left.join(won, ["kind", "value"], "left_anti"), "pii-left")
    done = stage(done, "pii-done")
    same = alias.join(first.select(F.col("kind").alias("to"), "value", F.col("new").alias("_first")), ["to", "value"])
    same = same.join(done.select(F.col("kind").alias("to"), "value", F.col("new").alias("_done")), ["to", "value"], "left")
    return done.unionByName(same.select("kind", "value", F.coalesce("_done", "_first").alias("new")))


def _replaced(key: str, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = shared.value if shared else {}
        for batch in batches:
            texts, counts, kinds = [], [], []
            own = batch.column("own").to_pylist() if "own" in batch.schema.names else [None] * batch.num_rows
            for t, spans, o in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), own, strict=True):
                exceptions = {(x["kind"], x["value"]): x["new"] for x in o} if o else fixed
                new, found = replace(t, [(x["a"], x["b"], x["kind"], x["value"]) for x in spans], key, exceptions) if spans else (t, Counter())
                texts.append(new)
                counts.append(sum(found.values()))
                kinds.append(",".join(f"{k}:{found[k]}" for k in sorted(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_entities", "kinds", "text"])

    return run


def replaced(docs: DataFrame, key: str = KEY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_entities, kinds (``kind:count``, comma-joined) and text with surrogates, for every row."""
    sc = docs.sparkSession.sparkContext
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    found = stage(slim.mapInArrow(_detected, "rid long, doc_id long, text string, spans array<struct<a:int,b:int,kind:string,value:string>>"), "pii-spans")
    mentions = found.select("rid", F.explode("spans").alias("_s")).select("rid", "_s.kind", "_s.value")
    entities = stage(mentions.groupBy("kind", "value").agg(F.count("*").alias("n")), "pii-entities")
    exceptions = stage(resolved(entities, key), "pii-exceptions")
    out = "doc_id long, n_entities long, kinds string, text string"
    if exceptions.count() <= broadcast_rows:
        shared = sc.broadcast({(r["kind"], r["value"]): r["new"] for r in exceptions.collect()})
        return found.select("doc_id", "text", "spans").mapInArrow(_replaced(key, shared), out)
    own = mentions.distinct().join(exceptions, ["kind", "value"]).groupBy("rid").agg(F.collect_list(F.struct("kind", "value", "new")).alias("own"))
    return found.join(own, "rid", "left").select("doc_id", "text", "spans", "own").mapInArrow(_replaced(key, None), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents"))
