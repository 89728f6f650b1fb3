"""Keyed surrogates for personal data and credentials (operator 3).

Detection finds entities of a type in a text; a surrogate is drawn for each distinct entity
of the corpus from a keyed hash of its type and normal form, character by character in the
same class (script, case, digit) so that it keeps the format, and for names with the ending
of the gender that the title names.  The draws are checked against each other and against
all entities of the corpus: of entities that drew the same surrogate one keeps it and the
others draw again, as do those that drew something that really occurs.  So equal entities
have equal surrogates everywhere and different ones different surrogates.

A person is found by a title; the words of the name then count wherever they stand capitalised
in that text, with or without title, initials and other words of the name.  Each word of a name
is an entity of its own and begins with a letter that only the key and its first letter give, so
full names, parts of them and initials agree.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkeda.llm.common import written

#: Titles before a personal name (fixed values): title -> gender, n if it names none.
TITLES = {"Mr": "m", "Mr.": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Herrn": "m",
          "Frau": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr.": "m", "Sra.": "f", "Monsieur": "m", "Madame": "f", "Mme": "f",
          "Mademoiselle": "f", "господин": "m", "госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "n", "Dr.": "n", "Prof": "n", "Prof.": "n",
          "Professor": "n"}
#: Small words inside a name, which stay (fixed values).
PARTICLES = set("van von der den ten ter zu de la le las los du del della di da dos das al el bin ibn y e".split())
#: Letters that drawn names use and the last letters by gender, by script (fixed values).
NAME_LETTERS = {"LATIN": ("aeiou", "bdfgklmnprstv"), "CYRILLIC": ("аеиоу", "бвгдклмнпрст"), "GREEK": ("αεηιου", "βγδκλμνπρστ")}
NAME_ENDS = {"LATIN": {"m": "onrs", "f": "ae", "n": "iltk"}, "CYRILLIC": {"m": "нрвм", "f": "ая", "n": "коит"},
             "GREEK": {"m": "ςν", "f": "αη", "n": "ορι"}}
ALPHABETS = {"LATIN": string.ascii_lowercase, "CYRILLIC": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
_TITLE = "(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + ")"
_GAP = "  -"
#: A word of a name: initials with their dots, or letters with an inner apostrophe.
_NAME_WORD = re.compile(r"(?:[^\W\d_]\.)+(?!\w)|[^\W\d_]+(?:['’][^\W\d_]{2,})?(?!\w)")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A word of two letters or more with the initials before it.
_WITH_INITIALS = re.compile(rf"(?<!\w)((?:[^\W\d_](?:['’]|\.[{_GAP}]?))*)([^\W\d_]{{2,}})")
#: Types in order of precedence; the group that holds the entity has the type's name.
PATTERNS = (
    ("email", r"(?<![.+%-])[\w.+%-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    ("aws_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    # the keyword stands anywhere in an identifier; a quoted value goes to its quote, another one to white space
    ("pem", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----(?P<_pem>(?:[^-]|-(?!----))++)(?=-----END)"),
    ("jwt", r"(?<!-)eyJ[\w-]{8,}+\.eyJ[\w-]{8,}+\.[\w-]{8,}+"),
    # prefixes that issuers give their tokens (fixed values)
    ("token", r"(?<!-)(?:gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|(?:sk|pk|rk)_(?:live|test)_|hf_|npm_|AIza|sk-(?=[A-Za-z0-9_]{20}|proj-|ant-))"
              r"(?=[\w-]{0,80}\d)[\w-]{16,}+"),
    ("secret", r"(?:\w*?(?i:api-key)\w*+|(?=\w*?(?i:password|passwd|pwd|token|secret|api_?key))\w++)(?:[-.]\w++){0,4}[\"']?[ \t]{0,4}(?:=>|:=|[=:])[ \t]{0,4}"
               r"(?:\"(?P<_double>(?:\\.|[^\"\\\n]){8,}+)\"|'(?P<_single>(?:\\.|[^'\\\n]){8,}+)'|(?=\S*[^\W_])(?P<_plain>[^\s\"']\S{7,})|[\"'](?P<_open>[^\s\"']{8,}))"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("ipv6", r"(?<![\w:])(?=[A-Fa-f:]*[0-9])(?=[0-9A-Fa-f:]{0,40}::|(?:[0-9A-Fa-f]{1,4}:){7})(?:[0-9A-Fa-f]{1,4}|:)(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![\w:])"),
    ("card", r"(?<![.+-])3[47]\d{2}(?P<_gap>[ -])\d{6}(?P=_gap)\d{5}(?!\d)|(?<![.+-])[2-6]\d{3}(?P<_sep>[ -]?)\d{4}(?P=_sep)\d{4}(?P=_sep)\d{3,4}(?!\d)"),
    ("ssn", r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<!\+)(?:0|\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?)[1-9](?:[ .-]\d{2}){4}(?!\d)|(?<!\+)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<!\+)\+\d{8,15}(?!\d)"),
    ("name", rf"(?P<_titles>{_TITLE}(?:[{_GAP[:2]}]{_TITLE})*)[{_GAP[:2]}](?=[^\W\d_])"),  # the name itself is read word by word
)
#: What a text needs for a secret, in lower case, for a key or token, and for any other type than those with a digit or a title.
KEYWORDS, SIGNS = ("passw", "pwd", "token", "secret", "api"), ("@", "AKIA", "ASIA")
KEY_SIGNS = ("PRIVATE KEY", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "_live_", "_test_", "hf_", "npm_", "AIza", "sk-")
_FOUND: dict = {}


def _pattern(secrets: bool, keys: bool) -> re.Pattern:
    """All types at once, but for secrets, keys and tokens where the text can't have them; an entity begins where no word
    character stands before it."""
    if (secrets, keys) not in _FOUND:
        left = [(kind, p) for kind, p in PATTERNS if (secrets or kind != "secret") and (keys or kind not in ("pem", "jwt", "token"))]
        _FOUND[secrets, keys] = re.compile(r"(?<!\w)(?:" + "|".join(f"(?P<{kind}>{p})" for kind, p in left) + ")")
    return _FOUND[secrets, keys]


def detect(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of the entities of a text, in order, without overlap.  Names have the types ``name_m``, ``name_f``
    and, after a title that names no gender and without another mention that does, ``name_n``; a name goes from its title over
    capitalised words, initials and small words between them."""
    out, people = [], []
    low = text.lower()
    secrets, keys, titled = any(k in low for k in KEYWORDS), any(k in text for k in KEY_SIGNS), any(t in text for t in TITLES)
    if not (secrets or keys or titled) and not any(x in text for x in SIGNS) and not re.search(r"\d", text):
        return out
    search, at = _pattern(secrets, keys).search, 0
    while m := search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "name":
            end = _name_end(text, m.end())
            if end > m.end():
                gender = next((g for g in (TITLES[t] for t in re.split(f"[{_GAP[:2]}]", m["_titles"])) if g != "n"), "n")
                people.append(len(out))
                out.append((m.end(), end, "name_" + gender))
                at = end
        elif kind == "secret":
            group = next(g for g in ("_double", "_single", "_plain", "_open") if m[g] is not None)
            out.append((m.start(group), m.end(group), kind))
        elif kind == "pem":
            out.append((m.start("_pem"), m.end("_pem"), kind))
        elif kind != "ipv6" or _address(m[0]):
            out.append((m.end() - len(m[0].lstrip(".+%-")) if kind == "email" else m.start(), m.end(), kind))
    return _mentions(text, out, people) if people else out


def _name_end(text: str, start: int) -> int:
    """Where the name that begins at ``start`` ends; ``start`` if there is none."""
    end = at = start
    full = False
    while w := _NAME_WORD.match(text, at):
        if w[0][0].isupper():
            end, full = w.end(), full or len(w[0]) > 1 and w[0][1] != "."
        elif w[0] not in PARTICLES:
            break
        at = w.end() + 1
        if text[w.end():at] not in tuple(_GAP):
            break
    return end if full else start


def _words(name: str) -> list[str]:
    """The words of a name in normal form, without initials and small words."""
    return [w.casefold() for w in _LETTERS.findall(name) if len(w) > 1 and w not in PARTICLES]


def _mentions(text: str, out: list, people: list[int]) -> list[tuple[int, int, str]]:
    """The entities with the other mentions of the people among them.  A name without gender takes that of a titled one with the
    same last word; other mentions take the gender that all their words have in the text, of several the one met first."""
    kinds: dict[str, dict] = {}  # word -> the types it has, in order
    first = set()
    for k in people:
        for w in _words(text[out[k][0]:out[k][1]]):
            if out[k][2] != "name_n":
                kinds.setdefault(w, {})[out[k][2]] = True
    for k in people:
        s, e, kind = out[k]
        words = _words(text[s:e])  # none if small words follow an initial only, as in D'al
        if kind == "name_n" and words:
            kind = next(iter(kinds.get(words[-1], ())), kind)
            out[k] = (s, e, kind)
        for w in words:
            kinds.setdefault(w, {})[kind] = True
        first.update(x[0].casefold() for x in _LETTERS.findall(text[s:e]))
    more, taken = [], 0
    for m in _WITH_INITIALS.finditer(text):
        if m[2].casefold() not in kinds or not m[2][0].isupper():
            continue
        initials = [x for x in m[1] if x.isalpha()]
        start = m.start() if initials and all(x.isupper() and x.casefold() in first for x in initials) else m.start(2)
        while taken < len(out) and out[taken][1] <= start:
            taken += 1
        if taken < len(out) and out[taken][0] < m.end():
            continue  # inside an entity
        had = kinds[m[2].casefold()]
        if more and more[-1][1] + 1 == start and text[more[-1][1]] in _GAP and (both := [x for x in more[-1][2] if x in had]):
            more[-1] = (more[-1][0], m.end(), both)
        else:
            more.append((start, m.end(), list(had)))
    return sorted([*out, *((s, e, which[0]) for s, e, which in more)])


def _address(text: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(text)
    except ValueError:
        return None


_DIGITS_ONLY = ("card", "ssn", "phone", "iban")


def normal(kind: str, value: str) -> str:
    """The form that mentions of one entity share."""
    if kind in _DIGITS_ONLY:  # digits of any script are one
        return re.sub(r"[^0-9A-Za-z]", "", value if value.isascii() else re.sub(r"\d", lambda m: str(unicodedata.decimal(m[0])), value))
    if kind == "email":
        return value.lower()
    if kind == "ipv6":
        return ":".join(f"{int(x, 16):x}" for x in _address(value).exploded.split(":"))
    if kind == "pem":
        return re.sub(r"\s", "", value)
    return value


def parts(kind: str, mention: str) -> list[str]:
    """The entities of a mention in normal form: the words of a name, else one."""
    return _words(mention) if kind.startswith("name") else [normal(kind, mention)]


def draw(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of a normal form.  Further attempts draw anew; every eighth makes room by one more character."""
    stream = _stream(key, f"{kind}\x00{attempt}\x00{value}")
    extra = attempt // 8
    if kind.startswith("name"):
        return _name(key, stream, value, kind[-1], attempt // 3)
    if kind in ("token", "jwt"):  # the prefix and a token's segments stay
        prefix = re.match(r"(?:github_pat_|glpat-|[a-z]{2}_(?:live|test)_|sk-proj-|sk-ant-|xox.-|AIza|[a-z]{2,3}_|sk-|eyJ)", value)[0]
        return prefix + ".".join(x[:3] + _like(stream, x[3:]) if k and kind == "jwt" and x.startswith("eyJ") else _like(stream, x)
                                 for k, x in enumerate(value[len(prefix):].split("."))) + "".join(str(next(stream) % 10) for _ in range(extra))
    if kind == "ip":
        parts = value.split(".")
        if extra:  # all addresses of the form are taken: a form of its own
            parts += ["0"] * extra
        room = {1: (1, 9), 2: (10, 90), 3: (100, 155)}  # as many digits as before: the least number, how many
        return ".".join(str(room[len(x)][0] + next(stream) % room[len(x)][1]) for x in parts)
    if kind == "ipv6":  # groups of zeros stay, others keep their digits
        groups = [x if x == "0" else "123456789abcdef"[next(stream) % 15] + "".join("0123456789abcdef"[next(stream) % 16] for _ in range(min(3, len(x) - 1 + extra)))
                  for x in value.split(":")]
        return ":".join(groups)
    if kind == "email":
        name, _, domain = value.rpartition("@")
        labels = domain.split(".")
        host = [_like(stream, x) for x in labels[:-1]]
        return _like(stream, name) + "".join(_like(stream, "x") for _ in range(extra)) + "@" + ".".join([*host, labels[-1]])
    if kind == "aws_key":
        return value[:4] + "".join(_like(stream, c) for c in value[4:] + "A" * extra)
    if kind == "card":
        lead = 2 if len(value) == 15 else 1  # the issuer's digits that the 4-6-5 form needs
        body = value[:lead] + "".join(str(next(stream) % 10) for _ in value[lead:-1]) + "0" * extra
        return body + _luhn(body) if _luhn(value[:-1]) == value[-1] else body + str(next(stream) % 10)
    if kind == "phone":
        keep = 1 if len(value) > 10 or value[0] == "0" else 0
        rest = "".join(str(next(stream) % 10) for _ in value[keep:])
        return value[:keep] + str(2 + next(stream) % 8) + rest[1:] + "".join(str(next(stream) % 10) for _ in range(extra))
    if kind == "iban":
        return value[:2] + _like(stream, value[2:]) + "".join(str(next(stream) % 10) for _ in range(extra))
    return _like(stream, value + "0" * extra)


def render(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate in the format of a mention: its separators and its case."""
    if kind in _DIGITS_ONLY:
        left = iter(surrogate)
        out = "".join(_digit_as(c, next(left, "")) if c.isalnum() else c for c in mention)
        return out + "".join(left)
    if kind == "ipv6":
        left = iter([x for x in surrogate.split(":") if x != "0"])
        return re.sub(r"[0-9A-Fa-f]+", lambda m: m[0] if int(m[0], 16) == 0 else next(left).zfill(len(m[0])), mention)
    if kind == "email":
        return surrogate.upper() if mention.isupper() else surrogate
    if kind == "pem":
        left = iter(surrogate)
        return re.sub(r"\S", lambda m: next(left), mention) + "".join(left)
    return surrogate


def _digit_as(c: str, new: str) -> str:
    """A digit in the script of the digit that it stands for."""
    return new if c.isascii() or not new.isdecimal() else chr(ord(c) - unicodedata.decimal(c) + int(new))


def surrogate(key: bytes, kind: str, mention: str, attempts: dict[str, int]) -> str:
    """What replaces a mention; ``attempts`` has, as ``kind\\0value``, the entities whose first draw did not stand."""
    if not kind.startswith("name"):
        value = normal(kind, mention)
        return render(kind, mention, draw(key, kind, value, attempts.get(f"{kind}\x00{value}", 0)))

    def word(m):
        if m[0] in PARTICLES:
            return m[0]
        if len(m[0]) == 1:
            return _initial(key, m[0])
        got = draw(key, kind, m[0].casefold(), attempts.get(f"{kind}\x00{m[0].casefold()}", 0))
        return got.upper() if m[0].isupper() else got.capitalize()

    return _LETTERS.sub(word, mention)


def _stream(key: bytes, text: str):
    k = 0
    while True:
        h = hashlib.blake2b(f"{k}\x00{text}".encode("utf-8", "surrogatepass"), key=key).digest()
        yield from (int.from_bytes(h[i:i + 4], "little") for i in range(0, 64, 4))
        k += 1


def _like(stream, text: str) -> str:
    """Letters and digits replaced by others of their class; hexadecimal words stay hexadecimal."""
    hexa = len(text) >= 12 and not text.isdigit() and re.fullmatch(r"[0-9a-f]+", text)
    out = []
    for c in text:
        if hexa:
            out.append("0123456789abcdef"[next(stream) % 16])
        elif c.isdigit():
            out.append(str(next(stream) % 10))
        elif "a" <= c <= "z":
            out.append(chr(97 + next(stream) % 26))
        elif "A" <= c <= "Z":
            out.append(chr(65 + next(stream) % 26))
        elif c.isalpha():
            letters = "".join(NAME_LETTERS.get(_script(c), NAME_LETTERS["LATIN"]))
            got = letters[next(stream) % len(letters)]
            out.append(got.upper() if c.isupper() else got)
        else:
            out.append(c)
    return "".join(out)


def _script(c: str) -> str:
    return unicodedata.name(c, "LATIN").split(" ")[0]


_ORDERS: dict = {}


def _initial(key: bytes, letter: str) -> str:
    """The letter that stands for a first letter: the key orders the script's letters anew, so that none stands for two."""
    script = _script(letter) if _script(letter) in ALPHABETS else "LATIN"
    base = letter.lower() if letter.lower() in ALPHABETS[script] else unicodedata.normalize("NFD", letter)[0].lower()
    if (key, script) not in _ORDERS:
        order = sorted(ALPHABETS[script], key=lambda c: hashlib.blake2b(c.encode(), key=key).digest())
        _ORDERS[key, script] = dict(zip(ALPHABETS[script], order))
    got = _ORDERS[key, script].get(base) or ALPHABETS[script][next(_stream(key, base)) % len(ALPHABETS[script])]
    return got.upper() if letter.isupper() else got


def _name(key: bytes, stream, word: str, gender: str, extra: int) -> str:
    """A pronounceable name of the word's length and script that ends as the gender does."""
    script = _script(word[0]) if _script(word[0]) in NAME_LETTERS else "LATIN"
    vowels, others = NAME_LETTERS[script]
    ends = NAME_ENDS[script][gender]
    size = max(4, len(word)) + extra
    first = _initial(key, word[0])
    body = "".join((others, vowels)[(k + (first not in vowels)) % 2][next(stream) % len((others, vowels)[(k + (first not in vowels)) % 2])] for k in range(size - 2))
    return first + body + ends[next(stream) % len(ends)]


def _luhn(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kind, value)``: the distinct entities of each row, in normal form; of a name its words."""
    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if t:
                    rows += [(i, *e) for e in {(k, v) for s, e, k in detect(t) for v in parts(k, t[s:e])}]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])],
                                                 names=["doc_id", "kind", "value"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, kind string, value string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """``(kind, value, attempt, surrogate)`` for each distinct ``(kind, value)``, no two surrogates of a kind alike
    and none equal to a value of its kind; all names are one kind in this.

    Each round draws for what is left; the smallest value keeps a surrogate that several drew.  Rounds are
    written tables; what is left shrinks by the chance of a collision each time, and every eighth attempt has
    ten times the room or more, so the loop ends."""
    values = written(found.select("kind", "value").distinct(), "pii-values")
    group = F.regexp_replace("kind", "^name_.$", "name").alias("group")
    left, done, attempt = values, None, 0
    while True:
        def run(batches, n=attempt):
            for b in batches:
                got = [draw(key, k, v, n) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], names=["kind", "value", "surrogate"])

        drawn = written(left.mapInArrow(run, "kind string, value string, surrogate string"), "pii-drawn")
        taken = values.select(group, F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select(group, "surrogate"))
        free = drawn.withColumn("group", group).join(taken, ["group", "surrogate"], "left_anti")
        wins = free.groupBy("group", "surrogate").agg(F.min(F.struct("value", "kind")).alias("won"))
        wins = written(wins.select("won.kind", "won.value", F.lit(attempt).alias("attempt"), "surrogate"), "pii-assigned")
        done = wins if done is None else done.unionByName(wins)
        left = written(drawn.select("kind", "value").join(wins, ["kind", "value"], "left_anti"), "pii-left")
        if left.isEmpty():
            return done
        attempt += 1


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity replaced by its surrogate; other columns unchanged.

    ``count_col`` adds the number of replaced mentions.  Null and empty texts stay as they are; texts without an
    entity do not change; repeated rows change alike.  Texts are read twice and never shuffled for entities whose
    first draw stood: a worker draws that again.  Entities that drew more than once are a table joined by
    document, broadcast only if Spark finds it small enough (``spark.sql.autoBroadcastJoinThreshold``)."""
    found = written(entities(docs, id_col, text_col), "pii-found")
    again = assign(found, key).where("attempt > 0").select("kind", "value", "attempt")
    again = found.join(again, ["kind", "value"]).groupBy(F.struct("doc_id").alias("_llm_key")).agg(
        F.collect_set(F.struct("kind", "value", "attempt")).alias("_llm_again"))  # a document's own entities
    again = written(again, "pii-again")
    src = docs.withColumn("_llm_key", F.struct(F.col(id_col).cast("long").alias("doc_id"))).join(again, "_llm_key", "left")
    cols, at = docs.columns, docs.columns.index(text_col)
    src = src.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cols)],
                     F.transform("_llm_again", lambda e: F.concat_ws("\x00", e.kind, e.value)).alias("names"),
                     F.transform("_llm_again", lambda e: e.attempt).alias("attempts"))
    kinds = ", ".join([*[f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(src.schema.fields[:len(cols)])], "n long"])

    def run(batches):
        for b in batches:
            texts, counts = [], []
            for t, names, attempts in zip(b.column(at), b.column(len(cols)), b.column(len(cols) + 1)):
                t, n = t.as_py(), 0
                if t:
                    tries = dict(zip(names.as_py(), attempts.as_py())) if names.is_valid else {}
                    out, upto = [], 0
                    for s, e, kind in detect(t):
                        out += [t[upto:s], surrogate(key, kind, t[s:e], tries)]
                        upto, n = e, n + 1
                    if n:
                        t = "".join(out) + t[upto:]
                texts.append(t)
                counts.append(n)
            arrays = list(b.columns[:len(cols)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], names=[*b.schema.names[:len(cols)], "n"])

    out = src.mapInArrow(run, kinds)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(cols)], *([F.col("n").alias(count_col)] if count_col else []))
