"""Personal data: detected behind disguises, reported and redacted at the places of the source text.

Transducers rewrite a text step by step: lookalike letters, full-width forms and invisible characters;
"name [at] host (dot) tld", then in what that gives "name at host dot tld" and mixed forms; runs of spelled digits. Each keeps the list of its
rewrites, so that a span of the last text is carried back through them to the source text, where
a rewritten piece counts as a whole. Identifiers are looked for in the last text.

Defined cases: a null text stays null, with no spans; an empty one stays empty. Very long texts are read whole, in time that grows with their length.
Of overlapping findings the kind that comes first in KINDS stays, then the
one further left. Rows are independent of each other: ids may be null or repeated. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.llm.common import id_text, map_arrow, table, workers

_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁһӏ", "ABESIJKMHOPCTYXaeijopcyxsdhl")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυχ", "ABEZHIKMNOPTYXoivpux"))
_LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_LOOKALIKES |= {chr(0x660 + n): str(n) for n in range(10)} | {"‐": "-", "‑": "-", "‒": "-", "–": "-", "．": ".", "。": ".", "＠": "@", "﹫": "@"}
_ODD = re.compile(f"[{''.join(map(re.escape, _LOOKALIKES))}]")

_DIGITS = {w: str(n) for ws in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for n, w in enumerate(ws.split())} | {"oh": "0"}
_ONE = "(?:" + "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w))) + "|[0-9])"
_SPELLED = re.compile(rf"\b{_ONE}(?:[ \t]*[-,.]?[ \t]*\b{_ONE}\b){{3,}}", re.IGNORECASE)
_WORDS = "(?:" + "|".join(sorted(_DIGITS)) + ")"
_SPELLED_HINT = re.compile(rf"\b{_WORDS}[ \t,.-]+(?:{_WORDS}|[0-9])\b|\b[0-9][ \t,.-]+{_WORDS}\b")
_DIGIT = re.compile(_ONE, re.IGNORECASE)

_AT = r"(?:at|arroba|arobase|@)"
_DOT = r"(?:dot|punto|punkt|point|\.)"
_BRACKETED = re.compile(rf"[ \t]*[\[({{<][ \t]*(?:({_AT})|{_DOT})[ \t]*[\])}}>][ \t]*", re.IGNORECASE)
#: Top-level domains after a bare "dot"; those that are words of a language here (at, in, is, it, me, to, us) would turn sentences into addresses.
_TLD = "(?:com|org|net|edu|gov|mil|int|info|biz|name|mobi|aero|museum|io|ai|app|dev|co|cc|tv|uk|de|fr|es|eu|ch|nl|dk|fi|pl|cz|ru|ua|jp|cn|kr|br|mx|ar|cl|au|nz|ca|ie|pt|gr|tr|za|example|invalid|localhost)"
_SEPARATOR = rf"(?:[ \t]+{_DOT}[ \t]+|\.)"
_BARE = re.compile(rf"(?<![\w.+-])(?P<name>[\w.+-]+)(?P<at>[ \t]+{_AT}[ \t]+|@)[\w-]+(?:{_SEPARATOR}[\w-]+)*{_SEPARATOR}{_TLD}\b", re.IGNORECASE)
_BARE_PART = re.compile(rf"[ \t]+(?:({_AT})|{_DOT})[ \t]+", re.IGNORECASE)
_BARE_HINT = re.compile(rf"[ \t](?:(?:dot|punto|punkt|point)[ \t]|{_AT}[ \t]+[\w-]+\.)", re.IGNORECASE)
#: Words before "at" and a site written with plain dots ("look at example.com") that aren't the name of an address.
_PROSE = frozenset("a an and are available be been bought buy by call directly docs documentation documented down download downloaded email find found free go have help here hosted i in info information is it join learn live located look looked looking mail me meet more now of on online or order out page pages published purchase read register released see seen shop sign site store team that the them there these they this those today up us visit was we website welcome were you".split())

Edit = tuple[int, int, str]


class Step:
    """A rewritten text with what leads its spans back."""

    def __init__(self, text: str, edits: list[Edit]) -> None:
        self.edits, self.starts, self.text = edits, [], text
        if edits:
            parts, at, size = [], 0, 0
            for a, b, new in edits:
                parts += [text[at:a], new]
                size += a - at
                self.starts.append(size)
                size += len(new)
                at = b
            self.text = "".join([*parts, text[at:]])

    def made(self, start: int, end: int) -> bool:
        """Whether a rewrite made a part of this span of the text after."""
        i = bisect_right(self.starts, end - 1) - 1
        return i >= 0 and self.starts[i] + len(self.edits[i][2]) > start

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text before that the span of the text after comes from."""

        def to(at: int, right: bool) -> int:
            i = bisect_right(self.starts, at - right) - 1
            if i < 0:
                return at
            a, b, new = self.edits[i]
            into = at - self.starts[i]
            return (b if right else a) if (into <= len(new) if right else into < len(new)) else b + into - len(new)

        return to(start, False), to(end, True)


def _lookalikes(text: str) -> list[Edit]:
    return [(m.start(), m.end(), _LOOKALIKES[m[0]]) for m in _ODD.finditer(text)] if not text.isascii() else []


def _bracketed(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)] if any(c in text for c in "[({<") else []


def _bare(text: str) -> list[Edit]:
    edits: list[Edit] = []
    if _BARE_HINT.search(text):
        for m in _BARE.finditer(text):
            parts = list(_BARE_PART.finditer(text, m.start(), m.end()))
            if len(parts) == 1 and parts[0][1] and m["name"].lower() in _PROSE:
                continue
            edits += [(p.start(), p.end(), "@" if p[1] else ".") for p in parts]
    return edits


def _spelled(text: str) -> list[Edit]:
    if not _SPELLED_HINT.search(text.lower()):
        return []
    return [(m.start(), m.end(), "".join(_DIGITS.get(d.lower(), d) for d in _DIGIT.findall(m[0]))) for m in _SPELLED.finditer(text)]


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _is_iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


#: (kind, pattern, test of the match); a group 1, where there is one, is the identifier.
KINDS = [
    ("EMAIL", re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,24}(?![\w-])"), None),
    ("SECRET", re.compile(r"""(?i)\b(?:token|api[_-]?key|access[_-]?key|secret|passw(?:or)?d|pwd)\b["']?\s*[:=]\s*["']?([\w+/=.~-]{8,})"""), None),
    ("SECRET", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})"), None),
    ("IBAN", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"), _is_iban),
    ("CARD", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"), lambda m: m[0] in "23456" and _luhn(_digits(m))),
    ("IP", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])"), None),
    ("IP", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"), None),
    ("SSN", re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])"), None),
    ("PHONE", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w-]|\.[0-9])"), None),
]
#: A word right before a number that says whose it is.
_CALLED = re.compile(r"\b(?:tel|t[ée]l[ée]phone|telefono|tel[ée]fono|telefon|phone|mobile|m[óo]vil|cell|handy|portable|fax|whatsapp|sms|call|dial|ring|text|appelez|llame|llama|anrufen|ruf)\b\W{0,3}(?:(?:no|nr|number|num[ée]ro|n[úu]mero|nummer|us|me|at|on|is)\b\W{0,3}){0,2}$", re.IGNORECASE)
_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}[-. ][0-9]{2}[-. ][0-9]{2}")
_WORTH = re.compile(r"[0-9@]|(?i:token|key|secret|passw|pwd)")


def _is_phone(number: str, before: str, spelled: bool) -> bool:
    """Whether a number is written as telephone numbers are: with a country or area code, in groups of 3, 3 and 4, from 0 on in groups, after such a word, or in spelled digits.

    Other runs of digits (orders, amounts, ISBN) are left alone.
    """
    groups = re.findall("[0-9]+", number)
    if not 9 <= sum(map(len, groups)) <= 15:
        return False
    if number[0] in "+(" or spelled:
        return True
    if _DATE.match(number):
        return False
    shape = tuple(map(len, groups))
    return shape in ((3, 3, 4), (1, 3, 3, 4)) or (groups[0][0] == "0" and len(groups) > 1) or bool(_CALLED.search(before))


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source text, from left to right."""
    if not text:
        return []
    steps, now, spelled = [], text, None
    for rewrite in (_lookalikes, _bracketed, _bare, _spelled):
        step = Step(now, rewrite(now))
        if step.edits:
            steps.append(step)
            now = step.text
            spelled = step if rewrite is _spelled else None
    if not _WORTH.search(now):
        return []
    digits, at = any(c in now for c in "0123456789"), "@" in now
    found: list[tuple[int, int, str]] = []
    for kind, pattern, test in KINDS:
        if not (at if kind == "EMAIL" else digits or kind == "SECRET"):
            continue
        for m in pattern.finditer(now):
            group = 1 if pattern.groups else 0
            if test and not test(m[group]):
                continue
            start, end = m.span(group)
            if kind == "PHONE" and not _is_phone(m[0], now[max(0, start - 40) : start], spelled is not None and spelled.made(start, end)):
                continue
            for step in reversed(steps):
                start, end = step.back(start, end)
            if all(end <= a or start >= b for a, b, _ in found):
                found.append((start, end, kind))
    return sorted(found)


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_found, spans) for each document; text: redacted; spans: start, end and kind in the source text."""

    def step(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        found = [find(t) for t in texts]
        return {"doc_id": batch.column("doc_id"), "text": [redact(t, f) for t, f in zip(texts, found)], "n_found": [len(f) for f in found], "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found]}

    return map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, text string, n_found int, spans array<struct<start: int, end: int, kind: string>>")


def redact_rows(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the redacted text, and its length where there is that column; the other columns as they are."""
    workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [redact(t, find(t)) for t in batch.column(text_col).to_pylist()]
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (at := batch.schema.get_field_index(length_col)) >= 0:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema).select([F.col(f"`{c}`") for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents"))
