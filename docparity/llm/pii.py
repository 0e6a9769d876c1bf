"""Offset-preserving deobfuscation and redaction of personal data.

A text goes through a chain of transducers, each rewriting it while keeping for
every output character the source characters it stands for:

1. ``fold``: look-alike letters, full-width and foreign digits, dots, dashes
   and spaces become ASCII; invisible characters vanish;
2. ``digits``: runs of spelled digits ("five five five", "drei", "double two")
   become digits;
3. ``mail``: disguised addresses ("name (at) host [dot] org", "name at host dot
   org", "name-at-host-dot-org", "na.me at host.org") get their ``@`` and dots.

Detectors run on the normal form, and what they find is mapped back to the
span of source characters. Only detection sees the normal form: text outside
the found spans is never changed.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docparity.llm.common import slices

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("normal", T.StringType())])
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("normal", pa.string())]))

# --- transducer 1: characters ---

_LOOKS = {
    "АВЕКМНОРСТУХІЈЅԚԜ": "ABEKMHOPCTYXIJSQW",
    "аеорсухіјѕԛԝһӏ": "aeopcyxijsqwhl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οαρνυικ": "oapvuik",
    "ᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ": "abcdeghijklmnoprstuvwyz",
    "․。｡．﹒·∙": ".......",
    "‐‑‒–—―−﹣－": "---------",
    "              　": " " * 15,
    "﹫": "@",
}
_GONE = "­​‌‍‎‏⁠⁡⁢⁣﻿"
_FOLD: dict[int, str] = {ord(a): b for k, v in _LOOKS.items() for a, b in zip(k, v, strict=True)}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD |= {c: str(d) for c in range(0x80, 0x1FBFA) if (d := unicodedata.decimal(chr(c), None)) is not None}
_FOLD |= {c: n for c in range(0x1D400, 0x1D800) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
_INVISIBLE = re.compile(f"[{_GONE}]")
_FOLDED = re.compile("[" + re.escape("".join(map(chr, sorted({*_FOLD, *map(ord, _GONE)})))) + "]")

# --- transducer 2: spelled digits ---

_WORDS = {
    "zero": 0, "oh": 0, "nought": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "niner": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_TIMES = {"double": 2, "triple": 3}
_DIGIT_WORD = r"(?:(?:double|triple)\s+)?(?:" + "|".join(sorted(_WORDS, key=len, reverse=True)) + ")"
_ITEM = rf"(?:{_DIGIT_WORD}\b|[0-9]+)"
#: At least three in a row, one of them spelled; single number words are prose.
_SPELLED = re.compile(rf"(?<!\w)(?={_ITEM}[\s,.()+-]+{_ITEM})(?:{_ITEM}(?:[\s,()-]+|[.]\s*)){{2,}}{_ITEM}(?!\w)", re.I)
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD}\b[\s,.()+-]+{_ITEM}|[0-9]++[\s,.()-]+{_DIGIT_WORD}\b)", re.I)
_EACH = re.compile(rf"(?:(double|triple)\s+)?({'|'.join(sorted(_WORDS, key=len, reverse=True))}|[0-9])(?![a-zà-ÿ])", re.I)

# --- transducer 3: at and dot ---

_OPEN, _SHUT = r"[(\[{<]\s*", r"\s*[)\]}>]"
_AT_WORD, _DOT_WORD = r"(?:at|@|arroba|arobase)", r"(?:dot|punto|point|punkt|\.)"
_AT_B, _DOT_B = rf"\s*{_OPEN}{_AT_WORD}{_SHUT}\s*", rf"\s*{_OPEN}{_DOT_WORD}{_SHUT}\s*"
_DOT_ALONE = "(?:dot|punto|punkt)"
_AT_BARE, _DOT_BARE = r"\s+(?:at|arroba|arobase)\s+", rf"\s+{_DOT_ALONE}\s+"
_MARK = "[-_*~|/]"
_MARKS, _MARKS_AFTER = rf"\s*(?<!{_MARK}){_MARK}+\s*", rf"\s*{_MARK}+\s*"
_AT_M, _DOT_M = rf"{_MARKS}{_AT_WORD}{_MARKS_AFTER}", rf"{_MARKS}{_DOT_WORD}{_MARKS_AFTER}"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
# a bare "at" counts only if a dot is disguised as well: "look at example.com" is prose
_AT_HOST = re.compile(
    rf"(?:{_AT_B}|\s*@\s*){_LABEL}(?:(?:\.|{_DOT_B}|{_DOT_BARE}){_LABEL})+"
    rf"|(?:{_AT_BARE}|{_AT_M}){_LABEL}(?:\.{_LABEL})*?(?:(?:{_DOT_M}|{_DOT_B}|{_DOT_BARE}){_LABEL})+(?:\.{_LABEL})*",
    re.I,
)
_AT_DOT = re.compile(rf"(?P<at>{_AT_B}|{_AT_M}|\s*@\s*|{_AT_BARE})|(?P<dot>{_DOT_B}|{_DOT_M}|{_DOT_BARE})", re.I)
# every disguise has an at; from there the local part is read backwards, so text without one costs one pass
_AT_ANY = re.compile(rf"(?<!\s)(?:\s*+(?:[(\[{{<]\s*+{_AT_WORD}\s*+[)\]}}>]|(?<!{_MARK}){_MARK}++\s*+{_AT_WORD}(?=\s*+{_MARK})|@)|\s++(?:at|arroba|arobase)(?=\s))", re.I)
_LOCAL_BACK = re.compile(r"[\w+%-]++(?:(?:\.|\s*+[)\]}>]\s*+(?:tod|otnup|tniop|tknup|\.)\s*+[(\[{<]\s*+|\s++(?:tod|otnup|tknup)\s++)[\w+%-]++)*+", re.I)
# a bare "at" before plain dots counts after a local part that is no word: "jo.doe at example.com"
_BARE_AT = re.compile(r"(?<!\s)\s++at\s++", re.I)
_NO_WORD_BACK = re.compile(r"[\w+%.-]++")
_NO_WORD = re.compile(r"[+%-]*+(?=[^\W_][\w+%-]*[._][\w+%-])[\w+%-]++(?:\.[\w+%-]++)*+")
_PLAIN_HOST = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[a-z]{{2,}}(?!\w)", re.I)
# what each disguise has at least, of the same alternations; every address has a dot, so the marks around the at need no hint
_DISGUISE = rf"{_OPEN}(?:{_AT_WORD}|{_DOT_WORD}){_SHUT}|\s{_DOT_ALONE}\s|\s@|@\s|{_MARK}\s*{_DOT_WORD}\s*{_MARK}|\sat\s+[^\s]*\.[a-z]"
_DISGUISE_HINT = re.compile(_DISGUISE, re.I)

# --- detectors, the first wins where two overlap ---

_DETECT = (
    ("secret", re.compile(r"""(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)\b["']?\s*[:=]\s*["']?[^\s"']{8,}["']?|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_\w{36,}|\bsk-[\w-]{20,}|\b[0-9a-f]{32,64}\b""")),
    # begins where no local part is under way, so a run is read once
    ("email", re.compile(r"(?<![\w+%-])(?<![\w+%-]\.)[\w+%-]++(?:\.[\w+%-]++)*+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+|(?<!\S)\.[\w+%.-]+@[\w-]+(?:\.[\w-]+)+")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![\w-])|(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\w-])")),
)
_RUN = re.compile(r"(?<!\d)\d{7,15}(?!\d)")
_TRIGGERS = r"[0-9@]|(?i:token|secret|api[_-]?key|access[_-]?key|passw|pwd|AKIA|\bsk-|\bgh[pousr]_|[a-f]{32})"
_TRIGGER = re.compile(_TRIGGERS)

#: White space and forms of i that the linear-time matcher takes for something else; a text with some counts as one with characters to fold.
_OTHERWISE = {c for c in range(0x80, 0x10000) if chr(c).isspace()} | {0x0B, 0x1C, 0x1D, 0x1E, 0x1F, 0x130, 0x131}

_RE2 = (
    _TRIGGERS.replace(r"\b", ""),  # a word ends elsewhere for this matcher
    "[" + "".join(f"\\x{{{c:x}}}" for c in sorted({*_FOLD, *map(ord, _GONE), *_OTHERWISE})) + "]",
    rf"(?i)(?:{'|'.join(_WORDS)})[\s,.()+-]+(?:(?:double|triple)\s+)?(?:[0-9]|{'|'.join(_WORDS)})|[0-9][\s,.()-]+(?:(?:double|triple)\s+)?(?:{'|'.join(_WORDS)})",
    f"(?i){_DISGUISE}",
)


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@dataclass
class Aligned:
    """A text and, for each of its characters, the source span it stands for."""

    text: str
    starts: list[int] | range
    ends: list[int] | range

    @classmethod
    def of(cls, text: str) -> Aligned:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewritten(self, edits: list[tuple[int, int, str, list[tuple[int, int]] | None]]) -> Aligned:
        """edits: (from, to, new text, span in this text of each new character or None for the whole), ascending and apart."""
        if not edits:
            return self
        text: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for i, j, new, spans in [*edits, (len(self.text), len(self.text), "", None)]:
            text.append(self.text[at:i])
            starts.extend(self.starts[at:i])
            ends.extend(self.ends[at:i])
            for k in range(len(new)):
                a, b = spans[k] if spans else (i, j)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
            text.append(new)
            at = j
        return Aligned("".join(text), starts, ends)

    def source(self, i: int, j: int) -> tuple[int, int]:
        return self.starts[i], self.ends[j - 1]


def fold(a: Aligned) -> Aligned:
    """Look-alikes to ASCII, one for one; then the invisible characters go."""
    if a.text.isascii() or not _FOLDED.search(a.text):
        return a
    a = Aligned(a.text.translate(_FOLD), a.starts, a.ends)
    return a.rewritten([(m.start(), m.end(), "", None) for m in _INVISIBLE.finditer(a.text)])


def digits(a: Aligned) -> Aligned:
    """Runs of spelled digits to digits; what stands between them goes."""
    if not _SPELLED_HINT.search(a.text):
        return a
    edits = []
    for m in _SPELLED.finditer(a.text):
        new, spans, spelled = [], [], False
        for x in _EACH.finditer(a.text, m.start(), m.end()):
            word = x[2].lower()
            spelled |= word in _WORDS
            times = _TIMES.get((x[1] or "").lower(), 1)
            new += [str(_WORDS.get(word, word))] * times
            spans += [(x.start(), x.end())] * times
        if spelled and len(new) >= 3:
            edits.append((m.start(), m.end(), "".join(new), spans))
    return a.rewritten(edits)


def mail(a: Aligned) -> Aligned:
    """Disguised addresses to plain ones."""
    if not _DISGUISE_HINT.search(a.text):
        return a
    edits, done, back = [], 0, a.text[::-1]
    for at in _AT_ANY.finditer(a.text):
        if at.start() <= done or not (m := _AT_HOST.match(a.text, at.start())):
            continue
        local = _LOCAL_BACK.match(back, len(back) - at.start(), len(back) - done)
        if local:
            edits += [(x.start(), x.end(), "@" if x["at"] else ".", None) for x in _AT_DOT.finditer(a.text, len(back) - local.end(), m.end()) if x[0] not in ("@", ".")]
            done = m.end()
    a = a.rewritten(edits)
    plain, back = [], a.text[::-1]
    for at in _BARE_AT.finditer(a.text):
        local = _NO_WORD_BACK.match(back, len(back) - at.start())
        if local and _NO_WORD.fullmatch(a.text, len(back) - local.end(), at.start()) and _PLAIN_HOST.match(a.text, at.end()):
            plain.append((at.start(), at.end(), "@", None))
    return a.rewritten(plain)


def hints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text whether it may have: a plain trigger, characters to fold, spelled digits, disguises.

    One pass of a linear-time matcher each over the whole column. Each is a
    necessary condition of what the exact expressions above look for in a text
    without characters to fold; a text with some is taken to have them all.
    """
    plain, folds, spelled, disguised = (pc.fill_null(pc.match_substring_regex(column, x), False).to_numpy(zero_copy_only=False) for x in _RE2)
    return plain, folds, spelled | folds, disguised | folds


def find(text: str, folds: bool = True, spelled: bool = True, disguised: bool = True) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normal form) of each identifier, apart and ascending; offsets are in characters of ``text``.

    The flags tell which transducers may be left out as without effect on this text.
    """
    a = Aligned.of(text)
    for step, on in ((fold, folds), (digits, spelled), (mail, disguised)):
        if on:
            a = step(a)
    if not _TRIGGER.search(a.text):
        return []
    found: list[tuple[int, int, str, str]] = []  # ascending and apart

    def add(kind: str, s: int, e: int, normal: str) -> None:
        k = bisect.bisect(found, (s,))
        if (not k or found[k - 1][1] <= s) and (k == len(found) or e <= found[k][0]):
            found.insert(k, (s, e, kind, normal))

    for kind, pattern in _DETECT:
        for m in pattern.finditer(a.text):
            if kind != "iban" or _iban_ok(m[0]):
                add(kind, *a.source(m.start(), m.end()), m[0])
    if spelled:  # digits that someone took the trouble to spell are no ordinary number
        for m in _RUN.finditer(a.text):
            s, e = a.source(m.start(), m.end())
            if any(c.isalpha() for c in text[s:e]):
                add("phone", s, e, m[0])
    return [(kind, s, e, normal) for s, e, kind, normal in found]


def find_all(column: pa.Array) -> tuple[list[str | None], list[list[tuple[str, int, int, str]]]]:
    """The texts of a column and what :func:`find` gives for each; [] for null."""
    texts = column.to_pylist()
    flags = hints(column)
    live = np.flatnonzero(np.logical_or.reduce(flags))
    found: list[list[tuple[str, int, int, str]]] = [[]] * len(texts)
    for i in live.tolist():
        found[i] = find(texts[i], *(bool(f[i]) for f in flags[1:]))
    return texts, found


def redacted(text: str, found: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for kind, s, e, _ in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def _report_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts, found = find_all(part.column("text"))
            spans = pa.array([[{"kind": k, "start": s, "end": e, "normal": n} for k, s, e, n in f] for f in found], _ARROW_SPANS)
            new = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans, new], ["doc_id", "spans", "redacted"])


def pii_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``spans`` (kind, start, end, normal form; [] if none) and the ``redacted`` text.

    Offsets count characters of the source text, end excluded. A null text
    gives no spans and a null ``redacted``, an empty one gives itself; a null
    ``doc_id`` stays null; repeated rows are treated one by one. Other columns
    are not read. An empty table gives an empty result. No shuffle.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS), T.StructField("redacted", T.StringType())])
    return given.mapInArrow(_report_rows, schema)


def _redact_rows(text: str, size: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts, found = find_all(part.column(text))
                new = [redacted(t, f) if f else t for t, f in zip(texts, found)]
                out = part.set_column(part.schema.get_field_index(text), pa.field(text, pa.string()), pa.array(new, pa.string()))
                if size:
                    old = part.column(size).to_pylist()
                    at = part.schema.get_field_index(size)
                    n = [len(b) if b is not None and b != a else c for a, b, c in zip(texts, new, old)]
                    out = out.set_column(at, part.schema.field(at), pa.array(n, part.schema.field(at).type))
                yield out

    return run


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with identifiers in the text replaced by their kind in brackets; ``n_chars``, if there, follows the change.

    Every row stays, all other columns pass through as they are. Null and empty texts are kept.
    """
    if size not in docs.columns or not isinstance(docs.schema[size].dataType, (T.LongType, T.IntegerType)):
        size = None
    return docs.mapInArrow(_redact_rows(text, size), docs.schema)
