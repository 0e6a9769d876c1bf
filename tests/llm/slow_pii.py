"""Personal data by its definitions, without regard to time: every rule is tried at every place, character by character where it can be said so."""

from __future__ import annotations

import re
import unicodedata

from docparity.llm.pii import _GONE, _LOOKS, _TIMES, _WORDS

LOOKS = {a: b for k, v in _LOOKS.items() for a, b in zip(k, v)}
AT, DOT, ALONE = r"(?:at|@|arroba|arobase)", r"(?:dot|punto|point|punkt|\.)", "(?:dot|punto|punkt)"
AT_B, DOT_B = (rf"\s*[(\[{{<]\s*{x}\s*[)\]}}>]\s*" for x in (AT, DOT))
AT_BARE, DOT_BARE = r"\s+(?:at|arroba|arobase)\s+", rf"\s+{ALONE}\s+"
AT_M, DOT_M = (rf"\s*(?<![-_*~|/])[-_*~|/]+\s*{x}\s*[-_*~|/]+\s*" for x in (AT, DOT))
LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
LOCAL = rf"[\w+%-]+(?:(?:\.|{DOT_B}|{DOT_BARE})[\w+%-]+)*"
DISGUISED = re.compile(rf"(?:{LOCAL})(?:(?:{AT_B}|\s*@\s*){LABEL}(?:(?:\.|{DOT_B}|{DOT_BARE}){LABEL})+|(?:{AT_BARE}|{AT_M}){LABEL}(?:\.{LABEL})*?(?:(?:{DOT_M}|{DOT_B}|{DOT_BARE}){LABEL})+(?:\.{LABEL})*)", re.I)
PARTS = re.compile(rf"(?P<at>{AT_B}|{AT_M}|\s*@\s*|{AT_BARE})|(?P<dot>{DOT_B}|{DOT_M}|{DOT_BARE})", re.I)
PLAIN = re.compile(rf"(?<![\w.])[^\W_](?=[\w+%.-]*[._])[\w+%-]*(?:\.[\w+%-]+)*(\s+at\s+){LABEL}(?:\.{LABEL})*\.[a-z]{{2,}}(?!\w)", re.I)


def word(c: str) -> bool:
    return c.isalnum() or c == "_"


def folded(text: str) -> list[tuple[str, int, int]]:
    out = []
    for i, c in enumerate(text):
        if c in _GONE:
            continue
        n = ord(c)
        if 0x1D400 <= n < 0x1D800 and len(x := unicodedata.normalize("NFKC", c)) == 1 and x.isascii():
            c = x
        elif 0x80 <= n < 0x1FBFA and unicodedata.decimal(c, None) is not None:
            c = str(unicodedata.decimal(c))
        elif 0xFF01 <= n < 0xFF5F:
            c = chr(n - 0xFEE0)
        else:
            c = LOOKS.get(c, c)
        out.append((c, i, i + 1))
    return out


def spliced(chars, edits):
    """edits: (from, to, new characters with their spans)."""
    out, at = [], 0
    for i, j, new in edits:
        out += chars[at:i] + new
        at = j
    return out + chars[at:]


def item(text: str, i: int) -> tuple[int, list[tuple[str, int, int]], bool] | None:
    """End, digits with their places and whether it is spelled, of the number word or digits at ``i``."""
    j = i
    while j < len(text) and text[j] in "0123456789":
        j += 1
    if j > i:
        return j, [(text[k], k, k + 1) for k in range(i, j)], False
    times = 1
    for t, n in _TIMES.items():
        if text[i : i + len(t)].lower() == t and text[i + len(t) : i + len(t) + 1].isspace():
            times, j = n, i + len(t)
            while text[j : j + 1].isspace():
                j += 1
    for w in sorted(_WORDS, key=len, reverse=True):
        end = j + len(w)
        if text[j:end].lower() == w and not word(text[end : end + 1] or " "):
            return end, [(str(_WORDS[w]), i, end)] * times, True
    return None


def digits(chars):
    text = "".join(c for c, _, _ in chars)
    edits, i = [], 0
    while i < len(text):
        items, j = [], i
        if not i or not word(text[i - 1]):
            while (x := item(text, j)) is not None:
                items.append(x)
                j = x[0]
                if text[j : j + 1] == ".":
                    j += 1
                    while text[j : j + 1].isspace():
                        j += 1
                else:
                    while text[j : j + 1] and (text[j].isspace() or text[j] in ",()-"):
                        j += 1
                if j == x[0]:
                    break
        while items and word(text[items[-1][0] : items[-1][0] + 1] or " "):
            items.pop()
        if len(items) < 3:
            i += 1
            continue
        new = [d for x in items for d in x[1]]
        if any(x[2] for x in items):
            edits.append((i, items[-1][0], [(c, chars[a][1], chars[b - 1][2]) for c, a, b in new]))
        i = items[-1][0]
    return spliced(chars, edits)


def mail(chars):
    text = "".join(c for c, _, _ in chars)
    edits, i = [], 0
    while i < len(text):
        m = DISGUISED.match(text, i)
        if m and (not i or not (word(text[i - 1]) or text[i - 1] in "+%-")):
            edits += [(x.start(), x.end(), [("@" if x["at"] else ".", chars[x.start()][1], chars[x.end() - 1][2])]) for x in PARTS.finditer(text, i, m.end()) if x[0] not in ("@", ".")]
            i = m.end()
        else:
            i += 1
    chars = spliced(chars, edits)
    text = "".join(c for c, _, _ in chars)
    return spliced(chars, [(m.start(1), m.end(1), [("@", chars[m.start(1)][1], chars[m.end(1) - 1][2])]) for m in PLAIN.finditer(text)])


def ips(t):
    for i in range(len(t)):
        if i and (t[i - 1].isdecimal() or t[i - 1] == "."):
            continue
        m = re.match(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", t[i:])
        if m and all(int(x) < 256 and (len(x) < 3 or x[0] in "12") for x in m[0].split(".")):
            after = t[i + m.end() : i + m.end() + 2]
            if not (after[:1].isdecimal() or after[:1] == "." and after[1:].isdecimal()):
                yield i, i + m.end()


def ssns(t):
    for i in range(len(t) - 10):
        if all((c == "-") if k in (3, 6) else c.isdecimal() for k, c in enumerate(t[i : i + 11])) and not (i and (word(t[i - 1]) or t[i - 1] == "-")) and not (t[i + 11 : i + 12] and (word(t[i + 11]) or t[i + 11] == "-")):
            yield i, i + 11


def emails(t):
    local, at = lambda c: word(c) or c in "+%-", 0
    while (k := t.find("@", at)) >= 0:
        at, s = k + 1, k
        while s and (local(t[s - 1]) or t[s - 1] == "." and s < k and local(t[s]) and s > 1 and local(t[s - 2])):
            s -= 1
        if s < k and t[s : k] and local(t[k - 1]):
            if s > 0 and t[s - 1] == "." and (s < 2 or t[s - 2].isspace()):
                s -= 1
            if m := re.match(rf"{LABEL}(?:\.{LABEL})+", t[k + 1 :]):
                yield s, k + 1 + m.end()
                at = k + 1 + m.end()


EXPRESSIONS = {
    "secret": r"""(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)\b["']?\s*[:=]\s*["']?[^\s"']{8,}["']?|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_\w{36,}|\bsk-[\w-]{20,}|\b[0-9a-f]{32,64}\b""",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![\w-])|(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\w-])",
    "run": r"(?<!\d)\d{7,15}(?!\d)",
}


def iban_ok(s):
    s = s.replace(" ", "")
    n = 0
    for c in s[4:] + s[:4]:
        v = int(c, 36)
        n = (n * (100 if v > 9 else 10) + v) % 97
    return len(s) >= 15 and n == 1


def find(text: str) -> list[tuple[str, int, int, str]]:
    chars = mail(digits(folded(text)))
    t = "".join(c for c, _, _ in chars)
    found = []
    for kind in ("secret", "email", "ip", "iban", "card", "ssn", "phone", "run"):
        spans = {"email": emails, "ip": ips, "ssn": ssns}[kind](t) if kind not in EXPRESSIONS else ((m.start(), m.end()) for m in re.finditer(EXPRESSIONS[kind], t))
        for i, j in spans:
            s, e = chars[i][1], chars[j - 1][2]
            if kind == "iban" and not iban_ok(t[i:j]) or kind == "run" and not any(c.isalpha() for c in text[s:e]):
                continue
            if all(e <= x[1] or x[2] <= s for x in found):
                found.append(("phone" if kind == "run" else kind, s, e, t[i:j]))
    return sorted(found, key=lambda x: x[1])


def redacted(text: str) -> str:
    for kind, s, e, _ in reversed(find(text)):
        text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
    return text
