"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, digits, dots and plus signs
before digits, ``://`` and identifier cues.  Around each anchor a local parser
expands to the boundaries and validates: e-mail addresses, IPv4 addresses,
payment cards (Luhn), phone numbers, and beyond these URLs with credentials,
IBANs (mod 97 and the length of their country, or any length after a cue), and
all social security and account numbers in reach of a cue in any case of letters.

One pass, no shuffle.  Null and empty texts have no spans; every row is scanned
by itself, so ties and repeated rows need no rule; an empty table gives an empty
result.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType

from sessionlens.llm.common import each, map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "ssn", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+[A-Za-z0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
#: Country -> length of its IBANs (ISO 13616).
IBAN_LENGTHS = {
    p[:2]: int(p[2:])
    for p in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 "
        "NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![0-9])[0-9]{6,17}(?![0-9])")

CUES = {"iban": ("iban", None), "ssn": ("ssn", SSN), "social security": ("ssn", SSN), "account": ("account", ACCOUNT), "acct": ("account", ACCOUNT)}
#: Code points after a cue in which its identifier must start.
CUE_REACH = 24
#: Between the identifiers of a list, which may go on beyond the reach.
LIST_GAP = re.compile(r"[\s,;/&]*(?:(?:and|or)\s+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(text: str, at: int, cued: bool) -> int | None:
    """End of the valid IBAN that starts here; only after a cue other lengths than its country's count."""
    m = IBAN_REST.match(text, at + 4)
    if not m:
        return None
    ends = [k + 1 for k in range(at, m.end()) if text[k] != " "]
    own = IBAN_LENGTHS.get(text[at : at + 2])
    for n in [*([own] if own else []), *(range(34, 14, -1) if cued else ())]:
        if n <= len(ends) and not text[ends[n - 1] : ends[n - 1] + 1].isalnum() and iban_valid(text[at : ends[n - 1]]):
            return ends[n - 1]
    return None


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
        found.add_word("." + d, ("dot", 2))
        found.add_word("+" + d, ("plus", 2))
    for cue in CUES:
        found.add_word(cue, (cue, len(cue)))
    found.make_automaton()
    return found


class Scanner:
    """Spans of one text after another; ``spans(text)`` gives (kind, start, end) by kind, then start."""

    def __init__(self) -> None:
        self.automaton = anchors()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out: dict[str, list] = {k: [] for k in BASE_KINDS + MORE_KINDS}
        done = dict.fromkeys(out, 0)  # end of the last match of each kind, valid or not
        cued = []  # ends of the cues of IBANs
        lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
        for last, (cue, width) in self.automaton.iter(lower):
            at = last + 1 - width
            if cue == "digit":
                if at >= done["card"] and (m := CARD.match(text, at)):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((at, m.end()))
            elif cue == "dot":
                start = at
                while start > done["ip"] and text[start - 1] in DIGITS:
                    start -= 1
                if at >= done["ip"] and start < at and (m := QUAD.match(text, start)):
                    done["ip"] = m.end()
                    if all(len(q := p.lstrip("0") or "0") <= 3 and int(q) <= 255 for p in m.groups()):
                        out["ip"].append((start, m.end()))
            elif cue == "at":
                start = at
                while start > done["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    done["email"] = m.end()
                    out["email"].append((start, m.end()))
            elif cue == "plus":
                if at >= done["phone"] and (m := PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                        out["phone"].append((at, m.end()))
            elif cue == "scheme":
                start = at
                while start > done["url"] and text[start - 1] in SCHEME:
                    start -= 1
                if start < at and (m := USERINFO.match(text, at + 3)):
                    done["url"] = m.end()
                    out["url"].append((start, m.end()))
            elif cue == "iban":
                cued.append(last + 1)
            else:
                kind, pattern = CUES[cue]
                at, reach = max(last + 1, done[kind]), last + 1 + CUE_REACH
                while (m := pattern.search(text, at, reach + 48)) and m.start() <= reach:
                    at = done[kind] = m.end()
                    out[kind].append((m.start(), at))
                    reach = max(reach, LIST_GAP.match(text, at).end())
        for m in IBAN.finditer(text):
            k = bisect_right(cued, m.start())
            near = k > 0 and m.start() <= cued[k - 1] + CUE_REACH
            if m.start() >= done["iban"] and (end := iban_end(text, m.start(), near)):
                done["iban"] = end
                out["iban"].append((m.start(), end))
        return [(kind, a, b) for kind, found in out.items() for a, b in found]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and a digest of the base spans, and all spans as text."""

    def make():
        scanner = Scanner()

        def row(text):
            spans = scanner.spans(text or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
            return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return each(row)

    fields = [(f"n_{k}", LongType()) for k in BASE_KINDS]
    return map_texts(docs, make, [*fields, ("base_sha256", StringType()), ("spans", StringType())], id_col, text_col)
