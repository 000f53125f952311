"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs, digits
and identifier cues ("iban", "account", "street" ...). A parser of the anchor's kind
then expands and validates the span round it. Base kinds:

* email: the local part runs back from an at-sign, the domain runs on from it;
* ip, card, phone: parsed from the first digit of a run, or from a plus sign. A parse
  that is well formed but not valid is passed over whole.

The anchors add further kinds: ``login`` (user and password after a scheme),
``account`` (an IBAN that passes its check, or 6 to 20 digits and letters after an
account cue) and ``address`` (a house number, one to five capitalised names and a street
word of its own, with a postal code if one follows; no sentence ends in between). Added
spans that lie inside a base span are left out.

Spans are half-open code-point ranges of the whole text. Null counts as empty, and
repeated rows are found as often as they come. Columns other than the given ones are
ignored when counting and pass unchanged when masking.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm.common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "address")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
LOGIN = re.compile(r"://([^\s/?#@:]+:[^\s/?#@]+)@")
IBAN = re.compile(r"[ \t]*[:=#]?[ \t]*([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|id))?[ \t]*[:=#][ \t]*([A-Za-z0-9-]{6,20})(?![A-Za-z0-9-])", re.I)
HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?$")
#: A name in an address; a full stop only follows an initial or a listed short form.
NAME = re.compile(r"(?:[A-Z]|St|Ste|Dr|Mt|Ft)\.|[^\W\d_][\w'-]*(?:\.[\w'-]+)*")
PARTICLES = frozenset(("of", "the", "and", "de", "del", "der", "des", "du", "la", "le", "van", "von"))
ADDRESS_NAMES = 5
ADDRESS_AFTER = re.compile(r"(?:\.|,)?(?: [^\W\d_][\w'-]*){0,3},? [0-9]{5}(?![0-9])")

IDENTIFIERS = ("iban", "account", "acct", "konto", "compte", "cuenta")
STREETS = ("street", "avenue", "road", "boulevard", "lane", "drive", "square")
#: Street words that are as often verbs or measures; these must be capitalised.
COMMON_STREETS = ("drive", "square")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    """Country, check digits and account in one number that leaves 1 when divided by 97."""
    plain = text.replace(" ", "").upper()
    moved = plain[4:] + plain[:4]
    return plain.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    import ahocorasick

    built = ahocorasick.Automaton()
    for mark in "@+0123456789":
        built.add_word(mark, ("digit" if mark.isdigit() else mark, 1))
    built.add_word("://", ("scheme", 3))
    for kind, cues in (("account", IDENTIFIERS), ("street", STREETS)):
        for cue in cues:
            built.add_word(cue, (kind, len(cue)))
    built.make_automaton()
    return built


class Finder:
    def __init__(self):
        self.anchors = automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all spans, by start and then by kind's place in KINDS."""
        text = text or ""
        lower = text.encode().lower().decode()  # A-Z only, so places stay
        found: list[tuple[int, int, str]] = []
        added: list[tuple[int, int, str]] = []
        done = dict.fromkeys(("email", "ip", "card", "phone", "run"), 0)
        for last, (kind, length) in self.anchors.iter(lower):
            at = last - length + 1
            if kind == "digit":
                if at >= done["run"]:
                    done["run"] = DIGITS.match(text, at).end()
                if at >= done["ip"]:
                    self.ip(text, at, done, found)
                if at >= done["card"]:
                    self.card(text, at, done, found)
            elif kind == "@":
                self.email(text, at, done, found)
            elif kind == "+":
                if at >= done["phone"] and (m := PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        found.append((at, m.end(), "phone"))
            elif kind == "scheme":
                if m := LOGIN.match(text, at):
                    added.append((m.start(1), m.end(1), "login"))
            elif kind == "account":
                self.account(text, last + 1, added)
            else:
                self.address(text, at, last + 1, added)
        for span in added:
            if span not in found and not any(s <= span[0] and span[1] <= e for s, e, _ in found):
                found.append(span)
        place = {k: i for i, k in enumerate(KINDS)}
        return sorted(found, key=lambda s: (s[0], place[s[2]], s[1]))

    @staticmethod
    def email(text, at, done, found):
        start = at
        while start > done["email"] and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            done["email"] = m.end()

    @staticmethod
    def ip(text, at, done, found):
        m = IP.match(text, at)
        if not m:
            done["ip"] = done["run"]  # a later digit of the run fails likewise
            return
        done["ip"] = m.end()
        parts = [part.lstrip("0") or "0" for part in m[0].split(".")]  # of any number of zeros
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append((at, m.end(), "ip"))

    @staticmethod
    def card(text, at, done, found):
        m = CARD.match(text, at)
        if not m:
            done["card"] = at + 1
            return
        done["card"] = m.end()
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((at, m.end(), "card"))

    @staticmethod
    def account(text, at, added):
        if m := IBAN.match(text, at):
            words = m[1].split(" ")
            for n in range(len(words), 0, -1):  # the check tells where it ends
                value = " ".join(words[:n])
                if len(value.replace(" ", "")) >= 15 and iban_holds(value):
                    added.append((m.start(1), m.start(1) + len(value), "account"))
                    return
        if (m := ACCOUNT.match(text, at)) and sum(c.isdigit() for c in m[1]) >= 6:
            added.append((m.start(1), m.end(1), "account"))

    @staticmethod
    def address(text, at, end, added):
        if text[at - 1 : at] != " " or text[end : end + 1].isalnum() or text[at:end] in COMMON_STREETS:
            return
        stop = at - 1  # the space before a word that is looked at already
        for names in range(ADDRESS_NAMES + 1):
            start = text.rfind(" ", 0, stop) + 1
            if names and (m := HOUSE.search(text, max(start, stop - 7), stop)):
                after = ADDRESS_AFTER.match(text, end)
                added.append((m.start(), after.end() if after else end, "address"))
                return
            word = text[start:stop]
            small = names and word in PARTICLES  # between names
            if not NAME.fullmatch(word) or not (small or word[0].isupper()):
                return
            if not word[0].isupper() and HOUSE.search(text, max(0, start - 8), start - 1):
                return
            stop = start - 1
            if stop <= 0:
                return


def digest(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """kind:start:end of the spans of these kinds, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans if kind in kinds)


def masked_text(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every span, and what overlaps it, replaced by its first kind's name."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the number of spans of each base kind, base_sha256 and all spans of every row."""
    numbers = [f"n_{kind}" for kind in BASE_KINDS]

    def run(batches):
        find = Finder()
        for part in slices(batches):
            rows = [find(t) for t in part.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for *_, k in r) for r in rows], pa.int64()) for kind in BASE_KINDS]
            sums = [hashlib.sha256(digest(r, BASE_KINDS).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(sums, pa.string()), pa.array([digest(r, KINDS) for r in rows], pa.string())],
                [id_col, *numbers, "base_sha256", "spans"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{n} long" for n in numbers)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}, base_sha256 string, spans string")


def masked(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns with personal data in the text replaced; ``length_col``, if
    given, gets the new number of code points where the text changes."""
    names = df.columns

    def run(batches):
        find = Finder()
        for part in slices(batches):
            before = part.column(names.index(text_col)).to_pylist()
            texts = [masked_text(t, find(t)) for t in before]
            columns = list(part.columns)
            columns[names.index(text_col)] = pa.array(texts, pa.string())
            if length_col:
                old = part.column(names.index(length_col))
                lengths = [n if t == b else len(t) for n, t, b in zip(old.to_pylist(), texts, before)]
                columns[names.index(length_col)] = pa.array(lengths, old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)
