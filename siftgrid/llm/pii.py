"""Personal data by a semi-Markov conditional random field (operator 7).

Base spans (e-mail, IP, card, phone) follow fixed rules and always stay.  Where
a text has digits or written-out addresses, a semi-Markov model segments the
neighbourhood.  A segment is any run of up to ``MAX_TOKENS`` tokens; it is
scored as a whole - digits and their groups, checksums, separators, letters,
what stands beside it and which cue word before it - under every kind at once,
and tokens outside of entities are segments of weight 0.  With s of a segment:

    p(segments | text) = exp(sum of s) / Z,   log Z by the forward recursion

The weights maximise the penalised log-likelihood of generated sentences (fixed
seed, ``TRAINING_SENTENCES`` of them; gradients from forward and backward sums;
some seconds on the driver, once per process).  A dynamic program over segment
ends picks the likeliest segmentation, choosing bounds and kinds together; as a
segment's tokens are bounded, it is linear in the text.  Segments that overlap
no base span are added.

Defined results: a null text is an empty text and has no spans; spans are in
code points with exclusive ends; among equally likely segmentations the one of
fewer and later-ending segments wins; spans are distinct, and those of the
model do not overlap; repeated rows give repeated results; an empty table gives
an empty table; very long texts, with or without blanks, are read whole in
time linear in their length; further columns, whatever their names, are not
read (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, lean

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of listing; the last three come from the model only.
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
MAX_TOKENS = 16
MAX_CHARS = 96
#: Characters on either side of a trigger that the model reads, before it goes on to a blank.
MARGIN = 40
TRAINING_SENTENCES, STEPS, PENALTY = 320, 45, 0.02

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_OBFUSCATED = re.compile(r"[\[({]\s?(?:at|AT)\s?[\])}]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of a text, by kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


# ---- segments and their features -------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9][0-9 ().:/-]*[0-9]")
_CUES = {
    "phone": "tel phone call mobile cell fax telefon telefono teléfono téléphone llame appelez handy whatsapp sms",
    "ssn": "ssn social security",
    "iban": "iban account konto cuenta compte bank",
    "email": "email mail contact write correo courriel",
    "card": "card visa mastercard karte tarjeta carte credit",
    "ip": "ip host server address",
    "secret": "token password passwd pwd secret key apikey api_key bearer passwort clave contraseña credential auth",
    "number": "order invoice isbn commit sha sha256 md5 version ticket ref id number nr no order_id checksum digest",
}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws.split()}
_CLASS = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}})


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34 or not s.isascii() or not s.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def char_class(c: str) -> str:
    if not c:
        return "end"
    if c.isspace():
        return " "
    return c.translate(_CLASS) if c.isascii() else ("a" if c.isalpha() else "?")


@dataclass(frozen=True)
class Zone:
    """Tokens of a stretch of text, with running counts for cheap tests of segments."""

    text: str
    tokens: list[tuple[int, int]]
    digits: list[int]
    letters: list[int]
    marks: list[int]
    cues: list[str]


def read_zone(text: str, lo: int, hi: int) -> Zone:
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    digits, letters, marks, cues, recent = [0], [0], [0], [], []
    for a, b in tokens:
        word = text[a:b]
        cues.append(next((c for c in reversed(recent[-3:]) if c), ""))
        digits.append(digits[-1] + sum("0" <= c <= "9" for c in word))
        letters.append(letters[-1] + (len(word) if word.isalpha() else sum(map(str.isalpha, word))))
        marks.append(marks[-1] + (word in ("at", "AT", "@")))
        if word.isalnum():
            recent.append(_CUE_OF.get(word.lower(), "") if len(word) < 16 else "")
        elif word == "_":
            pass
        elif word in ".;!?" and recent:
            recent[-1] = recent[-1] if word == "." else ""
    return Zone(text, tokens, digits, letters, marks, cues)


#: What may stand in an entity besides letters and digits.
INSIDE = frozenset("+-.:/_@()[]{}")


def segments_at(zone: Zone, j: int) -> Iterator[tuple[int, int, int]]:
    """Candidate segments (first token, start, end) that end with token ``j - 1``."""
    text, hi = zone.text, zone.tokens[j - 1][1]
    last = text[hi - 1]
    if not last.isalnum():
        return
    for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
        lo = zone.tokens[i][0]
        if hi - lo > MAX_CHARS or not (text[lo].isalnum() or text[lo] in INSIDE):
            return
        if i < j - 1 and "\n" in text[lo : zone.tokens[i + 1][0]]:
            return
        digits = zone.digits[j] - zone.digits[i]
        is_code = i == j - 1 and hi - lo >= 16 and digits > 0
        if hi - lo < 7 or digits < 3 and zone.marks[j] == zone.marks[i] and not is_code:
            continue
        # Without a letter: at least seven digits, and more of them than tokens.
        if zone.letters[j] == zone.letters[i] and (digits < 7 or 4 * digits < 5 * (j - i)) and text[lo + 1 : hi].count(":") < 2:
            continue
        c = text[lo]
        if c.isalnum() or c in "+(":
            yield i, lo, hi


def segment_features(zone: Zone, i: int, j: int) -> list[str]:
    """Whole-span features of tokens i..j-1; the model has a weight of each for every kind."""
    text, tokens = zone.text, zone.tokens
    lo, hi = tokens[i][0], tokens[j - 1][1]
    s = text[lo:hi]
    digits = only_digits(s)
    groups = re.findall(r"[0-9]+", s)
    letters = sum(c.isalpha() for c in s)
    before, after = text[lo - 1 : lo], text[hi : hi + 1]
    separators = "".join(sorted(set(re.sub(r"[^\W_]", "", s))))
    cue = zone.cues[i] or "none"
    out = ["bias", f"cue={cue}", f"digits={min(len(digits), 20)}", f"tokens={j - i}", f"separators={separators[:5]}", f"before={char_class(before)}", f"after={char_class(after)}", f"first={char_class(s[0])}", f"letters={min(letters, 4) if letters < 12 else 12}"]
    if before and (before.isalnum() or before in "_#$/@") or before and before in "+-.:" and text[lo - 2 : lo - 1].isalnum():
        out.append("glued-left")
    if after and (after.isalnum() or after in "_%@") or after and after in "-.:/" and text[hi + 1 : hi + 2].isalnum():
        out.append("glued-right")
    if before == " " and after == " " or before in " \n" and after in " \n.,;":
        out.append("alone")
    # A digit group goes on beyond a blank: a part of something longer.
    if after == " " and "0" <= text[hi + 1 : hi + 2] <= "9" and "0" <= s[-1] <= "9":
        out.append("runs-on-right")
    if before == " " and lo > 1 and "0" <= text[lo - 2] <= "9" and "0" <= s[0] <= "9":
        out.append("runs-on-left")
    if " " in s and letters:
        out.append(f"words={min(sum(w.isalpha() and not w.isupper() for w in s.split()), 3)}")
    if not letters and len(groups) <= 7:
        sizes = "-".join(str(len(g)) for g in groups)
        out += [f"groups={sizes}", f"groups={sizes}|{separators[:3]}", f"start={s[0] if s[0] in '+(0' else 'other'}|{len(groups)}"]
        if s[0] == "+":
            out.append(f"international|{8 <= len(digits) <= 15}")
        if 13 <= len(digits) <= 19:
            out.append(f"luhn={luhn(digits)}|{len(groups)}|cue={cue == 'card'}")
        if len(groups) == 3 and len(groups[0]) == 3:
            out.append(f"ssn-range={groups[0] not in ('000', '666') and groups[0] < '900' and int(groups[1]) > 0 and int(groups[2]) > 0}")
        if len(groups) >= 3 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and separators == ".":
            out.append("octets")
        if len(groups) == 3 and re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}", s):
            out.append("date")
    elif s.isascii():
        solid = s.replace(" ", "")
        if solid.isalnum() and solid[:2].isalpha() and solid[:2].isupper() and solid[2:4].isdigit():
            out.append(f"country-check={iban_ok(s)}")
        if s.isalnum() or not separators.strip("-_+/="):
            changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
            case = sum(a.islower() != b.islower() for a, b in zip(s, s[1:]) if a.isalpha() and b.isalpha())
            hexa = all(c in "0123456789abcdefABCDEF" for c in s)
            size = min(len(s) // 8, 6)
            out += [f"mixed={min(changes // 2, 6)}|{size}", f"cased={min(case, 4)}", f"code|cue={cue}|{size}", f"code|hex={hexa}|{size}", f"code|value={before in QUOTES and after in QUOTES and bool(before)}|cue={cue}", f"code|{before == '='}|cue={cue}"]
            if j - i > 1:
                out.append("code|pieces")
        if ":" in separators and re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}", s):
            out.append(f"colons={min(s.count(':'), 8)}|{'::' in s}")
        if zone.marks[j] > zone.marks[i]:
            out.append(f"written={bool(_WRITTEN.search(s))}|{bool(_WRITTEN.search(s) and re.search(r'[.]|dot|DOT', s))}|{'  ' in s or chr(10) in s}|{len(s.split()) > 6}")
            out.append(f"written-ends={s.rsplit('.', 1)[-1].isalpha() and s[0].isalnum()}|{len(re.split(r'[^A-Za-z]+', s)[-1])}")
            m = _WRITTEN.search(s)
            out.append(f"written-name={bool(m) and ' ' not in s[: m.start()].strip()}|{bool(m) and not re.search(r'[A-Za-z0-9-] [A-Za-z0-9-]', s[m.end():])}")
    return out


QUOTES = ("'", '"', "`")
_WRITTEN = re.compile(r"\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?")


# ---- the model -------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Weights of known features, a row of one number per kind."""

    weights: dict[str, np.ndarray]

    def score(self, names: list[str]) -> np.ndarray:
        rows = [w for w in map(self.weights.get, names) if w is not None]
        return sum(rows) if rows else np.zeros(len(KINDS))


def viterbi(zone: Zone, model: Model) -> list[tuple[int, int, str]]:
    """The likeliest segmentation of a zone: best[j] over segments that end at token j."""
    n = len(zone.tokens)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, _, _ in segments_at(zone, j):
            scores = model.score(segment_features(zone, i, j))
            kind = int(scores.argmax())
            total = best[i] + float(scores[kind])
            if total > best[j]:
                best[j], back[j] = total, (i, KINDS[kind])
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((zone.tokens[i][0], zone.tokens[j - 1][1], kind))
            j = i
    return out[::-1]


def log_sum(terms: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials along the second axis; a row has a finite term."""
    most = terms.max(axis=1)
    return most + np.log(np.exp(terms - most[:, None]).sum(axis=1))


def log_partition(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log-sums and log Z of sentences.

    ``scores[s, j, l]`` is the log-sum over kinds of the segment of ``l`` tokens
    that ends at token ``j`` (-inf: none); outside tokens weigh 0, so padding
    tokens change nothing.
    """
    n, width, lengths = scores.shape
    ahead, behind = np.zeros((n, width)), np.zeros((n, width))
    for j in range(1, width):
        terms = [ahead[:, j - 1]] + [ahead[:, j - k] + scores[:, j, k] for k in range(1, min(lengths - 1, j) + 1)]
        ahead[:, j] = log_sum(np.stack(terms, axis=1))
    for j in range(width - 2, -1, -1):
        terms = [behind[:, j + 1]] + [behind[:, j + k] + scores[:, j + k, k] for k in range(1, min(lengths - 1, width - 1 - j) + 1)]
        behind[:, j] = log_sum(np.stack(terms, axis=1))
    return ahead, behind, ahead[:, -1]


def fit(sentences: list[tuple[str, list[tuple[int, int, str]]]], steps: int = STEPS, penalty: float = PENALTY) -> tuple[Model, list[float]]:
    """Maximum penalised likelihood by gradient steps; the model and its likelihoods by step."""
    zones = [read_zone(t, 0, len(t)) for t, _ in sentences]
    known: dict[str, int] = {}
    where, names, gold = [], [], []
    for s, (zone, (_, spans)) in enumerate(zip(zones, sentences)):
        wanted = {(a, b): KINDS.index(k) for a, b, k in spans}
        for j in range(1, len(zone.tokens) + 1):
            for i, lo, hi in segments_at(zone, j):
                where.append((s, j, j - i))
                names.append([known.setdefault(f, len(known)) for f in segment_features(zone, i, j)])
                gold.append(wanted.get((lo, hi), -1))
    width = max(map(len, names))
    index = np.array([row + [len(known)] * (width - len(row)) for row in names])
    s, j, k = np.array(where).T
    truth = np.zeros((len(gold), len(KINDS)))
    gold = np.array(gold)
    truth[np.flatnonzero(gold >= 0), gold[gold >= 0]] = 1
    weights = np.zeros((len(known) + 1, len(KINDS)))
    mean, spread, likelihoods = np.zeros_like(weights), np.zeros_like(weights), []
    for step in range(1, steps + 1):
        scores = weights[index].sum(axis=1)
        table = np.full((len(zones), max(len(z.tokens) for z in zones) + 1, MAX_TOKENS + 1), -np.inf)
        table[s, j, k] = log_sum(scores)
        ahead, behind, log_z = log_partition(table)
        likelihoods.append(float((truth * scores).sum() - log_z.sum() - penalty / 2 * (weights**2).sum()))
        share = np.exp(np.minimum(0, ahead[s, j - k] + behind[s, j] - log_z[s])[:, None] + scores)
        change = truth - np.minimum(share, 1)
        gradient = np.stack([np.bincount(index.ravel(), np.repeat(change[:, c], width), len(known) + 1) for c in range(len(KINDS))], axis=1) - penalty * weights
        gradient[-1] = 0
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        weights = weights + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Model({f: weights[i] for f, i in known.items()}), likelihoods


def _sentence(rnd: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated sentence with its entities, and things that only look alike."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    pick = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    hexa = lambda n: pick(n, rnd.choice(("0123456789abcdef", "0123456789ABCDEF")))
    word = lambda: "".join(rnd.choice(("an", "the", "er", "ion", "st", "que", "ung", "os", "re", "é")) for _ in range(rnd.randint(1, 3)))
    solid = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"

    def iban() -> str:
        country = rnd.choice(("DE", "FR", "ES", "GB", "NL", "IT"))
        body = rnd.choice(("", pick(4, "ABCDEFGHJKLMNPQRSTUVWXYZ"))) + digits(rnd.randint(11, 16)) + rnd.choice(("", "M", "X")) + digits(2)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        s = f"{country}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rnd.random() < 0.5 else s

    def card() -> str:
        body = rnd.choice("3456") + digits(14)
        s = body + next(c for c in "0123456789" if luhn(body + c))
        return s if rnd.random() < 0.5 else rnd.choice(" -").join(s[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, str, str]:
        """What stands before it, the entity, what stands after it; its kind by the caller's roll."""
        kind = rnd.choice(("phone", "phone", "phone", "card", "ssn", "email", "iban", "secret", "secret", "ip"))
        cue = rnd.choice((": ", " ", "")) if rnd.random() < 0.35 else None
        lead = f"{rnd.choice(_CUES[kind].split())}{cue or ' '}" if cue is not None else ""
        if kind == "phone":
            a, b, c = str(rnd.randint(200, 999)), digits(3), digits(4)
            s = rnd.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{rnd.randint(1, 9)} " + " ".join(digits(2) for _ in range(4)), f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(4)} {digits(4)}", f"0{digits(3)}-{digits(7)}", f"+{rnd.choice((1, 33, 49, 34, 44))} ({a}) {b}-{c}", f"+{rnd.choice((1, 33, 49, 34, 44))} {a} {b} {c}"))
        elif kind == "card":
            s = card()
        elif kind == "ssn":
            s = f"{rnd.randint(1, 665):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"
        elif kind == "email":
            s = rnd.choice((f"{word()}.{word()} [at] {word()}.com", f"{word()} (at) {word()} (dot) org", f"{word()}{digits(2)}[at]{word()}.net", f"{word()}_{word()} {{at}} {word()}-{word()}.de", f"{word()}.{word()}(AT){word()}.{word()}.fr")).replace("é", "e")
        elif kind == "iban":
            s = iban()
        elif kind == "ip":
            groups = [pick(rnd.randint(1, 4), "0123456789abcdef") for _ in range(8)]
            s = ":".join(groups) if rnd.random() < 0.5 else ":".join(groups[: rnd.randint(2, 4)]) + "::" + ":".join(groups[5:])
            if s[0] == ":" or sum(c.isdigit() for c in s) < 4:
                s = "2001:db8:85a3:1:2:8a2e:370:7334"
        else:
            s = rnd.choice((hexa(rnd.choice((32, 40, 48, 64))), pick(rnd.randint(14, 40), solid), "AKIA" + pick(16, rnd.choice(("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ7"))), "sk_live_" + pick(24, solid), "ghp_" + pick(36, solid)))
            known = s.startswith(("AKIA", "sk_live_", "ghp_"))
            if not any(c.isdigit() for c in s):
                s = s[:-1] + "7"
            quote = rnd.choice(("'", '"', '"', ""))
            if not known or rnd.random() < 0.6:
                lead = rnd.choice(_CUES[kind].split()) + rnd.choice((" = ", "=", ": ", " ")) + quote
                return lead, s, quote, kind
        return lead, s, "", kind

    def other() -> str:
        return rnd.choice((digits(rnd.randint(1, 9)), digits(rnd.randint(10, 20)), digits(16), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(3)}-{digits(3)}-{digits(5)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{word().upper()}{digits(2)}{word().upper()}{digits(8)}", f"{digits(4)}-{digits(4)}", f"{digits(4)} {digits(4)}", f"{digits(2)} {digits(3)} {digits(2)}", f"{word()} (at) {word()}", f"look at {word()} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(3)}-{digits(2)}-{digits(4)}-{digits(2)}", f"DE{digits(20)}", f"commit {hexa(40)}", f"sha256: {hexa(64)}", f"md5 {hexa(32)}", f"order {digits(3)}-{digits(7)}-{digits(7)}", f"isbn 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"id {digits(8)}-{pick(4, '0123456789abcdef')}-{digits(4)}", f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", f"{word()}{digits(3)}-{digits(4)}", f"pages {digits(3)}-{digits(3)}", " ".join(digits(rnd.randint(1, 4)) for _ in range(rnd.randint(3, 7))), ",".join(digits(rnd.randint(1, 4)) for _ in range(rnd.randint(3, 9))), f"v{digits(1)}.{digits(2)}.{digits(3)}", f"the {rnd.choice(('token', 'password', 'key', 'card', 'phone'))} {word()} {digits(3)}"))

    parts, spans = "", []
    for _ in range(rnd.randint(2, 5)):
        parts += " ".join(word() for _ in range(rnd.randint(1, 4))) + " "
        if rnd.random() < 0.5:
            lead, s, tail, kind = entity()
            parts += lead
            spans.append((len(parts), len(parts) + len(s), kind))
            parts += s + tail
        else:
            parts += other()
        parts += rnd.choice((" ", ". ", ", ", "\n"))
    return parts, spans


@lru_cache(maxsize=1)
def trained() -> Model:
    rnd = random.Random(11)
    return fit([_sentence(rnd) for _ in range(TRAINING_SENTENCES)])[0]


def zones_of(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint stretches around what may be an entity, cut at blanks; found in one pass."""
    triggers = [m.span() for m in _TRIGGER.finditer(text) if m.end() - m.start() >= 7 or sum("0" <= c <= "9" for c in m.group()) >= 4]
    triggers += [m.span() for m in _CODE.finditer(text)] + [m.span() for m in _WRITTEN.finditer(text)]
    low, high = 0, -1
    for a, b in sorted(triggers):
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if high >= 0 and a <= high:
            if b <= high:
                continue
        else:
            if high >= 0:
                yield low, high
            while a > max(0, high) and not text[a - 1].isspace():
                a -= 1
            low = a
        while b < len(text) and not text[b].isspace():
            b += 1
        high = b
    if high >= 0:
        yield low, high


#: Letters and digits mixed, as in codes; the bound keeps the look-ahead short.
_CODE = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]{0,40}[0-9])(?=[0-9]{0,40}[A-Za-z])[A-Za-z0-9]{12,}|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{0,4}:")


def model_spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """Spans by the model, in order and without overlaps."""
    return [span for a, b in zones_of(text) for span in viterbi(read_zone(text, a, b), model)]


def find_spans(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans (kind, start, end) in listing order."""
    base = base_spans(text)
    spans = [(k, a, b) for k in BASE_KINDS for a, b in base[k]]
    taken = sorted((a, b) for _, a, b in spans)
    at, reach = 0, 0
    for a, b, kind in model_spans(text, model):
        # Base spans that begin before this one ends; they may overlap each other.
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a:
            spans.append((kind, a, b))
    return base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` per row."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            digests, listed, sizes = [], [], []
            for scalar in batch.column(1):
                base, spans = find_spans(scalar.as_py() or "", model)
                for k in BASE_KINDS:
                    counts[k].append(len(base[k]))
                digests.append(hashlib.sha256(written([(k, a, b) for k in BASE_KINDS for a, b in base[k]]).encode()).hexdigest())
                listed.append(written(spans))
                sizes.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"])

    return id_and_text(docs).mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace spans by their kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced; columns stay, ``n_chars`` is counted anew."""
    model = trained()
    schema = docs.schema
    at_text = docs.columns.index("text")
    at_size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            sizes = batch.column(at_size).to_pylist() if at_size >= 0 else []
            for i, text in enumerate(texts):
                spans = find_spans(text, model)[1] if text else []
                if spans:
                    texts[i] = redact_text(text, spans)
                    if at_size >= 0:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at_text] = pa.array(texts, batch.schema.field(at_text).type)
            if at_size >= 0:
                columns[at_size] = pa.array(sizes, batch.schema.field(at_size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), schema)
