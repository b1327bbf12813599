"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans (email, ip, card, phone by fixed patterns) are always reported. Further candidates are spans of looser shapes: written-out or
broken-up addresses ("a at b dot com", "1[.]2[.]3[.]4"), addresses of version 6, phone numbers without a country code or with 00, and digit
groups that fail the card checksum or have other separators. Each candidate, base or not, gets the votes of five labelers (shape, check
digits or ranges, gazetteer, words before it, neighbours) and four traits of its own (how it is written and what stands around it).

EM estimates for each kind how often each labeler is right, from the votes of all candidates; what the fixed patterns say is one
vote among others, not the truth. A logistic regression is then trained on EM's beliefs, with kind, votes and traits, and accepts a candidate
at a fixed probability. What leaves a task for the fit is how often each combination occurs over the whole corpus: at most
len(KINDS) * 2 * 3**5 * 2**4 rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, stash, texts

KINDS = ("email", "ip", "card", "phone")
#: A candidate is added at this probability.
ACCEPT = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(](?:at|AT|@)[\])] ?| (?:at|AT) )[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT|\.)[\])] ?| (?:dot|DOT) )[A-Za-z0-9-]++)+")
_LOCAL_PHONE = re.compile(r"(?<![A-Za-z0-9_+.(=/#\"'-])(?:\+1[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_ABROAD = re.compile(r"(?<![0-9])00[1-9][0-9]{0,2}(?:[ .-]?[0-9]){7,12}(?![0-9])")
_BROKEN_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}(?![0-9A-Za-z:])")
_OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])")

#: Gazetteers and cue words (fixed lists).
TOP_DOMAINS = frozenset("com org net edu gov mil int io info biz dev app ai co me tv xyz online site shop tech cloud name eu de fr es it pt nl be lu at ch li dk se no fi is ie uk pl cz sk hu ro bg gr hr si rs ua ru ee lv lt tr il in pk bd lk cn jp kr tw hk sg my th vn id ph au nz ca us mx br ar cl pe za ng ke eg ma ae sa".split())
COUNTRY_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 880 886 961 962 965 966 971 972 974".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|62")
CUES = {
    "email": re.compile(r"e-?mail|contact|write|correo|courriel|adresse|kontakt"),
    "ip": re.compile(r"\bip\b|host|server|address|adresse|dirección"),
    "card": re.compile(r"card|visa|mastercard|credit|karte|carte|tarjeta"),
    "phone": re.compile(r"phone|call|tel\b|tel\.|fax|mobile|telefon|teléfono|appel"),
}
CODE_CUES = re.compile(r"(?:token|sha[0-9]*|hash|key|version|uuid|order|invoice|id)\W{0,3}$|[=#/\"]\s*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    free = 0  # a match cannot begin before the end of the one before it
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans that touch no base span and no candidate that begins before them; of several from one place a phone number, before a card."""
    found = []
    if any(x in text for x in (" at ", " AT ", "at)", "at]", "AT)", "AT]", "@)", "@]")):
        found += [(m.start(), 0, m.end()) for m in _WRITTEN.finditer(text)]
    if ":" in text:
        found += [(m.start(), 1, m.end()) for m in _IP6.finditer(text) if m[0].count(":") > 2 and _DIGITS.search(m[0])]
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _BROKEN_IP.finditer(text) if all(_small(x) for x in re.findall("[0-9]+", m[0]))]
        found += [(m.start(), 3, m.end()) for p in (_LOCAL_PHONE, _ABROAD) for m in p.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= sum(map(str.isdigit, m[0])) <= 19]
        found += [(m.start(), 2, m.end()) for m in _OTHER_CARD.finditer(text)]
    # both lists go by start; base spans of two kinds may overlap, so what they cover is told by the furthest end so far
    out, k, reach, free = [], 0, 0, 0
    for s, kind, e in sorted(found, key=lambda c: (c[0], -c[1])):
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][2])
            k += 1
        if s >= reach and s >= free:
            out.append((s, kind, e))
            free = e
    return out


def votes(text: str, span: tuple[int, int, int], is_base: bool, near: bool) -> tuple[int, ...]:
    """Five votes, each 0 (no), 1 (abstains) or 2 (yes): shape, checks, gazetteer, context, neighbours. near: a base span is within 200 characters."""
    s, k, e = span
    own, before = text[s:e], text[max(0, s - 40) : s].lower()
    digits = "".join(c for c in own if c.isdigit())
    shape = 2 if is_base else 1 if k in (0, 1, 3) else 0
    check = 1
    if k == 2:
        check = 2 if 14 <= len(digits) <= 19 and luhn(digits) else 0
    elif k == 3:
        # without a country code: neither area nor exchange begins with 0 or 1
        check = 2 if own[0] == "+" or own.startswith("00") or digits[0] > "1" and digits[3] > "1" else 0
    elif k == 1 and ":" in own:
        check = 2 if own.count(":") == 7 or "::" in own else 0
    if k == 0:
        known = 2 if re.split(r"[.\s)\]]", own)[-1].lower() in TOP_DOMAINS else 0
    elif k == 1:
        known = 0 if own.startswith(("0.", "127.", "255.")) else 1
    elif k == 2:
        known = 2 if ISSUERS.match(digits) else 0
    else:
        abroad = own[0] == "+" or own.startswith("00")
        known = (2 if digits.removeprefix("00").startswith(COUNTRY_CODES) else 0) if abroad else 1
    context = 2 if CUES[KINDS[k]].search(before) else 0 if CODE_CUES.search(before) else 1
    return shape, check, known, context, 2 if near else 1


def traits(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """Four yes-or-no traits: has separators, follows a colon, touches a letter, digit or underline, stands at a line's end."""
    s, _, e = span
    before, after = text[max(0, s - 2) : s].strip(), text[e : e + 1]
    touches = lambda c: c.isalnum() or c == "_"
    return int(any(c in " .-/_" for c in text[s:e])), int(before.endswith((":", "="))), int(touches(text[s - 1 : s]) or touches(after)), int(after in ("", "\n"))


def _code(kind: int, is_base: bool, v: tuple[int, ...], t: tuple[int, ...] = (0, 0, 0, 0)) -> int:
    n = kind * 2 + is_base
    for x in v:
        n = n * 3 + x
    for x in t:
        n = n * 2 + x
    return n


def _decode(code: int) -> tuple[int, bool, list[int], list[int]]:
    v, t = [], []
    for _ in range(4):
        code, x = divmod(code, 2)
        t.append(x)
    for _ in range(5):
        code, x = divmod(code, 3)
        v.append(x)
    return code // 2, bool(code % 2), v[::-1], t[::-1]


def _codes(text: str, spans: list[tuple[int, int, int]], is_base: bool, base: list[tuple[int, int, int]]) -> list[int]:
    """The combinations of spans that go by start, as base does."""
    starts = [s for s, _, _ in base]
    out = []
    for span in spans:
        lo, hi = bisect_right(starts, span[0] - 200), bisect_left(starts, span[0] + 200)
        out.append(_code(span[1], is_base, votes(text, span, is_base, hi - lo > is_base), traits(text, span)))
    return out


def em(kind: np.ndarray, v: np.ndarray, n: np.ndarray, steps: int = 60) -> np.ndarray:
    """The belief that each combination is personal data: two classes, labelers that err independently, with rates of their own for each kind.

    It starts at the majority of votes; rates are smoothed towards those of all kinds together, and these towards labelers that are rather right.
    Where a labeler abstains it says nothing.
    """
    belief = 1 / (1 + np.exp(-(v - 1).sum(1)))
    for _ in range(steps):
        odds = np.zeros(len(n))
        for y, sign in ((0, -1), (1, 1)):
            weight = n * (belief if y else 1 - belief)
            for j in range(v.shape[1]):
                said = v[:, j] != 1
                yes = v[said, j] == 2
                pooled = np.array([8.0, 2.0] if y == 0 else [2.0, 8.0]) + np.bincount(yes, weight[said], 2)
                own = np.bincount(kind[said] * 2 + yes, weight[said], 2 * len(KINDS)).reshape(-1, 2) + 20 * pooled / pooled.sum()
                odds[said] += sign * np.log(own / own.sum(1, keepdims=True))[kind[said], yes.astype(int)]
        share = (np.bincount(kind, n * belief, len(KINDS)) + 10) / (np.bincount(kind, n, len(KINDS)) + 20)
        belief = 1 / (1 + np.exp(-np.clip(odds + np.log(share / (1 - share))[kind], -40, 40)))
    return belief


def fit(counts: dict[int, int]) -> dict[int, float]:
    """From how often each combination occurs, the probability that the final classifier gives to each."""
    codes = sorted(counts)
    if not codes:
        return {}
    n = np.array([counts[c] for c in codes], float)
    parts = [_decode(c) for c in codes]
    kind, v, t = np.array([p[0] for p in parts]), np.array([p[2] for p in parts]), np.array([p[3] for p in parts], float)
    belief = em(kind, v, n)
    # logistic regression on kind, votes and traits, to EM's beliefs, each combination as often as it occurs
    x = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[v[:, j]] for j in range(5)), t], axis=1)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (weight * (p - belief)) + 1e-4 * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(codes, p.tolist()))


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: kind:start:end in code points, by start, then kind.

    The counts and the hash are of base spans; spans has the added ones too. Null and empty texts have no spans;
    repeated rows and rows with a null doc_id are searched one by one; texts may be of any length; an empty table gives no rows.
    """

    def search(batches):
        for whole in batches:
            for b in slices(whole):
                out = {"doc_id": b.column("doc_id"), "base": [], "more": [], "codes": [], "base_codes": []}
                for text in b.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    more = _candidates(text, base)
                    out["base"].append([x for s in base for x in s])
                    out["more"].append([x for s in more for x in s])
                    out["codes"].append(_codes(text, more, False, base))
                    out["base_codes"].append(_codes(text, base, True, base))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_pydict({k: v if k == "doc_id" else pa.array(v, ints) for k, v in out.items()})

    seen = stash(texts(docs).mapInArrow(search, "doc_id long, base array<int>, more array<int>, codes array<int>, base_codes array<int>"), "spans")
    counts = seen.select(F.explode(F.concat("codes", "base_codes")).alias("code")).groupBy("code").count().collect()
    model = docs.sparkSession.sparkContext.broadcast(fit({r["code"]: r["count"] for r in counts}))

    def decide(batches):
        for b in batches:
            n = np.zeros((b.num_rows, len(KINDS)), np.int64)
            digest, spans = [], []
            for i, (base, more, codes) in enumerate(zip(*(b.column(c).to_pylist() for c in ("base", "more", "codes")))):
                base = list(zip(*[iter(base)] * 3))
                for _, k, _ in base:
                    n[i, k] += 1
                added = [s for s, c in zip(zip(*[iter(more)] * 3), codes) if model.value[c] >= accept]
                digest.append(hashlib.sha256(_said(base).encode()).hexdigest())
                spans.append(_said(sorted(base + added)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return seen.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
