"""Personal information in free text, found and replaced by typed placeholders (problem 1).

A linear-chain conditional random field tags the chunks of a text (runs without white space, and line breaks) as
beginning, continuing or outside an item of one kind. Features are word shapes, digit patterns, marks at either
end, known words, and how the word occurs in the whole corpus (an ordinary word, a frequent name or label, or
rare), each for the chunk and its three neighbours on either side. The field is trained by maximum likelihood
on the small labelled table of ``pii_samples`` (its size is a parameter) and decoded by Viterbi over padded batches
of texts. An exact check of form follows (an e-mail address has a host, a phone number enough digits and so on).

Defined results: null and empty texts have no items and stay; texts are tagged whole; an item that occurs
several times in a document is one row of ``found``, and every occurrence is replaced.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import names, pii_samples, scans
from paperloom.llm.common import spread

KINDS = ("email", "phone", "identity", "address", "name")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
L = len(LABELS)
REACH = 3  # chunks on either side whose features count
ROLES = tuple(range(-REACH, REACH + 1))
SAMPLES = 3000
EPOCHS = 36
BREAK = "⏎"
_PUNCT = ".,;:()<>[]{}\"'|!?-–—*#"
_MAX_TYPES = 200_000

_GIVEN = {g.lower() for g in pii_samples.GIVEN} | {n for n in names.NICKNAMES if len(n) > 2} - {"bill", "will", "art", "rich", "ray", "pat", "don", "val", "leo"}
_GERMAN = tuple(pii_samples.GERMAN_STREETS)
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")


def _allowed() -> np.ndarray:
    """-inf where a label can't follow another: an item continues only one of its own kind."""
    t = np.zeros((L, L), np.float32)
    for j in range(1, len(KINDS) + 1):
        t[:, 2 * j] = -1e4
        t[2 * j - 1, 2 * j] = t[2 * j, 2 * j] = 0
    return t


MASK = _allowed()
FIRST = np.where([x.startswith("I") for x in LABELS], -1e4, 0).astype(np.float32)


def chunks(text: str) -> list[str]:
    return text.replace("\n", f" {BREAK} ").replace("\f", f" {BREAK} ").split()


def nines(text: str) -> str:
    """All digits as 9. Replacing digit by digit is several times faster than a translation table."""
    for d in "012345678":
        text = text.replace(d, "9")
    return text


def _shape(core: str) -> str:
    out = []
    for c in core[:24]:
        s = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)[:10]


def features(chunk: str, kind: str) -> list[str]:
    """Features of a chunk whose digits are all nines. ``kind`` says how its word occurs in the corpus."""
    if chunk == BREAK:
        return ["break"]
    core = chunk.strip(_PUNCT)
    low, shape = core.lower(), _shape(core)
    f = ["any", f"w={low}", f"shape={shape}", f"kind={kind}{shape[:2]}"]
    if chunk[-1] in _PUNCT:
        f += [f"end={chunk[-1]}", f"end={chunk[-1]}{kind}"]
    if chunk[0] in _PUNCT:
        f.append(f"beg={chunk[0]}")
    if "9" in core:
        f.append("digits=" + "".join("A" if c.isalpha() else c for c in core[:18]))
        f.append(f"ndigits={min(core.count('9'), 12)}")
    elif core:
        f.append(f"len={min(len(core), 8)}")
        if low in _GIVEN:
            f += ["given", "given" + (chunk[-1] if chunk[-1] in _PUNCT else "")]
        elif kind == "r":
            f.append("rare" + (chunk[-1] if chunk[-1] in _PUNCT else ""))
        if low.endswith(_GERMAN) and len(low) > 6:
            f.append("germanstreet")
    if "@" in chunk or "[at]" in low or "(at)" in low:
        f.append("at" + ("1" if len(chunk) > 6 else ""))
    if _HOST.fullmatch(core) and not core[0] == "9":
        f.append("host")
    return f


class Kinds:
    """How a word occurs in the corpus: o ordinary, c frequent but hardly in lower case, r rare, - not a word."""

    def __init__(self, ordinary: set[str], frequent: set[str]):
        self.ordinary, self.frequent = ordinary, frequent

    def __call__(self, chunk: str) -> str:
        core = chunk.strip(_PUNCT).lower()
        if not core or not core.replace("-", "").replace("'", "").isalpha():
            return "-"
        return "o" if core in self.ordinary else "c" if core in self.frequent else "r"


def _sample_kinds(seed: int = 11) -> Kinds:
    """The same for the labelled table, whose own counts are too small to tell."""
    words = re.compile(r"[^\W\d_]+")
    ordinary, frequent = set(), set()
    slots = re.compile(r"\{\w+\}")
    m = pii_samples.Maker(1)
    literal = " ".join(slots.sub(" ", t) for t in pii_samples.HEADS + pii_samples.FIELDS + pii_samples.SENTENCES)
    literal += " " + " ".join(pii_samples.GOODS + pii_samples.KINDS + pii_samples.TEAMS + pii_samples.VERBS) + " " + " ".join(m.LABEL() for _ in range(400))
    literal += " ".join(pii_samples.ROMANCE_STREETS) + " de du des la van der von di da bis ter one two three four five six seven eight nine ten eleven twelve mr mrs ms dr prof"
    for w in words.findall(literal):
        ordinary.add(w.lower())
    for w in words.findall(" ".join(pii_samples.TRADES + pii_samples.FORMS + pii_samples.MONTHS + pii_samples.STREETS + pii_samples._PLACES)):
        if w.lower() not in ordinary:
            frequent.add(w.lower())
    frequent |= (_GIVEN | {w.lower() for w in pii_samples.Maker(seed).pool}) - ordinary
    return Kinds(ordinary, frequent)


class Model:
    """Weights by feature, role and label, and transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.index, self.weights, self.transitions = index, weights, transitions


def _forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, expected transitions and log partition of padded sequences (n, steps, L)."""
    n, steps, _ = e.shape
    expt = np.exp(np.maximum(trans + MASK, -60)) * (MASK > -1)
    alpha = np.zeros_like(e)
    scale = np.zeros((n, steps), np.float32)
    peak = e.max(2)
    x = np.exp(e - peak[:, :, None])
    a = x[:, 0] * (FIRST > -1)
    logz = np.zeros(n)
    for t in range(steps):
        if t:
            a = (a @ expt) * x[:, t]
        s = a.sum(1)
        a = a / s[:, None]
        alpha[:, t] = a
        scale[:, t] = s
        logz += np.where(t < lengths, np.log(s) + peak[:, t], 0)
    marginal = np.zeros_like(e)
    expected = np.zeros((L, L))
    b = np.ones((n, L), np.float32)
    for t in range(steps - 1, -1, -1):
        live = t < lengths
        last = t == lengths - 1
        b = np.where(last[:, None], 1.0, b)
        p = alpha[:, t] * b
        marginal[:, t] = np.where(live[:, None], p / np.maximum(p.sum(1), 1e-30)[:, None], 0)
        if t:
            y = x[:, t] * b / scale[:, t][:, None]
            y = np.where(live[:, None], y, 0)
            expected += (alpha[:, t - 1].T @ y) * expt
            b = np.where(live[:, None], y @ expt.T, 1.0)
    return marginal, expected, logz


@lru_cache(4)
def train(n: int = SAMPLES, epochs: int = EPOCHS, seed: int = 11, which: str = "all") -> Model:
    """Maximum likelihood with L2 by Adam, on ``n`` labelled samples."""
    kinds = _sample_kinds(seed)
    streets = {x for w in pii_samples.STREETS + pii_samples.ROMANCE_STREETS for x in (w, w.lower(), w.capitalize(), w.upper(), w.strip("."))}
    rng = np.random.default_rng(seed)
    seqs: list[tuple[list[int], list[int]]] = []
    types: dict[tuple[str, str], int] = {}
    counts: dict[str, int] = {}
    for text, spans in pii_samples.samples(n, seed, which):
        ids, tags, at = [], [], 0
        for chunk in chunks(text):
            if chunk == BREAK:
                at = min(i for i in (text.find("\n", at), text.find("\f", at)) if i >= 0)
                lo, hi = at, at + 1
            else:
                lo = text.index(chunk, at)
                hi = lo + len(chunk)
            at = hi
            tag = 0
            for a, b, k in spans:
                if lo < b and hi > a:
                    j = 2 * KINDS.index(k) + 1
                    tag = j if lo <= a else j + 1
            nine = nines(chunk)
            kind = kinds(nine)
            if nine.strip(_PUNCT) in streets:
                kind = "ocr"[rng.integers(3)]  # corpora differ in how they use street words
            elif kind == "o" and nine[0].isupper() and rng.random() < 0.2:
                kind = "c"  # words that only ever begin a line are hardly in lower case
            elif kind in "oc" and rng.random() < (0.03 if kind == "o" else 0.15):
                kind = "r"  # misread words, and names that a small corpus has seldom
            elif kind == "r" and rng.random() < 0.06:
                kind = "c"  # names that a large corpus has often
            key = (nine, kind)
            if key not in types:
                types[key] = len(types)
            ids.append(types[key])
            tags.append(tag)
            counts[nine] = counts.get(nine, 0) + 1
        seqs.append((ids, tags))
    # Words seen less than three times say nothing as such; given names only count as a list.
    index: dict[str, int] = {}
    rows: list[list[int]] = []
    often: dict[str, int] = {}
    for (c, _), _i in types.items():
        w = c.strip(_PUNCT).lower()
        often[w] = often.get(w, 0) + counts[c]
    for chunk, kind in types:
        mine = []
        for f in features(chunk, kind):
            if f.startswith("w=") and (often.get(f[2:], 0) < 3 or f[2:] in _GIVEN):
                continue
            mine.append(index.setdefault(f, len(index)))
        rows.append(mine)
    # Types by features as a flat pair of arrays.
    of_type = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    of_feature = np.concatenate([np.array(r, np.int64) for r in rows])
    order = np.argsort(of_feature, kind="stable")
    by_feature, starts = of_type[order], np.searchsorted(of_feature[order], np.arange(len(index)))
    type_starts = np.searchsorted(of_type, np.arange(len(rows)))
    w = np.zeros((len(index), len(ROLES) * L), np.float32)
    trans = np.zeros((L, L), np.float32)
    pad = len(rows)
    seqs.sort(key=lambda s: len(s[0]))
    size = -(-len(seqs) // 8)
    batches = []
    for lo in range(0, len(seqs), size):
        part = seqs[lo : lo + size]
        lengths = np.array([len(s[0]) for s in part])
        steps = lengths.max()
        ids = np.full((len(part), steps + 2 * REACH), pad)
        tags = np.zeros((len(part), steps), np.int64)
        for i, (a, b) in enumerate(part):
            ids[i, REACH : REACH + len(a)] = a
            tags[i, : len(b)] = b
        live = np.arange(steps) < lengths[:, None]
        gold = np.zeros((*tags.shape, L), np.float32)
        np.put_along_axis(gold, tags[:, :, None], 1, 2)
        gold *= live[:, :, None]
        pairs = np.zeros((L, L))
        both = live[:, 1:]
        np.add.at(pairs, (tags[:, :-1][both], tags[:, 1:][both]), 1)
        batches.append((ids, lengths, gold, pairs))
    m1, v1 = np.zeros_like(w), np.zeros_like(w)
    m2, v2 = np.zeros_like(trans), np.zeros_like(trans)
    step = 0
    total = sum(int(b[1].sum()) for b in batches)
    for epoch in range(epochs):
        rate = 0.08 * (1 - 0.85 * epoch / epochs)
        for k in rng.permutation(len(batches)):
            ids, lengths, gold, pairs = batches[k]
            r = np.concatenate([np.add.reduceat(w[of_feature], type_starts, axis=0), np.zeros((1, w.shape[1]), np.float32)]).reshape(-1, len(ROLES), L)
            steps = gold.shape[1]
            e = sum(r[ids[:, REACH + d : REACH + d + steps], q] for q, d in enumerate(ROLES))
            marginal, expected, _ = _forward_backward(e, lengths, trans)
            diff = (gold - marginal).reshape(-1, L)
            g_type = np.zeros((pad + 1, len(ROLES), L), np.float32)
            for q, d in enumerate(ROLES):
                flat = ids[:, REACH + d : REACH + d + steps].ravel()
                for lab in range(L):
                    g_type[:, q, lab] = np.bincount(flat, diff[:, lab], pad + 1)
            g = np.add.reduceat(g_type[:pad].reshape(pad, -1)[by_feature], starts, axis=0)
            share = lengths.sum() / total
            g -= 0.4 * share * w
            g_t = (pairs - expected - 0.4 * share * trans).astype(np.float32)
            step += 1
            for x, gx, m, v in ((w, g, m1, v1), (trans, g_t, m2, v2)):
                m += 0.1 * (gx - m)
                v += 0.01 * (gx * gx - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(index, w, trans)


def decode(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels (n, steps) of padded sequences of emissions (n, steps, L); padding must favour O."""
    n, steps, _ = e.shape
    t = (trans + MASK).T.copy()  # to, from
    back = np.empty((steps, n, L), np.int8)
    s = e[:, 0] + FIRST
    for k in range(1, steps):
        x = s[:, None, :] + t[None]
        b = x.argmax(2)
        back[k] = b
        s = np.take_along_axis(x, b[:, :, None], 2)[:, :, 0] + e[:, k]
    out = np.empty((n, steps), np.int8)
    now = s.argmax(1)
    rows = np.arange(n)
    for k in range(steps - 1, -1, -1):
        out[:, k] = now
        if k:
            now = back[k, rows, now]
    return out


class Tagger:
    """Decodes batches of texts; scores of chunk types are kept."""

    def __init__(self, model: Model, kinds: Kinds):
        self.model, self.kinds = model, kinds
        self._reset()

    def _reset(self) -> None:
        self.types: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(ROLES), L), np.float32)  # row 0 is beyond either end
        self.scored = 1

    def _ids(self, tokens: list[str]) -> list[int]:
        types = self.types
        try:
            return [types[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in types:
                    types[t] = self.scored
                    if self.scored == len(self.scores):
                        self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                    rows = [i for f in features(t, self.kinds(t)) if (i := self.model.index.get(f)) is not None]
                    self.scores[self.scored] = self.model.weights[rows].sum(0).reshape(len(ROLES), L)
                    self.scored += 1
            return [types[t] for t in tokens]

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Items of each text as (first chunk, chunk after the last, kind)."""
        if self.scored > _MAX_TYPES:
            self._reset()
        seqs = [self._ids(chunks(nines(t))) for t in texts]
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(seqs[i]))
        lo = 0
        while lo < len(order):
            # Texts of like length together, bounded in cells.
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and len(seqs[order[hi]]) * (hi - lo + 1) < 120_000 and len(seqs[order[hi]]) <= 1.3 * len(seqs[order[lo]]) + 16:
                hi += 1
            group = order[lo:hi]
            lo = hi
            steps = len(seqs[group[-1]])
            if not steps:
                continue
            ids = np.zeros((len(group), steps + 2 * REACH), np.int32)
            for r, i in enumerate(group):
                ids[r, REACH : REACH + len(seqs[i])] = seqs[i]
            e = self.scores[ids[:, 0:steps], 0]
            for q, d in enumerate(ROLES[1:], 1):
                e += self.scores[ids[:, REACH + d : REACH + d + steps], q]
            e[:, :, 0] += np.where(ids[:, REACH : REACH + steps] == 0, 1e4, 0)
            tags = decode(e, self.model.transitions)
            rows, cols = np.nonzero((tags % 2 == 1))
            for r, c in zip(rows.tolist(), cols.tolist()):
                k, end = tags[r, c], c + 1
                while end < steps and tags[r, end] == k + 1:
                    end += 1
                found[group[r]].append((c, end, KINDS[(k - 1) // 2]))
        return found


# Whole items -----------------------------------------------------------------------------------------------------

_PARTICLES = {"van", "der", "den", "de", "del", "della", "la", "le", "du", "di", "da", "dos", "von", "zu", "ter", "ten", "bin", "al"}
_SHORT_GIVEN = {"Bill", "Will", "Art", "Rich", "Ray", "Pat", "Don", "Val", "Leo", "Jo", "Al", "Ed"}  # given names that are words too
_NUMBER_WORD = re.compile(r"^(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b", re.I)
_STREET_WORDS = {w.strip(".").lower() for w in pii_samples.STREETS} | {"plaza", "square", "row", "walk", "mews"}
_FIRM_END = {"inc", "llc", "ltd", "limited", "plc", "corp", "corporation", "company", "gmbh", "bv", "sa", "llp", "ag", "co"}
_HOUSE = re.compile(r"(?:\d{1,5}[A-Za-z]?|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve),?")


def widen(tokens: list[str], items: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Items completed by what belongs to them by form: particles, house numbers, prefixes and last labels of hosts."""
    out = []
    for a, b, kind in items:
        floor = out[-1][1] if out else 0
        back = lambda i: i - 1 if i - 1 >= floor else -1
        if kind == "name":
            initial = re.fullmatch(r"[A-Z]\.", tokens[b - 1])
            while b + 1 < len(tokens) and tokens[b].lower() in _PARTICLES and tokens[b + 1][:1].isupper() and (initial or tokens[b - 1][-1].isalpha()):
                b += 2 + (tokens[b + 1].lower() in _PARTICLES and b + 2 < len(tokens))
            while (i := back(a)) >= 0 and tokens[i].lower() in _PARTICLES and (tokens[i].islower() or tokens[a].isupper()):
                a = i
            if (i := back(a)) >= 0 and tokens[i] in _SHORT_GIVEN:
                a = i
            if _place_or_firm(tokens, a, b):
                continue
            if _NUMBER_WORD.match(tokens[a]) and tokens[b - 1].strip(_PUNCT).lower() in _STREET_WORDS:
                kind = "address"
        elif kind == "address":
            if not any(c.isdigit() for t in tokens[a:b] for c in t) and any(t.strip(_PUNCT).lower() in _GIVEN for t in tokens[a:b]):
                kind = "name"
            elif not any(c.isdigit() for t in tokens[a:b] for c in t) and not _HOUSE.fullmatch(tokens[a]):
                i = back(a)
                while i >= 0 and tokens[i] == BREAK:
                    i = back(i)
                if i >= 0 and _HOUSE.fullmatch(tokens[i]):
                    a = i
        elif kind == "identity":
            i = back(a)
            if i >= 0 and tokens[i] == BREAK:
                i = back(i)
            if i >= 0 and re.fullmatch(r"\(?[A-Z]{2}", tokens[i]) and re.match(r"\d{2}\b", tokens[a]):
                a = i
        elif kind == "email":
            while b < len(tokens) and tokens[b - 1].lower() in ("dot", "at", "@"):
                b += 1 + (tokens[b] == BREAK)
            b = min(b, len(tokens))
            while b + 1 < len(tokens) and "." not in tokens[b - 1] and tokens[b].lower() == "dot":
                b += 2 + (tokens[b + 1] == BREAK)
            b = min(b, len(tokens))
        elif kind == "phone":
            parts = " ".join(tokens[a:b]).split(BREAK)
            if len(parts) > 1 and (sum(c.isdigit() for p in parts for c in p) > 15 or re.fullmatch(r"\s*\d{5}\s*", parts[0])):
                a = max(k for k in range(a, b) if tokens[k] == BREAK) + 1
        out.append((a, b, kind))
    return out


def _place_or_firm(tokens: list[str], a: int, b: int) -> bool:
    """A town before its code, or the first word of a firm whose name goes on in the next line."""
    after = [t for t in tokens[b : b + 6] if t != BREAK]
    if len(after) > 1 and re.fullmatch(r"[A-Z]{2}", after[0]) and re.fullmatch(r"\d{5}\W*", after[1]):
        return True
    if b - a == 1 and b < len(tokens) and tokens[b] == BREAK:
        stop = tokens.index(BREAK, b + 1) if BREAK in tokens[b + 1 :] else len(tokens)
        last = tokens[b + 1 : stop][-1:]
        return bool(last) and re.sub(r"\W", "", last[0]).lower() in _FIRM_END and tokens[a].strip(_PUNCT).lower() not in _GIVEN
    return False


# Exact checks of form -----------------------------------------------------------------------------------------

_LEAD = re.compile(r"^(?:[^\W\d_][\w.-]*:)+(?=\S)")
_EDGE = " \t.,;:<>[]{}\"'|!?*#" + BREAK
_EXTENSION = re.compile(r"\s*(?:ext\.?|extension|x)\s*\d+\W*$", re.I)
_NOBODY = {"madam", "sir", "sirs", "team", "all", "colleagues", "customer", "client", "subtotal", "total"}
_TITLE = re.compile(r"^(?:(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|sir|dear|hello|hi)\b\.?\s+)+", re.I)


def item(kind: str, raw: str) -> str | None:
    """The item in ``raw`` without what doesn't belong to it, or None if its form is wrong."""
    s = raw.replace(BREAK, " ").strip(_EDGE + ("" if kind == "phone" else "()"))
    if kind == "email":
        s = _LEAD.sub("", s).strip(_EDGE + "()")
        ok = ("@" in s or re.search(r"(?i)[\[(]at[\])]|\bat\b", s)) and re.search(r"\w{2}", s) and re.search(r"(?i)\w\.\s?\w|\bdot\b", s)
        return s if ok else None
    digits = sum(c.isdigit() for c in s)
    if kind == "phone":
        s = _EXTENSION.sub("", _LEAD.sub("", s))
        s = re.sub(r"^[^\d+(]+|[^\d]+$", "", s)
        digits = sum(c.isdigit() for c in s)
        return s if 7 <= digits <= 15 and sum(c.isalpha() for c in s) <= 2 else None
    if kind == "identity":
        s = re.sub(r"^\W+|\W+$", "", _LEAD.sub("", s))
        return s if digits >= 5 and sum(c.isalnum() for c in s) >= 7 and sum(c.isalpha() for c in s) <= 4 else None
    if kind == "address":
        s = s.rstrip(_EDGE)
        ok = (digits or _NUMBER_WORD.match(s)) and sum(c.isalpha() for c in s) >= 4 and digits <= 9
        return s if ok else None
    s = _TITLE.sub("", s)
    s = re.sub(r"^[^\w]+|[^\w]+$", "", s)
    return s if sum(c.isalpha() for c in s) >= 3 and not digits and s.lower() not in _NOBODY else None


def key_of(s: str) -> str:
    return "".join(c for c in s.lower() if c.isalnum())


# Operators -----------------------------------------------------------------------------------------------------


def corpus_kinds(texts: DataFrame) -> Kinds:
    """From counts over all texts (the frequent words are bounded in number, see ``scans``)."""
    vocab = scans.vocabulary(texts)
    ordinary = {w for w, o in zip(vocab.words, vocab.ordinary) if o}
    return Kinds(ordinary, set(vocab.words) - ordinary)


def fitted(samples: int = SAMPLES, path: str | None = None) -> Model:
    """The model, trained once a process; or read from ``path`` and written there where it is missing (any mounted folder)."""
    if path and os.path.exists(path):
        with np.load(path, allow_pickle=False) as saved:
            return Model({f: i for i, f in enumerate(saved["features"].tolist())}, saved["weights"], saved["transitions"])
    model = train(samples)
    if path:
        part = f"{path}.{uuid.uuid4().hex}.npz"
        np.savez(part, features=np.array(sorted(model.index, key=model.index.get)), weights=model.weights, transitions=model.transitions)
        os.replace(part, path)
    return model


def _tagger(documents: DataFrame, text: str, samples: int, path: str | None):
    texts = spread(documents.select(F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''"))
    return documents.sparkSession.sparkContext.broadcast((fitted(samples, path), corpus_kinds(texts)))


def _source(documents: DataFrame, key: str, text: str) -> DataFrame:
    return spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''"))


def found(documents: DataFrame, key: str = "doc_id", text: str = "raw_text", samples: int = SAMPLES, path: str | None = None) -> DataFrame:
    """(key, pii_type, pii_key): each different item of a document once."""
    shared = _tagger(documents, text, samples, path)
    source = _source(documents, key, text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("pii_type", T.StringType()), T.StructField("pii_key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts = part.column(1).to_pylist()
                rows, kinds, keys = [], [], []
                for i, items in enumerate(tagger.tag(texts)):
                    if not items:
                        continue
                    tokens = chunks(texts[i])
                    for pair in {(k, key_of(s)) for a, b, k in widen(tokens, items) if (s := item(k, " ".join(tokens[a:b])))}:
                        rows.append(i)
                        kinds.append(pair[0])
                        keys.append(pair[1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(keys, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema).distinct()


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """Items replaced by placeholders such as [NAME]; everything else stays as it was."""
    spots = [m.span() for m in re.finditer(r"\n|\f|[^\s]+", text)]
    out, last = [], 0
    for a, b, kind in widen(chunks(text), items):
        lo, hi = spots[a][0], spots[b - 1][1]
        inner = item(kind, " ".join(chunks(text[lo:hi])))
        if not inner:
            continue
        # Place of the item's first and last letter or digit within the chunks.
        letters = [i for i in range(lo, hi) if text[i].isalnum()]
        want, have = key_of(inner), "".join(text[i].lower() for i in letters)
        at = have.find(want)
        if at < 0 or len(have) != len(letters):
            at, want = 0, have
        start, stop = letters[at], letters[at + len(want) - 1] + 1
        if kind == "phone":
            while start > lo and text[start - 1] in "+(":
                start -= 1
        out += [text[last:start], f"[{kind.upper()}]"]
        last = stop
    return "".join(out) + text[last:]


def redacted(documents: DataFrame, key: str = "doc_id", text: str = "raw_text", samples: int = SAMPLES, path: str | None = None) -> DataFrame:
    """(key, redacted): one row for each row with text."""
    shared = _tagger(documents, text, samples, path)
    source = _source(documents, key, text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("redacted", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts = part.column(1).to_pylist()
                done = [redact(t, items) for t, items in zip(texts, tagger.tag(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
