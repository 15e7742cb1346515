"""Text decoded with the wrong character encoding: found and restored (problem 8).

A hidden Markov model labels the characters outside ASCII. It has one clean state, one state for each
pair (real encoding, wrong encoding), and one for replacement characters, whose bytes are lost. What a
state emits is judged by one model of clean characters in their context: the clean state emits the
character as it stands, the state of a pair emits what its inverse transform makes of it. For pairs whose
real encoding is UTF-8 a unit of two to four characters is emitted at its lead; UTF-8 is self-synchronising,
so each state has only one way to read the characters. Viterbi runs over all texts of a batch at once.

The model of clean characters is learned from all documents: first from all characters outside
what would be valid UTF-8 under some pair, then (hard EM) from those that are labelled clean. Labelled spans get the inverse transform of their state; passes repeat
until nothing is labelled, which undoes text garbled any number of times. A text that comes back to a form it had
before is left there.

Defined results: null and empty texts have no case and stay; text without characters outside ASCII stays;
replacement characters are found but stay; characters without an inverse in a labelled span stay, and the
text then counts as not fully restored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import spread

#: (real encoding, wrong encoding) of each pair that has a state; "utf-8*2" was garbled so twice.
PAIRS = [
    ("utf-8*3", "cp1252"), ("utf-8*3", "latin-1"), ("utf-8*2", "cp1252"), ("utf-8*2", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "iso8859-15"), ("utf-8", "cp1250"), ("utf-8", "iso8859-2"),
    ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "koi8-r"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
]
CLEAN, LOST = 0, len(PAIRS) + 1
N_STATES = len(PAIRS) + 2
INVALID = -14.0
ENTER, LEAVE, SWITCH = -4.5, -2.0, -8.0
# Box and block signs are right in plain text, yet UTF-8 read as koi8-r is made of them: it costs more to enter.
EXTRA = np.array([-8.0 if i and i <= len(PAIRS) and PAIRS[i - 1] == ("utf-8", "koi8-r") else 0.0 for i in range(N_STATES)], np.float32)

# Characters up to FOLD stand for themselves, higher ones for their block of 256; neighbours for a class.
FOLD = 0x3000
N_CHARS = FOLD + 0x1100
N_NEAR = 32
N_CONTEXT = N_NEAR * N_NEAR


def _near_table() -> np.ndarray:
    """Class of a neighbour: its letter in lower case, or upper, digit, white space, mark, outside ASCII."""
    table = np.full(129, 30, np.uint8)
    for cp in range(128):
        ch = chr(cp)
        if ch.islower():
            table[cp] = cp - ord("a")
        elif ch.isupper():
            table[cp] = 26
        elif ch.isdigit():
            table[cp] = 27
        elif ch.isspace():
            table[cp] = 28
    table[128] = 31
    return table


NEAR = _near_table()


def _decoder(encoding: str) -> np.ndarray:
    """Code point of each byte; bytes that the encoding leaves undefined stand for themselves."""
    out = np.arange(256, dtype=np.int32)
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            pass
    return out


def _encoder(encoding: str) -> np.ndarray:
    """Byte of each code point below 0x10000, or -1; the last entry stands for the rest."""
    out = np.full(0x10001, -1, np.int16)
    table = _decoder(encoding)
    for b in range(255, 127, -1):
        out[table[b]] = b
    if encoding == "mac_roman":
        out[0xA4] = 0xDB  # the euro sign's place before it was redefined
    return out


_ENCODERS = {wrong: _encoder(wrong) for wrong in {w for _, w in PAIRS}}
_DECODERS = {real: _decoder(real) for real in {r for r, _ in PAIRS} if not real.startswith("utf-8")}


def _fold(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < FOLD, cp, FOLD + (cp >> 8))


class Marks:
    """The characters outside ASCII of a batch of texts, in order, with their neighbours."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.joined, self.cps = joined, cps
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.starts = np.concatenate([[0], ends[:-1]])
        self.at = np.flatnonzero(cps >= 0x80)
        self.cp = cps[self.at]
        self.doc = np.searchsorted(ends, self.at, side="right")
        self.near = NEAR[np.minimum(cps, 128)].astype(np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        return np.where(at > 0, self.near[np.maximum(at - 1, 0)], 28)

    def context(self, at: np.ndarray, length: np.ndarray | int = 1) -> np.ndarray:
        return self.before(at) * N_NEAR + self.near[np.minimum(at + length, len(self.near) - 1)]


class CleanModel:
    """log P(character | neighbours), smoothed towards log P(character)."""

    STRENGTH = 4.0

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.float64)
        self.alone = np.bincount(self.keys // N_CONTEXT, self.counts, N_CHARS) + 1e-3
        self.alone /= self.alone.sum()
        self.contexts = np.bincount(self.keys % N_CONTEXT, self.counts, N_CONTEXT)

    def __call__(self, cp: np.ndarray, context: np.ndarray) -> np.ndarray:
        char = _fold(cp)
        key = char * N_CONTEXT + context
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            n = np.where(self.keys[i] == key, self.counts[i], 0.0)
        else:
            n = 0.0
        return np.log((n + self.STRENGTH * self.alone[char]) / (self.contexts[context] + self.STRENGTH))


def _units(b: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid UTF-8 units in the bytes ``b``, each of which takes ``width`` characters from ``at``: index, bytes, code point."""
    n = len(b)
    size = np.select([(b >= 0xC2) & (b <= 0xDF), (b >= 0xE0) & (b <= 0xEF), (b >= 0xF0) & (b <= 0xF4)], [2, 3, 4], 0)
    lead = np.flatnonzero(size)
    size = size[lead]
    code = b[lead] & np.select([size == 2, size == 3], [0x1F, 0x0F], 0x07)
    ok = lead + size <= n
    for k in (1, 2, 3):
        use = size > k
        j = np.minimum(lead + k, n - 1)
        good = (b[j] >= 0x80) & (b[j] <= 0xBF) & (at[j] == at[j - 1] + width[j - 1])
        ok &= ~use | good
        code = np.where(use, code << 6 | b[j] & 0x3F, code)
    low = np.select([size == 2, size == 3], [0x80, 0x800], 0x10000)
    ok &= (code >= low) & (code <= 0x10FFFF) & ((code < 0xD800) | (code > 0xDFFF))
    return lead[ok], size[ok], code[ok]


def utf8_units(m: Marks, real: str, wrong: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of a pair whose real encoding is UTF-8: index of the first mark, number of marks, code point."""
    encoder = _ENCODERS[wrong]
    lead, size, code = _units(encoder[np.minimum(m.cp, 0x10000)].astype(np.int64), m.at, np.ones(len(m.at), np.int64))
    for _ in range(1, int(real.partition("*")[2] or 1)):
        outer, n, code = _units(encoder[np.minimum(code, 0x10000)].astype(np.int64), m.at[lead], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        lead, size = lead[outer], ends[outer + n] - ends[outer]
    return lead, size, code


def plausible(m: Marks) -> np.ndarray:
    """Marks outside any unit that would be a Latin letter or common sign in UTF-8: ordinary text has hardly any."""
    keep = m.cp != 0xFFFD
    for wrong in {w for r, w in PAIRS if r == "utf-8"}:
        lead, size, code = utf8_units(m, "utf-8", wrong)
        likely = (code >= 0xA0) & (code < 0x250) | (code >= 0x2010) & (code < 0x20C0)
        lead, size = lead[likely], size[likely]
        for j in range(size.max(initial=0)):
            keep[lead[size > j] + j] = False
    return keep


def emissions(m: Marks, model: CleanModel) -> np.ndarray:
    e = np.full((len(m.cp), N_STATES), INVALID, np.float32)
    if not len(m.cp):
        return e
    context = m.context(m.at)
    lost = m.cp == 0xFFFD
    e[:, CLEAN] = np.where(lost, 4 * INVALID, model(m.cp, context))
    e[lost, LOST] = 0
    e[~lost, LOST] = 4 * INVALID
    for k, (real, wrong) in enumerate(PAIRS, 1):
        if real.startswith("utf-8"):
            lead, size, code = utf8_units(m, real, wrong)
            e[lead, k] = model(code, m.context(m.at[lead], size))
            for j in range(1, size.max(initial=0)):
                e[lead[size > j] + j, k] = 0
        else:
            b = _ENCODERS[wrong][np.minimum(m.cp, 0x10000)]
            ok = np.flatnonzero(b >= 0)
            e[ok, k] = model(_DECODERS[real][b[ok]], context[ok])
    return e


def viterbi(e: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Best state of each mark. All texts advance together, longest first, so each step is one array."""
    n = len(e)
    state = np.zeros(n, np.int8)
    if not n:
        return state
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    into = ENTER + EXTRA
    into[CLEAN] = 0
    score = e[first] + into
    back = np.empty((n, N_STATES), np.int8)
    rows = np.arange(N_STATES)
    for t in range(1, len(active)):
        now = active[t]
        s = score[:now]
        clean = s[:, CLEAN]
        others = s[:, 1:]
        best = others.argmax(1) + 1
        top = s[np.arange(now), best]
        # From the clean state, from the best other state, or staying.
        to = np.where((clean + ENTER)[:, None] >= (top + SWITCH)[:, None], clean[:, None] + ENTER, top[:, None] + SWITCH)
        src = np.where(clean + ENTER >= top + SWITCH, CLEAN, best)[:, None].repeat(N_STATES, 1)
        to = to + EXTRA
        stay = s >= to
        src = np.where(stay, rows, src)
        to = np.where(stay, s, to)
        leave = top + LEAVE > clean
        src[:, CLEAN] = np.where(leave, best, CLEAN)
        to[:, CLEAN] = np.where(leave, top + LEAVE, clean)
        at = first[:now] + t
        back[at] = src
        score[:now] = to + e[at]
    final = score.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        now = active[t]
        at = first[:now] + t
        state[at] = final[:now]
        if t:
            final[:now] = back[at, final[:now]]
    return state


def label(texts: list[str], model: CleanModel) -> tuple[Marks, np.ndarray]:
    m = Marks(texts)
    return m, viterbi(emissions(m, model), m.doc)


def restore(texts: list[str], model: CleanModel) -> list[tuple[bool, bool, list[str], str]]:
    """For each text: found, fully restored, pairs in the order undone, restored text."""
    found = [False] * len(texts)
    whole = [True] * len(texts)
    pairs: list[list[str]] = [[] for _ in texts]
    out = list(texts)
    todo = list(range(len(texts)))
    seen: list[set[str]] = [set() for _ in texts]
    while todo:
        m, state = label([out[i] for i in todo], model)
        if not state.any():
            break
        edits: dict[int, list[tuple[int, int, str]]] = {}
        for d in np.unique(m.doc[state > 0]):
            found[todo[d]] = True
        for d in np.unique(m.doc[state == LOST]):
            whole[todo[d]] = False
        for k, (real, wrong) in enumerate(PAIRS, 1):
            mine = state == k
            if not mine.any():
                continue
            for d in np.unique(m.doc[mine]):
                pairs[todo[d]].append(f"{real}>{wrong}")
            done = np.zeros(len(state), bool)
            if real.startswith("utf-8"):
                lead, size, code = utf8_units(m, real, wrong)
                use = mine[lead]
                for j, n, c in zip(lead[use].tolist(), size[use].tolist(), code[use].tolist()):
                    done[j : j + n] = True
                    edits.setdefault(int(m.doc[j]), []).append((int(m.at[j]), n, chr(c)))
            else:
                b = _ENCODERS[wrong][np.minimum(m.cp, 0x10000)]
                for j in np.flatnonzero(mine & (b >= 0)).tolist():
                    done[j] = True
                    edits.setdefault(int(m.doc[j]), []).append((int(m.at[j]), 1, chr(_DECODERS[real][b[j]])))
            for d in np.unique(m.doc[mine & ~done]):
                whole[todo[d]] = False
        nxt = []
        for d, found_here in edits.items():
            base, text, parts, last = int(m.starts[d]), out[todo[d]], [], 0
            for at, n, new in sorted(found_here):
                parts += [text[last : at - base], new]
                last = at - base + n
            i = todo[d]
            seen[i].add(text)
            out[i] = "".join(parts) + text[last:]
            if out[i] not in seen[i]:
                nxt.append(i)
        todo = nxt
    return list(zip(found, whole, pairs, out))


_COUNTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with a character outside ASCII; the others never reach Python."""
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))


def learn(docs: DataFrame, text: str = "text", rounds: int = 2) -> CleanModel:
    """The model of clean characters, from every text.

    The counts collected are bounded by the alphabet (characters or blocks x 32 x 32 neighbours), not by
    the number of documents; they are summed before the shuffle.
    """
    spark = docs.sparkSession
    source = spread(_marked(docs, text, text).select("text"))
    model = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                if shared.value is None:
                    m = Marks(texts)
                    keep = plausible(m)
                else:
                    m, state = label(texts, shared.value)
                    keep = state == CLEAN
                key = _fold(m.cp[keep]) * N_CONTEXT + m.context(m.at[keep])
                both = np.concatenate([keys, key])
                weight = np.concatenate([counts, np.ones(len(key), np.int64)])
                keys, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, weight, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        rows = source.mapInArrow(count, _COUNTS).groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        model = CleanModel(rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    return model


def repaired(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fully_restored, pairs, restored): one row for each text with garbled characters."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, text))
    source = spread(_marked(docs, key, text))
    schema = T.StructType(
        [
            T.StructField(key, source.schema["key"].dataType),
            T.StructField("fully_restored", T.BooleanType()),
            T.StructField("pairs", T.ArrayType(T.StringType())),
            T.StructField("restored", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = restore(batch.column(1).to_pylist(), model.value)
            rows = [i for i, r in enumerate(results) if r[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([results[i][1] for i in rows], pa.bool_()),
                    pa.array([results[i][2] for i in rows], pa.list_(pa.string())),
                    pa.array([results[i][3] for i in rows], pa.string()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the texts that were decoded wrongly, in whole or in part; each key once."""
    return repaired(docs, key, text).select(key).distinct()
