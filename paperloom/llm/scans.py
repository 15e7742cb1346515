"""Text from scanned pages repaired into continuous paragraphs (problem 3).

1. Words are counted over all texts. Frequent ones (their share is ``SHARE`` or more beyond ``SURE`` standard errors,
   hence at most 1 / SHARE of them) are the vocabulary; ordinary words are those that also occur in lower case.
2. Skip-gram vectors with negative sampling are learned for the vocabulary from the co-occurrences of the
   whole corpus. These are counted where the texts are, kept as a table with one row a word, and the objective is
   maximised over all of them, word by word, by Newton steps that alternate between word and context vectors; only
   vectors, whose number is bounded, reach the driver.
3. A rare word has the vector of its context: it is linked to the frequent words that plausible glyph edits turn it
   into (equal after folding confused glyphs), ranked by the affinity of their vectors. That is a log-likelihood
   ratio: how much likelier the words around are beside the frequent word than elsewhere. Together with how unlikely a
   chance resemblance is (longer words, signs among letters) it must not be negative. A frequent word is rare here
   beside one that is ``RATIO`` times as frequent.
4. Furniture is found per text: page numbers, alone or beside a title, and titles that recur at page tops.
5. With furniture gone, words divided at line ends are joined unless they are compounds, misread words are corrected
   in context, and lines are reflowed into paragraphs.

Defined results: null and empty texts have no noise and stay; texts are processed whole; a text counts once
however often its row is repeated; words seen rarely without a frequent neighbour stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import STOPWORDS
from paperloom.llm.common import spread
from paperloom.session import materialize

SHARE = 1e-5
SURE = 2.0
RATIO = 100.0
WINDOW = 3
DIM = 16
SWEEPS = 5
NEWTON = 2
RIDGE = 1.0
NEGATIVES = 5
SMOOTH = 0.75  # power of the counts that negative samples follow
# Log odds that a resemblance is no chance, by letters beyond four and for signs among them; bound of each context word's part.
LETTER, ODD, CLIP = 2.0, 8.0, 3.0

MARKS = "-‐‑\xac\xad"
SOFT = "‐‑\xac\xad"
_STRIP = ".,;:()[]{}\"'<>“”‘’…?|*" + MARKS
_JOIN = re.compile(rf"(?<=[^\W\d_])[{MARKS}][ ]?\n[ \t]*(?=[^\W\d_])")

# Glyphs that scanning confuses.
_SINGLE = [
    ("e", "c"), ("a", "o"), ("0", "o"), ("@", "o"), ("i", "l"), ("1", "l"), ("!", "l"), ("|", "l"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("h", "b"),
    ("9", "g"), ("q", "g"), ("+", "t"), ("f", "t"), ("2", "z"),
]
_DOUBLE = [("rl", "n"), ("rn", "m"), ("ll", "u"), ("cl", "d"), ("vv", "w")]
# Groups undone one by one where folding alone finds nothing, because neighbouring glyphs fold together.
_UNDONE = [("h", "li"), ("li", "h"), ("ii", "u"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w")]


def fold_glyphs(word: str) -> str:
    # No glyph that is replaced comes out of another replacement; replacing is faster than translating here.
    for a, b in _SINGLE:
        word = word.replace(a, b)
    for a, b in _DOUBLE:
        word = word.replace(a, b)
    return word


def _candidate(word: str) -> bool:
    """Letters, with at most a third of other glyphs."""
    letters = sum(c.isalpha() for c in word)
    if word[0].isdigit():
        return len(word) >= 4 and word[1:].isalpha()
    return letters >= 2 and 3 * (len(word) - letters) <= len(word) and not (len(word) < 3 and word[-1].isdigit())


# 1. Vocabulary -------------------------------------------------------------------------------------------

_WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("lower", T.LongType())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw: Counter = Counter()
        for text in batch.column(0).to_pylist():
            raw.update(_JOIN.sub("", text).split())
        total: Counter = Counter()
        lower: Counter = Counter()
        everything = 0
        for token, n in raw.items():
            everything += n
            bare = token.strip(_STRIP)
            if len(bare) < 2 or "@" in bare[1:-1] and "." in bare or not bare[0].isalpha() and not bare[-1].isalpha():
                continue
            low = bare.lower()
            if sum(map(str.isalpha, low.replace("-", ""))) < len(low.replace("-", "")):
                continue  # frequent words have letters only; the rest need no count
            total[low] += n
            if bare.islower():
                lower[low] += n
        words = list(total)
        # Hapaxes of a batch only matter in sum; all are kept, nothing is cut off here.
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*words, None], pa.string()),
                pa.array([*(total[w] for w in words), everything], pa.int64()),
                pa.array([*(lower[w] for w in words), 0], pa.int64()),
            ],
            names=_WORDS.names,
        )


class Vocabulary:
    def __init__(self, words: list[str], counts: np.ndarray, lower: np.ndarray, total: int):
        self.words = words
        self.index = {w: i for i, w in enumerate(words)}
        self.counts = counts.astype(np.float64)
        # Names hardly ever occur in lower case; the commonest labels of documents often only at line starts.
        self.ordinary = (lower >= 0.03 * counts) | (counts >= 5e-4 * total)
        self.ordinary &= np.array(["-" not in w for w in words], bool) if words else True
        self.folded: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if self.ordinary[i]:
                self.folded.setdefault(fold_glyphs(w), []).append(i)
        # Words beside which one that folds alike is so much more frequent that they may be misread from it.
        self.doubtful = {
            i for i, w in enumerate(words) if any(h != i and counts[h] >= RATIO * counts[i] for h in self.folded.get(fold_glyphs(w), ()))
        }
        self.compounds = {fold_glyphs(w) for w in words if "-" in w}
        self.vectors = np.zeros((len(words), DIM), np.float32)
        self.outputs = np.zeros((len(words), DIM), np.float32)


def vocabulary(texts: DataFrame) -> Vocabulary:
    words = texts.mapInArrow(_count_words, _WORDS).groupBy("word").agg(F.sum("n").alias("n"), F.sum("lower").alias("lower"))
    # The row without a word has the number of all words, so that one pass over the texts is enough.
    words = materialize(words)
    total = (words.filter("word IS NULL").select("n").first() or [0])[0]
    sure = F.col("n") - SURE * F.sqrt("n") >= SHARE * total
    kept = words.filter("word IS NOT NULL").filter(sure).toPandas().sort_values("word")
    return Vocabulary(kept["word"].tolist(), kept["n"].to_numpy(np.int64), kept["lower"].to_numpy(np.int64), total)


# 2. Skip-gram vectors ------------------------------------------------------------------------------------


class _Ids(dict):
    """Id of a token as it stands in a text in lower case, -1 outside the vocabulary."""

    def __init__(self, index: dict[str, int]):
        self.known = index

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        i = self[token] = self.known.get(token.strip(_STRIP), -1)
        return i


def cooccurrences(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(i, near): for each word of the vocabulary the words at most WINDOW words from it, with counts; one row a word."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab.index)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size = _Ids(shared.value), len(shared.value)
        gap = [-1] * WINDOW
        for batch in batches:
            flat: list[int] = []
            for text in batch.column(0).to_pylist():
                flat.extend([ids[w] for w in _JOIN.sub("", text.lower()).split()])
                flat.extend(gap)
            seq = np.array(flat, np.int64)
            keys = []
            for d in range(1, WINDOW + 1):
                a, b = seq[:-d], seq[d:]
                use = (a >= 0) & (b >= 0)
                keys.append(np.minimum(a[use], b[use]) * size + np.maximum(a[use], b[use]))
            key = np.concatenate(keys)
            if size * size <= 1 << 22:
                counts = np.bincount(key, minlength=size * size)
                key = np.flatnonzero(counts)
                n = counts[key]
            else:
                key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=schema.names)

    size = max(len(vocab.words), 1)
    pairs = texts.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").cast("double").alias("n"))
    pairs = pairs.select((F.col("key") / size).cast("int").alias("i"), (F.col("key") % size).cast("int").alias("j"), "n")
    # From both sides (a word beside itself too), in one pass over the texts.
    sides = F.explode(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n"))).alias("x")
    both = pairs.select(sides).select("x.*").groupBy("i", "j").agg(F.sum("n").alias("n"))
    return both.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "n"))).alias("near"))


def newton(now: np.ndarray, counts: np.ndarray, other: np.ndarray, noise: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Vectors of some words after ``NEWTON`` steps towards the maximum of the skip-gram objective, ``other`` being fixed.

    ``counts`` (words, vocabulary) are their co-occurrences; each of them stands against ``NEGATIVES`` draws from ``noise``.
    """
    upper = np.triu_indices(DIM)
    negative = NEGATIVES * counts.sum(1, keepdims=True) * noise
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(now @ other.T, -30, 30)))
        slope = (counts * (1 - p) - negative * p) @ other - RIDGE * now
        flat = ((counts + negative) * p * (1 - p)) @ squares
        curve = np.empty((len(now), DIM, DIM))
        curve[:, upper[0], upper[1]] = flat
        curve[:, upper[1], upper[0]] = flat
        step = np.linalg.solve(curve + RIDGE * np.eye(DIM), slope[:, :, None])[:, :, 0]
        length = np.linalg.norm(step, axis=1, keepdims=True)
        now = now + step * np.minimum(1, 2 / np.maximum(length, 1e-9))
    return now


def learn_vectors(vocab: Vocabulary, near: DataFrame, seed: int = 7) -> None:
    """Skip-gram with negative sampling on all co-occurrences: word and context vectors in turn, words in partitions."""
    size = len(vocab.words)
    if not size:
        return
    rng = np.random.default_rng(seed)
    vectors = [rng.normal(0, 0.1, (size, DIM)), rng.normal(0, 0.1, (size, DIM))]
    noise = vocab.counts**SMOOTH
    noise /= noise.sum()
    near = spread(materialize(near))
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    context = near.sparkSession.sparkContext
    for sweep in range(2 * SWEEPS):
        side = sweep % 2
        shared = context.broadcast((vectors[side], vectors[1 - side], noise))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine, other, noise = shared.value
            upper = np.triu_indices(DIM)
            squares = other[:, upper[0]] * other[:, upper[1]]
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    rows = part.column(0).to_numpy(zero_copy_only=False)
                    lists = part.column(1)
                    entries = lists.flatten()
                    counts = np.zeros((len(rows), len(other)))
                    of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
                    counts[of, entries.field(0).to_numpy(zero_copy_only=False)] = entries.field(1).to_numpy(zero_copy_only=False)
                    new = newton(mine[rows], counts, other, noise, squares)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(new), pa.list_(pa.float64()))], names=schema.names)

        # One vector for each word of the vocabulary, at most 1 / SHARE of them.
        done = near.mapInArrow(run, schema).toPandas()
        if len(done):
            vectors[side][done["i"].to_numpy()] = np.stack(done["vector"].to_numpy())
        shared.unpersist()
    vocab.vectors, vocab.outputs = (v.astype(np.float32) for v in vectors)


# 3. Misread words ----------------------------------------------------------------------------------------


class _Hits(dict):
    """Candidates of a token, none for most."""

    def __init__(self, corrector: Corrector):
        self.corrector = corrector

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[token] = self.corrector._look(token)[1]
        return found


_LOG_NEGATIVES = float(np.log(NEGATIVES))


class Corrector:
    """Corrections of rare words by glyph edits, chosen and accepted by context."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.cache: dict[str, tuple[int, tuple[int, ...]]] = {}
        self.hits = _Hits(self)

    def look(self, token: str) -> tuple[int, tuple[int, ...]]:
        """Id in the vocabulary (-1 if rare) and candidates of a rare word."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            found = self.cache[token] = self._look(token)
        return found

    def _look(self, token: str) -> tuple[int, tuple[int, ...]]:
        low = token.lower()
        word = low.strip(_STRIP)
        i = self.vocab.index.get(word, -1)
        if i in self.vocab.doubtful:
            return i, tuple(h for h in self.vocab.folded[fold_glyphs(word)] if self.vocab.counts[h] >= RATIO * self.vocab.counts[i])
        if i >= 0 or len(word) < 2:
            return i, ()
        # A stripped sign may itself be a misread letter.
        for form in dict.fromkeys((word, low.strip(".,;:()[]\"'"))):
            if _candidate(form) and not ("@" in form and "." in form) and "/" not in form and "-" not in form:
                for spelled in (form, *self._undone(form)):
                    hits = self.vocab.folded.get(fold_glyphs(spelled), ())
                    hits = tuple(h for h in hits if self._plausible(spelled, self.vocab.words[h]))
                    if hits:
                        return -1, hits
        return -1, ()

    @staticmethod
    def _undone(form: str) -> Iterator[str]:
        """``form`` with one misread group put right; only longer words are safe enough."""
        if len(form) >= 5:
            for a, b in _UNDONE:
                at = form.find(a)
                while at >= 0:
                    yield form[:at] + b + form[at + len(a) :]
                    at = form.find(a, at + 1)

    def _plausible(self, form: str, word: str) -> bool:
        same = sum(a == b for a, b in zip(form, word)) + sum(a == b for a, b in zip(form[::-1], word[::-1]))
        return same >= len(word) * 0.5 and (len(word) > 3 or form[0] == word[0] or form[-1] == word[-1])

    def affinity(self, hits: tuple[int, ...], near: list[int]) -> np.ndarray:
        """Log-likelihood ratio of the words around, beside each candidate against anywhere."""
        if not near:
            return np.zeros(len(hits))
        # Skip-gram with negative sampling estimates log P(context | word) / P(context) - log(NEGATIVES).
        terms = self.vocab.outputs[list(hits)] @ self.vocab.vectors[near].T + _LOG_NEGATIVES
        return np.clip(terms, -CLIP, CLIP).sum(1)

    def fits(self, tokens: list[str], at: int, hits: tuple[int, ...]) -> int:
        """The candidate that fits the words around best, or -1."""
        near = [i for k in range(max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)) if k != at and (i := self.look(tokens[k])[0]) >= 0]
        odd = any(not c.isalpha() for c in tokens[at].strip(_STRIP))
        chance = np.array([LETTER * (len(self.vocab.words[h]) - 4) for h in hits]) + ODD * odd
        score = self.affinity(hits, near) + chance
        best = int(score.argmax())
        return hits[best] if score[best] >= (0 if near else LETTER) else -1


# 4. Furniture --------------------------------------------------------------------------------------------

_NUMBER = r"(?:page\s*\d{1,4}(?:\s*of\s*\d{1,4})?|p\.?\s?\d{1,4}|-\s?\d{1,4}\s?-|\[\s?\d{1,4}\s?\]|\d{1,2}\s?/\s?\d{1,2}|\d{1,4}|[ivxl]{1,6})"
_ALONE = re.compile(rf"{_NUMBER}", re.I)
_BARE = re.compile(r"\d{1,4}")
_BESIDE = re.compile(rf"(?:(?P<a>{_NUMBER})\s{{2,}}(?P<title>\S.*?)|(?P<title2>\S.*?)\s{{2,}}(?P<b>{_NUMBER}))", re.I)
_ROMAN = re.compile(r"(?=[ivxl])(?:x{0,4}l?)(?:ix|iv|v?i{0,3})", re.I)
_FOUR = re.compile(r"(?:[^\W\d_][\W\d_]*){4}")


def _valid_number(s: str) -> bool:
    low = s.lower()
    if "/" in low:
        a, b = (int(x) for x in low.split("/"))
        return 1 <= a <= b <= 99
    if low[0] in "ivxl":
        return bool(_ROMAN.fullmatch(low))
    return True


_STOP = set(STOPWORDS)


def _sentence(s: str) -> bool:
    """A line of a sentence rather than a title: small words in it or at its end, or several words in lower case.

    Lines of stock phrases can recur by chance; titles name things.
    """
    words = s.split()
    small = sum(w.lower() in _STOP for w in words)
    return small >= 2 or words[-1].lower() in _STOP or sum(w.islower() and w.isalpha() for w in words) >= 5


def furniture(text: str) -> tuple[list[str], set[int], bool, bool]:
    """Lines, the indexes of those that are furniture, and whether there are page numbers and headers."""
    lines = text.replace("\f", "\n\f\n").split("\n")
    bare: list[int] = []
    numbers: set[int] = set()
    titles: dict[str, list[int]] = {}
    beside: dict[int, str] = {}
    titled: list[int] = []
    names: list[str] = []
    full = [i for i, s in enumerate(lines) if s and s != "\f" and not s.isspace()]
    for i in full:
        s = lines[i].strip()
        if len(s) <= 16 and s[-1] in "0123456789]-ivxlIVXL" and _ALONE.fullmatch(s):
            if _BARE.fullmatch(s):
                bare.append(i)
            elif _valid_number(s):
                numbers.add(i)
            continue
        if len(s) > 100 or len(s) < 5:
            continue
        if "  " in s and (m := _BESIDE.fullmatch(s)):
            number, title = m["a"] or m["b"], m["title"] or m["title2"]
            if _valid_number(number) and _FOUR.search(title):
                beside[i] = number
                s = title
        # Body lines end sentences or are items; titles are neither.
        if s[0].islower() and (s[-1] == "." or " " not in s) or "|" in s or s[-3:-2] == "." and s[-2:].isdigit():
            continue
        if _FOUR.search(s) and not _sentence(s):
            titled.append(i)
            names.append(" ".join(s.split()) if "  " in s else s)
    # Folded in one go: calls on short lines would cost more than the folding.
    for i, name in zip(titled, fold_glyphs("\n".join(names).lower()).split("\n")):
        titles.setdefault(name, []).append(i)
    headers = {i for at in titles.values() if len(at) > 1 for i in at}
    # A number beside a title counts if the title recurs or says "page".
    for i, number in beside.items():
        if i in headers or number.lower().startswith("page") and "  " in lines[i].strip():
            numbers.add(i)
    # Bare numbers: a quantity repeats the item before it; page numbers stand at an edge or count up.
    place = {i: k for k, i in enumerate(full)}
    values = {i: int(lines[i].strip()) for i in bare}
    seen = set(values.values())
    for i in bare:
        k, v = place[i], values[i]
        before = lines[full[k - 1]].strip() if k else ""
        quantity = bool(re.match(rf"{v}\b", before) or re.search(rf"(?:\s{v} [xX] |\| {v} \|)", before))
        edge = (
            k in (0, len(full) - 1)
            or "\f" in lines[full[k - 1] + 1 : i]
            or (k + 1 < len(full) and ("\f" in lines[i + 1 : full[k + 1]] or full[k + 1] in headers))
            or (k and full[k - 1] in headers and full[k - 1] not in numbers)
        )
        counted = v - 1 in seen or v + 1 in seen or v == 1
        padded = lines[i] != lines[i].strip() and lines[i].strip() != lines[i].rstrip()
        if 1 <= v <= 400 and (edge or padded or counted and not quantity) and not (quantity and not edge and not padded):
            numbers.add(i)
    return lines, numbers | headers, bool(numbers), bool(headers)


# 5. Joining and reflow -----------------------------------------------------------------------------------


_TAIL = re.compile(rf"(\S*?)([^\W\d_]+)([{MARKS}])\s*$")
_HEAD = re.compile(r"\s*([^\W\d_]+)(\S*)")


def divided(line: str, after: str, vocab: Vocabulary) -> bool:
    """The line ends with a part of a word that goes on in the next one."""
    tail, head = _TAIL.search(line), _HEAD.match(after)
    if not tail or not head or "@" in tail[1] or "@" in head[2]:
        return False
    a, b = tail[2], head[1]
    if b[0].isupper() and not a.isupper():
        return False
    if fold_glyphs(f"{a}-{b}".lower()) in vocab.compounds:
        return False
    joined = fold_glyphs((a + b + head[2].strip(_STRIP)).lower())
    if (a + b).lower() in vocab.index or joined in vocab.folded:
        return True
    if tail[3] in SOFT:
        return True
    if "." in tail[1] or re.match(r"\.\w", head[2]) or re.search(r"[\d@./_-]", tail[1]):
        return False
    # Unknown: two known words joined by an ordinary hyphen are a compound.
    return not (len(a) >= 3 and len(b) >= 3 and a.lower() in vocab.index and b.lower() in vocab.index)


def repair(text: str, corrector: Corrector, with_text: bool = True) -> tuple[str, list[str]]:
    """Continuous text and the kinds of noise that were in it."""
    lines, drop, has_number, has_header = furniture(text)
    kinds = []
    body: list[str] = []
    at_break = False
    for i, line in enumerate(lines):
        if i in drop or line == "\f":
            # Blank lines beside furniture come from the page break.
            while body and not body[-1]:
                body.pop()
            at_break = True
            continue
        line = line.rstrip()
        if line or not at_break:
            body.append(line)
            at_break = False
    hyphen = False
    out: list[str] = []
    tails: list[int] = []  # length of the last line as it stood on the page
    for line in body:
        if out and out[-1] and line and out[-1][-1] in MARKS and divided(out[-1], line, corrector.vocab):
            hyphen = True
            out[-1] = out[-1][:-1] + line.lstrip()
            tails[-1] = len(line.strip())
            continue
        out.append(line)
        tails.append(len(line.strip()))
    # Context reaches over line ends.
    tokens = " ".join(out).split()
    hits_of = [corrector.hits[t] for t in tokens]
    right: dict[int, str] = {}
    if any(hits_of):
        for k, hits in enumerate(hits_of):
            if hits and (best := corrector.fits(tokens, k, hits)) >= 0:
                right[k] = tokens[k] = _as_written(tokens[k], corrector.vocab.words[best])
    for kind, there in (("hyphenation", hyphen), ("misread", bool(right)), ("header", has_header), ("page_number", has_number)):
        if there:
            kinds.append(kind)
    if not with_text:
        return "", kinds
    if right:
        k = 0
        for i, line in enumerate(out):
            n = len(line.split())
            if any(j in right for j in range(k, k + n)):
                out[i] = line[: len(line) - len(line.lstrip())] + " ".join(tokens[k : k + n])
            k += n
    return "\n".join(" ".join(line.split()) for line in _reflow(out, tails)).strip("\n"), kinds


def _as_written(token: str, word: str) -> str:
    bare = token.strip(".,;:()[]\"'")
    letters = [c for c in bare if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and len(letters) > 1:
        word = word.upper()
    elif bare[:1].isupper():
        word = word.capitalize()
    return token.replace(bare, word, 1)


_FIELD = re.compile(r"[^\W\d_][\w .]{1,40}: ")  # a label and its value
_SMALL = re.compile(r"[^\W\dA-Z_]")


def _reflow(lines: list[str], tails: list[int]) -> list[str]:
    """Lines of running prose joined; structured lines and blank lines stay."""
    width = max(tails, default=0)
    out: list[str] = []
    open_ = False
    for line, tail in zip(lines, tails):
        bare = line.strip()
        if not bare:
            if out and out[-1] != "":
                out.append("")
            open_ = False
            continue
        field = _FIELD.match(bare)
        if open_ and not field and (bare[0] in "$£€(" or bare[0].isalnum()):
            out[-1] += " " + bare
        else:
            out.append(bare)
        # Prose: a long line of mostly small letters that isn't a table row.
        open_ = (
            tail >= 0.6 * width
            and not field
            and "|" not in bare
            and not (bare[-3:-2] == "." and bare[-2:].isdigit())
            and (len(_SMALL.findall(bare)) >= 0.6 * len(bare) or bare.isupper())
        )
    return out


# Operators -----------------------------------------------------------------------------------------------


def learn(documents: DataFrame, text: str = "raw_text") -> Vocabulary:
    texts = spread(documents.select(F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''"))
    vocab = vocabulary(texts)
    learn_vectors(vocab, cooccurrences(texts, vocab))
    return vocab


def repaired(documents: DataFrame, key: str = "doc_id", text: str = "raw_text", with_text: bool = True) -> DataFrame:
    """(key, kinds[, repaired]): one row for each row with text."""
    vocab = documents.sparkSession.sparkContext.broadcast(learn(documents, text))
    source = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''"))
    fields = [T.StructField(key, source.schema["key"].dataType), T.StructField("kinds", T.ArrayType(T.StringType()))]
    schema = T.StructType(fields + [T.StructField("repaired", T.StringType())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corrector = Corrector(vocab.value)
        for batch in batches:
            done = [repair(t, corrector, with_text) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([k for _, k in done], pa.list_(pa.string()))]
            if with_text:
                columns.append(pa.array([t for t, _ in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def found(documents: DataFrame, key: str = "doc_id", text: str = "raw_text") -> DataFrame:
    """(key, noise_kind): each kind of noise in a text once."""
    return repaired(documents, key, text, with_text=False).select(key, F.explode("kinds").alias("noise_kind")).distinct()
