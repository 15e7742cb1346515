"""Variant spellings of names linked by merge-and-rematch resolution (problem 2).

A spelling becomes a profile: slots (one for each full word, with the variants seen) and initials. Labels,
titles and legal forms are set aside, case, accents and order don't matter, and letters that scanning
confuses are folded. Two profiles match if their slots pair off one to one: equal, one typing error apart,
one an abbreviation of the other, or nickname and name. Merging unions the variants of paired slots and the
initials, and the richer profiles re-enter blocking, until no profiles merge.

A profile with initials instead of words (an abbreviated given name or trade), or a firm's first word alone, can
fit several others. It waits until the rest is merged and joins only where exactly one entity fits; what comes of it
re-enters blocking in its turn.

Blocking: a profile of several words is keyed by a one-letter deletion of the words that tell most and a letter of
another slot (its first or second one, or that of the full form of a nickname) or an initial, so that a block holds one
word beside words of one letter. How telling a word is follows from how many spellings have it, or a word that it is one
typing error from, or a common word (in ``COMMON`` of all spellings, hence of bounded number) that it abbreviates; a
mistyped or shortened common word doesn't count as rare. All of it is relative to the number of spellings. A block
streams through one task, longest profiles first, and meets the merged profiles of the block that have a word like its
own, not pair by pair; only a link to the profile that it joined is emitted. Profiles of one word are keyed by its
deletions and their initials, and find what they abbreviate in an aggregate: of each word, and the initials of what
stands beside it, only the least and the greatest entity are kept, which tells whether there is exactly one.

Defined results: null and empty values are nobody; unreadable values (no regular word of five letters,
or irregular case) are nobody; repeated values count once; an ambiguous abbreviation is linked only to
equal abbreviations.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import confusables
from paperloom.llm.common import components, spread
from paperloom.session import materialize, release

# Words beside a name.
TITLES = "mr mrs ms miss mx dr prof professor sir dame madam messrs herr frau fraulein monsieur madame mme mlle senor senora sr sra sig dott ing rev hon esq jr snr jnr ii iii iv phd md".split()
LEGAL = "inc incorporated llc ltd limited plc corp corporation co company cie gmbh mbh bv nv sa srl sarl spa ag kg kgaa ohg llp lp pty ooo oao zao oy ab as aps sas sl".split()
LABELS = "to attn attention payee payer client customer vendor supplier issuer recipient from co dept department the and und et y".split()
PLACE_PREFIXES = "port saint new".split()  # dropped when a name is reordered
CYRILLIC_LEGAL = "ооо оао зао пао ао ип".split()
# Common short forms of given names.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alexander", "alex": "alexander alexandra", "andy": "andrew", "annie": "anne anna", "art": "arthur",
    "barb": "barbara", "ben": "benjamin", "bea": "beatrice", "bert": "albert robert", "bess": "elizabeth", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles",
    "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "don": "donald",
    "ed": "edward edwin", "eddie": "edward", "fran": "frances francisco", "frank": "francis francisco", "fred": "frederick friedrich alfred", "freddie": "frederick",
    "fritz": "friedrich", "gabi": "gabriela gabriele", "gaby": "gabriela", "gene": "eugene", "gerry": "gerald", "greg": "gregory", "hannes": "johannes", "hans": "johannes",
    "harry": "henry harold", "jack": "john", "jake": "jacob", "jamie": "james", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome",
    "jim": "james", "jimmy": "james", "jo": "josephine johanna", "joe": "joseph", "joey": "joseph", "johnny": "john", "josie": "josephine", "kate": "katherine",
    "katie": "katherine", "kathy": "katherine", "kit": "christopher katherine", "larry": "lawrence", "leo": "leon leonard", "liz": "elizabeth", "lizzie": "elizabeth",
    "maggie": "margaret", "marge": "margaret", "mat": "matthew", "matt": "matthew", "meg": "margaret", "memo": "guillermo", "mick": "michael", "mickey": "michael",
    "mike": "michael", "mitch": "mitchell", "molly": "mary", "nan": "anne", "nat": "nathaniel natalie", "ned": "edward", "nell": "eleanor", "nick": "nicholas",
    "nico": "nicholas", "paco": "francisco", "pam": "pamela", "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret",
    "pepe": "jose", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald",
    "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander alexandra", "sasha": "alexander alexandra", "stan": "stanley", "steve": "stephen steven", "sue": "susan susannah",
    "susie": "susan susannah", "ted": "theodore edward", "terry": "terence theresa", "theo": "theodore", "tim": "timothy", "tina": "christina", "toby": "tobias",
    "tom": "thomas tomas", "tommy": "thomas", "tony": "anthony antonio", "tricia": "patricia", "trish": "patricia", "val": "valerie", "vicky": "victoria", "viv": "vivian genevieve",
    "walt": "walter", "wendy": "gwendolyn", "will": "william", "willy": "william", "wim": "william willem", "zach": "zachary",
}

#: Share of the spellings from which on a word counts as common, hence of a bounded number of words.
COMMON = 1e-3
#: A slot at most so many times less telling than the best one is a key too.
NEARLY = 4

_FOLD = str.maketrans("015|!8i", "olsllbl")
_GROUPS = [("rn", "m"), ("cl", "d"), ("vv", "w")]


def fold(word: str) -> str:
    """Lower case without accents, scanning confusions folded."""
    word = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    word = word.replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae")
    for a, b in _GROUPS:
        word = word.replace(a, b)
    return word.translate(_FOLD)


_OPTIONAL = {fold(w) for w in TITLES + LEGAL + LABELS + PLACE_PREFIXES + CYRILLIC_LEGAL}
_LONG_OPTIONAL = [w for w in _OPTIONAL if len(w) >= 6]
_GIVEN = {fold(x) for v in NICKNAMES.values() for x in v.split()}
_NICK = {fold(k): {fold(x) for x in v.split()} for k, v in NICKNAMES.items()}
_LABEL = re.compile(r"^\s*[^\w\s]*\s*[^\W\d]+(?: [^\W\d]+){0,2}\s*[:;]\s*")
_DOTTED = re.compile(r"(?<!\w)(?:\w\.){2,}\w?(?!\w)")
_GLUED = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ]{2})")
_VOWELS = set("aeiouyаеиоуыэюяёl")


def within1(a: str, b: str) -> bool:
    """At most one letter inserted, deleted, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def abbreviates(s: str, w: str) -> bool:
    """``s`` is a beginning of ``w``, or letters of it with the first and last one or only consonants."""
    if len(s) < 2 or len(w) - len(s) < 2 or s[0] != w[0]:
        return False
    if w.startswith(s):
        return True
    rest = iter(w)
    return all(c in rest for c in s) and (s[-1] == w[-1] or not _VOWELS & set(s[1:]))


@lru_cache(1 << 18)
def alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if a in _GIVEN and b in _GIVEN:
        return False  # two names of their own, such as Thomas and Tomas, not one mistyped
    if min(len(a), len(b)) >= 3 and within1(a, b):
        return True
    if min(len(a), len(b)) >= 8 and abs(len(a) - len(b)) <= 1 and not set(deletions(a)).isdisjoint(deletions(b)):
        return True  # long words: one letter out of each may make them equal
    if abbreviates(a, b) or abbreviates(b, a):
        return True
    na, nb = _NICK.get(a), _NICK.get(b)
    return bool(na and b in na or nb and a in nb or na and nb and na & nb)


def _regular(word: str) -> bool:
    """Case as in ordinary words: all lower, all upper, capitalised, or such words glued together."""
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return True
    return all(p.islower() or p.isupper() or p[:1].isupper() and p[1:].islower() for p in _GLUED.split("".join(letters)))


_FIRM = {fold(w) for w in LEGAL + CYRILLIC_LEGAL}
_TITLED = {fold(w) for w in TITLES}


def parse(value: str) -> tuple[list[str], list[str], list[str]] | None:
    """Full words, initials and marks of a spelling in the consistent form, or None if it is unreadable.

    Marks: "firm" if it has a legal form, "title" if it has a person's title.
    """
    text = _LABEL.sub("", value).strip()
    text = re.sub(r"\bc/o\b", " ", text, flags=re.I)
    text = re.sub(r"['’`´]", "", text)

    def undot(m: re.Match) -> str:
        joined = m.group().replace(".", "")
        return f" {joined} " if fold(joined) in _OPTIONAL else " " + " ".join(joined) + " "

    text = _GLUED.sub(" ", _DOTTED.sub(undot, text))
    raw = re.findall(r"[^\W_]+(?:-[^\W_]+)*", text)
    if not all(_regular(w) for w in raw if fold(w) not in _OPTIONAL):
        return None
    full, initials, marks = [], [], set()
    for word in raw:
        w = fold(word)
        if w in _FIRM:
            marks.add("firm")
        elif w in _TITLED:
            marks.add("title")
        if w in _OPTIONAL or len(w) >= 5 and any(within1(w, x) for x in _LONG_OPTIONAL):
            continue
        if len(w) == 1:
            initials.append(w)
        elif len(word) <= 3 and word.islower():
            continue  # a particle or a stray label
        else:
            full.append(w)
    longest = max(full, key=len, default="")
    if len(longest) < 5 or not 0.15 <= sum(c in _VOWELS for c in longest) / len(longest) <= 0.75:
        return None
    return sorted(full), sorted(initials), sorted(marks)


class Profile:
    """Slots of variants, initials and marks, as merged so far. Merging makes a new one."""

    __slots__ = ("slots", "initials", "marks")

    def __init__(self, slots, initials, marks=()):
        self.slots = [frozenset(x) for x in slots]
        self.initials, self.marks = frozenset(initials), frozenset(marks)

    @classmethod
    def load(cls, raw: str) -> Profile:
        return cls(*json.loads(raw))

    def dump(self) -> str:
        return json.dumps([sorted(map(sorted, self.slots)), sorted(self.initials), sorted(self.marks)], ensure_ascii=False)

    def pairing(self, other: Profile) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """Slots paired off (equal variants first), and the unpaired ones of either side."""
        left, right = list(range(len(self.slots))), list(range(len(other.slots)))
        pairs = []
        for test in (lambda a, b: not a.isdisjoint(b), lambda a, b: any(alike(x, y) for x in a for y in b)):
            for i in left[:]:
                for j in right:
                    if test(self.slots[i], other.slots[j]):
                        pairs.append((i, j))
                        left.remove(i)
                        right.remove(j)
                        break
        return pairs, left, right

    def match(self, other: Profile) -> tuple[str, list[tuple[int, int]]]:
        """"same", "weak" (initials stand for words) or "", with the paired slots."""
        pairs, left, right = self.pairing(other)
        if not pairs or not any(max(map(len, self.slots[i])) >= 5 for i, _ in pairs):
            return "", []
        if not left and not right:
            if len(pairs) == 1 and self.initials != other.initials:
                return "", []
            return "same", pairs
        if left and right:
            return "", []
        words, initials = (self.slots, other.initials) if left else (other.slots, self.initials)
        short, full = (other, self) if left else (self, other)
        if len(short.slots) == 1 and not initials:
            # A firm by its first word alone; a person's surname alone isn't enough.
            return ("weak", pairs) if "firm" in full.marks and "title" not in short.marks else ("", [])
        missing = [words[i] for i in left or right]
        if len(missing) != len(initials):
            return "", []
        pool = set(initials)
        for variants in missing:
            hit = next((c for c in sorted(pool) if c in firsts(variants)), None)
            if hit is None:
                return "", []
            pool.remove(hit)
        return "weak", pairs

    def merge(self, other: Profile, pairs: list[tuple[int, int]]) -> Profile:
        slots = list(self.slots)
        for i, j in pairs:
            slots[i] = slots[i] | other.slots[j]
        initials = self.initials | other.initials if len(slots) > 1 else self.initials
        return Profile(slots, initials, self.marks | other.marks)


@lru_cache(1 << 15)
def _load(raw: str) -> Profile:
    return Profile.load(raw)


def firsts(variants: frozenset[str]) -> set[str]:
    """Initials that a slot can be abbreviated to."""
    return {v[0] for v in variants} | {n[0] for v in variants for n in _NICK.get(v, ())}


def hints(variants: frozenset[str]) -> set[str]:
    """Letters of which two slots that are alike have one in common (a typing error can change the first one)."""
    return firsts(variants) | {v[1] for v in variants if len(v) > 1}


def deletions(word: str) -> list[str]:
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def spellings(extractions: DataFrame) -> DataFrame:
    """(name, form): each different spelling and its parsed form (JSON), null if unreadable."""
    tidy = confusables.normalized(extractions).select(
        F.trim(F.regexp_replace("canonical", " +", " ")).alias("name")
    ).filter("name <> ''").distinct()

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        def one(v: str) -> str | None:
            found = parse(v)
            return found and Profile([[w] for w in found[0]], found[1], found[2]).dump()

        return values.map(one)

    return tidy.withColumn("form", form("name"))


_SLOTS = "array<array<string>>"


def _slots(profile: str = "profile"):
    return F.from_json(F.get_json_object(profile, "$[0]"), _SLOTS)


def _cuts(word: str = "word"):
    """A word and all its one-letter deletions; words one typing error apart share one."""
    return F.array_distinct(
        F.concat(
            F.array(word),
            F.transform(
                F.sequence(F.lit(1), F.length(word)),
                lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.length(word))),
            ),
        )
    )


def _telling(profiles: DataFrame) -> DataFrame:
    """(word, weight): spellings with the word, a common word that it abbreviates, or the most frequent word one typing error from it."""
    words = materialize(profiles.select(F.explode(F.flatten(_slots())).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    least = COMMON * profiles.count()
    common: dict[str, list[tuple[str, int]]] = {}
    for r in words.filter(F.col("n") >= least).collect():  # at most 1 / COMMON x words of a spelling
        common.setdefault(r.word[0], []).append((r.word, r.n))
    counts = {w: n for group in common.values() for w, n in group}

    @F.pandas_udf("long")
    def lifted(values: pd.Series) -> pd.Series:
        def one(v: str) -> int:
            short = [n for w, n in common.get(v[0], ()) if len(w) - len(v) >= 2 and abbreviates(v, w)]
            return max([0, *short, *(counts.get(w, 0) for w in _NICK.get(v, ()))])

        return values.map(one)

    words = words.select("word", F.greatest("n", lifted("word")).alias("n"))
    keyed = materialize(words.select("word", F.explode(_cuts()).alias("cut"), "n"))
    best = keyed.groupBy("cut").agg(F.max("n").alias("most"))
    return keyed.join(best, "cut").groupBy("word").agg(F.max("most").alias("weight"))


def _keyed(profiles: DataFrame) -> DataFrame:
    """(block, letter, pid, profile, size) under the deletions of the most telling slots' variants, with letters of the other slots."""
    # An entity can have several profiles, each with keys of its own.
    profiles = profiles.withColumn("rid", F.xxhash64("pid", "profile"))
    exploded = profiles.select("rid", F.posexplode(_slots()).alias("slot", "variants"))
    variants = exploded.select("rid", "slot", F.explode("variants").alias("word"))
    weights = variants.join(_telling(profiles), "word").groupBy("rid", "slot").agg(F.max("weight").alias("weight"))
    least = weights.groupBy("rid").agg(F.min("weight").alias("least"))
    chosen = weights.join(least, "rid").filter(F.col("weight") <= NEARLY * F.col("least")).groupBy("rid").agg(F.collect_set("slot").alias("chosen"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for pid, raw, slots in zip(frame["pid"], frame["profile"], frame["chosen"]):
                p = Profile(*json.loads(raw))
                keys = set()
                for i in slots:
                    words = [v for v in p.slots[i] if len(v) >= 3]
                    if len(p.slots) == 1:
                        letters = {"." + "".join(sorted(p.initials))}
                    else:
                        letters = p.initials.union(*(hints(x) for k, x in enumerate(p.slots) if k != i))
                    keys.update(itertools.product({c for v in words for c in deletions(v)}, letters))
                out += [(cut, letter, pid, raw, len(p.slots)) for cut, letter in keys]
            yield pd.DataFrame(out, columns=["cut", "letter", "pid", "profile", "size"])

    source = spread(profiles.join(chosen, "rid").select("pid", "profile", "chosen"))
    return source.mapInPandas(run, "cut string, letter string, pid long, profile string, size int")


def _stream_links(keyed: DataFrame) -> DataFrame:
    """(a, b, kind): profile ``a`` joined the merged profile that began with ``b``, or is weak and fits it."""
    order = ["cut", "letter", F.desc("size"), "pid", "profile"]
    ordered = keyed.repartition("cut", "letter").sortWithinPartitions(*order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders, having = None, [], {}
        for frame in frames:
            out = []
            for cut, letter, pid, raw in zip(frame["cut"], frame["letter"], frame["pid"], frame["profile"]):
                if (cut, letter) != now:
                    now, leaders, having = (cut, letter), [], {}
                mine = _load(raw)
                # Words of the slots that brought the profile here; those of leaders are kept with the leaders that have them.
                words = {v for x in mine.slots if len(letter) > 1 or len(mine.slots) == 1 or letter in hints(x) for v in x}
                if letter in mine.initials or len(leaders) < 4:
                    near = range(len(leaders))
                else:
                    near = sorted({k for w, at in having.items() if any(alike(v, w) for v in words) for k in at})
                joined, fits = None, set()
                for k in near:
                    lead_id, lead = leaders[k]
                    kind, pairs = lead.match(mine)
                    if kind == "same" and joined is None:
                        joined = k
                        if lead_id != pid:
                            out.append((pid, lead_id, kind))
                        leaders[k] = lead_id, lead.merge(mine, pairs)
                    elif lead_id == pid:
                        continue
                    elif kind == "same":
                        out.append((pid, lead_id, kind))
                    elif kind == "weak" and len(fits) < 2 and len(mine.slots) > 1:
                        if lead_id not in fits:  # two that fit say already that it isn't exactly one
                            fits.add(lead_id)
                            out.append((pid, lead_id, kind))
                if joined is None:
                    joined = len(leaders)
                    leaders.append((pid, mine))
                for w in words:
                    having.setdefault(w, set()).add(joined)
            yield pd.DataFrame(out, columns=["a", "b", "kind"])

    return ordered.select("cut", "letter", "pid", "profile").mapInPandas(run, "a long, b long, kind string").distinct()


def _single_fits(profiles: DataFrame) -> DataFrame:
    """(a, low, high): the least and the greatest entity that a profile of one word fits, with its initials for their other words.

    Without initials a firm's word alone will do, unless it has a person's title.
    """
    def offers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = set()
            for pid, raw in zip(frame["pid"], frame["profile"]):
                p = Profile.load(raw)
                for i, x in enumerate(p.slots if len(p.slots) > 1 else ()):
                    others = {"".join(sorted(set(c))) for c in itertools.product(*(sorted(firsts(y)) for k, y in enumerate(p.slots) if k != i))}
                    # As many different initials as words are missing.
                    others = {c for c in others if len(c) == len(p.slots) - 1} | ({""} if "firm" in p.marks else set())
                    out.update((v, c, pid) for v in x if len(v) >= 3 for c in others)
            yield pd.DataFrame(list(out), columns=["word", "letters", "pid"])

    def wants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for pid, raw in zip(frame["pid"], frame["profile"]):
                p = Profile.load(raw)
                if len(p.slots) == 1 and (p.initials or "title" not in p.marks):
                    out += [(pid, v, "".join(sorted(p.initials))) for v in p.slots[0] if len(v) >= 3]
            yield pd.DataFrame(out, columns=["pid", "word", "letters"])

    source = profiles.select("pid", "profile")
    offered = source.mapInPandas(offers, "word string, letters string, pid long").groupBy("word", "letters")
    offered = offered.agg(F.min("pid").alias("low"), F.max("pid").alias("high")).select(F.explode(_cuts()).alias("cut"), "letters", "word", "low", "high")
    wanted = source.mapInPandas(wants, "pid long, word string, letters string").select("pid", F.explode(_cuts()).alias("cut"), F.col("word").alias("mine"), "letters")

    @F.pandas_udf("boolean")
    def fit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max(len(x), len(y)) >= 5 and alike(x, y) for x, y in zip(a, b)], dtype=bool)

    met = wanted.join(offered, ["cut", "letters"]).select("pid", "mine", "word", "low", "high").distinct()
    return met.filter(fit("mine", "word")).groupBy(F.col("pid").alias("a")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _merged(profiles: DataFrame, roots: DataFrame) -> DataFrame:
    """The profiles of each root, streaming through the members in order; what can't be merged stays a profile of its own."""
    members = profiles.join(roots, profiles["pid"] == roots["node"], "left").select(
        F.coalesce("component", "pid").alias("root"), "pid", "profile"
    )
    ordered = members.repartition("root").sortWithinPartitions("root", "pid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            out = []
            for root, raw in zip(frame["root"], frame["profile"]):
                if root != now:
                    out += [(now, p.dump()) for p in _union(held)]
                    now, held = root, []
                _absorb(held, Profile.load(raw))
            yield pd.DataFrame(out, columns=["pid", "profile"])
        if held:
            yield pd.DataFrame([(now, p.dump()) for p in _union(held)], columns=["pid", "profile"])

    return ordered.select("root", "profile").mapInPandas(run, "pid long, profile string").distinct()


def _absorb(held: list[Profile], p: Profile) -> None:
    """Merges ``p`` with the first profile that it matches, or appends it."""
    for k, lead in enumerate(held):
        kind, pairs = lead.match(p)
        if kind:
            longer = kind == "weak" and len(p.slots) > len(lead.slots)
            held[k] = p.merge(lead, [(j, i) for i, j in pairs]) if longer else lead.merge(p, pairs)
            return
    held.append(p)


def _union(profiles: list[Profile]) -> list[Profile]:
    """The profiles of one entity merged until none match; those linked only through others stay beside the rest."""
    while True:
        held: list[Profile] = []
        for p in profiles:
            _absorb(held, p)
        if len(held) == len(profiles):
            return held
        profiles = held


def entities(extractions: DataFrame) -> DataFrame:
    """(name, entity): each readable spelling and its entity."""
    names = materialize(spread(spellings(extractions)).filter("form IS NOT NULL").withColumn("fid", F.xxhash64("form")))
    profiles = materialize(names.select(F.col("fid").alias("pid"), F.col("form").alias("profile")).distinct())
    owner = profiles.select(F.col("pid").alias("fid"), "pid")
    while True:
        links = materialize(_stream_links(_keyed(profiles)))
        merging = links.filter("kind = 'same'").select("a", "b")
        if merging.isEmpty():  # nothing merges any more: abbreviations that exactly one entity fits join it
            several = links.filter("kind = 'weak'").groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
            fits = several.union(_single_fits(profiles)).filter("low = high AND a <> low")
            merging = materialize(fits.select("a", F.col("low").alias("b")))
            if merging.isEmpty():
                break
        roots = components(merging)
        old = (owner, profiles, links)
        owner = materialize(
            owner.join(roots, owner["pid"] == roots["node"], "left").select("fid", F.coalesce("component", "pid").alias("pid"))
        )
        profiles = materialize(_merged(profiles, roots))
        release(*old)
    return names.join(owner, "fid").select("name", F.col("pid").alias("entity"))


def found(extractions: DataFrame) -> DataFrame:
    """(name_a, name_b): pairs of different spellings of one entity, smaller first."""
    members = materialize(entities(extractions))
    # Code point order is the order of UTF-8 bytes.
    other = members.select("entity", F.col("name").alias("name_b"))
    return members.withColumnRenamed("name", "name_a").join(other, "entity").filter("name_a < name_b").select("name_a", "name_b")
