"""Training-data operators on small cases: brute force, round trips, planted cases, nulls, ties, empty tables."""

import datetime
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, common, confusables, mojibake, names, overlap, packing, pii, pii_samples, scans

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# p6 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_bpe_equals_reference_on_odd_texts(reference):
    merge = bpe.Merger(bpe.read_ranks(open(VOCAB, "rb").read()))
    rng = random.Random(3)
    alphabet = " '  \n\t\x1c 　stmdrevlaé́ß1²٣!-’日\U0001f9fe\x85<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "it's we'll they've 'S", "a" * 3000, " " * 500 + "x", "'" * 99 + "s"]
    cut, doc, _ = bpe.pieces(texts)
    ids = [[] for _ in texts]
    for piece, i in zip(cut, doc):
        ids[i].extend(merge(piece))
    assert ids == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_bpe_state_crosses_chunks(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CHUNK", 256)
    text = "the quick  brown\n fox's 123 " * 60
    assert "".join(bpe.pieces([text])[0]) == text
    merge = bpe.Merger(bpe.read_ranks(open(VOCAB, "rb").read()))
    ids = [i for p in bpe.pieces([text])[0] for i in merge(p)]
    assert ids == reference.encode(text, add_special_tokens=False).ids


def test_encode_rows_and_round_trip(spark):
    rows = [(1, "Hello wörld\n", "x"), (2, "", "y"), (3, None, None), (4, "日本 🧾", "z"), (4, "日本 🧾", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4]
    assert {r.doc_id: len(r.ids) for r in got}[2] == {r.doc_id: len(r.ids) for r in got}[3] == 0
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()} == {1: "Hello wörld\n", 2: "", 3: "", 4: "日本 🧾"}
    assert bpe.encode(df.limit(0)).count() == 0
    off = {r.doc_id: r for r in bpe.encode(df, output="offsets").collect()}[1]
    assert off.piece_at == [0, 5, 11] and sum(off.piece_ids) == len(off.ids)


# p7 ---------------------------------------------------------------------------------------------------------------


def test_plan_is_best_fit_decreasing():
    """Against best fit over single items: as many containers, none overfull."""
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(3, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        hist = {s: sizes.count(s) for s in set(sizes)}
        runs, made = packing.plan(hist, capacity)
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(capacity - s)
        used = {}
        for s, found in runs.items():
            assert sum(n * each for _, _, each, n, _ in found) == hist[s]
            for _, first, each, n, before in found:
                for c in range(first, first + n):
                    assert used.get(c, 0) == before
                    used[c] = before + each * s
        assert all(v <= capacity for v in used.values()) and made == len(rooms) == len(used)


def test_pack_whole_and_split(spark):
    texts = [(i, "word " * (i % 40)) for i in range(300)] + [(900, "word " * 5000), (901, None), (902, ""), (903, "word " * 256)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    specs = spark.createDataFrame([("a", 256), ("b", 64), ("same", 64), ("bad", 0), (None, 9)], "spec_name string, capacity_tokens int")
    got = packing.pack(docs, specs)
    rows = got.collect()
    sizes = {r.doc_id: r.n_tokens for r in bpe.encode(docs, output="count").collect()}
    assert {r.spec_name for r in rows} == {"a", "b", "same"}
    for spec, cap in (("a", 256), ("b", 64)):
        mine = [r for r in rows if r.spec_name == spec]
        total = {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert total == sizes
        boxes = {}
        for r in mine:
            boxes.setdefault(r.container_id, []).append((r.token_offset, r.n_tokens))
        for items in boxes.values():
            at = 0
            for off, n in sorted(x for x in items if x[1]):
                assert off == at
                at += n
            assert at <= cap
        pieces = {}
        for r in mine:
            pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        assert all(n == 1 for d, n in pieces.items() if sizes[d] <= cap)
    assert packing.pack(docs.limit(0), specs).count() == 0
    assert packing.fill(got).filter("used > capacity_tokens").count() == 0


# p4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "value, form",
    [
        ("Ａｃｍｅ　Ｉｎｃ．", "Acme Inc."), ("Ac​me Ltd", "Acme Ltd"), ("Subruteﬁx", "Subrutefix"), ("José", "José"), ("Аcme Соrр", "Acme Corp"),
        ("GmbΗ", "GmbH"), ("ООО Фигрогипарт", "ООО Фигрогипарт"), ("ОО‍О Фирма", "ООО Фирма"), ("Фиpмa", "Фирма"), ("Zoë  Müller", "Zoë  Müller"), ("", ""), ("日本 Ltd", "日本 Ltd"),
        ("СОРЕ Trading Inc", "COPE Trading Inc"), ("L0tus", "L0tus"),
        ("Ϲompany", "Company"), ("aϲme", "acme"), ("Ꮯompany", "Company"), ("ⲟpen", "open"), ("ꓚompany", "Company"), ("Ω Ltd", "Ω Ltd"), ("ไทยᎠ", "ไทยᎠ"), ("東京カメラのﾃｽﾄ", "東京カメラのテスト"), ("5 µm", "5 µm"),
    ],
)
def test_canonical(value, form):
    assert confusables.canonical(value) == form
    assert confusables.canonical(form) == form


def test_scripts_have_bits_of_their_own():
    thai, cherokee, tamil, hangul, coptic, bengali = (confusables._scripts(c) for c in "กᎠதᄀⲀক")
    assert len({thai, cherokee, tamil, coptic, bengali}) == 5
    for a, b in itertools.combinations((thai, cherokee, tamil, hangul, coptic, bengali), 2):
        assert not a & b
    assert confusables._and("กᎠ", confusables._scripts) == confusables._and("தᄀ", confusables._scripts) == confusables._and("Ⲁক", confusables._scripts) == 0
    assert confusables._and("日本のカメラ", confusables._scripts) and confusables._and("漢한", confusables._scripts) and not confusables._and("の한", confusables._scripts)


EXTRACTIONS = "doc_id string, issuer_name string, recipient_name string, run_ts timestamp"


def test_confusables_found(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "Acme", "B​ob", t), ("a", "Acme", "B​ob", t), ("b", None, "", t), ("c", "Асme", None, t), ("c", "Acme", None, t), ("d", "Acme\n", None, t)], EXTRACTIONS)
    assert {tuple(r) for r in confusables.found(df).collect()} == {("a", "recipient_name"), ("c", "issuer_name"), ("d", "issuer_name")}
    assert confusables.found(df.limit(0)).count() == 0


# p8 ---------------------------------------------------------------------------------------------------------------

CLEAN = ["Le contrôle qualité a révélé des défauts à l’entrepôt — 40 €", "größtenteils störungsfrei, fällt über", "año señal café piñata “bien” £5", "não está já até às 5 §"]


def test_mojibake_planted(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(CLEAN) for _ in range(3))) for i in range(300)]
    bad = {1000: ("utf-8", "cp1252"), 1001: ("utf-8", "cp437"), 1002: ("cp1252", "mac_roman"), 1003: ("utf-8", "mac_roman"), 1004: ("cp1252", "cp850"), 1011: ("utf-8", "koi8-r")}
    original = " ".join(CLEAN[:3])
    rows = clean + [(k, original.encode(a).decode(b, "replace")) for k, (a, b) in bad.items()]
    rows += [(1005, original.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")), (1006, "lost � sign"), (1007, None), (1008, ""), (1009, "plain ascii")]
    rows += [(1010, CLEAN[3] + " " + CLEAN[0].encode("utf-8").decode("latin-1"))]
    thrice = original
    for _ in range(3):
        thrice = thrice.encode("utf-8").decode("latin-1")
    rows += [(1012, thrice)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in mojibake.repaired(df).collect()}
    assert set(got) == {*bad, 1005, 1006, 1010, 1012}
    assert got[1012].restored == original
    for k, (_, b) in bad.items():
        if "�" not in dict(rows)[k]:
            assert got[k].restored == original, k
    assert got[1005].restored == original and not got[1006].fully_restored
    assert got[1010].restored == CLEAN[3] + " " + CLEAN[0]
    assert mojibake.found(df.limit(0)).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    n = mojibake.N_STATES
    for _ in range(4):
        e = rng.normal(0, 6, (4, n)).astype(np.float32)
        e[:, 4:] = -60

        def score(path, e=e):
            s = e[0, path[0]] + (0 if path[0] == 0 else mojibake.ENTER)
            for t in range(1, len(path)):
                a, b = path[t - 1], path[t]
                if a != b:
                    s += mojibake.ENTER if a == 0 else mojibake.LEAVE if b == 0 else mojibake.SWITCH
                s += e[t, b]
            return s

        best = max(itertools.product(range(4), repeat=4), key=score)
        got = mojibake.viterbi(e, np.zeros(4, np.int64))
        assert abs(score(tuple(got)) - score(best)) < 1e-3


# p5 ---------------------------------------------------------------------------------------------------------------


def _page(rng, n=120):
    return " ".join(rng.choice("alpha beta gamma delta order invoice ledger copy carton signed total amount number please receipt".split()) + str(rng.randint(0, 99)) for _ in range(n))


def test_overlap_planted_and_hot_copies(spark):
    rng = random.Random(4)
    pages = [_page(rng) for _ in range(60)]
    standard = _page(rng, 40)
    raw, gold = [], []

    def add(i, text, split, source="s"):
        raw.append((f"d{i:03}", text, source))
        gold.append((f"d{i:03}", split))

    for i, p in enumerate(pages):
        add(i, p + " " + standard, "train")
    noisy = pages[0].replace("total", "tota1").upper().replace(" ", "\n", 20)
    add(100, noisy + " " + standard, "test")  # capture noise
    add(101, pages[1][: len(pages[1]) * 4 // 5], "val")  # lost ending
    add(102, _page(rng) + " " + standard, "test")  # only the standard paragraph
    add(103, None, "test")
    add(104, "", "val")
    for i in range(200, 240):  # a hot group of equal pages
        add(i, pages[2] + " " + standard, "test")
    rawdf = spark.createDataFrame(raw + raw[:5], "doc_id string, raw_text string, source_dataset string")
    golddf = spark.createDataFrame(gold + gold[:5], "doc_id string, _split string")
    got = {tuple(r) for r in overlap.found(golddf, rawdf).collect()}
    assert got == {("d000", "d100"), ("d001", "d101")} | {("d002", f"d{i}") for i in range(200, 240)}
    rep = {r.split: r for r in overlap.report(golddf, rawdf).collect()}
    assert (rep["test"].records, rep["test"].overlapping, rep["val"].overlapping) == (42, 41, 1)
    pages_ = {(r.doc_id, r.split): r for r in overlap.pages(golddf, rawdf).collect()}
    assert len(pages_) == 60 + 3 + 40  # texts that are null or empty have no page
    assert (pages_["d002", "train"].copies, pages_["d002", "train"].held, pages_["d210", "test"].train) == (41, 40, 1)
    linked = overlap.span_report(golddf, rawdf).collect()
    assert len(linked) == 1 and all(0.8 <= r.covered <= 1 and r.spans >= 1 and r.longest >= 3 for r in linked)
    assert overlap.found(golddf.limit(0), rawdf).count() == 0


def _words(rng, n, vocab=4000):
    return np.array([rng.randrange(vocab) * 16 + 1 for _ in range(n)], np.uint16)


@pytest.mark.parametrize("lo, hi, changed", [(8, 15, 1), (12, 19, 1), (20, 30, 1), (31, 60, 3), (60, 250, 12)])
def test_overlap_recall_in_each_band_of_length(spark, lo, hi, changed):
    """Against coverage over all diagonals, among texts that share standard paragraphs; sorted in many partitions."""
    rng = random.Random(lo)
    seqs, pairs = [], []
    for _ in range(120):
        t = _words(rng, rng.randint(lo, hi))
        u = t.copy()
        for p in rng.sample(range(len(t)), changed):
            u[p] = rng.randrange(4000) * 16 + 1
        if overlap.extend(t, u, np.arange(-20, 21))[0] >= overlap.COVERED:
            pairs.append((len(seqs), len(seqs) + 1))
        seqs += [t, u]
    standard = [_words(rng, 50) for _ in range(2)]
    seqs += [np.concatenate([_words(rng, 30), rng.choice(standard)]) for _ in range(200)]
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(seqs)], "rec long, words binary")
    rows = overlap.spans(overlap.suffixes(reps))
    got = {(r.a, r.b) for r in overlap.links(overlap.nominated(rows), reps).collect()}
    assert len(got & set(pairs)) >= 0.9 * len(pairs) and len(pairs) > 60
    assert all(a // 2 == b // 2 for a, b in got if b < 240)


def test_overlap_compares_across_borders(spark):
    """As many spans in eight partitions as in one."""
    rng = random.Random(1)
    seqs = [_words(rng, 100, 5) for _ in range(40)]
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(seqs)], "rec long, words binary")
    rows = np.concatenate([np.column_stack([overlap.keys(w, at := overlap.anchors(w)), np.full(len(at), i), at << 32 | len(w)]) for i, w in enumerate(seqs)])
    want = overlap.adjacent(rows[np.lexsort(rows.T[::-1])])
    got = np.array([tuple(r) for r in overlap.spans(overlap.suffixes(reps)).collect()])
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want)


def test_common_prefix_goes_on_past_the_keyed_words():
    rng = random.Random(2)
    base = _words(rng, 300)
    for equal in (5, 12, 17, 30, 60, 300):
        other = base.copy()
        other[equal:] = _words(rng, 300 - equal) + 1
        a, b = (np.column_stack([overlap.keys(w, np.zeros(1, np.int64)), [[i, 300]]]) for i, w in enumerate((base, other)))
        got = int(overlap.common_prefix(a, b)[0])
        assert got <= equal and got == max([n for n in (*range(13), *overlap.LEVELS, 300) if n <= equal])


def test_overlap_folds_as_a_table_character_by_character():
    table = {"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "8": "b", "6": "b", "@": "a", "+": "t"}

    def naive(text):
        text = re.sub(r"(?<=\w)[-\xad\xac‐‑]\s*\n\s*(?=\w)", "", text.lower())
        text = "".join(table.get(c, c) for c in text)
        for a, b in (("rn", "m"), ("ll", "u"), ("cl", "d"), ("vv", "w"), ("c", "e")):
            text = text.replace(a, b)
        return re.findall(r"[^\W_]+", text)

    rng = random.Random(6)
    odd = ["a-\nb", "-\nb", "a--\nb", "a-\n", "_-\n_", "İ-\nx", "ΟΔΟΣ-\nΣ", "é-\n\n é‐ \nz", "1l1|", "clc", "rnrn", "", " "]
    odd += ["".join(rng.choice("aAcClLrRnNvViI015|!86@+-­‐\n\t _.éßİΣ日½²") for _ in range(60)) for _ in range(500)]
    for text in odd:
        words = naive(text)
        assert overlap.fold_words(text) == words
        assert b"".join(map(overlap._HASHES.__getitem__, words)) == np.array([zlib.crc32(w.encode()) & 0xFFFF for w in words], np.uint16).tobytes()


def _cpu(f):
    """Least CPU seconds of five calls."""
    took = []
    for _ in range(5):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    return min(took)


def test_overlap_folds_texts_beyond_ascii_as_fast():
    plain = [_page(random.Random(i), 300) for i in range(100)]
    dashed = [t + " – €" for t in plain]  # one sign beyond ASCII, as in most captured texts
    assert _cpu(lambda: [overlap.fold_words(t) for t in dashed]) < 2 * _cpu(lambda: [overlap.fold_words(t) for t in plain])


def test_overlap_suffixes_of_many_records_together_equal_one_at_a_time():
    rng = random.Random(9)
    lengths = [0, 1, 2, 3, 4, 11, 12, 13, 62, 63, 64, 65, 66, 300, 0, 5, 2000, 64, 1] + [rng.randint(0, 130) for _ in range(400)]
    seqs = [_words(rng, n, rng.choice((2, 5, 4000))) for n in lengths]
    ids = np.array([rng.getrandbits(63) - (1 << 62) for _ in seqs], np.int64)
    rows = overlap.suffix_rows(ids, [s.tobytes() for s in seqs])
    one = [np.column_stack([overlap.keys(s, at := overlap.anchors(s)), np.full(len(at), i), at << 32 | len(s)]) for i, s in zip(ids, seqs)]
    assert np.array_equal(rows, np.concatenate(one))
    for s in seqs:  # positions by the definition
        h = [(int(a) * 0x9E3779B97F4A7C15 ^ int(b) * 0xC2B2AE3D27D4EB4F ^ int(c) * 0x165667B19E3779F9) % 2**64 for a, b, c in zip(s, [*s[1:], 0], [*s[2:], 0, 0])]
        h = [(x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64 for x in h]
        if len(s) < overlap.DENSE:
            want = list(range(max(len(s) - 2, min(len(s), 1))))
        else:
            want = [i for i in range(len(h)) if i == 0 or all(h[i] < x for x in h[max(0, i - 2) : i]) and all(h[i] <= x for x in h[i + 1 : i + 3])]
        assert overlap.anchors(s).tolist() == want
    assert overlap.suffix_rows(np.empty(0, np.int64), []).shape == (0, 6)


def test_overlap_suffixes_cost_little_a_record():
    rng = random.Random(10)
    seqs = [_words(rng, 40) for _ in range(1000)]
    ids, raw = np.arange(1000), [s.tobytes() for s in seqs]
    one = _cpu(lambda: [overlap.keys(s, overlap.anchors(s)) for s in seqs])
    assert 3 * _cpu(lambda: overlap.suffix_rows(ids, raw)) < one


def test_overlap_groups_of_records_lose_none(spark):
    """Records longer than a group, shorter ones after them, and as many rows as without groups."""
    rng = random.Random(11)
    seqs = [_words(rng, n) for n in (70_000, 3, 40_000, 40_000, 140_000, 5, 90)]
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(seqs)], "rec long, words binary").coalesce(1)
    got = sorted(map(tuple, overlap.suffixes(reps).collect()))
    assert got == sorted(map(tuple, overlap.suffix_rows(np.arange(len(seqs)), [s.tobytes() for s in seqs]).tolist()))


def test_overlap_extends_as_by_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        a, b = (_words(rng, rng.randint(3, 40), 3) for _ in range(2))
        if len(a) > len(b):
            a, b = b, a
        diagonals = np.array([rng.randint(-len(a), len(b)) for _ in range(rng.randint(1, 3))])
        covered = set()
        for d in {d + k for d in diagonals.tolist() for k in range(-overlap.DRIFT, overlap.DRIFT + 1)}:
            for i in range(len(a) - 2):
                if all(0 <= i + d + k < len(b) and a[i + k] == b[i + d + k] for k in range(3)):
                    covered |= {i, i + 1, i + 2}
        runs = "".join("x" if i in covered else " " for i in range(len(a))).split()
        want = (len(covered) / len(a), len(runs), max(map(len, runs), default=0))
        assert overlap.extend(a, b, diagonals) == want
        assert overlap.extend(a, b, diagonals, 0.8) == (want if want[0] >= 0.8 else (want[0], 0, 0))


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(1, 1), (5, None)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 301 + i) for i in range(30)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(label)):
        for a, b in edges:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


# p2 ---------------------------------------------------------------------------------------------------------------


def test_names_planted(spark):
    groups = [
        ["Alexander Lohubedruck", "Lohubedruck, Alexander", "Mr. Alexander Lohubedruck", "Alexander Lohbuedruck", "LOHUBEDRUCK ALEXANDER", "Alex Lohubedruck"],
        ["Anthony Lohubedruck", "Anthony L. Lohubedruck", "Tony Lohubedruck"],
        ["Bizikomes International Trading Inc.", "Bizikomes Int'l Trdg Inc", "Bill To: Bizikomes International Trading Inc.", "BizikomesInternational Trading Inc.", "International Trading Inc., Bizikomes", "Bizikomes I.T."],
        ["The Zolimur Packaging GmbH", "Zolimur Pkg G.m.b.H."],
        ["Tigragrurt Paper Company", "Tigragrurt"],
        ["Zolimur Catering Ltd"],
        ["W. Karabonte", "William Karabonte"],
    ]
    noise = ["Mr. Karabonte", "Lohubedruck", "Zolimur", "RzQfC|", "kMO'", None, "", "   "]
    rows = [("d", v, None, datetime.datetime(2024, 1, 1)) for g in groups for v in g] + [("e", None, v, datetime.datetime(2024, 1, 1)) for v in noise]
    df = spark.createDataFrame(rows + rows[:3], EXTRACTIONS)
    got = {tuple(r) for r in names.found(df).collect()}
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    assert got == want
    assert names.found(df.limit(0)).count() == 0


def test_ambiguous_abbreviation_waits(spark):
    vals = ["Drubonat Packaging Ltd", "Drubonat Printing Ltd", "Drubonat P."]
    df = spark.createDataFrame([("d", v, None, datetime.datetime(2024, 1, 1)) for v in vals], EXTRACTIONS)
    assert names.found(df).count() == 0


def test_union_keeps_what_does_not_match():
    a, b, c = (names.Profile([[w], ["karabonte"]], []) for w in ("packaging", "catering", "packagin"))
    got = names._union([a, b, c])
    assert sorted(w for p in got for slot in p.slots for w in slot) == ["catering", "karabonte", "karabonte", "packagin", "packaging"]


def test_profiles_of_one_entity_are_not_linked_to_themselves(spark):
    dumps = [(1, names.Profile([["karabonte"], ["packaging"]], []).dump()), (1, names.Profile([["catering"], ["karabonte"]], []).dump()), (2, names.Profile([["caterin"], ["karabonte"]], []).dump())]
    links = names._stream_links(names._keyed(spark.createDataFrame(dumps, "pid long, profile string"))).collect()
    assert {(frozenset((r.a, r.b)), r.kind) for r in links} == {(frozenset((1, 2)), "same")}


def test_abbreviations_re_enter_blocking(spark):
    """The short name joins the only firm it fits, and brings its variant of the first word into the next round."""
    vals = ["Bizikomes Trading Packaging Ltd", "Bizikomess T. P.", "Bizikomesss"]
    df = spark.createDataFrame([("d", v, None, datetime.datetime(2024, 1, 1)) for v in vals], EXTRACTIONS)
    assert {frozenset(r) for r in names.found(df).collect()} == {frozenset(p) for p in itertools.combinations(vals, 2)}


@pytest.mark.parametrize("copies", [1, 8])
def test_common_words_hide_nothing_at_any_size(spark, copies):
    """Variants of people who share surnames and given names, among ever more of them; against the planted groups."""
    rng = random.Random(4)
    given = ["Margaret", "Theodore", "Frederick", "Josephine", "Nicholas", "Patricia", "Benjamin", "Samantha"]
    surnames = ["Karabonte", "Lohubedruck", "Zolimurest", "Tigragrurt", "Bizikomest"] + ["".join(rng.choice("ba du ki lo me ra so tu vi pe fo ga hi ju zo nu we cy".split()) for _ in range(5)).capitalize() + "x" for _ in range(10 * copies)]
    groups = []
    for s in surnames:
        for g in given:
            typo = s[:3] + s[4] + s[3] + s[5:] if s[3] != s[4] else s[:-1]
            groups.append([f"{g} {s}", f"{s}, {g}", f"Mr. {g} {s}", f"{g} {typo}"])
    want = {frozenset(p) for g in groups for p in itertools.combinations(g, 2)}
    df = spark.createDataFrame([("d", v, None, datetime.datetime(2024, 1, 1)) for g in groups for v in g], EXTRACTIONS)
    got = {frozenset(r) for r in names.found(df).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)


def test_hints_are_complete():
    """Words that are alike share a hint, so that blocks by hints lose no pair."""
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(400)} | set(names._NICK) | set(names._GIVEN)
    for a, b in itertools.combinations(sorted(words), 2):
        if names.alike(a, b):
            assert names.hints(frozenset([a])) & names.hints(frozenset([b])), (a, b)


def test_within1():
    for a, b, ok in [("abc", "abc", True), ("abc", "abd", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "axbc", True), ("abc", "cba", False), ("abcd", "ab", False)]:
        assert names.within1(a, b) == names.within1(b, a) == ok


# p3 ---------------------------------------------------------------------------------------------------------------

BODY = "The committee accepted the maintenance visit and the warehouse clerk returned the inspection certificate because the quarterly statement never reached our accounting department"


def _scans(spark, extra):
    rng = random.Random(1)
    words = BODY.split()
    rows = [(f"c{i}", " ".join(rng.sample(words, 18)) + ".\nA well-documented report for our accounting department.") for i in range(250)]
    return spark.createDataFrame(rows + extra, "doc_id string, raw_text string")


def test_scans_planted(spark):
    extra = [
        ("h", "The commit-\ntee accepted the maintenance visit and the clerk"), ("compound", "This was a well-\ndocumented report for the committee"),
        ("m", "the committee accepted the mainteriance visit and the warehou5e clerk"), ("p", "the committee accepted\nPage 2 of 3\nthe maintenance visit"),
        ("t", "QUALITY AUDIT 12-B\nthe committee accepted\n\fQUALITY AUDIT 12-B\nthe maintenance visit"), ("q", "14 carton label 3.00 42.00\n14\n3 packing list 1.00 3.00"),
        ("ref", "the report, see page 12 of the certificate"), ("n", None), ("e", ""), ("clean", "The committee accepted the statement because the clerk returned the certificate."),
    ]
    df = _scans(spark, extra)
    got = {(r.doc_id, r.noise_kind) for r in scans.found(df).collect() if r.doc_id[0] != "c" or r.doc_id in ("compound", "clean")}
    assert got == {("h", "hyphenation"), ("m", "misread"), ("p", "page_number"), ("t", "header")}
    text = {r.doc_id: r.repaired for r in scans.repaired(df).collect()}
    assert text["h"].startswith("The committee accepted") and "maintenance" in text["m"] and "warehouse" in text["m"]
    assert "Page" not in text["p"] and "AUDIT" not in text["t"] and "well-documented" in text["compound"].replace("- ", "-").replace("-\n", "-")
    assert "n" not in text and scans.found(df.limit(0)).count() == 0


def _context_corpus(spark):
    """'dark' stands beside rooms and lamps, never beside titles, where a name that folds to it does."""
    rng = random.Random(6)
    rooms = ["the {} room behind the lamp store was empty", "a {} lamp hung over the empty room", "this {} store has no lamp at all"]
    people = ["dear mr {} please call our office today", "signed by mr {} for our office", "mr {} will call today"]
    rows = [(f"r{i}", rng.choice(rooms).format(rng.choice(["dark", "large", "quiet"]))) for i in range(600)]
    rows += [(f"m{i}", rng.choice(people).format(rng.choice(["miller", "potter"]))) for i in range(600)]
    # Glyphs as scanning confuses them: right only where the word could stand.
    rows += [(f"wrong{i}", rng.choice(people).format("clark")) for i in range(1)] + [(f"right{i}", rng.choice(rooms).format("clark")) for i in range(2)]
    return spark.createDataFrame(rows, "doc_id string, raw_text string")


def test_context_decides_and_zeroed_vectors_do_not(spark):
    df = _context_corpus(spark)
    vocab = scans.learn(df)
    rows = [r for r in df.collect() if r.doc_id[:5] in ("wrong", "right")]

    def corrected():
        corrector = scans.Corrector(vocab)
        return {r.doc_id for r in rows if "misread" in scans.repair(r.raw_text, corrector)[1]}

    assert corrected() == {"right0", "right1"}
    vocab.vectors, vocab.outputs = np.zeros_like(vocab.vectors), np.zeros_like(vocab.outputs)
    assert "wrong0" in corrected()


def test_skip_gram_objective_rises_to_a_fixed_point():
    rng = np.random.default_rng(3)
    size = 30
    counts = rng.poisson(4, (size, size)).astype(float)
    counts += counts.T
    noise = np.full(size, 1 / size)
    u, v = rng.normal(0, 0.1, (2, size, scans.DIM))

    def objective():
        s = u @ v.T
        negative = scans.NEGATIVES * counts.sum(1, keepdims=True) * noise
        return (counts * np.logaddexp(0, -s)).sum() + (negative * np.logaddexp(0, s)).sum() + scans.RIDGE / 2 * ((u * u).sum() + (v * v).sum())

    upper = np.triu_indices(scans.DIM)
    seen = [objective()]
    for _ in range(6):
        u = scans.newton(u, counts, v, noise, v[:, upper[0]] * v[:, upper[1]])
        seen.append(objective())
    assert all(b <= a + 1e-6 for a, b in zip(seen, seen[1:])) and seen[0] - seen[-1] > 1 and seen[-2] - seen[-1] < 1e-3


def test_found_and_repaired_agree(spark):
    df = _scans(spark, [("x", "the committee accepted the mainteriance visit\nand the warehou5e cl-\nerk")])
    one = {(r.doc_id, k) for r in scans.repaired(df).collect() for k in r.kinds}
    assert one == {tuple(r) for r in scans.found(df).collect()}


# p1 ---------------------------------------------------------------------------------------------------------------


def test_crf_gradient_and_decoding_by_brute_force():
    rng = np.random.default_rng(2)
    trans = rng.normal(0, 1, (pii.L, pii.L)).astype(np.float32)
    e = rng.normal(0, 1, (1, 3, pii.L)).astype(np.float32)
    full = trans + pii.MASK
    paths = list(itertools.product(range(pii.L), repeat=3))
    score = np.array([pii.FIRST[p[0]] + e[0, 0, p[0]] + full[p[0], p[1]] + e[0, 1, p[1]] + full[p[1], p[2]] + e[0, 2, p[2]] for p in paths])
    prob = np.exp(score - score.max())
    prob /= prob.sum()
    marginal, expected, logz = pii._forward_backward(e, np.array([3]), trans)
    want = np.zeros((3, pii.L))
    for p, w in zip(paths, prob):
        for t in range(3):
            want[t, p[t]] += w
    assert np.allclose(marginal[0], want, atol=1e-4)
    assert abs(logz[0] - (np.log(np.exp(score - score.max()).sum()) + score.max())) < 1e-3
    assert abs(expected.sum() - 2) < 1e-3
    assert tuple(pii.decode(e, trans)[0]) == paths[int(score.argmax())]


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.train(1200, 24, which="train"), pii._sample_kinds())


def test_pii_on_frames_not_trained_on(tagger):
    """Recall and precision of each kind on the held-out fifth of the frames."""
    assert not set(pii_samples.frames("train")[2]) & set(pii_samples.frames("held")[2])
    hit, miss, extra = ({k: 0 for k in pii.KINDS} for _ in range(3))
    cases = pii_samples.samples(300, 77, "held")
    for (text, spans), items in zip(cases, tagger.tag([t for t, _ in cases])):
        tokens = pii.chunks(text)
        got = {(k, pii.key_of(s)) for a, b, k in pii.widen(tokens, items) if (s := pii.item(k, " ".join(tokens[a:b])))}
        gold = {(k, pii.key_of(text[a:b])) for a, b, k in spans}
        for count, items in ((hit, got & gold), (miss, gold - got), (extra, got - gold)):
            for k, _ in items:
                count[k] += 1
    for k in pii.KINDS:
        recall, precision = hit[k] / (hit[k] + miss[k]), hit[k] / (hit[k] + extra[k])
        print(f"{k}: recall {recall:.3f}, precision {precision:.3f} of {hit[k] + miss[k]}")
        assert recall > 0.85 and precision > 0.85, (k, recall, precision)


def test_model_is_saved_and_read(tmp_path, monkeypatch):
    path = str(tmp_path / "model.npz")
    one = pii.fitted(150, path)
    monkeypatch.setattr(pii, "train", lambda *a, **k: pytest.fail("trained again"))
    two = pii.fitted(150, path)
    assert one.index == two.index and np.array_equal(one.weights, two.weights) and np.array_equal(one.transitions, two.transitions)


def test_pii_rows(spark):
    rng = random.Random(3)
    prose = "the garden was quiet and nobody came by for the old boat near the bridge while we waited in the rain".split()
    filler = [(f"f{i}", " ".join(rng.choice(prose) for _ in range(60)) + "\nDear Customer, call phone fax order is late please send to write") for i in range(60)]
    text = "Dear Margaret Soveno,\nPlease write to margaret.soveno@example.org or send a fax to +1 212 555 0199.\nSSN: 123-45-6789\nOrder 4711-C is late."
    texts = [("a", text), ("a", text), ("n", None), ("e", ""), *filler]
    df = spark.createDataFrame(texts, "doc_id string, raw_text string").withColumn("text", F.lit(1)).withColumn("key", F.lit(2))
    got = {tuple(r)[1:] for r in pii.found(df).collect() if r.doc_id == "a"}
    assert {("email", "margaretsovenoexampleorg"), ("phone", "12125550199"), ("identity", "123456789"), ("name", "margaretsoveno")} <= got
    red = {r.doc_id: r.redacted for r in pii.redacted(df).collect()}["a"]
    assert "[EMAIL]" in red and "[PHONE]" in red and "[IDENTITY]" in red and red.endswith("Order 4711-C is late.") and "soveno" not in red.lower()
    assert pii.found(df.limit(0), samples=200).count() == 0


def test_redaction_keeps_the_rest():
    text = "From: Ann Lee <ann@x.example>\n\fCall (212) 555-0100, please."
    toks = pii.chunks(text)
    items = [(1, 3, "name"), (3, 4, "email"), (toks.index("(212)"), toks.index("(212)") + 2, "phone")]
    assert pii.redact(text, items) == "From: [NAME] <[EMAIL]>\n\fCall [PHONE], please."
