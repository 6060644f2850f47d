"""Token counts, language id, packing, sampled pieces and quality rules against libraries and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ebbtide.llm import language_id, packing, piece_sampling, quality, token_counts

ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, "a" * 30_000, "fr"), (5, "a  b\n \n c  ", "en"),
    (5, "a  b\n \n c  ", "en"), (6, "don't stop<|endoftext|>now é漢🙂▁x", None), (None, "no id", "de"), (7, "The of and " * 3000, "en"),
]
SCHEMA = "doc_id long, text string, lang string, n_tokens int, score int, piece string, length string, ids string, kept string"


def odd(spark, rows=ODD):
    """Edge rows in a table whose extra columns clash with names of the results."""
    return spark.createDataFrame([(*r, 1, 2, "p", "l", "i", "k") for r in rows], SCHEMA)


@pytest.mark.parametrize("rows", [ODD, []])
def test_token_counts_equal_the_library(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = token_counts.token_counts(odd(spark, rows), path).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(map(str, (tuple(r)[:3] for r in found))) == sorted(map(str, expected))
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)


def test_token_counts_of_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(path), token_counts.ByteCounter(path), random.Random(1)
    letters = [*"aB .\n\t  '’sdré1٣½\x1c\x85漢🙂!?_-\r", "<|endoftext|>", "'ll", " the", "ing", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("rows", [ODD, []])
def test_packing_is_gapless_and_exact(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = packing.pack_documents(odd(spark, rows), path).collect()
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    expected = Counter(
        (i, at // 4096, at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes()))
        for i, x in ids
        for at in range(0, len(x), 4096)
    )
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    by_sequence = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_sequence.get(r.sequence_id, 0)
        by_sequence[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in by_sequence.values())


def test_packing_ids_of_random_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = packing._word_ids(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    letters = "aAbB zé.É,!?;:' \n\t'sS1½ΣΟσ.ßİ\u0307é(\")~<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, " ", "it's. It'S! don't, ΟΔΟΣ. ΟΔΟΣ", "x" * 300 + ". Y", "a ~ b ~.", "İ.", "<|endoftext|>", "a<|EndOfText|> B.", "A <|startoftext|>b."]
    ids, counts = coder.of(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], text


def test_words_are_asked_for_without_capitals_and_marks():
    """Forms of one word are one entry, and their ids stay those of the library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = packing.WordIds(path), Tokenizer.from_file(path)
    coder.of(pa.array([b"Kelo kelo, KELO.$$$ kelo, (kelo)"]))
    assert set(coder.ids) <= {b"kelo", b",", b".$$$", b"(kelo)", b""}
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choices("aZéÀ×÷ÿßµªΣİ1'", k=rng.randrange(4))) + "".join(rng.choices(packing.MARKS + "~<|'\u0301", k=rng.randrange(4))) for _ in range(9)) for _ in range(2000)]
    ids, counts = coder.of(pa.array([t.encode() for t in texts]))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, packing.END_ID], text


def test_fullest_bin_against_enumeration():
    rng = random.Random(2)
    for _ in range(200):
        counts = {k: rng.randint(1, 3) for k in rng.sample(range(1, 30), 5)}
        lengths = sorted(counts, reverse=True)
        chosen = packing.fullest(lengths[0], counts, lengths, 60)
        left = counts | {lengths[0]: counts[lengths[0]] - 1}
        sums = {lengths[0]}
        for k, n in left.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= 60}
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(n <= counts[k] for k, n in chosen.items())


def test_cross_parsing_against_its_definition():
    def brute(train, text):
        i = n = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in train:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    trains, rng = ("abcab bca xyz", "zzyx ab"), random.Random(3)
    model = language_id.LanguageModel(tuple(zip("xy", trains)))
    texts = ["".join(rng.choice("abcxyz q") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    assert model.phrases(texts).tolist() == [[brute(t, x) for t in trains] for x in texts]


@pytest.mark.parametrize("cells", [language_id.CELLS, 0])
def test_long_texts_are_parsed_without_a_cut(monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    rng = random.Random(5)
    trains = ["".join(rng.choice("abcd ") for _ in range(500)) for _ in range(2)]
    model = language_id.LanguageModel(tuple(zip("xy", trains)))
    trains = [language_id.plain(t) for t in trains]
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (20_000, 3, 7000, *[40] * 100)]

    def brute(train, text):
        i = n = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in train:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        return n

    assert model.phrases(texts).tolist() == [[brute(t, x) for t in trains] for x in texts]


def test_signs_that_are_no_letters():
    model = language_id.LanguageModel((("x", "some text"), ("y", "anderer satz")))
    found = model.predict(["½ ² ①", "Ⅷ ⅻ", "٣ 7", "", None, "é", "some Ⅷ text"])
    assert [f[0] for f in found[:5]] == ["und"] * 5 and found[0][1] == 0.0
    assert found[5][0] != "und" and found[6][0] == "x" and language_id.plain("some Ⅷ½ text") == "some text"


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = [r for r in language_id.op2_language_id(spark, sf).collect() if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.9 * len(found)


def test_language_of_edge_rows(spark):
    rows = {(r.doc_id, r.lang_pred) for r in language_id.language_id(odd(spark), odd(spark)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows
    assert {r.lang_pred for r in language_id.language_id(odd(spark), odd(spark, [])).collect()} == {"und"}


def test_sampled_pieces_decode_to_the_text_and_repeat(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    runs = [piece_sampling.decode_pieces(piece_sampling.encode_sampled(odd(spark).repartition(n), path), path).collect() for n in (1, 4)]
    assert all((r.text or "") == r.decoded for r in runs[0])
    assert Counter((r.doc_id, tuple(r.ids)) for r in runs[0]) == Counter((r.doc_id, tuple(r.ids)) for r in runs[1])
    assert piece_sampling.encode_sampled(odd(spark, []), path).count() == 0


def test_long_units_have_one_lattice(monkeypatch):
    pieces = piece_sampling.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    unit = piece_sampling.SPACE + "other" * 2000
    seeds = np.arange(40, dtype=np.uint64)
    drawn = piece_sampling.sample(pieces, [[unit]] * 40, seeds)
    spelled = [[pieces.spelled[i].decode() for i in ids.tolist()] for ids in drawn]
    assert all("".join(x) == " " + "other" * 2000 for x in spelled)
    # forward sums against the recursion over the whole unit
    lattice = piece_sampling.Lattices(pieces, [unit])
    sums = [0.0]
    for j in range(1, len(unit) + 1):
        own = [sums[i] + pieces.weights[unit[i:j]][1] for i in range(max(0, j - pieces.longest), j) if unit[i:j] in pieces.weights]
        sums.append(np.logaddexp.reduce(own))
    last = len(unit) - 1
    edges = np.flatnonzero(np.floor(lattice.cumulative - 1e-12) == last)
    want = {i: np.exp(sums[i] + pieces.weights[unit[i:]][1] - sums[-1]) for i in range(max(0, last + 1 - pieces.longest), last + 1) if unit[i:] in pieces.weights}
    got = dict(zip((lattice.before[edges] + 1).tolist(), np.diff(np.concatenate([[last], lattice.cumulative[edges]])).tolist()))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    # groups of units change nothing
    rows = [["▁a", "▁other", unit], ["▁other"], []]
    whole = piece_sampling.sample(pieces, rows, seeds[:3])
    monkeypatch.setattr(piece_sampling, "TOGETHER", 3)
    assert [x.tolist() for x in piece_sampling.sample(pieces, rows, seeds[:3])] == [x.tolist() for x in whole]


def test_sampling_follows_the_path_weights():
    pieces = piece_sampling.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    unit = piece_sampling.SPACE + "other"

    def paths(i):
        if i == len(unit):
            yield (), 0.0
        for j in range(i + 1, len(unit) + 1):
            if (own := pieces.weights.get(unit[i:j])) is not None:
                for ids, w in paths(j):
                    yield (own[0], *ids), w + own[1]

    weights = {ids: np.exp(w) for ids, w in paths(0)}
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in piece_sampling.sample(pieces, [[unit]] * n, np.arange(n, dtype=np.uint64)))
    for ids, w in weights.items():
        assert abs(drawn[ids] / n - w / sum(weights.values())) < 0.01


def test_quality_figures_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in quality.op10_quality_rules(spark, sf).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {k + d for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for d in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_quality_keeps_good_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    judged = quality.op10_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id").collect()
    good, junk = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.2 * len(junk)


def test_quality_of_edge_rows(spark):
    found = quality.quality_rules(odd(spark)).collect()
    assert len(found) == len(ODD) and all(r.base_failed for r in found if r.n_words < 20)
    kept = quality.passing(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == sum(r.kept for r in found)
    assert quality.quality_rules(odd(spark, [])).count() == 0


def test_symbols_beyond_ascii_are_no_letters():
    assert quality.class_histogram("éЖ中🙂█�«٣ ".encode()).tolist() == [2 / 9, 1 / 9, 1 / 9, 1 / 9, 1 / 9, 3 / 9]
    rng, common = random.Random(9), [f"common{chr(97 + k)}" for k in range(24)]
    plain = [[rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(200)] for _ in range(40)]
    references = quality.References([("x", " ".join(w)) for w in plain])
    judge = quality.judgement(quality.LIMITS)
    assert all(judge(references, 1, " ".join(w).encode())[-1] for w in plain)
    for mark in "🙂█�":
        marked = " ".join(mark * len(w) if rng.random() < 0.3 else w for w in plain[0])
        assert not judge(references, 1, marked.encode())[-1]


def test_judging_keeps_no_words():
    """What a worker holds doesn't grow with the words it has seen; texts judged together get what each gets alone."""
    import tracemalloc

    references, judge = quality.References([("x", "some plain words, some more")]), quality.judgement(quality.LIMITS)
    judge(references, 1, b"a first text")
    tracemalloc.start()
    for k in range(10):
        judge(references, 1, " ".join(f"w{k}x{j}" for j in range(10_000)).encode())
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert left < 2_000_000
    rng = random.Random(13)
    texts = [b"", None, b" ", b" a ", "\u2003\x85 é".encode(), b"a b c d e f g h " * 2, b"\n\n a\n a\x0b"]
    texts += ["".join(rng.choices("ab,. \n\t#é中", k=rng.randrange(200))).encode() for _ in range(200)]
    together = zip(*(c.to_pylist() for c in quality.judged(references, quality.LIMITS, pa.array(texts, pa.binary()).slice(1))))
    assert [tuple(r) for r in together] == [judge(references, 1, t)[1:] for t in texts[1:]]


def test_both_distances_are_to_one_language():
    rng = random.Random(10)
    low = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(150)) for _ in range(20)]
    high = [" ".join(rng.choice(["EE", "FF", "GG", "HH"]) for _ in range(150)) for _ in range(20)]
    references, judge = quality.References([*(("x", t) for t in low), *(("y", t) for t in high)]), quality.judgement(quality.LIMITS)
    assert judge(references, 1, low[0].encode())[-1] and judge(references, 1, high[0].encode())[-1]
    assert not judge(references, 1, low[0].upper().encode())[-1]  # capitals as in y, words as in x


def test_references_come_from_every_labelled_text(spark):
    """A text of any row moves the shares, however many rows there are."""
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choices(["Aa", "bb.", "cc", "--"], [1, 2, 3, 1], k=rng.randrange(1, 60))), "x") for k in range(3000)]
    rows += [(None, "aa 1", "x"), (1, None, "x"), (2, "", "x"), (3, "zz", None), (4, "-- --", "y")]
    (lang, found), *others = quality.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), "lang", "text")
    own = [t for _, t, x in rows if t and x == "x"]
    words = [[w.lower().strip(".-").encode() for w in t.split()] for t in own]
    counts = Counter(w for t in words for w in t if w)
    assert lang == "x" and not others
    assert found.top == tuple(w for w, _ in counts.most_common()) and found.shares == tuple(counts[w] / counts.total() for w in found.top)
    expected = [np.median([t.count(w) / len(t) for t in words]) for w in found.top]
    assert np.allclose(found.medians, expected, atol=1e-4)
    assert np.allclose(found.classes, np.median([quality.class_histogram(t.encode()) for t in own], axis=0), atol=1e-4)


def test_the_pipeline_learns_from_rows_without_id_too(spark):
    """References of the quality stage come from every labelled text, so junk goes even where no row has an id."""
    import corpus_pipeline

    rng, common = random.Random(12), [f"common{chr(97 + k)}" for k in range(24)]
    plain = [" ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(200)) for _ in range(40)]
    junk = " ".join("🙂" * len(w) if rng.random() < 0.3 else w for w in plain[0].split())
    docs = spark.createDataFrame([(None, t, "x") for t in [*plain, junk]], "doc_id long, text string, lang string")
    kept = corpus_pipeline.quality_stage(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == sorted(plain)
