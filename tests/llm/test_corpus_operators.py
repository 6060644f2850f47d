"""Substring dedup, n-gram join, personal data, WARC, top-k search and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ebbtide.llm import ngram_join, pii, substring_dedup, topk_search, warc
from ebbtide.session import shared_dir, written

SCHEMA = "doc_id long, text string, ranges string, mark string, shared int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def passages(seed=1):
    rng = random.Random(seed)
    shared = [" ".join(f"s{k}w{rng.randint(0, 99)}" for _ in range(70)) for k in range(3)]
    rows = []
    for i in range(40):
        parts = [" ".join(f"d{i}x{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))) for _ in range(2)]
        rows.append((i, f"{parts[0]} {rng.choice(shared)}\n{parts[1]}" if i % 3 else parts[0]))
    copy = rows[4][1]
    return [*rows, *((100 + k, copy) for k in range(6)), (200, None), (201, ""), (202, "short"), (203, "again " * 300)]


def test_repeated_ids_with_other_texts_all_stay(spark):
    words = [" ".join(f"{k}w{i}" for i in range(40)) for k in "abcd"]
    rows = [(1, words[0]), (1, words[1]), (1, words[0]), (2, words[1] + " more"), (3, words[2]), (3, None), (0, words[2]), (None, words[0])]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(frame(spark, rows)).collect()), key=str)
    # of each group of near copies the smallest id, of equal rows one; nothing goes for sharing an id
    assert kept == sorted([(1, words[0]), (1, words[1]), (0, words[2]), (3, None), (None, words[0])], key=str)


def removal(rows, window=50):
    words, first, out = {i: (t or "").encode().split() for i, t in rows}, {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    for i, own in words.items():
        gone = {q for p in range(len(own) - window + 1) if first[tuple(own[p : p + window])] < i for q in range(p, p + window)}
        kept = [w for q, w in enumerate(own) if q not in gone]
        out[i] = (len(own), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 1])
def test_substring_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)  # 1: every shared anchor takes the whole-window prefix
    rows = passages()
    found = substring_dedup.removal_figures(substring_dedup.marked_texts(frame(spark, rows))).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == removal(rows) and len(found) == len(rows)


def test_substring_dedup_edges(spark):
    rows = [*passages()[:6], (1, passages()[1][1]), (None, passages()[1][1])]
    kept = substring_dedup.without_repeats(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    by_id = {(r.doc_id, r.text) for r in kept.collect()}
    assert (None, rows[1][1]) in by_id and (1, rows[1][1]) in by_id and kept.count() == len(rows)
    assert substring_dedup.without_repeats(frame(spark, [])).count() == 0


def near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    lists, common, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    for own in lists.values():
        common.update(combinations(sorted(own), 2))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_ngram_join(spark):
    rng, rows = random.Random(4), []
    bases = [[f"W{k}" for k in range(100)], [f"v{k}" for k in range(60)], [f"u{k}" for k in range(9)]]
    for i in range(120):
        words = list(bases[i % 3])
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        rows.append((i, (" " if i % 2 else "\n").join(words)))
    rows += [(200 + i, f"Short TEXT {i % 2}") for i in range(4)] + [(300, None), (301, ""), (302, " \n")]
    found = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near(rows)
    kept = ngram_join.one_of_each(frame(spark, [*rows, (None, "no id at all")]))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in near(rows).values()} | {None}


def near_copies(rng, many: int, changes: int) -> list[tuple[int, str]]:
    """A text and copies of it with some words replaced, after them other texts that share a passage of it."""
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(many):
        own = list(words)
        for at in rng.sample(range(150), changes if i else 0):
            own[at] = f"x{rng.randrange(40)}"
        rows.append((many - i, " ".join(own)))
    return rows + [(1000 + i, " ".join([*words[:40], *(f"o{i}_{k}" for k in range(10 + i))])) for i in range(many // 2)]


@pytest.mark.parametrize("changes", [2, 4])
def test_ngram_join_compares_few_of_many_near_copies(spark, monkeypatch, changes):
    rows = near_copies(random.Random(changes), 120, changes)
    seen = []
    compared = ngram_join.compared

    def watched(pairs, held):
        seen.append(compared(pairs, held))
        return seen[-1]

    monkeypatch.setattr(ngram_join, "compared", watched)
    found = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near(rows)
    assert sum(x.count() for x in seen) < 8 * len(rows)


@pytest.mark.parametrize("parts", [1, 6])
def test_ngram_join_of_ids_that_have_several_texts(spark, parts):
    """A document links by each of its texts, however the rows lie."""
    rng, rows = random.Random(11), []
    for i in range(60):
        words = [f"b{i // 5}w{k}" for k in range(rng.choice([12, 60, 140]) if i % 5 == 0 else len(rows[-1][1].split()))]
        for _ in range(rng.choice([0, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append((i * 7 % 60, " ".join(words)))
    # texts of several groups, long and short ones, under one id; an id's other text may be equal to another's, empty or null
    rows += [(rows[k][0], rows[(k * 13 + 5) % 60][1]) for k in range(0, 60, 9)] + [(rows[0][0], None), (rows[3][0], ""), (100, rows[1][1]), (100, "no other text has this")]
    rows += [(101, None), (101, "  "), *rows[:4]]
    # documents without id: one near to others, one that two ids meet by, one that is near to none, one without words
    chain = [[f"c{k}" for k in range(100)]]
    for at in ((20, 70), (40, 90)):
        chain.append([f"changed{k}" if k in at else w for k, w in enumerate(chain[-1])])
    rows += [(201, " ".join(chain[0])), (None, " ".join(chain[1])), (200, " ".join(chain[2]))]
    rows += [(None, rows[5][1]), (None, " ".join(map(str, range(12)))), (None, None)]
    parent = list(range(len(rows)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [(t or "").lower().split()]]
    for x, y in combinations(range(len(rows)), 2):
        a, b = sets[x], sets[y]
        if rows[x][0] == rows[y][0] is not None or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
            parent[top(x)] = top(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min((x for x in (i, least.get(top(k))) if x is not None), default=None)
    assert [least[top(k)] for k, (i, _) in enumerate(rows) if i in (None, 200, 201)].count(200) == 3
    expected = Counter((i, len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, ngram_join.ngram_components(frame(spark, rows).repartition(parts)).collect())) == expected


def test_list_pairs_leave_out_leaders_that_share_too_few_lists(spark):
    # 1 and 2 share twelve lists; 3 shares one with each of them and nine with others
    lists = [(k, d, 40) for k in range(12) for d in (1, 2)] + [(0, 3, 40)] + [(50 + k, d, 40) for k in range(9) for d in (3, 4)]
    placed = spark.createDataFrame(lists, "shingle long, leader long, least int")
    of = {r.leader: r for r in ngram_join.lists_of(placed).collect()}
    assert set(of) == {1, 2, 3}
    rows = sorted((k, d, n, n, 38, d, 30, of[d].smallest, of[d].lists, *[of[d][f"bits_{i}"] for i in range(ngram_join.BITMAP)]) for k, d, n in lists if d in of)
    part = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[f"c{i}" for i in range(len(rows[0]))])
    pairs = [tuple(r.values()) for b in ngram_join._list_pairs(iter([part])) for r in b.to_pylist()]
    assert pairs == [(1, 2, 12, 10)]


@pytest.mark.parametrize("rows_of_a_batch", [1, 7, 1000])
def test_list_pairs_leave_out_whole_sets_that_share_too_few(rows_of_a_batch):
    """Of leaders that share the lists of a passage only those are paired that may link as a whole, or whose followers may."""
    rng, sets = random.Random(8), {}
    passage = list(range(12))
    for i in range(30):
        # the passage, what three of them have in common, and what a set has of its own
        own = [100 + i // 3 * 40 + k for k in range(28)] + [10_000 + 100 * i + k for k in range(rng.choice([1, 2, 12]))]
        sets[i] = np.unique(np.array([hash_of(x) for x in passage + own], np.uint64))
    ids = list(sets)
    known = pa.record_batch([pa.array(ids), pa.array([b""] * len(ids))], names=["doc_id", "text"])
    held = iter([list(sets.values())])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram_join, "shingle_sets", lambda of: next(held))
        sketches = pa.Table.from_batches(list(ngram_join._sketch_rows([known]))).to_pylist()
    folded = {r["doc_id"]: [*np.bitwise_xor.reduce([[r[w] for w in ngram_join.WORDS[k :: ngram_join.FOLDED]] for k in range(ngram_join.FOLDED)], axis=1).tolist()] for r in sketches}
    follows = {4: (25, 40)}  # a follower of 4 has so many shingles of its own
    rows = []
    for k, x in enumerate(passage):
        for i, s in sorted(sets.items(), key=lambda e: (len(e[1]), e[0])):
            own, fewest = follows.get(i, (0, len(s)))
            rows.append((x, i, len(s), len(s), len(s), i, len(s), len(s), 12, *[0] * ngram_join.BITMAP, len(s), own, fewest, *folded[i]))
    parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + rows_of_a_batch])], names=[f"c{i}" for i in range(len(rows[0]))]) for at in range(0, len(rows), rows_of_a_batch)]
    found = {r["a"]: set() for b in ngram_join._list_pairs(iter(parts)) for r in b.to_pylist()}
    pairs = [r for b in ngram_join._list_pairs(iter(parts)) for r in b.to_pylist()]
    for r in pairs:
        found[r["a"]].add(r["b"])
        assert (r["hits"], r["need"]) == (12, 10)
    assert len(pairs) == sum(map(len, found.values()))
    linked = {(a, b) for a, b in combinations(ids, 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked and all(b in found.get(a, ()) for a, b in linked)
    assert all(4 in (a, b) for a in found for b in found[a] if a // 3 != b // 3)
    assert any(a // 3 != b // 3 for a in found for b in found[a])


def hash_of(x: int) -> int:
    return int.from_bytes(hashlib.sha256(str(x).encode()).digest()[:8], "big")


def test_ngram_join_compares_few_of_many_variants(spark, monkeypatch):
    """Variants of a text that share most of it but too little to link aren't compared."""
    rng, words = random.Random(9), [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(f"x{i}_{at}" if at in changed else w for at, w in enumerate(words))) for i in range(150) for changed in [rng.sample(range(150), 4)]]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(0, 150, 10)]
    seen = []
    compared = ngram_join.compared

    def watched(pairs, held):
        seen.append(compared(pairs, held))
        return seen[-1]

    monkeypatch.setattr(ngram_join, "compared", watched)
    found = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near(rows)
    assert sum(x.count() for x in seen) < 3 * len(rows)


@pytest.mark.parametrize("few", [0, 1000])
def test_ngram_join_of_texts_that_are_mostly_frequent(spark, monkeypatch, few):
    """Prefixes that need more shingles than are stored, with all documents in the order's sample and with a part of them."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng, rows = random.Random(5), []
    passage = [f"p{k}" for k in range(400)]
    for i in range(90):
        words = [*passage, *(f"d{i // 3}x{k}" for k in range(rng.choice([20, 110])))]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"y{rng.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    found = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near(rows)


def test_stored_shingles_give_the_prefixes_of_whole_texts():
    """Each text is cut into shingles once; its stored shingles give the prefix that the whole set has, or none."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghijkl", k=rng.randint(0, 700))).encode() for _ in range(60)]
    part = pa.record_batch([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    stored = pa.Table.from_batches(list(ngram_join._set_rows([part]))).filter(pc.field("n") > 0)
    some = np.unique(np.concatenate(ngram_join.shingle_sets(pa.array(texts))))
    for frequent in (some[:0], some[::9], some[::2]):
        whole = {r["doc_id"]: [] for r in stored.to_pylist()}
        for r in pa.Table.from_batches(list(ngram_join._text_prefix_rows([part], frequent))).to_pylist():
            whole[r["doc_id"]].append((r["shingle"], r["position"]))
        rows = [b for b in stored.select(["doc_id", "n", "signature", "low"]).to_batches()]
        short = {r["doc_id"] for b in ngram_join._short_rows(rows, frequent) for r in b.to_pylist()}
        own = {i: [] for i in whole if i not in short}
        for b in ngram_join._prefix_rows(rows, frequent):
            for r in b.to_pylist():
                own[r["doc_id"]].append((r["shingle"], r["position"]))
        assert own == {i: x for i, x in whole.items() if i not in short}
        assert not short if not len(frequent) else len(short) < len(whole)


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(digits) <= 19 and sum(digits[::2]) % 10 == -sum(2 * d - 9 * (d > 4) for d in digits[1::2]) % 10:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans(spark):
    rng = random.Random(5)
    letters = [*"a1 .-+@(9é\n", "12.3.4.5", "+1 (2", "4111111111111111", "a@b.c", "@x.y", "🙂", " 4111 1111-1111 1111"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))) for i in range(800)]
    rows += [(900, "1" * 20_000 + " " + "a" * 20_000 + "@" + "b." * 9000), (901, None), (902, "")]
    df = frame(spark, rows).select("doc_id", pii.written_out(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s"))
    assert {r.doc_id: r.s for r in df.collect()} == {i: base_spans(t or "") for i, t in rows}


def test_bootstrapping_finds_what_reliable_contexts_point_to(spark):
    rows = [(i, f"please write to reach{i}@mail.example.com soon") for i in range(20)]
    rows += [(50, "please write to lost55555@mailexample soon"), (51, "other words lost66666 here"), (52, None)]
    found = {r.doc_id: (r.base, r.spans) for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert not found[50][0] and len(found[51][1]) == 0 and len(found[52][1]) == 0
    assert all(len(found[i][1]) == 1 for i in range(20))
    clean = pii.redact(frame(spark, rows))
    assert {r.text for r in clean.where("doc_id < 20").collect()} == {"please write to [EMAIL] soon"}
    assert clean.where("doc_id = 51").first().text == rows[-2][1]


def told(spans, text):
    return [(pii.KINDS[s.kind], text[s.start : s.end]) for s in spans]


def test_seeds_are_whole_and_runs_are_candidates(spark):
    rows = [(i, f"you may ring Anna +1 (017) 555-77{i:02} tonight") for i in range(20)]
    rows += [(100 + i, f"paid with visa 4111 1111 1111 {1111 + 1000 * i}; thanks") for i in range(9)]
    rows += [(200, "you may ring Anna (017) 555 7799 today"), (201, "we ring Anna 017-555-7798"), (202, "ring Anna 5 times")]
    places = pii.found_in(frame(spark, rows))
    own = pii.instances(places).where("whole").join(places.select("row", "doc_id"), "row").collect()
    by_id = {r.doc_id: r for r in own}
    assert len(own) == len(rows) and by_id[3].name == "+1 (017) 555-7703" and by_id[3].patterns == ["l:anna", "L:ring anna", "r:tonight"]
    assert by_id[100].name == "4111 1111 1111 1111" and by_id[100].patterns == ["l:visa", "L:with visa", "r:thanks"]
    found = {r.doc_id: told(r.spans, dict(rows)[r.doc_id]) for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert found[200] == [("phone", "(017) 555 7799")] and found[201] == [("phone", "017-555-7798")] and found[202] == []


UNSEEN = [
    ("email", "please write to", "reach{}@mail.example.com", "soon", ["lost55555@mailexample", "andré@mail.de"]),
    ("ip", "we saw host", "10.20.30.{}", "online", ["10.20.30.400", "10.20.31"]),
    ("card", "paid with visa", "{card}", "thanks", ["4111 1111 1111 1112", "411111111111112"]),
    ("phone", "you may ring", "+1 (017) 555-77{}", "tonight", ["017 555 7713", "(017) 555-7714"]),
]


def luhn(n):
    body = f"41111111111{n:04}"
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(body))
    return body + str(-total % 10)


def test_bootstrapping_adds_unseen_identifiers_of_each_kind(spark):
    rows, planted = [], {}
    for k, (kind, left, seed, right, unseen) in enumerate(UNSEEN):
        rows += [(1000 * k + i, f"{left} {seed.format(10 + i, card=luhn(i))} {right}") for i in range(200)]
        for j, one in enumerate(unseen):
            rows.append((1000 * k + 500 + j, f"{left} {one}, {right}"))
            planted[1000 * k + 500 + j] = [(kind, one)]
        rows.append((1000 * k + 600, f"{left} 5 {right}"))
    # a second context of phones is learned only from what the first one led to, and leads to one more
    rows += [(5000 + i, f"then dial 0170 555 78{i:02} tonight") for i in range(12)] + [(5101, "dial 0171 555 7799 tomorrow")]
    planted[5101] = [("phone", "0171 555 7799")]
    rows += [(6000, "a run with numbers 10 20 30 40 of a table"), (6001, "1 2 3 " * 2000), (6002, "9 - 9 " * 500 + "1." * 9000)]
    found = {r.doc_id: told(r.spans, dict(rows)[r.doc_id]) for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert {i: found[i] for i in planted} == planted
    assert all(not found[1000 * k + 600] for k in range(4)) and not found[6000] and not found[6001]


def test_warc_round_trip(spark, monkeypatch):
    big = "<p>" + "same " * 400
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "", big + "é")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    back = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, shared_dir(spark, "warc"))).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (back[i].payload_bytes, back[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (back[i].record_type, back[i].refers_to) == (("revisit", 2) if i == 1 else ("response", None))
        assert back[i].payload is None if i == 1 else bytes(back[i].payload) == data
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10)
    manifest = warc.write_archives(pages, shared_dir(spark, "warc"))
    # a read task per archive, and no path without its file system
    assert manifest.count() > 1 and warc.read_archives(manifest).rdd.getNumPartitions() == manifest.count()
    assert all(r.archive.startswith("file:") for r in manifest.collect())
    empty = warc.read_archives(warc.write_archives(pages.limit(0), shared_dir(spark, "warc")))
    assert empty.count() == 0


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice((-1, -0.5, 0, 0.3, 1)) * rng.random() for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.25] * 8) for i in range(300, 340)]
    odd = [(400, None), (401, []), (402, [None] * 8), (403, [float("nan")] * 8), (404, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, rank int")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert [found[q, k] for k in range(1, 6)] == [(i, -s) for s, i in best]
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = written(stage(spark, docs, sf), name)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(before)
            break
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        sizes.append(len(after))
        assert docs.columns == columns and set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {c for _, c in near(before.items()).values()}
        if name == "substrings":
            expected = removal(before.items())
            digest = {i: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in after.items()}
            assert digest == {i: x[2] for i, x in expected.items()}
        if name == "pii":
            assert all(not base_spans(after[i]) and (after[i] == t or base_spans(t)) for i, t in before.items())
    assert sizes[0] > sizes[1] == sizes[2] == sizes[3] > 0
