"""Operators on documents against plain Python, on small texts full of ties, repeats, nulls and long runs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.llm import debruijn_dedup, decontaminate, jaccard_join, mixture, suffix_dedup

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CODE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def messy(spark, rows, schema=SCHEMA):
    """The rows over several partitions, with extra columns whose names clash with internal ones."""
    df = spark.createDataFrame(rows, schema).repartition(5)
    return df.withColumns({c: F.lit(1) for c in ("doc", "body", "keys", "sig", "rep", "bucket", "size", "rank", "copy", "row")})


# ---------------------------------------------------------------- repeated bytes and words


def brute_bytes(rows, n):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            if d is not None:
                least[b[i : i + n]] = min(d, least.get(b[i : i + n], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if d is not None and least[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def found_bytes(df, n):
    out = suffix_dedup.remove_repeated_bytes(df, n)
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")), F.size("spans"), F.sha2("kept", 256)).collect()), key=str)


def byte_rows():
    r = random.Random(1)
    base = ["".join(r.choice("ab c") for _ in range(r.randint(0, 200))) for _ in range(12)]
    rows = [(i, None if i % 17 == 3 else "".join(r.choice(base)[: r.randint(0, 150)] for _ in range(r.randint(0, 4))) + "é" * r.randint(0, 90)) for i in range(60)]
    rows += [(5000 - i, "x" * 60 + "y" * i) for i in range(70)] + [(100 + i, rows[i][1]) for i in range(20)]
    return rows + [(7, rows[7][1]), (None, rows[8][1]), (None, None), (9000, ""), (-4, rows[9][1])]


@pytest.mark.parametrize("n", [50, 9])
def test_repeated_bytes(spark, n):
    rows = byte_rows()
    assert found_bytes(messy(spark, rows), n) == brute_bytes(rows, n)


def test_repeated_bytes_of_an_empty_table(spark):
    assert found_bytes(messy(spark, byte_rows()).where("doc_id = 123456"), 50) == []


def test_radix_groups_are_the_repeated_windows():
    import numpy as np

    r = random.Random(5)
    data = np.array([r.randint(97, 99) for _ in range(2000)], np.uint8)
    starts = np.arange(len(data) - 13)
    order, first = suffix_dedup.radix_groups(data, starts, 13)
    groups = {tuple(sorted(order[a:b].tolist())) for a, b in zip(first, [*first[1:], len(order)])}
    expected = {}
    for i in starts.tolist():
        expected.setdefault(data[i : i + 13].tobytes(), []).append(i)
    assert groups == {tuple(v) for v in expected.values() if len(v) > 1}


def brute_words(rows, n):
    least, words = {}, [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and least[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def word_rows():
    r = random.Random(1)
    base = [" ".join(r.choice(["a", "b", "c", "é", "ddd"]) for _ in range(r.randint(0, 60))) for _ in range(12)]
    rows = [(i, None if i % 17 == 3 else "\t\n".join(" ".join(r.choice(base).split(" ")[: r.randint(0, 50)]) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(5000 - i, " ".join(["x"] * 20 + ["y"] * i)) for i in range(40)] + [(100 + i, rows[i][1]) for i in range(20)]
    return rows + [(7, rows[7][1]), (None, rows[8][1]), (None, None), (9000, " \n"), (-4, rows[9][1])]


@pytest.mark.parametrize("n", [13, 4])
def test_repeated_words(spark, n):
    rows = word_rows()
    out = debruijn_dedup.remove_repeated_words(messy(spark, rows), n).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect()), key=str) == brute_words(rows, n)


def test_repeated_words_carry_columns_and_leave_whole_texts_alone(spark):
    text = "  two  blanks\nstay "
    df = spark.createDataFrame([(1, text, "de"), (2, " ".join("abcdefghijklmnop") + " x", None), (3, " ".join("abcdefghijklmnop"), "fr"), (None, text, "es")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept, r.lang) for r in debruijn_dedup.remove_repeated_words(df, as_is=True, carry=("lang",)).collect()}
    assert got == {1: (text, "de"), 2: (" ".join("abcdefghijklmnop") + " x", None), 3: ("", "fr"), None: (text, "es")}


def test_repeated_words_of_an_empty_table(spark):
    assert debruijn_dedup.remove_repeated_words(messy(spark, word_rows()).where("doc_id = 123456")).collect() == []


# ---------------------------------------------------------------- near duplicates


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (o := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - o):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d), links[d]) for d, _ in rows)


def near_rows():
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(0, 160))] for _ in range(10)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            if w:
                w[r.randrange(len(w))] = r.choice(words)
        rows.append((i * 3 if i % 50 else 1000 + i, None if i % 41 == 0 else " ".join(x.upper() if r.random() < 0.1 else x for x in w[: r.choice([3, 999, 999, 150])])))
    return rows


@pytest.mark.parametrize(("tile", "rare"), [(1024, 16), (16, 3), (16, 0), (1024, 1000)])
def test_near_duplicates(spark, monkeypatch, tile, rare):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    rows = near_rows()
    rows.append(rows[5])
    got = jaccard_join.jaccard_components(messy(spark, rows)).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_near_duplicates_without_ids_or_rows(spark):
    df = messy(spark, [(None, "a b c d e f"), (None, None), (3, "a b c d e f")])
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)
    assert got == [(3, 2, 3, 0), (None, 0, None, 0), (None, 2, None, 0)]
    assert jaccard_join.jaccard_components(df.where("doc_id = 99")).collect() == []


def test_chains_of_shared_passages_stay_pairs(spark):
    """Each text is two passages, and shares each with one neighbour: connected all through, but nowhere near alike."""
    passage = lambda i: " ".join(f"p{i}w{j}" for j in range(30))
    rows = [(i, f"{passage(i)} {passage(i + 1)}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    made = []
    keep = jaccard_join.written
    try:
        jaccard_join.written = lambda t, name: made.append((name, w := keep(t, name))) or w
        got = jaccard_join.jaccard_components(df)
        assert got.where("component_id <> doc_id or n_links > 0").count() == 0
    finally:
        jaccard_join.written = keep
    tables = dict(made)
    assert tables["prefixes"].count() > 2900
    assert tables["bands"].count() == 0


def test_longer_prefixes_need_more_matches():
    import numpy as np

    assert jaccard_join.matches_for(np.array([2, 2, 2, 2]), 3) >= 1
    common_first = jaccard_join.matches_for(np.array([1000] * 10 + [1001] * 10), 15)
    assert common_first > 1


# ---------------------------------------------------------------- decontamination


def brute_contamination(docs, bench, n):
    windows = {}
    for i, t in bench:
        w = CODE.findall((t or "").translate(ASCII_LOWER))
        for k in range(max(1, len(w) - n + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = CODE.findall((t or "").translate(ASCII_LOWER))
        hit, items = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    items |= x
                    hit[k : k + size] = [1] * size
        out.append((i, len(w), sum(hit), tuple(sorted(items))))
    return sorted(out, key=str)


def contamination_rows():
    r = random.Random(3)
    words = ["a", "b", "c", "dé", "f"]
    bench = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 10, 14, 25])))) for i in range(2, 25)] + [(None, "x y"), (99, None), (98, ""), (2, "a b")]
    docs = [(i, None if i == 5 else " ".join((r.choice(bench)[1] or "").upper() if r.random() < 0.4 else r.choice(["a", "b,", "c-dé", "f", "q", "z"]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    return docs + [docs[8], (None, docs[9][1])], bench


@pytest.mark.parametrize("n", [10, 3])
@pytest.mark.parametrize("most", [1 << 18, 3])
def test_contamination(spark, n, most):
    docs, bench = contamination_rows()
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contamination(messy(spark, docs), items, n, broadcast_windows=most)
    assert sorted(((r[0], r[1], r[2], tuple(r[3])) for r in found.collect()), key=str) == brute_contamination(docs, bench, n)
    clean = decontaminate.without_contaminated(messy(spark, docs), items, n, broadcast_windows=most)
    kept = {d for d, _, hit, _ in brute_contamination(docs, bench, n) if not hit and d is not None}
    assert {r.doc_id for r in clean.collect() if r.doc_id is not None} == kept


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_rows_are_judged_by_their_own_text(spark, most):
    """Also rows without an id, and clean rows with the id of a contaminated one."""
    docs, bench = contamination_rows()
    docs = [*docs, *((None, t) for _, t in docs[:20]), (None, None), *((8, t) for _, t in docs[20:40])]
    kept = [i for i, d in enumerate(docs) if not brute_contamination([d], bench, 3)[0][2]]
    assert {docs[i][0] is None for i in kept} == {True, False} and any(docs[i][0] is None for i in set(range(len(docs))) - set(kept))
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, row long").repartition(5)
    clean = decontaminate.without_contaminated(df, spark.createDataFrame(bench, "item_id long, text string"), 3, broadcast_windows=most)
    assert clean.columns == df.columns
    assert sorted(map(tuple, clean.collect()), key=lambda r: r[2]) == [(*docs[i], i) for i in kept]


def test_words_are_compared_after_the_join():
    places = [{"begin": 0, "window": b"a b", "items": [4]}, {"begin": 1, "window": b"b x", "items": [5]}, {"begin": 2, "window": b"c d", "items": [6]}, {"begin": -1, "window": b"a", "items": [7]}]
    assert decontaminate.verified(b"a b c", [0, 2, 4], [1, 3, 5], places) == (2, [4])
    assert decontaminate.verified(b"", [], [], None) == (0, [])


def test_contamination_of_and_by_empty_tables(spark):
    docs, bench = contamination_rows()
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.contamination(messy(spark, docs).where("doc_id = 777"), items).collect() == []
    assert {r.n_hit for r in decontaminate.contamination(messy(spark, docs), items.where("item_id = 777")).collect()} == {0}


# ---------------------------------------------------------------- mixing


def brute_targets(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    out, free, rest = {}, set(order), sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not full:
            return out | share
        for s in full:
            out[s] = 3 * sizes[s]
            rest -= out[s]
            free.discard(s)
    return out


def check_mix(df):
    source = {r.doc_id: r.source for r in df.collect()}
    rows = mixture.mix(df).taken.collect()
    sizes, taken = {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    expected = brute_targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(expected[s])
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 1
    return sorted(map(tuple, rows), key=str)


def test_mix(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert check_mix(docs) == check_mix(docs.repartition(7))


def test_mix_of_tiny_and_missing_sources(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, " ", "y"), (4, "w " * 500, None), (5, "q " * 100, "a"), (6, "z", "b"), (None, "t u", "b")]
    df = messy(spark, rows, "doc_id long, text string, source string")
    check_mix(df)
    assert mixture.mix(df.where("doc_id = 99")).taken.collect() == []
    assert {r.taken for r in mixture.mix(df.where("doc_id = 3")).taken.collect()} == {0}


def test_slots_of_a_source_fill_its_target_to_the_word():
    for size in (1, 5, 63, 64, 65, 640, 1000):
        for target in range(1, 3 * size + 1, 1 if size < 100 else 37):
            need = mixture.needed(size, target, 64)
            assert 0 <= need.part <= need.places <= need.blocks
            full = 64 * (need.part - 1) if need.part else 0
            assert need.epochs * size + full + (need.last if need.part else 0) == target
            assert need.part == 0 or 0 < need.last <= 64


def test_permutations():
    for n in (1, 2, 5, 64, 1000, 5000):
        p = mixture.Permutation(n, 7, 1)
        there = p.indices(np.arange(n))
        assert sorted(there.tolist()) == list(range(n))
        assert p.places(there).tolist() == list(range(n))
    assert mixture.Permutation(1000, 7, 1).indices(np.arange(1000)).tolist() != mixture.Permutation(1000, 7, 2).indices(np.arange(1000)).tolist()


def test_counts_of_a_shard_are_multinomial():
    left = np.array([160_000, 160_000, 80_000])
    draws = np.array([mixture.drawn(400, left, mixture.generator(1, k)) for k in range(2000)])
    assert (draws.sum(axis=1) == 400).all()
    assert np.abs(draws.mean(axis=0) - [160, 160, 80]).max() < 2
    assert np.abs(draws.var(axis=0) - [96, 96, 64]).max() < 12
    assert mixture.drawn(7, np.array([1, 4, 0, 2]), mixture.generator(3)).tolist() == [1, 4, 0, 2]


def test_the_mix_holds_the_words_that_documents_give(spark):
    """Every word tells its document and place: what shards hold is what was taken, each block of an epoch once."""
    r = random.Random(11)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(r.choice([0, 1, 7, 64, 150, 1500]))), r.choice(["a", "b", "b", "b", None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    made = mixture.mix(docs, shard_words=700)
    shards = mixture.mixed_text(docs, made).collect()
    given, word_source = {}, {i: s for i, _, s in rows}
    for row in shards:
        for w in row.words.split(" "):
            given[w] = given.get(w, 0) + 1
    taken = {x.doc_id: x for x in made.taken.collect()}
    for i, text, _ in rows:
        assert sum(given.get(w, 0) for w in text.split()) == taken[i].taken
        assert all(given.get(w, 0) <= 3 for w in text.split())
    for s in ("a", "b", None):
        own = [x for i, x in taken.items() if word_source[i] == s]
        assert sum(x.taken for x in own) == int(own[0].target)
    assert len({(x.shard, x.slot, x.rank) for x in shards}) == len(shards)
    assert len({x.shard for x in shards}) > 5


def test_draws_decide_what_is_taken_and_targets_hold(spark, data):
    """Another seed or another size of shards takes other words of the same targets; the same draw the same ones."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    taken = lambda **how: {x.doc_id: (x.target, x.taken) for x in mixture.mix(docs, **how).taken.collect()}
    one, again, smaller, other = taken(), taken(), taken(shard_words=500), taken(seed=21)
    assert one == again
    source = {x.doc_id: x.source for x in docs.collect()}
    for x in (smaller, other):
        assert x != one and {d: t for d, (t, _) in x.items()} == {d: t for d, (t, _) in one.items()}
        for s in set(source.values()):
            own = [v for d, v in x.items() if source[d] == s]
            assert sum(n for _, n in own) == int(own[0][0])


def test_slots_by_hand(spark):
    """The ranges, shards and slots against a plain walk: every whole epoch has each block once, the last one none twice."""
    rows = [(i, "w " * (37 * i % 900), "abc"[i % 3]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    made = mixture.mix(docs, shard_words=300)
    slots = made.slots.collect()
    per_shard = {}
    for x in slots:
        per_shard[x.shard] = per_shard.get(x.shard, 0) + 1
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) > 64
    by_epoch = {}
    for x in slots:
        by_epoch.setdefault((x.rank, x.epoch), []).append(x["index"])
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for (rank, epoch), index in by_epoch.items():
        blocks = -(-sizes["abc"[rank]] // 64)
        assert len(set(index)) == len(index)
        last = epoch == max(e for r, e in by_epoch if r == rank)
        assert last or sorted(index) == list(range(blocks))
    assert len({x.rank for x in slots}) == 3


# ---------------------------------------------------------------- ids that repeat with other texts, and very long texts


def test_ids_that_repeat_with_another_text(spark):
    """Each row is judged by its own text; none is lost or measured by another's."""
    span = " ".join(f"word{i}" for i in range(30))
    rows = [(1, f"{span} tail one"), (2, f"x {span} y"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g"), (3, None), (4, "q r s"), (None, span)]
    df = messy(spark, rows)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in debruijn_dedup.remove_repeated_words(df, 5).collect()), key=str)
    assert got == sorted([(1, 32, 0, f"{span} tail one"), (2, 32, 30, "x y"), (2, 7, 0, "a b c d e f g"), (2, 7, 0, "a b c d e f g"), (3, 7, 7, ""), (3, 0, 0, ""), (4, 3, 0, "q r s"), (None, 30, 0, span)], key=str)
    bytes_kept = sorted(((r.doc_id, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeated_bytes(df, 12).collect()), key=str)
    assert (2, "a b c d e f g") in bytes_kept and (3, "") in bytes_kept and (1, f"{span} tail one") in bytes_kept
    assert len(bytes_kept) == len(rows) and all(t in ("x y", "x  y") or "word" not in t for d, t in bytes_kept if d == 2)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect() if r.doc_id is not None)
    assert found == [(1, 28, 1), (2, 3, 2), (2, 3, 2), (2, 28, 2) if (2, 28, 2) in found else (2, 28, 1), (3, 0, 3), (3, 3, 2), (4, 1, 4)]


@pytest.mark.parametrize("unit", ["long words of one text ", "x", "é "])
def test_very_long_texts(spark, unit):
    """A single text of more than a megabyte, its copy, and a short one."""
    text = "".join(f"{unit}{i % 997}" for i in range(1_200_000 // len(unit.encode())))
    rows = [(1, text), (2, text), (3, "a short one"), (4, text[:400])]
    df = messy(spark, rows)
    words = {r.doc_id: (r.n_words, r.n_removed) for r in debruijn_dedup.remove_repeated_words(df).collect()}
    n = len(WORD.findall(text))
    assert words[1] == (n, 0) and words[2][0] == n
    assert words[2][1] == (n if n >= 13 else 0)
    kept = {r.doc_id: len(r.kept) for r in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert kept[2] == 0 and kept[1] == len(text.encode()) and kept[3] == 11 and kept[4] == 0
    joined = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert joined[2] == 1 and joined[3] == 3
    item = " ".join(CODE.findall(text)[-10:]).translate(ASCII_LOWER)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for most in (1 << 18, 0):
        hit = {r.doc_id: list(r.items) for r in decontaminate.contamination(df, bench, broadcast_windows=most).collect()}
        assert hit[1] == hit[2] == [7] and hit[3] == []
    mixed = {r.doc_id: r.taken for r in mixture.mix(df.withColumn("source", F.lit("s"))).taken.collect()}
    assert sum(mixed.values()) == 2 * n + 3 + len(WORD.findall(text[:400]))
