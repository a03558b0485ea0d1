"""Fingerprints, the Merkle manifest and the trie of prefixes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.llm import fingerprint, manifest, prefix_trie, queries

CLASHING = ("part", "kind", "mixed", "rank", "tree", "leaves", "tag", "prefix", "hash", "tampered", "family", "array", "element", "depth", "side", "text_", "meta.url")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def clashing(df, n=5):
    return df.repartition(n).withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns}).withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))


# ---------------------------------------------------------------- fingerprints


def plain_fingerprint(text: str) -> bytes:
    """One paragraph after another."""
    exact, sketch = [0] * fingerprint.EXACT, np.zeros(fingerprint.LANES, np.int64)
    for p in text.split("\n") if text else []:
        d = hashlib.blake2b(p.encode()).digest()
        exact = [(x + int.from_bytes(d[8 * i : 8 * i + 8], "little")) % 2**64 for i, x in enumerate(exact)]
        sketch = sketch + fingerprint.vectors([[p]])[1][0].astype(np.int64)
    return b"".join(x.to_bytes(8, "little") for x in exact) + (sketch % 2**16).astype("<u2").tobytes()


def plain_edits(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(ordered):
        t, following = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        own, changed, after = map(plain_fingerprint, (t, e, following))
        like = lambda a, b: float(fingerprint.likeness(fingerprint.unpack([a])[1], fingerprint.unpack([b])[1])[0])
        out.append((d, len(t), sha(e), own, changed, like(own, changed), like(own, after)))
    return out


def messy_texts():
    r = random.Random(11)
    words = ["alpha", "béta", "c", "dd", "\t", "eée"]
    texts = [None, "", "\n", "\n\n", "a", "abcdefgh", "x" * 700, " ", "long line " * 3000] + ["\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 6))) for _ in range(70)]
    return list(zip(r.sample(range(-500, 500), len(texts) - 1), texts, strict=False)) + [(None, "nobody's text here")]


@pytest.mark.parametrize("shuffles", ["1", "4", "40"])
def test_fingerprints_of_edited_texts(spark, shuffles):
    rows = messy_texts()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        got = fingerprint.edited_fingerprints(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r[0], r[1], r[2], bytes(r[3]), bytes(r[4]), r[5], r[6]) for r in got), key=str) == sorted(plain_edits(rows), key=str)


def test_fingerprints_of_ties_single_rows_and_none(spark):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(1, "a b c d")] * 3 + [(1, "other words stand here"), (1, None)], schema)
    got = fingerprint.edited_fingerprints(same).collect()
    assert len(got) == 5 and len({(r.n_chars, bytes(r.fingerprint)) for r in got}) == 3
    (one,) = fingerprint.edited_fingerprints(same.limit(1)).collect()
    assert (one.edited_sha256, one.near_next) == (sha("a b c a"), 1.0)
    assert fingerprint.edited_fingerprints(same.where("doc_id = 9")).collect() == []


def test_paragraphs_in_any_order_put_in_and_taken_out():
    r = random.Random(2)
    own = ["one line of text", "", "x", "one line of text", "the last"]
    make = lambda ps: fingerprint.pack(*fingerprint.vectors([ps]))[0]
    for _ in range(5):
        assert make(r.sample(own, len(own))) == make(own)
    assert make(own) != make(own[1:]) and make(["ab", "c"]) != make(["a", "bc"])
    assert fingerprint.changed(make(own), ["new", ""], ["x", "the last"]) == make(["one line of text", "", "one line of text", "new", ""])
    assert make([]) == bytes(8 * fingerprint.EXACT + 2 * fingerprint.LANES)


def test_likeness_estimates_shared_shingles():
    r = random.Random(5)
    errors = []
    for _ in range(60):
        a = [str(r.random()) for _ in range(300)]
        b = a[: r.randint(0, 300)]
        b = b + [str(r.random()) for _ in range(300 - len(b))]
        grams = [Counter(zip(x, x[1:], x[2:], strict=False)) for x in (a, b)]
        exact = 1 - sum((grams[0] - grams[1]).values()) / sum(grams[0].values())
        found = fingerprint.likeness(*(fingerprint.vectors([[" ".join(x)]])[1] for x in (a, b)))[0]
        errors.append(found - exact)
    assert np.sqrt(np.mean(np.square(errors))) < 0.06


def test_registered_fingerprints(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.QUERIES["op11_fingerprint"](spark, data).collect()
    expected = [(d, n, e, a.hex(), b.hex(), x, y) for d, n, e, a, b, x, y in plain_edits(docs)]
    assert sorted(map(tuple, got)) == sorted(expected)
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.65
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


# ---------------------------------------------------------------- manifest


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(frame, (r[0], r[3], r[2], r[4], t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: plain_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in names}
    top, out = plain_tree([trees[k][-1][0] for k in names]), []
    for place, k in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            again, proof = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if changed else own, ""
            for tree, at in ((trees[k], i), (top, place)):
                for level in tree[:-1]:
                    run = at - at % 8
                    before, after = "".join(level[run:at]), "".join(level[at + 1 : run + 8])
                    proof, again, at = proof + before + after, sha(before + again + after), at // 8
            out.append((r[0], own, trees[k][-1][0], top[-1][0], sha(proof), again, again == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", ["dense", "sparse", "strided", "one", "many"])
def test_manifest(spark, ids):
    r = random.Random(3)
    ids = {"dense": [*range(300), None, None, 3, 3], "sparse": [r.randint(-(2**63), 2**63 - 1) for _ in range(200)] + [-(2**63), 2**63 - 1], "strided": [5000 * i - 70_000 for i in range(40)], "one": [7], "many": [*range(5000), 2**62, None]}[ids]
    langs = [None, "de", "en", "", "zz", "é", *(f"l{i}" for i in range(5))] if len(ids) < 1000 else ["en"]
    rows = [(i, r.choice([None, "", "Ab C é", "x" * 40, "É"]), r.choice(langs), r.choice([None, "s"]), r.choice([None, 5])) for i in ids]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    found = manifest.manifest(df, tamper=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == plain_manifest(rows)


def test_manifest_of_no_rows_and_untampered(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert manifest.manifest(docs.where("doc_id = -7")).collect() == []
    assert manifest.manifest(docs).where("not verified").count() == 0


def test_manifest_of_a_very_long_text(spark):
    rows = [(3, "Long Text " * 150_000, "en", "s", 1_500_000), (1, "a", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, manifest.manifest(df, tamper=F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect())) == plain_manifest(rows)


# ---------------------------------------------------------------- trie of prefixes


def plain_trie(rebuilt):
    nodes, children = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = own + sum(saved[x] for x in children.get(k, []))
        leaves[k] = sum(leaves[x] for x in children.get(k, [])) or 1
        ends = [c for c in sorted(nodes[k]) if len(rebuilt[c]) == len(k)]
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(children.get(k, [])), leaves[k], saved[k], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("shuffles", ["1", "4", "23"])
def test_trie(spark, shuffles):
    r = random.Random(int(shuffles))
    rows = [(c, r.choice([None, *range(6)]), r.choice(["user", "assistant", None, ""]), r.choice([None, "", "a b", "é\tx  y"])) for c in (r.randint(-60, 400) for _ in range(250)) for _ in range(r.randint(1, 6))]
    rows += [(c, 0, "user", "the same") for c in range(1000, 1150)] + [(c, t, "user", f"turn {t}") for c in (2000, 2001, 2021) for t in range(200)] + [(None, 0, "user", "x"), (3000, 0, "user", "word " * 200_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str) == plain_trie(plain_rebuilt(rows))
        assert prefix_trie.prefix_trie(df.where("conv_id = 99999")).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sweeps_of_any_ranges_stitch_to_one_trie(monkeypatch):
    """Ranges cut anywhere, also inside a group of equal arrays; ids packed in small pieces."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 48)
    monkeypatch.setattr(prefix_trie, "HELD", 2)
    r = random.Random(8)
    for _ in range(150):
        rebuilt = {c: [("", r.choice(["a", "b b", "c c c"])) for _ in range(r.choice([0, 1, 2, 3, 3, 6]))] for c in range(r.randint(1, 40))}
        code = lambda turns: b"".join(hashlib.sha256(x.encode()).digest() + len(x.split()).to_bytes(4, "big") for _, x in turns)
        ordered = sorted((code(v), c) for c, v in rebuilt.items())
        cuts = sorted(r.choices(range(len(ordered) + 1), k=r.randint(0, 6)))
        ranges = [ordered[a:b] for a, b in zip([0, *cuts], [*cuts, len(ordered)], strict=True)]
        swept = [(kind, part, *rest) for part, own in enumerate(ranges) for kind, *rest in prefix_trie.Sweep().rows(own)]
        parts = [(k, p, depth, conv, n, children, leaves, saved, ends, data) for k, p, _, depth, conv, _, n, children, leaves, saved, ends, data in swept if k != prefix_trie.CLOSED]
        stitched = list(prefix_trie.Stitch().rows(parts))
        above = {(p, side, depth): conv for p, side, conv, depth, *_ in stitched if p is not None}
        found = [x[2:] for x in stitched if x[0] is None]
        for k, p, side, depth, conv, parent, n, children, leaves, saved, ends, _ in swept:
            if k == prefix_trie.CLOSED:
                found.append((conv, depth, parent if side is None else above[p, side, depth - 1], n, children, leaves, saved, ends or prefix_trie.NOTHING))
        assert sorted(found, key=str) == plain_trie(rebuilt)
