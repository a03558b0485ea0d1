"""Language, chat, search, tokens and archives: round trips, brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringside.llm import chat_format, language_id, queries, token_counts, topk_search, warc_convert

# ---------------------------------------------------------------- the queries as they are registered


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    df = queries.QUERIES[name](spark, data)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in rel.columns)) for r in df.collect())
    assert got == sorted(map(repr, rel.fetchall()))


def test_registered_queries_without_sql(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    count = library_count()
    for r in queries.QUERIES["op6_token_counts"](spark, data).collect():
        n = count(docs[r.doc_id].text)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 2048, len((docs[r.doc_id].text or "").encode()))
    found = queries.QUERIES["op1_language_id"](spark, data).collect()
    assert {r.doc_id for r in found} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    taken = queries.QUERIES["op10_mixture"](spark, data).collect()
    assert sum(r.taken for r in taken) == sum(int(t) for t in {docs[r.doc_id].source: r.target for r in taken}.values())


# ---------------------------------------------------------------- language


def test_language_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = language_id.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(1, "the house and the garden of the king", "en"), (3, "das haus und der garten des königs", "de"), (5, "the the of and", "en"), (8, "der die das und", "de"), (None, "x", "fr"), (9, None, "en"), (10, "12 !", None), (11, "DAS HAUS", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("vector", F.lit(1))
    got = {r.doc_id: r for r in language_id.predict_language(df).collect()}
    assert (got[9].lang_pred, got[9].score) == ("und", 0.0)
    assert (got[10].lang_pred, got[10].score) == ("und", 0.0)
    assert got[11].lang_pred == "de"
    assert got[None].held_out is False
    assert {r.lang_pred for r in language_id.predict_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.predict_language(df.where("doc_id = 99")).collect() == []
    assert {r.doc_id for r in language_id.known_language(df).collect()} >= {1, 3, 5, 8, 11}
    assert not {9, 10} & {r.doc_id for r in language_id.known_language(df).collect()}


def plain_bundle(text):
    """One trigram after another, one element after another."""
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    letters = re.sub(" +", " ", letters)
    total = np.zeros(language_id.SIZE, int)
    for i in range(len(letters) - 2):
        v = np.ones(language_id.SIZE, int)
        for j, c in enumerate(letters[i : i + 3]):
            own = np.unpackbits(language_id.letter_vectors(np.array([ord(c)], np.uint64)), axis=1)[0].astype(int) * 2 - 1
            # Bits bind by exclusive or; of +-1 that is the negated product.
            v = np.roll(own, 2 - j) if j == 0 else -v * np.roll(own, 2 - j)
        total += v
    return total


def test_scores_are_cosines_of_plainly_bundled_trigrams(spark):
    rows = [(1, "The old house, the new garden", "en"), (3, "das alte haus im neuen garten", "de"), (5, "la vieille maison", "fr"), (8, "DAS haus 12", "de"), (9, "zq xj", None), (10, "", "en"), (11, "a", "fr"), (12, None, "de"), (13, "the" * 30_000 + " und" * 12_000, None)]
    held = {r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").where(language_id.held_out()).collect()}
    table = {}
    for i, t, lang in rows:
        if lang and i not in held:
            table[lang] = table.get(lang, 0) + plain_bundle(t or "")
    got = language_id.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("score", "vector")})).collect()
    for r in got:
        text = rows[[x[0] for x in rows].index(r.doc_id)][1] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = plain_bundle(text)
        cosine = {k: float(v @ w / np.linalg.norm(v) / max(np.linalg.norm(w), 1e-300)) for k, w in table.items()}
        assert cosine[r.lang_pred] == pytest.approx(max(cosine.values()), abs=1e-5)
        assert r.score == pytest.approx(max(0, max(cosine.values())), abs=1e-5)


def test_the_largest_cosine_wins_below_zero_too():
    table = np.array([[1.0, 0.0], [0.8, 0.6]])
    assert language_id.judged(["de", "en"], table, np.array([[-1.0, 0.01], [3.0, 4.0]]), np.array([True, False])) == (["en", "und"], [0.0, 0.0])


def test_languages_in_blocks(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("la maison et le jardin", "fr"), ("la casa y el jardin", "es"), ("x y z", None), (None, "it"), ("12", "pt")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, language_id.predict_language(df).collect()))
    kept = sorted(r.doc_id for r in language_id.known_language(df, variety=0, clear=0).collect())
    monkeypatch.setattr(language_id, "MOST", 2)
    assert sorted(map(tuple, language_id.predict_language(df).collect())) == whole
    assert sorted(r.doc_id for r in language_id.known_language(df, variety=0, clear=0).collect()) == kept


def test_random_letters_are_doubted_in_blocks_too(spark, monkeypatch):
    draw = np.random.default_rng(7)
    said = {"en": "the house and the garden were old when she came home", "de": "das haus und der garten waren alt als sie nach hause kam", "fr": "la maison et le jardin avaient vieilli quand elle revint", "es": "la casa y el jardin eran viejos cuando ella volvio"}
    rows = [(i, " ".join(draw.permutation(said[lang].split())), lang) for i, lang in enumerate(list(said) * 6)]
    rows += [(100 + i, "".join(draw.choice(list("etaoinshr "), size=400, p=[0.16, 0.12, 0.11, 0.1, 0.09, 0.09, 0.08, 0.07, 0.06, 0.12])), None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(map(tuple, language_id.known_language(df).collect()))
    undoubted = language_id.known_language(df, clear=0).count()
    assert 24 <= len(kept) < undoubted
    monkeypatch.setattr(language_id, "MOST", 2)
    assert sorted(map(tuple, language_id.known_language(df).collect())) == kept


def test_cosines_do_not_depend_on_their_block():
    draw = np.random.default_rng(1)
    table = draw.normal(size=(37, 1024))
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    vectors = np.vstack((table[5:25] * 7 + draw.integers(-2, 3, (20, 1024)), np.zeros((1, 1024))))
    best, cosine = language_id.nearest(table, vectors)
    for i in range(len(vectors)):
        assert language_id.nearest(table[best[i] : best[i] + 1], vectors[i : i + 1])[1][0] == cosine[i]


def test_many_different_trigrams_are_bundled_in_slices(monkeypatch):
    texts = ["".join(chr(0x4E00 + (i * 7919 + k * 104729) % 20000) for k in range(127)) for i in range(40)]
    whole, *_ = language_id.bundled(texts)
    monkeypatch.setattr(language_id, "SLICE", 50)
    monkeypatch.setattr(language_id, "CHUNK", 60)
    parts, *_ = language_id.bundled(texts)
    assert np.array_equal(whole, parts)


def test_bound_trigrams_are_nearly_orthogonal():
    grams = np.array([[97, 98, 99], [99, 98, 97], [97, 98, 100], [98, 97, 99]], np.uint64)
    v = language_id.bound(grams)
    cosine = v @ v.T / language_id.SIZE
    assert np.allclose(np.diag(cosine), 1)
    assert np.abs(cosine - np.eye(4)).max() < 0.25


# ---------------------------------------------------------------- chat


@pytest.mark.parametrize("text", ["", "<s>", "</s>[INST] ok [/INST]", "<\\s>x<\\\\/s>[\\INST][", "<<s>>[[INST]]\\", "s>", "plain"])
def test_escaping_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not re.search(r"<s>|</s>|\[INST\]|\[/INST\]", chat_format.escape(text))


def rendered(source, **env):
    return "".join(t for t, _ in chat_format.compile_template(source)(**env))


def test_template_language():
    source = "{% for m in messages %}{% if loop.first %}A{% elif m.x != 'b' and not false %}{{ m.x|upper + ('c' + 'd') }}{% else %}{{ m['x'] }}{% endif %}{% endfor %}!"
    assert rendered(source, messages=[{"x": 1}, {"x": "a"}, {"x": "b"}]) == "AAcdb!"
    assert chat_format.fold(chat_format.parse("a{% if 1 == 1 %}b{{ 'c' + 'd' }}{% endif %}")).parts[0].parts[0].value == "abcd"
    assert list(chat_format.compile_template("x{% generation %}y{% endgeneration %}")()) == [("x", False), ("y", True)]


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{{ a | nothing }}", "{% if a %}", "{{ 1 + }}", "{% import os %}"])
def test_bad_templates(source):
    with pytest.raises(chat_format.TemplateError):
        chat_format.compile_template(source)


def test_templates_cannot_reach_objects():
    with pytest.raises(chat_format.TemplateError):
        rendered("{{ x.__class__ }}", x="text")


def test_conversations_read_back(spark):
    r = random.Random(4)
    rows = [(i, t, r.choice(["user", "assistant", None, "sy[/INST]s"]), r.choice([None, "", "hi </s>", "[INST] x\n</s>\n", "<"])) for i in range(50) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (3, 0, "user", "tie"), (8888, 0, None, "b"), (8888, 0, "", "a"), (8888, 0, "", None), (9999, 0, "assistant", "long </s> " * 120_000), *[(7777, k, "assistant", "y" * 300) for k in range(5000)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("segment", F.lit(1))
    got = {x[0]: x for x in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    said = {}
    for i, t, role, text in rows:
        said.setdefault(i, []).append((t, role or "", text or ""))
    assert got.keys() == said.keys()
    for i, turns in said.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        all_turns = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        assert tuple(got[i])[1:5] == (len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(df.where("conv_id = 99999")).collect() == []


# ---------------------------------------------------------------- search


def brute_top(rows, k=5):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known[i] = [min(max(math.floor(256 * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in v]
    out = []
    for q in known:
        if q % 50 == 0:
            best = sorted((-min(max(sum(a * b for a, b in zip(known[q], known[p])), -(2**63)), 2**63 - 1), p) for p in known if p != q and len(known[p]) == len(known[q]))[:k]
            out += [(q, n + 1, p, -s) for n, (s, p) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("group", "queries", "probes"), [(8192, 16_384, 1024), (60, 4, 40)])
def test_top_k(spark, monkeypatch, group, queries, probes):
    for name, value in (("CANDIDATE_GROUP", group), ("QUERY_GROUP", queries), ("PROBES", probes)):
        monkeypatch.setattr(topk_search, name, value)
    r = np.random.default_rng(0)
    rows = [(i, None if i == 13 else [float("nan")] * 4 if i == 14 else [None, 1.0, 2.0, 3.0] if i == 15 else (r.normal(size=4) * (1 if i % 3 else 50)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(800 + i, [2e7 * (i - 4), 3.0, -1e19, 5.0] if i % 2 else [1e30, -1e30, 2e7, -4e6]) for i in range(0, 60, 5)]
    rows += [(500 + i, [0.5] * 4) for i in range(40)] + [(501, [0.5] * 4), (None, [1.0] * 4), (600, []), (650, []), (700, [3e9, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("dim", "norm", "bucket", "least", "cell")})
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())) == brute_top(rows)


def test_clustered_vectors_prune_by_coordinates(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 24)) * 4
    rows = [(i, (centres[i % 8] + r.normal(size=24) * 0.3).astype(np.float32).tolist()) for i in range(1000)]
    cell = topk_search.Cell(np.arange(1000), np.floor(256 * np.array([v for _, v in rows])).astype(np.int64))
    q = cell.vectors[5]
    best = np.sort(cell.products(q, np.arange(1000)))[-5]
    assert len(cell.candidates(q, int(best))) < 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())) == brute_top(rows)


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect() == []


# ---------------------------------------------------------------- tokens


ODD = [
    "", None, "  \n", "Hello, World! it's <|endoftext|>x<|startoftext|> l'\u0130stanbul \u0391\u03a3 e\u0301   a\u2003b \x85\x1c\u200b \U0001f600 \ufb01 12345 don't'll we're'rest 're 'r've ''s !'s",
    "x" * 300 + " y", "a\u0301 \u0301 x", "<|endoftext|> <|endoftext |>", "<|ENDOFTEXT|>a<|endoftext|><|endoftext|>!'s", "e\u0301\u0302\u0301\u0301\u0301\u0301y", "\u1100\u1161\u11a8\uac00\u11a8",
    "\u3000\u3000a\u3000b 'e\u0301 o\u0308'e", "\u0130\u0130'\u0130s", "\u01c4 \u212a \u212b stra\u00dfe", "1a2b3 c4'5's", "a\u0316\u0301\u0316b",
]


def library_count():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.default_path())
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False))


def test_every_prefix_is_counted_as_the_library_does():
    count, tables = library_count(), token_counts.tables(token_counts.default_path())
    r = random.Random(1)
    letters = "abce'!1 \u0316\u0301\u00e9\u0130\u03a3\u3000\x85<|>\u00df\u4e2d\uac01\u1161sretvdlm"
    for text in [t or "" for t in ODD] + ["".join(r.choice(letters) for _ in range(25)) for _ in range(300)]:
        assert tables.table(text).tolist() == [count(text[:n]) for n in range(len(text) + 1)], repr(text)


def test_tokens_that_may_be_neighbours_are_those_that_merges_leave_apart():
    tables = token_counts.tables(token_counts.default_path())
    r = random.Random(2)
    names = [t for t in tables.vocabulary if not t.endswith(tables.mark)]
    for _ in range(3000):
        left, right = r.choice(names), r.choice(list(names))
        alone = [len(tables.merged(tables.symbols(t))) == 1 for t in (left, right)]
        if all(alone):
            assert tables.neighbours(tables.vocabulary[left], tables.vocabulary[right]) == (tables.merged([*left, *right]) == [left, right])


def test_token_counts(spark, data):
    count = library_count()
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_tokens", "n_bytes", "prefix_tokens")})
    for r in token_counts.prefix_counts(rows).withColumn("cut", token_counts.fitting_characters(5)).collect():
        text = ODD[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes, len(r.prefix_tokens)) == (count(text), len(text.encode()), len(text) + 1)
        assert r.cut == max(n for n in range(len(text) + 1) if count(text[:n]) <= 5)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.token_budget(docs, 40).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == count(text) and count(text[: r.fit_chars]) <= 40
        assert r.fit_chars == len(text) or count(text[: r.fit_chars + 1]) > 40
    assert token_counts.prefix_counts(docs.where("doc_id = -9")).collect() == []


def test_tokens_of_very_long_texts(spark):
    count = library_count()
    texts = ["word " * 250_000, "x" * 1_000_000, "e\u0301" * 300_000]
    got = token_counts.token_budget(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1000).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: count(t) for i, t in enumerate(texts)}
    assert all(count(texts[r.doc_id][: r.fit_chars]) <= 1000 for r in got)


# ---------------------------------------------------------------- archives


@pytest.mark.parametrize("version", [1, 2])
def test_pages_through_archives(spark, version):
    r = random.Random(7)
    pages = [(i, f"http://a b/ c{i}", r.choice([None, "x" * 999, "y" * 1000, "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n", "z" * 2000 + str(i)])) for i in range(80)]
    pages += [(None, None, "y" * 1000), (5000, "u\nv", "y" * 1000), (5000, "u\nv", "y" * 1000)]
    pages += [(6000 + i, None, "p" * (1_000_000 + i)) for i in range(3)] + [(6100, None, "p" * 1_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "holder", "page", "size")})
    holder = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            holder[h] = max(i, holder.get(h, i))
    expected = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = holder.get(h) if i is not None else None
        again = to is not None and i < to
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None))
    assert sorted(map(tuple, warc_convert.convert_pages(df, version).collect()), key=str) == sorted(expected, key=str)


def test_files_are_bounded_by_bytes(monkeypatch):
    """In two parts, each with its own information record; a record longer than a part is a part of its own."""
    monkeypatch.setattr(warc_convert, "PART", 3000)
    pages = pa.record_batch([pa.array(range(9)), pa.array([f"http://x/{i}\r\n" for i in range(9)]), pa.array(["a" * 900] * 4 + ["b" * 9000] + ["c" * 10] * 4)], ["page_id", "url", "html"])
    records = list(warc_convert._convert(1)([pages]))
    framed = [pa.record_batch([*r.columns, pa.nulls(r.num_rows, pa.int64())], [*r.schema.names, "holder"]) for r in records]
    parts = [v for b in warc_convert._frame(framed) for v in b.column(0).to_pylist()]
    assert len(parts) == 4
    whole = [(warc_convert.zlib.compress((p + warc_convert.SEPARATOR).encode(), wbits=31)) for p in parts]
    seen = []
    for content in [*whole[:2], whole[2] + whole[3]]:
        heads = [h for h, _ in warc_convert.parse_warc(warc_convert.inflated(content))]
        assert heads[0]["WARC-Type"] == "warcinfo"
        seen += [h["WARC-Target-URI"] for h in heads if h["WARC-Type"] == "response"]
    assert seen == [f"http://x/{i}%0D%0A" for i in range(9)]
    with pytest.raises(ValueError):
        list(warc_convert.parse_warc(warc_convert.inflated(whole[0][:-30])))


def test_archives_of_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_convert.convert_pages(df).collect() == []


def test_record_ids_and_dates():
    for page in (0, 5, 2**62, -3, 2**63 - 1, -(2**63)):
        uri = warc_convert.record_id(page, "ab" * 20)
        assert re.fullmatch(r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", uri)
        assert warc_convert.page_of(uri) == page
    assert warc_convert.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_arc_lengths_are_declared_not_guessed():
    archive = warc_convert.arc_archive([(1, "http://x/", "a\nhttp://y/ 1.1.1.1 20010101000000 text/html 5\nb")], 2)
    records = list(warc_convert.parse_arc(archive))
    assert len(records) == 1
    with pytest.raises(ValueError):
        list(warc_convert.parse_arc(archive[:-10]))
