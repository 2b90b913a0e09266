"""Exact dedup, fingerprints, BPE, language ID."""

import hashlib
import random
import re
import string
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.bpe import LONG, Decoder, Digester, Merges, encode_decode, merge, transduce
from quern.llm.exact_dedup import chunks, collisions, exact_dedup, recipes
from quern.llm.fingerprints import block_tables, fingerprint_documents, neighbours, ordered_buckets
from quern.llm.language_id import Classifier, drawn, fit, identify, language_id, letters, recognised
from quern.llm.queries import tokenizer
from tests.llm.helpers import awkward, nothing, texts


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup(spark):
    docs = awkward(spark)
    found = exact_dedup(docs).collect()
    groups = {}
    for i, t in texts(docs):
        groups.setdefault(t, []).append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, sha(t)) for i in ids)
    assert Counter(tuple(r) for r in found) == want
    assert exact_dedup(nothing(spark)).count() == 0


def test_hot_groups_are_joined_apart(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1200, "the same").otherwise(F.concat(F.lit("own "), (F.col("id") / 2).cast("int"))).alias("text"))
    found = exact_dedup(docs)
    assert found.count() == 1500 and {(r["keep_id"], r["group_size"]) for r in found.filter("doc_id < 1200").collect()} == {(1199, 1200)}
    assert found.filter("doc_id >= 1200 AND group_size = 2").count() == 300


def cut(spark, *bodies):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(bodies)], "i long, text string")
    return [r["chunks"] for r in rows.select("i", chunks(F.coalesce("text", F.lit(""))).alias("chunks")).orderBy("i").collect()]


def test_chunks_are_whole_and_fall_into_step(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 8)))
    numbered = "".join(f"sentence number {i} of this text. " for i in range(2000))
    prose = " ".join(word() for _ in range(6000))
    same = "Always the very same sentence. " * 1500
    for body in (numbered, prose, same):
        a, b, c = cut(spark, body, "17 characters in " + body, body[: len(body) // 2] + "changed" + body[len(body) // 2 :])
        assert "".join(a) == body and "".join(b) == "17 characters in " + body and len(a) > 4
        # All but the chunks around the change are shared; a stretch without boundaries has short ones.
        assert len([x for x in a if x not in set(b)]) <= 1 and len([x for x in a if x not in set(c)]) <= 3
    whole = ["", None, "z" * 100_000, "日本語、" * 9000, " " * 5000, ".", "a\nb", "x" * 64, "x" * 65 + " "]
    assert ["".join(c) for c in cut(spark, *whole)] == [t or "" for t in whole]


def test_colliding_identifiers_are_seen_and_widened(spark):
    pieces = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "id long, wide string")
    assert [r["id"] for r in collisions(pieces).collect()] == [2]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "ca", "d"])], "doc_id long, text string")
    by_last = lambda c: F.ascii(F.right(c, F.lit(1))).cast("long")
    recipe = {r["doc_id"]: r["recipe"][0] for r in recipes(docs, identify=by_last).collect()}
    assert recipe[0] == recipe[2] != recipe[3] and recipe[3]["wide"] == sha("ca") and recipe[4]["wide"] is None and recipe[1]["wide"] is None
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup(docs, by_last).collect()} == {0: 2, 1: 1, 2: 2, 3: 3, 4: 4}


def simhash(t):
    """Votes of neighbouring lower-cased words by Spark's xxhash64 of the pair: the hash of the second, seeded by that of the first."""
    w = [x for x in re.split("[ \\t\\n\\x0b\\x0c\\r]+", t.lower()) if x]
    pairs = [(a, b) for a, b in zip(w, w[1:])] if len(w) > 1 else [(x, None) for x in w]
    first = lambda x, seed: xxhash.xxh64_intdigest(x.encode(), seed)
    hashes = [first(a, 42) if b is None else first(b, first(a, 42)) for a, b in pairs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def bits_apart(p, q):
    return (int(p, 16) ^ int(q, 16)).bit_count()


def check_fingerprints(spark, docs, **how):
    """Every column of every row that has an id of its own, against brute force."""
    found = fingerprint_documents(docs, **how).collect()
    assert len(found) == docs.count()
    rows = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    single = {i for i, n in Counter(i for i, _ in rows).items() if n == 1 and i is not None}
    by_id = {r["doc_id"]: r for r in found}
    every = {r["fingerprint"] for r in found}
    for at, (i, t) in enumerate(rows):
        nxt = rows[(at + 1) % len(rows)]
        if i not in single or nxt[0] not in single:
            continue
        half, r = len(t) // 2, by_id[i]
        edited = t[: len(t) - half] + nxt[1][:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        if t.isascii() and edited.isascii():
            assert (int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16)) == (simhash(t), simhash(edited))
        like = lambda p, q: 1 - bits_apart(p, q) / 64
        assert r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == like(r["fingerprint"], by_id[nxt[0]]["fingerprint"])
        asks = str(i).lstrip("-").isdigit() and int(i) % 50 == 0
        assert r["neighbours"] == (sum(0 < bits_apart(x, r["fingerprint"]) <= 3 for x in every) if asks else None)
    return found


def test_fingerprints(spark):
    docs = awkward(spark)
    found = check_fingerprints(spark, docs)
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (5, 6)}) == 1
    check_fingerprints(spark, docs, bucket_bytes=3000)
    assert fingerprint_documents(nothing(spark)).count() == 0
    assert fingerprint_documents(docs.filter("doc_id = 4")).first()["near_next"] == 1.0


def test_ids_of_any_spread_and_type(spark):
    random.seed(8)
    prose = [" ".join(random.choice(["the", "a", "word", "of", "many", "kinds"]) for _ in range(random.randint(0, 60))) for _ in range(400)]
    ids = [-(2**63), -(2**63) + 1, 0, 2**63 - 1, *range(50, 250), *(2**62 + i for i in range(100)), *(-(10**18) * 9 + 7 * i for i in range(96))]
    longs = spark.createDataFrame(list(zip(ids, prose)), "doc_id long, text string").repartition(5)
    check_fingerprints(spark, longs, bucket_bytes=500)
    strings = spark.createDataFrame([(f"id-{i:04}" if i % 3 else str(i), t) for i, t in zip(range(400), prose)], "doc_id string, text string")
    check_fingerprints(spark, strings, bucket_bytes=500)
    nulls = longs.limit(40).select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert fingerprint_documents(nulls, bucket_bytes=100).count() == 40


def test_buckets_are_bounded_by_bytes_and_cross(spark):
    docs = spark.range(9000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    # A third of the rows under one id, and ids crowded in a small part of their span.
    crowded = docs.unionByName(spark.range(4500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text"))).unionByName(spark.createDataFrame([(2**62, "far")], docs.schema))
    body = crowded.withColumn("th", F.xxhash64("text"))
    sizes = [r[0] for r in body.groupBy(ordered_buckets(body, 1000)).agg(F.sum(F.length("text"))).select("sum(length(text))").collect()]
    assert len(sizes) > 25 and max(sizes) < 6000
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_documents(docs, bucket_bytes=2000).collect()}
    for i in (0, 2047, 2048, 5000, 8999):
        t, n = f"t{i}", f"t{(i + 1) % 9000}"
        assert found[i * 3] == sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2])


def test_bounds_are_not_copied_for_a_row(spark):
    # The bounds grow with the table, so a row may read some of them but not build them anew.
    rows = [(None, "n"), *((i, f"t{i}") for i in range(-300, 300))]
    body = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    dealt = body.withColumn("bucket", ordered_buckets(body, 40))
    assert "arrays_zip" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    found = [r["bucket"] for r in dealt.orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert found == sorted(found) and found[0] == 0 and len(set(found)) > 25


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    near = [int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(63, n, False)))) for b in base for n in (1, 3, 4)]
    values = sorted({*map(int, base), *near})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    rows = [(r["query"], r["fp"], r["distance"]) for r in neighbours(fps, fps).collect()]
    got = set(rows)
    assert len(rows) == len(got)
    dist = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(a, b, dist(a, b)) for a in values for b in values if dist(a, b) <= 3}
    assert block_tables(fps).select("table").distinct().count() == 20


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def bpe(request):
    from tokenizers import Tokenizer

    path = tokenizer(request.param)
    return Digester(Merges(path)), Tokenizer.from_file(path)


def agree(bpe, text):
    digester, library = bpe
    ids = library.encode(text, add_special_tokens=False).ids
    assert digester.encoder.encode(text) == ids
    assert digester.digest(text) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_special_cases(bpe):
    for text in ["", " ", "\n\n a", "<|endoftext|> hi<|startoftext|>x", "<|endof", "ΑΣ Σ ς İI ǅ", "é ä", "a'S don't I'LL", "👩‍👧 x", "x" * 3000, "ab" * 2000, "½²Ⅷ٣", "\x00\x01﻿", " ".join(["word"] * 20_000), "é" * 40_000, "日本語" * 9000]:
        agree(bpe, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(bpe, text):
    agree(bpe, text)


def test_narrow_pattern_splits_as_the_wide_one():
    import random

    import regex

    from quern.llm.bpe import OWN, WORDS, narrow

    random.seed(5)
    wide, fast = regex.compile(OWN), narrow()
    every = "".join(map(chr, range(256)))
    texts = [every, *(a + b for a in every for b in every)]
    texts += ["".join(random.choices("ab1 '\n\t\x1c\x85\xa0\xaa\xb2\xe9.stmdrevl" + every, k=random.randint(1, 60))) for _ in range(3000)]
    assert all(fast.findall(t) == wide.findall(t) for t in texts)
    wide, fast = regex.compile(WORDS), narrow(WORDS)
    assert all(fast.findall(t) == wide.findall(t) for t in texts)


def plain_texts():
    """Texts of the first 256 characters with all their neighbourhoods, and some that are split one at a time."""
    rng = random.Random(6)
    every = "".join(map(chr, range(256)))
    texts = ["", " ", "\n ", every, *(a + "".join(x + b for x in every) for a in ("", "a", " ") for b in "a1.' \n\x00é\x85")]
    texts += ["".join(rng.choices("ab12 '\n\t\x1c\x85\xa0\xaa\xb2\xe9.stmdrevlSTM" + every, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["'s", "''s", "a's't're've'm'll'd", " 's", "'rex'r", "a'", "'ll", "x" * 64, "x" * 65, " " + "x" * 64, "é" * 64, "1" * 70, " " * 70 + "a", "a" + " " * 70]
    return texts + ["日本 a", "x <|endoftext|>y", "a" * 3000, "", "the end"]


def test_texts_together_equal_one_at_a_time(bpe, monkeypatch):
    digester, _ = bpe
    texts = plain_texts()
    alone = [digester.encoder.encode(t) for t in texts]
    for ids, where, count, places in digester.encoder.shared(texts):
        together = [None if p is None else [i for w in p for i in ids[where[w] : where[w] + count[w]].tolist()] for p in places]
        assert len(places) == len(texts) and all(t is None or t == a for t, a in zip(together, alone))
        assert sum(p is None for p in places) < 12
    want = [digester.digest(t) for t in texts]
    assert list(digester.digests(texts)) == want and list(digester.digests([])) == []
    monkeypatch.setattr("quern.llm.bpe.SLAB", 500)
    monkeypatch.setattr("quern.llm.bpe.SHORT", 40)
    assert list(digester.digests(texts)) == want


def test_plain_words_are_not_merged_one_at_a_time(monkeypatch):
    digester = Digester(Merges(tokenizer("word_bpe_49k.json")))
    text = "It's plain prose, and l'été has 2 or 3 words.\n" * 3
    want = digester.digest(text)
    monkeypatch.setattr("quern.llm.bpe.merge", None)
    assert list(Digester(digester.merges).digests([text, ""])) == [want, (0, sha(""), sha(""))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abceinorst'", min_size=1, max_size=400), st.integers(1, 40))
def test_transducer_equals_whole_merge(bpe, word, step):
    merges, encoder = bpe[0].merges, bpe[0].encoder
    symbols = [encoder.characters[b] for b in word.encode()]
    if merges.suffix:
        symbols[-1] += merges.suffix
    assert list(transduce(symbols, merges, step)) == merge(list(symbols), merges.ranks)


def test_decoder_is_incremental():
    merges = Merges(tokenizer("byte_bpe_50k.json"))
    digester, decoder = Digester(merges), Decoder(merges)
    text = "日本 é 👩‍👧 plain"
    assert "".join(decoder.feed([i]) for i in digester.encoder.encode(text)) + decoder.finish() == text


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_words_stream_and_are_not_remembered(file):
    rng = random.Random(8)
    digester, one = Digester(Merges(tokenizer(file))), Tokenizer.from_file(tokenizer(file))
    one.no_truncation()
    one.no_padding()
    for text in ("x" * 90_000, "".join(rng.choices("abcdefghij", k=30_000)), "a " + "q" * LONG + " b " + "zé" * 9_000 + "<|endoftext|>" + "no" * 900):
        ids = one.encode(text, add_special_tokens=False).ids
        assert digester.digest(text) == (len(ids), sha(" ".join(map(str, ids))), sha(one.decode(ids, skip_special_tokens=False)))
    assert max(len(w) for w in digester.spelled if isinstance(w, str)) <= LONG


def test_encode_decode_rows(spark):
    docs = awkward(spark)
    found = encode_decode(docs, tokenizer("word_bpe_49k.json")).collect()
    digester = Digester(Merges(tokenizer("word_bpe_49k.json")))
    assert Counter(map(tuple, found)) == Counter((i, *digester.digest(t)) for i, t in texts(docs))
    assert encode_decode(nothing(spark), tokenizer("word_bpe_49k.json")).count() == 0


def test_language_id_learns_and_rejects(spark, small):
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    found = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.filter("lang_pred = lang").count() / held.filter("lang IS NOT NULL").count() > 0.97
    assert found.filter("lang_pred NOT IN ('en', 'de', 'fr', 'es', 'und') OR score < 0 OR score > 1").count() == 0


def test_language_id_awkward(spark):
    docs = awkward(spark)
    found = language_id(docs).collect()
    assert len(found) == docs.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2, 12) or r["doc_id"] is None and r["score"] == 0) for r in found)
    assert language_id(nothing(spark)).count() == 0
    assert {r["lang_pred"] for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = recognised(docs, fit(docs))
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR text = '1234 5678'").count() == 0
    assert letters("A1b_C") == b" a b c " and identify(docs.select("doc_id", "text"), {}).filter("NOT rejected").count() == 0


def test_prediction_ignores_lang_source_and_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 60")
    model = fit(docs)
    a = identify(docs.select("doc_id", "text"), model).select("text", "lang_pred")
    b = identify(docs.select((F.col("doc_id") + 7).alias("doc_id"), "text"), model).select("text", "lang_pred")
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_language_sample_is_whole_and_bounded(spark):
    assert drawn([(0, 7, 90), (1, 8, 20), (2, 9, 10), (3, 5, 5)], 2, 100) == [7, 9]
    assert drawn([(0, 7, 300), (1, 8, 200)], 2, 100) == [8]
    long = "tail " * 2000 + "zzyzx"
    rows = [(None, long, "en")] * 3 + [(2, "ein kurzer text", "de"), (3, "ein kurzer text", "de"), (4, "noch einer", "de")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model == {"en": letters(long), "de": model["de"]} and model["en"].count(b"zzyzx") == 1
    assert sorted([letters("ein kurzer text") + letters("noch einer"), letters("noch einer") + letters("ein kurzer text")]).count(model["de"]) == 1


def test_narrow_margins_are_rejected_and_clean_texts_stay(spark, small):
    rows = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL").collect()
    held = [r for r in rows if crc32(str(r["doc_id"]).encode()) % 4 == 2]
    model = Classifier(fit(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows if r not in held], "doc_id long, text string, lang string")))
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(rng.randint(50, 400))) for _ in range(200)]
    assert sum(model.predict(x)[2] for x in junk) >= 180
    clean = [model.predict(r["text"]) for r in held if len(letters(r["text"])) >= 100]
    assert sum(rejected for *_, rejected in clean) <= len(clean) * 0.01
    assert model.predict("x")[2] in (True, False) and Classifier({"en": b"only one"}).predict("some words")[2] is False
