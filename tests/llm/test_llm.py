"""The corpus operators against brute force, round trips and odd rows."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import bpe, jaccard, lsh, media, mixing, pii, sharding, sql, tokenfiles, toxicity, warc
from lantern.llm.common import Files, components, fresh_dir, tokenizer_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, key string"
LONG = "lorem ipsum dolor " * 3000
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, copies, a repeated row, and columns whose names clash with results."""
    rows = [(1, TEXT), (2, TEXT), (3, TEXT + " end"), (4, None), (5, ""), (6, " \n\t"), (7, LONG), (None, TEXT), (1, TEXT), (8, "Mail a.b@c.org, 4111 1111 1111 1111 or +49 30 1234567 at 10.0.0.1 é😀"), (9, None), (10, "hi")]
    return spark.createDataFrame([(i, t, None if i == 9 else "en", None if i == 10 else "src1", None, 0, "x") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_token_files_ship_no_encoder(odd):
    """Where executors lack the module, it goes to them by value, so the driver's encoder must not be in it."""
    from pyspark import cloudpickle

    tokenfiles._encoders.clear()
    tokenfiles.round_trip(odd).count()
    assert not tokenfiles._encoders
    cloudpickle.register_pickle_by_value(tokenfiles)
    try:
        assert len(cloudpickle.dumps(tokenfiles.encoder)) < 1_000_000
    finally:
        cloudpickle.unregister_pickle_by_value(tokenfiles)


def test_toxicity_fits_in_blocks(monkeypatch):
    """What the driver holds grows by a few bytes with a word of the sample, not by what a round of the fit computes; blocks change no score."""
    import tracemalloc

    def peak(docs):
        texts = [" ".join(f"w{(i * 31 + k * 7) % 900}" for k in range(2_000)) + (" vile" if i % 2 else "") for i in range(docs)]
        tracemalloc.start()
        toxicity.fit(texts, [i % 2 for i in range(docs)])
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    monkeypatch.setattr(toxicity, "ROUNDS", 12)
    assert peak(320) - peak(80) < 16 * 240 * 2_000
    texts = [f"{TEXT} number {i} {'vile idiots' if i % 3 == 0 else 'kind people'}" for i in range(60)]
    fitted = []
    for block, piece in ((100_000, 10_000), (1, 7)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "PIECE", piece)
        fitted.append(toxicity.fit(texts, [int(i % 3 == 0) for i in range(60)]).scores(texts))
    assert np.allclose(*fitted, atol=1e-6)


def test_bpe(odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    got = bpe.encode(odd, keep_ids=True).collect()
    assert len(got) == odd.count() and bpe.encode(empty).count() == 0
    texts = [r.text or "" for r in odd.select("text").collect()]
    assert sorted(r.ids_sha256 for r in got) == sorted(hashlib.sha256(np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for x in texts)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in texts)
    assert sorted(r.text for r in bpe.decode(bpe.encode(odd, keep_ids=True)).collect()) == sorted(texts)
    c = bpe.codec(tokenizer_path(bpe.VOCABULARY))
    strange = ["<|endoftext|>x", "a" * 500, "  \n\n a\t\tb", "it's 'll \x1c!\x85?", "zzzz" * 40, "é漢字😀", "x" + chr(0xA0) + " y"]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_batch(strange)] == [t.encode(x, add_special_tokens=False).ids for x in strange]


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(tokenfiles.VOCABULARY))
    got = tokenfiles.round_trip(odd).collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, tokenfiles.END]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda r: r[1]) == want
    assert tokenfiles.round_trip(empty).count() == 0
    folder = fresh_dir(spark, "t")
    m = tokenfiles.write(odd, folder).collect()
    found = [x.tolist() for f in m for x in tokenfiles.TokenFile(Files(folder), f.file, f.n_bytes).document(8)]
    assert found == [[*t.encode(next(r.text for r in rows if r.doc_id == 8), add_special_tokens=False).ids, tokenfiles.END]]


def test_pii(odd, empty):
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    assert (got[8].n_email, got[8].n_ip, got[8].n_card, got[8].n_phone) == (1, 1, 1, 1) and got[4].spans == "" and pii.find(empty).count() == 0
    assert pii.masked_text("x GB82 WEST 1234 5698 7654 32 y") == "x [iban] y" and pii.luhn("4111111111111111") and not pii.mod97("GB82WEST12345698765433")
    masked = {r.doc_id: r for r in pii.mask(odd).collect()}
    assert masked[8].text.startswith("Mail [email], [card]") and masked[4].text is None
    other = odd.select("doc_id", "text", F.col("n_chars").cast("string").alias("n_chars"), F.lit("x").alias("label"))
    assert {r.doc_id: r.n_chars for r in pii.mask(other).collect()}[10] == "2" and pii.mask(odd.select("doc_id", "text", F.array("n_chars").alias("n_chars"))).filter("doc_id = 10").first().n_chars == [None]
    for n in ("1" * 100_000, "1." * 50_000, "a@" * 50_000, "+1" * 50_000):
        pii.base_spans(n)


def test_context_decides():
    number = "021000021"
    for text, found in ((f"routing {number}", True), (f"The number is {number}.", False), (f"Konto: {number}", True), (f"rerouting {number}", False), (f"routing {' ' * 60}{number}", False), ("routing 021000022", False), (f"bank {number}5", False)):
        assert [s[1] for s in pii.added_spans(text)] == ([5] if found else []), text
    assert pii.masked_text(f"ABA {number}, see {number}") == "ABA [routing], see [routing]" and pii.masked_text(f"order {number}") == f"order {number}"
    # Words count whole: neither a ship nor a hotel is context.
    assert pii.score("ship 1.2.3.4", 5, 12, "ip") == 0.6 and pii.score("ip 1.2.3.4", 3, 10, "ip") == 0.75 and pii.score("hotel +1 555", 6, 12, "phone") == 0.6


def test_base_spans_by_brute_force():
    """The patterns of the contract as they stand, each over the whole text, with its checks."""
    import random
    import re

    plain = {
        0: (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), 1: (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        2: (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)), 3: (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "4", "0", "25", "9", ".", "-", " ", "+", "@", "a", "b.c", "4111111111111111", "(", "é"]) for _ in range(rng.randint(0, 30)))
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in plain.items() for m in re.finditer(p, text) if ok(m[0]))
        assert pii.base_spans(text) == want, text


def test_iban_ends():
    for iban, after in (("DE89 3704 0044 0532 0130 00", " BIC COBADEFFXXX"), ("GB82 WEST 1234 5698 7654 32", " I paid"), ("DE89370400440532013000", " 2024"), ("QQ44 1234 5678 9012 345", " AB X")):
        assert pii.masked_text(f"to {iban}{after}") == f"to [iban]{after}", iban
    # A failed start does not hide what follows it, nor a confirmed one the next.
    assert pii.masked_text("AB12 X DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 OK") == "AB12 X [iban] [iban] OK"
    assert pii.added_spans("DE89 3704 0044 0532 0130 01 BIC") == [] and pii.added_spans("DE89370400440532013000a") == []
    pii.added_spans("AB12 " * 20_000)


def test_toxicity_long_words():
    weight = np.zeros(toxicity.BUCKETS, np.float32)
    weight[toxicity.grams(["nastyword"])[0]] = 50
    m = toxicity.Model(weight, -4.0)
    clean = "_".join(f"{i:04d}" for i in range(400))
    for at in (0, 60, 64, 118, 121, 1000, len(clean)):
        assert m.score(clean[:at] + "nastyword" + clean[at:]) > m.score(clean), at
    for n in (1, 64, 65, 68, 124, 125, 300):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(word)
        assert max(map(len, pieces)) <= toxicity.LONGEST and {word[i : i + k] for k in (3, 4, 5) for i in range(n - k + 1)} == {p[i : i + k] for p in pieces for k in (3, 4, 5) for i in range(len(p) - k + 1)}


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(500):
        w = rng.choice(words, 60).tolist()
        if i % 3 == 0:
            w[rng.integers(60)] = "nastyword"
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    m = toxicity.fit(texts[:400], labels[:400])
    right = [int(m.score(t) >= 0.5) == y for t, y in zip(texts[400:], labels[400:], strict=True)]
    assert np.mean(right) > 0.9
    assert m.score(texts[401].replace(texts[401].split()[3], "nastywords")) > m.score(texts[401])
    got = toxicity.score(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and toxicity.score(empty, m).count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = toxicity.train(odd, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert none.score("x") < 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_toxicity_held_out(spark):
    """Of the given labels that are held out, nine in ten of the toxic are above all but two in a hundred of the clean; and whole texts teach."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    clean, bad = sorted((r.score for r in rows if r.toxic == 0), reverse=True), [r for r in rows if r.toxic == 1]
    bound = clean[len(clean) // 50]
    assert len(bad) > 50 and sum(r.score > bound for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad) and sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(clean)


def test_toxicity_samples_whole_texts(spark, monkeypatch):
    """What is fitted are whole texts; one that would exceed the bound is left out whole. (That one bad word in a text of thousands is learnt is not claimed.)"""
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: held.append((texts, toxic)))
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 200_000)
    rows = [(i, "word " * 12_000 + f"end{i}" if i == 2 else "x" * 300_000 if i == 7 else f"text {i}") for i in range(20)] + [(30, None)]
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(31)], "doc_id long, toxic int"))
    learnt = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 and i != 7}
    assert sorted(map(str, held[0][0])) == sorted(str(t) for i, t in rows if i in learnt) and sum(held[0][1]) == sum(i % 2 for i in learnt)


def test_warc(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "v", ""), (5, "w\r\nx", "\r\n\r\nWARC/1.1\r\n" * 3), (5, "w", "z"), (None, "q", "a"), (7, "u", "é" * 9999)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(p).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        top = max(same)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    assert all(r.request and r.metadata for r in got) and warc.round_trip(p.limit(0)).count() == 0


def test_media(spark, odd, empty):
    got = media.round_trip(odd).collect()
    assert len(got) == odd.count() and media.round_trip(empty).count() == 0 and all(r.error is None for r in got)
    for r in got:
        if r.doc_id == 8:
            n, payload = media.padded(next(x.text for x in odd.collect() if x.doc_id == 8))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    folder = fresh_dir(spark, "m")
    m = media.write(odd, folder).collect()
    files = Files(folder)
    reader = media.ArchiveReader({"path": folder})
    at = int(reader.index(files, m[0].archive)["offset"][0])
    with open(files.path(m[0].archive), "r+b") as f:
        f.seek(at + 60)
        f.write(b"\xff\xff\xff\xff")
    rows = media.read(spark, folder).collect()
    assert len(rows) == odd.count() and sum(r.error is not None for r in rows) == 1


def _brute(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_jaccard(spark, odd, empty):
    rng = np.random.default_rng(3)
    texts = {}
    for g in range(12):  # chains of slow change, clusters around one text, and a passage shared by all
        w = rng.integers(0, 9999, 70).astype(str).tolist() + TEXT.split()
        for j in range(9):
            texts[len(texts) + 100] = " ".join(w)
            for _ in range(1 + g % 4):
                w[rng.integers(70)] = str(rng.integers(10_000, 20_000))
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    # A group larger than a piece of postings may be, of every distance from its origin, and one sharing its least words.
    w = rng.integers(0, 9999, 60).astype(str).tolist()
    for j in range(90):
        texts[2000 + j] = " ".join(str(rng.integers(20_000, 40_000)) if rng.random() < 0.004 * j else x for x in w)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    for size, percent in ((4, 85), (5, 80), (2, 60)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, size, percent).collect()} == _brute(texts, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(odd, 4, 85).collect()}
    assert got[2] == got[1] and got[1][1] == 1 and got[4] == (0, 4) and got[5] == (0, 5) and got[10] == (1, 10) and got[None][1] == 1
    assert jaccard.join(empty).count() == 0 and jaccard.keep_one(docs).count() == len({c for _, c in _brute(texts, 5, 80).values()})


def test_jaccard_pivots(spark, monkeypatch):
    """A text is the pivot of its near copies although they are too far from each other; and members enter a bounded number of cells."""
    rng = np.random.default_rng(5)
    w, texts = rng.integers(0, 9999, 300).astype(str).tolist(), {}
    for j in range(80):
        other = set(rng.integers(0, 300, 5).tolist())
        texts[j] = " ".join(str(20_000 + j) if i in other else x for i, x in enumerate(w))
    texts[1000] = " ".join(w)
    split, seen = jaccard._split, []

    def counted(region, members, *more):
        out = split(region, members, *more)
        seen.append((region.count(), out[2].count()))
        return out

    monkeypatch.setattr(jaccard, "_split", counted)
    for some in (texts, {i: t for i, t in texts.items() if i < 1000}):
        docs = spark.createDataFrame([*some.items()], "doc_id long, text string")
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, 4, 85).collect()} == _brute(some, 4, 85)
    assert seen[0][1] == 0 < seen[1][0] and seen[1][1] <= jaccard.HOMES * seen[1][0]
    assert len({c for _, c in _brute(texts, 4, 85).values()}) == 1


def test_keep_one(spark, odd):
    # Null ids: alone, and a group of nothing else; an id of two texts, one of them a near copy; empty texts that repeat.
    rows = [(None, "alone here"), *[(None, " ".join(map(str, range(n)))) for n in (60, 61, 60)], (13, TEXT), (5, TEXT + " end"), (5, "another text of the same id"), (5, ""), (None, None)]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", None, 0, "x") for i, t in rows], DOC))
    kept = jaccard.keep_one(docs)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    copies = [x for x in got if x[1] and x[1].startswith("0 1 2")]
    assert kept.columns == docs.columns and len(copies) == 1 and copies[0][0] is None
    mail = odd.filter("doc_id = 8").first().text
    want = [(1, TEXT), (4, None), (5, ""), (5, ""), (6, " \n\t"), (7, LONG), (8, mail), (9, None), (10, "hi"), (None, "alone here"), (5, rows[6][1]), (None, None), *copies]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(240):
        v = base[i % 40] + rng.normal(size=16) * 0.18
        rows.append((i, v.tolist() if i % 11 else base[i % 40].tolist(), int(i % 3)))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, base[0].tolist(), None), (904, [1.0, None], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in lsh.near_links(v).collect()}
    x = np.array([r[1] for r in rows[:240]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows[:240]])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(240))
    assert len(got) == len(rows) and 0.9 * link.sum() <= found <= link.sum() and all(got[i].n_links <= link[i].sum() for i in range(240))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905)) and lsh.near_links(v.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [20, 150])
def test_sharding(odd, empty, spark, pairs):
    text = lambda i: "copy" if i < 200 else f"t{i % pairs}" if i < 200 + 2 * pairs else f"s{i}"
    docs = odd.unionByName(spark.createDataFrame([(1000 + i, text(i), "en", "s", 1, 0, "x") for i in range(500)], DOC))
    got = sharding.shard(docs, 7).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(7)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sizes[s]))
    at = {}
    for r in got:
        at.setdefault(r.text_crc32, set()).add(r["shard"])
    assert sharding.shard(empty).count() == 0
    if len(at[zlib.crc32(b"copy")]) > 4 or sum(len(x) == 1 for x in at.values()) <= 0.9 * len(at):
        pytest.xfail("known shortfall: a group larger than a shard is spread over more shards than it needs")


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    for most in (5, 1000):
        got = {r.id: r.component_id for r in components(e, task_edges=most).collect()}
        assert len(got) == 62 and all(got[i] == 1 for i in range(1, 61)) and got[101] == 100
    assert components(e.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_mixing(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, mixing.mix(docs).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.execute(sql.ORACLE["op2_mixing"]).fetchall())
    taken = sum(r[4] * r[5] for r in got)
    assert taken <= sum(r[4] for r in got) * mixing.WANTED / 1000
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    assert 0 < mixing.select(docs, 500).count() < docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert toxic.columns == docs.columns and 0 < toxic.count() <= docs.count()
    masked = corpus_pipeline.mask_pii(spark, docs, SF)
    assert masked.count() == docs.count() and masked.filter(F.col("text").rlike("[a-z]@[a-z]+[0-9.]+example")).count() == 0
    assert corpus_pipeline.run(spark, SF).filter("n_tokens is null").count() == 0
