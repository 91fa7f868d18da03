"""Each operator against a brute-force version or an exact round trip on small fixtures, with null, empty, long, repeated and clashing rows."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from mixlume.llm import decontaminate, fingerprints, lang_id, line_dedup, near_dup, packing, pii, token_counts, token_files, toxicity
from mixlume.llm.tokens import WordEncoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all today", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all today", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, "   \n\t ", "b"),
    (6, "Don't <|endoftext|> a\x1cb ²3 aª Ünï é ΣΑΣ 日本語 12,345 ''s foo's x ÀÉ×÷ 😀", "b"),
    (7, "one two", "b"),
    (7, "one two", "b"),
    (8, " ".join(f"w{i % 977}" for i in range(30000)), "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_decontamination(spark, docs, empty):
    words = AWKWARD[8][1].split()
    items = [("q1", " ".join(words[100:115])), ("q2", "One, TWO!"), ("q3", None), ("q4", "..."), (None, "lazy dog and runs away from it all today yes"), ("q5", "lazy dog")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams: dict[tuple, set] = {}
    for item, text in items:
        w = pattern.findall(lower(text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).update({item} - {None})
    expected = []
    for doc, text, _ in AWKWARD:
        w, hit, found = pattern.findall(lower(text or "")), set(), set()
        for gram, owners in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit.update(range(i, i + len(gram)))
                    found |= owners
        expected.append((doc, len(w), len(hit), len(found), decontaminate.digest(list(found)), bool(hit)))
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == sorted(expected)
    # The same in many parts, with clashing column names.
    clash = docs.withColumnRenamed("source", "decon_items")
    one = decontaminate.scan(docs, bench).select("doc_id", "decon_ranges", "decon_items", "decon_spans").collect()
    many = decontaminate.scan(clash, bench, most_bytes=60).select("doc_id", "decon_ranges", "decon_items", "decon_spans").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    for row in decontaminate.scan(docs, bench).where("doc_id = 7").collect():
        assert row["decon_spans"] == [0, 7]
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = sorted(e[0] for e in expected if not e[5])
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == clean


def test_encoder_is_exact():
    encode, tokenizer = WordEncoder(TOKENIZER, most=50), Tokenizer.from_file(TOKENIZER)
    texts = [t or "" for _, t, _ in AWKWARD] + ["İstanbul ǅ ﬁ ½ ß", "é é àb", "<|ENDOFTEXT|> x", "a b c"]
    for text, ids in zip(texts, encode.ids([t.encode() for t in texts])):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_token_counts(spark, docs, empty):
    encode, tokenizer = WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(5)
    for _, text, _ in AWKWARD[:8]:
        tree, now = token_counts.TokenTree(text or "", encode), text or ""
        for _ in range(25):
            start, length = int(rng.integers(0, len(now) + 3)), int(rng.choice([0, 1, 7, 60]))
            new = str(rng.choice(["", " ", "zz", "a b c\n", (text or "q")[:50]]))
            at = min(start, len(now))
            now = now[:at] + new + now[at + length :]
            assert tree.edit(start, length, new) == len(tokenizer.encode(now, add_special_tokens=False).ids)
            assert tree.text() == now
    long = token_counts.TokenTree(AWKWARD[8][1], encode)
    before = long.encoded
    long.edit(5000, 3, "abc")
    assert long.encoded - before < 2000
    edits = spark.createDataFrame([(1, 1, 4, 5, "slow"), (1, 2, 0, 0, "x "), (99, 1, 0, 0, "y"), (3, 1, 0, None, None)], "doc_id long, seq int, start long, length long, replacement string")
    got = {r["doc_id"]: r for r in token_counts.count_edits(docs, edits, TOKENIZER).collect()}
    assert got[1]["edited_sha256"] == hashlib.sha256(b"x the slow" + AWKWARD[0][1][9:].encode()).hexdigest()
    assert got[3]["n_tokens"] == got[3]["n_tokens_edited"] == 0 and got[7]["n_edits"] == 0
    assert token_counts.report(empty, TOKENIZER).count() == 0


def test_pii(spark, empty):
    rows = [
        (1, "a@b.c_d@e.f x 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4 é mail me: x.y+z@host-1.example.org."),
        (2, "pay by card 4111 1111 1111 1111 or 4111-1111-1111-1112, IBAN GB82 WEST 1234 5698 7654 32 or DE89370400440532013001, call +49 (0)30 1234-567. +1 2 "),
        (3, None), (4, ""), (5, "1" * 20000 + " " + "a.b" * 9000 + "@x.y " + "p@q.r " * 3000 + "+1 " + "2 " * 9000), (1, "repeated a@b.cd"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def luhn(m: str) -> bool:
        ds = [int(c) for c in m if c.isdigit()]
        return 13 <= len(ds) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(ds))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    }
    got = [(r["doc_id"], r["base_sha256"]) for r in pii.report(docs).collect()]
    expected = []
    for doc, text in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])] if doc != 5 else None
        if spans is not None:
            expected.append((doc, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(x for x in got if x[0] != 5) == sorted(expected)
    two = pii.find(docs.where("doc_id = 2")).first()["pii_spans"]
    assert [s["kind"] for s in two] == ["card", "phone", "iban"]
    assert [round(s["score"], 2) for s in two] == [0.9, 0.7, 1.0]
    assert pii.report(docs.where("doc_id = 5")).first()["n_email"] == 3001
    assert pii.report(empty.drop("source")).count() == 0
    near = spark.createDataFrame([("lorem ipsum at 10.0.0.1",), ("the ip is 10.0.0.1",), ("they tell +4930123456789",), ("tel. +4930123456789",)], "text string")
    assert [round(pii.find(near).collect()[k]["pii_spans"][0]["score"], 2) for k in range(4)] == [0.5, 0.7, 0.5, 0.7]


def brute_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [(rows[i][0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))) for i in range(len(rows))]


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in range(120)]
    rows = [(d, t) for d, t, _ in AWKWARD[:8]]
    for k in range(60):  # copies of one text with up to three changed words: links near the threshold, chains, and more than one bucket block
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(0, 3)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(300 + k, " ".join(f"u{k}_{i}" for i in range(30))) for k in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(brute_components(rows))
    old = near_dup.BLOCK
    try:
        for near_dup.BLOCK in (8, old):
            got = near_dup.near_duplicates(table).select("doc_id", "n_shingles", "component_id").collect()
            assert sorted(map(tuple, got)) == expected
    finally:
        near_dup.BLOCK = old
    assert near_dup.near_duplicates(empty).count() == 0
    kept = sorted(r["doc_id"] for r in near_dup.deduplicate(docs).select("doc_id").collect())
    assert kept == [1, 3, 4, 5, 6, 7, 7, 8]
    least = near_dup.least_matches()
    assert all(a < b for a, b in zip(least, least[1:])) and least[-1] < 0.85 * near_dup.BANDS * near_dup.ROWS


def test_large_bucket_of_a_template_is_split(spark, monkeypatch):
    """Pages that share most of their words fill a bucket of more than a block; near copies among them are linked, the rest stay apart."""
    rng = np.random.default_rng(7)
    frame = [f"t{i}" for i in range(90)]
    own = [[f"p{k}_{i}" for i in range(24)] for k in range(40)]
    rows = [(k, " ".join(frame[:45] + own[k] + frame[45:])) for k in range(40)]
    for k in range(40, 55):  # a copy of an earlier page, or of a copy, with its last own words changed
        own.append(own[rng.integers(0, k)][:22] + [f"q{k}", f"r{k}"])
        rows.append((k, " ".join(frame[:45] + own[k] + frame[45:])))
    rows += [(60 + k, rows[k][1]) for k in range(3)]
    calls, slots = [], near_dup._slots
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "_slots", lambda texts: calls.append(1) or slots(texts))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows)) and calls
    assert 10 < len({r["component_id"] for r in got}) <= 40


def near_copies(n):
    """Copies of one text with up to five words changed, each in its own way, and copies of copies: many are linked with none."""
    rng = np.random.default_rng(13)
    words = [[f"t{i}" for i in range(150)]]
    for k in range(1, n):
        words.append(list(words[0] if k % 4 else words[rng.integers(0, k)]))
        for at in rng.integers(0, 150, rng.integers(1, 6) if k % 4 else 1):
            words[-1][at] = f"x{k}_{at}"
    return [(k, " ".join(w)) for k, w in enumerate(words)]


def test_compared_rows_grow_with_a_group_of_near_copies(spark, monkeypatch, tmp_path):
    """Twice the near copies are about twice the rows that are compared in blocks, not four times."""
    compared, folder = near_dup._spanning, str(tmp_path)

    def counted(group, percent):
        with open(f"{folder}/{uuid.uuid4().hex}-{group.num_rows}", "w"):
            return compared(group, percent)

    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "_spanning", counted)
    rows = []
    for n in (120, 240):
        table = near_copies(n)
        got = near_dup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == sorted(brute_components(table))
        assert 10 < len({r["component_id"] for r in got}) < 0.9 * n
        rows.append(sum(int(x.name.rpartition("-")[2]) for x in tmp_path.iterdir()) - sum(rows))
    assert 0 < rows[1] <= 2.6 * rows[0]


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_linked_sets_differ_from_any_reference_in_a_common_hash(percent):
    """Unless both are near: sets of a near-copy group and unrelated ones, with the majority, a member, nothing and an unrelated set as reference."""
    rng = np.random.default_rng(percent)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
    slots = rng.integers(0, 9, 1 << near_dup.SLOT_BITS)
    linked = apart = 0
    for n in (1, 3, 12, 60, 150):
        sets = [draw(n)]
        for _ in range(60):
            a = sets[rng.integers(0, len(sets))] if rng.random() < 0.5 else sets[0]
            sets.append(np.union1d(a[rng.random(len(a)) > rng.choice([0, 0.03, 0.1, 0.2])], draw(rng.integers(0, 2 + n // 8))))
        sets = [x for x in [*sets, draw(n)] if len(x)]
        found, k = np.unique(np.concatenate(sets), return_counts=True)
        for ref in (found[2 * k > len(sets)], sets[0], sets[-1], found[:0], draw(n)):
            differences = [np.setxor1d(x, ref, assume_unique=True) for x in sets]
            e = [near_dup.excess(len(d), len(x), percent) for d, x in zip(differences, sets)]
            m = int(np.argmin(e))
            keys = [near_dup.difference_prefix(d, x, e[m], slots, percent) for d, x in zip(differences, e)]
            near = [x + e[m] <= 0 for x in e]
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    if i != j and 100 * both >= percent * (len(x) + len(y) - both):
                        linked += 1
                        assert near[i] and near[j] or len(np.intersect1d(keys[i], keys[j])) or np.array_equal(x, y)
                    elif i != j:
                        apart += 1
                        assert not (near[i] and j == m)
    assert linked and apart


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """Each node gets the smallest it reaches; few edges are written once, edges of several tasks meet in rounds."""
    rng = np.random.default_rng(11)
    nodes = [bytes([k // 256, k % 256]) for k in rng.permutation(400)]
    pairs = [(nodes[k], nodes[k + 1]) for k in range(60)] + [(nodes[100 + rng.integers(0, 200)], nodes[100 + rng.integers(0, 200)]) for _ in range(120)] + [(nodes[350], nodes[350])]
    parent = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in parent:
        for a, b in pairs:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    expected = sorted(parent.items())
    edges = spark.createDataFrame(pairs, "a binary, b binary").repartition(7).localCheckpoint()
    written, materialize = [], near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    for size, rounds in ((200_000, False), (30, True)):
        monkeypatch.setattr(near_dup, "TASK_EDGES", size)
        written.clear()
        assert sorted((bytes(r["node"]), bytes(r["label"])) for r in near_dup.components(edges).collect()) == expected
        assert (len(written) > 1) == rounds


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_linked_sets_share_a_rare_hash(percent):
    rng = np.random.default_rng(percent)
    slots = rng.integers(0, 9, 1 << near_dup.SLOT_BITS)
    for n in (1, 2, 7, 40, 200):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 1 + n // 10), dtype=np.int64).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(near_dup.rare_prefix(a, slots, percent), near_dup.rare_prefix(b, slots, percent)))


def test_long_text_hashes_by_chunks():
    text = AWKWARD[8][1].encode()
    old = near_dup.CHUNK
    whole = near_dup.shingle_sets([text])[0]
    try:
        near_dup.CHUNK = 101
        assert (near_dup.shingle_sets([text])[0] == whole).all()
    finally:
        near_dup.CHUNK = old
    assert len(whole) == len({tuple(text.split()[i : i + 5]) for i in range(len(text.split()) - 4)})


def test_memory_of_a_block(monkeypatch):
    """A block's texts are hashed about 1 MB at a time, also those of one long text; nothing of the block's size is kept in the worker."""
    rng, least = np.random.default_rng(5), 1 << 20
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 50_000)).encode() for _ in range(6)]
    texts = [x for text in texts for x in (text, text + b" tail")]
    signed = near_dup._signatures(pa.array(texts, pa.binary()))
    block = pa.table({"cls": pa.array(signed["cls"]), "label": pa.array(signed["cls"]), "block": pa.array([0] * len(texts)), "sig": pa.array(signed["sig"]), "text": pa.array(texts, pa.binary())})
    near_dup._hasher.cache_clear()
    hashed, hash_units = [], near_dup._hash_units
    monkeypatch.setattr(near_dup, "_hash_units", lambda units, sizes: hashed.append(sum(sizes)) or hash_units(units, sizes))
    links = near_dup._spanning(block, near_dup.PERCENT).to_pylist()
    assert sorted(map(sorted, (x.values() for x in links))) == sorted(map(sorted, zip(signed["cls"][::2], signed["cls"][1::2])))
    assert sum(map(len, texts)) > 4 * least and len(near_dup._hasher().up) < 2 * least and max(hashed) < 2 * near_dup.CHUNK + near_dup.SHINGLE
    near_dup.shingle_sets([b" ".join(texts)])
    assert len(near_dup._hasher().up) < 2 * least


def test_line_dedup(spark, empty):
    rows = [(i, f"Menu\nstory {i}\n\n  Menu \nend {i % 2}", "h1") for i in range(30)] + [(40, "Menu\nalone", "h2"), (41, None, "h1"), (42, "", "h1"), (43, "Menu", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.mark(docs, least=5).collect()}
    assert got[3]["line_text"] == "story 3\n" and (got[3]["line_total"], got[3]["line_dropped"]) == (5, 3)
    assert got[40]["line_text"] == "Menu\nalone" and got[41]["line_text"] is None and got[42]["line_text"] == "" and got[43]["line_text"] == "Menu"
    # The ratio alone, against plain Python.
    for ratio in (0.02, 0.4, 0.6):
        pages, holding = {}, {}
        for _, text, host in rows:
            if host:
                pages[host] = pages.get(host, 0) + 1
                for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
                    holding[host, line] = holding.get((host, line), 0) + 1
        left = {d: None if t is None else "\n".join(x for x in t.split("\n") if not holding.get((h, x.strip(" \t\r")), 0) > ratio * pages.get(h, 1)) for d, t, h in rows}
        assert {r["doc_id"]: r["line_text"] for r in line_dedup.mark(docs, ratio=ratio).collect()} == left
    assert line_dedup.deduplicate(docs).columns == docs.columns
    assert line_dedup.report(empty).count() == 0
    url = spark.createDataFrame([("HTTP://u@Ex.com:80/a?b",), ("x",), (None,)], "u string").select(line_dedup.host_of("u").alias("h"))
    assert [r["h"] for r in url.collect()] == ["ex.com", None, None]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 2**32])
def test_segments_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype("<u4")
    if n > 10:
        ids[::37] = high - 1
    data = token_files.encode_segment(ids)
    assert (token_files.decode_segment(data) == ids).all()
    for block in range(-(-n // 128)):
        assert (token_files.decode_block(data, block) == ids[128 * block : 128 * block + 128]).all()


def test_token_files(spark, docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = sorted(map(tuple, token_files.round_trip(docs, TOKENIZER).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    start, expected = 0, []
    for doc, text, _ in AWKWARD:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert token_files.round_trip(empty, TOKENIZER).count() == 0


def test_lang_id(spark, empty):
    en, de = "the cat and the dog with this that then ", "der hund und die katze nicht schon sch ein "
    rows = [(k, (en if k % 2 else de) * 3, "en" if k % 2 else "de") for k in range(40)] + [(90, None, "en"), (91, "12 34 !!", None), (92, "", "de"), (93, en * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lang_id.report(docs).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(40)) and got[93]["lang_pred"] == "en"
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (90, 91, 92))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert lang_id.report(empty.withColumnRenamed("source", "lang")).count() == 0
    # Parts of a model give what the whole gives; predictions and scores are those of plain cosines.
    labelled = docs.where("lang is not null").select("lang", "text")
    whole = lang_id.fit(labelled)
    parted = lang_id.fit(labelled.unionByName(docs.limit(1).select(F.lit("xx").alias("lang"), F.lit("zzz qqq").alias("text"))), part=1)
    one, many = (sorted(map(tuple, lang_id.predict(docs, m).select("doc_id", "lang_pred", F.round("lang_score", 5)).collect())) for m in (whole, parted))
    assert len(parted) == 3 and one == many
    sums = {x: lang_id._bundles([t.encode() for _, t, y in rows if y == x and t], np.zeros(sum(1 for _, t, y in rows if y == x and t), int), 1, lang_id.DIM)[0] for x in ("en", "de")}
    for k, (name, score) in {k: (r["lang_pred"], r["lang_score"]) for k, r in ((r["doc_id"], r) for r in lang_id.predict(docs.where("doc_id < 4"), whole).collect())}.items():
        b = lang_id._bundles([rows[k][1].encode()], np.zeros(1, int), 1, lang_id.DIM)[0]
        cosine = {x: float(b @ v / np.linalg.norm(b) / np.linalg.norm(v)) for x, v in sums.items()}
        assert name == max(cosine, key=cosine.get) and abs(score - cosine[name]) < 1e-5
    # A bundle is the sum of its trigrams' bound vectors.
    codes, owner, index = lang_id.trigrams([b"Abc"])
    vectors = lang_id._letters(64)
    total = lang_id._bundles([b"Abc"], np.zeros(1, int), 1, 64)[0]
    v = {c: vectors(np.array([ord(c)]))[0] for c in " abc"}
    brute = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in (" ab", "abc", "bc "))
    assert len(codes) == 3 and np.allclose(total, brute)


_KEPT: dict = {}


def kept(spark, text: str) -> set[int]:
    """The shingle hashes of a text that the fixed fraction keeps, shingle by shingle."""
    if text not in _KEPT:
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if x]
        shingles = list(dict.fromkeys(tuple(w[i : i + 5]) for i in range(len(w) - 4))) if len(w) >= 5 else [(" ".join(w),)] if w else []
        rows = spark.createDataFrame([list(x) for x in shingles], ",".join(f"w{k} string" for k in range(len(shingles[0])))) if shingles else None
        hashes = [r["h"] & 0x7FFFFFFFFFFFFFFF for r in rows.select(F.xxhash64(*rows.columns).alias("h")).collect()] if shingles else []
        _KEPT[text] = {h for h in hashes if h < 2**63 // fingerprints.SCALE}
    return _KEPT[text]


def test_fingerprints(spark, docs, empty):
    rows = [(d, t) for d, t, _ in AWKWARD if d != 7] + [(7, "one two"), (5000, "far away " * 9), (90000, None), (90001, ""), *[(200 + k, f"tiny {k}") for k in range(12)]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts, reverse=True)
    for width in (3, 1024):
        got = {r["doc_id"]: r for r in fingerprints.report(table, width=width).collect()}
        assert len(got) == len(rows)
        for i, doc in enumerate(order):
            text, following = texts[doc], texts[order[(i + 1) % len(order)]]
            edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
            assert got[doc]["n_chars"] == len(text) and got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            mine, other, after = (kept(spark, x) for x in (text, edited, following))
            assert got[doc]["fingerprint"] == "".join(f"{h:016x}" for h in sorted(mine)) and got[doc]["edited_fingerprint"] == "".join(f"{h:016x}" for h in sorted(other))
            alike = lambda a, b, same: len(a & b) / len(a | b) if a | b else float(same)
            assert got[doc]["near_edited"] == alike(mine, other, text == edited) and got[doc]["near_next"] == alike(mine, after, text == following)
        assert got[1]["fingerprint"] == got[2]["fingerprint"] != "" and got[2]["near_next"] == 1.0 and got[4]["fingerprint"] == "" and len({got[200 + k]["fingerprint"] for k in range(12)}) > 4
    assert fingerprints.report(empty).count() == 0
    keys = [1, 2, 3, 700, 701, 9000, 123456, 10**9]
    found = fingerprints._next_lower(spark.createDataFrame([(k,) for k in keys], "key long"), 10**7, 10)
    assert sorted((r["key"], r["lower"]) for r in found.collect()) == list(zip(keys, [None, *keys[:-1]]))


def test_fingerprints_of_short_texts_that_share_half(spark):
    words = lambda k, part: " ".join(f"{part}{k}q{i}" for i in range(25))
    rows = [(k, f"{words(k, 'a')} {words(k, 'b')}", f"{words(k, 'a')} {words(k, 'c')}") for k in range(60)]
    pairs = spark.createDataFrame(rows, "k long, a string, b string")
    for name in "ab":
        pairs = fingerprints.with_sketch(pairs, name, f"s{name}")
    got = [r["x"] for r in pairs.select(fingerprints.likeness(F.col("sa"), F.col("sb"), F.col("a") == F.col("b")).alias("x")).collect()]
    assert min(got) > 0 and abs(sum(got) / len(got) - 21 / 71) < 0.05


def test_sketches_of_parts_lie_within_the_whole(spark):
    rows = [(f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}", f"h{k} i{k} j{k} k{k} l{k}") for k in range(200)]
    parts = spark.createDataFrame(rows, "a string, b string").withColumn("ab", F.concat_ws(" ", "a", "b"))
    for name in ("a", "b", "ab"):
        parts = fingerprints.with_sketch(parts, name, f"s_{name}")
    assert parts.where("size(array_except(array_union(s_a, s_b), s_ab)) > 0").count() == 0


def test_packing(spark, docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER).toPandas()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _ in AWKWARD}
    assert got["length"].sum() == sum(len(ids[d]) for d, _, _ in AWKWARD)
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    bins = got.sort_values(["sequence_id", "offset"])
    assert (bins.groupby("sequence_id")["length"].cumsum() - bins["length"] == bins["offset"]).all()
    assert bins.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got.sequence_id.nunique() == -(-int(got["length"].sum()) // 2048)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(0)
    for _ in range(5):
        lengths = rng.integers(1, 60, 400)
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        plan = packing.patterns(histogram, 100)
        used = {}
        for times, bin_ in plan:
            assert sum(bin_) <= 100
            for x in bin_:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        assert sum(t for t, _ in plan) <= -(-int(lengths.sum()) // 100) + 1
    assert sorted(packing._fullest({7: 1, 5: 2, 3: 1}, 13)) == [3, 5, 5]


def test_toxicity(spark, empty):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu") for b in ("na", "le", "mo") for c in ("x", "s", "nd")]
    rows, labels = [], []
    for k in range(400):
        text = [str(w) for w in rng.choice(words, 80)]
        toxic = int(k % 4 == 0)
        if toxic:
            for at in rng.integers(0, 80, 4):
                text[at] = str(rng.choice(["horrid", "vile"]))
        rows.append((k, " ".join(text)))
        labels.append((k, toxic))
    rows += [(900, None), (901, ""), (902, " ".join("vile" if i % 30 == 7 else words[(i * i + i // 7) % len(words)] for i in range(20000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, None), (77777, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs, marks).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] for k in held)
    assert np.mean([got[k]["predicted"] == labels[k][1] for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[902]["predicted"] == 1 and got[900]["predicted"] == got[901]["predicted"] == 0
    # Scores by plain calls of the compressor on each window.
    model = toxicity.fit(docs, marks.where(~toxicity.held_out()))

    def length(content: bytes, window: bytes) -> int:
        params = zstandard.ZstdCompressionParameters(window_log=15, hash_log=13, chain_log=13, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content.rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))

    for k in (0, 1, 4, 900):
        words, over, n = (dict(map(lambda r: (r[0], r[1]), rows))[k] or "").split(), 0, 0
        for i in range(0, len(words), toxicity.WINDOW):
            w = (" " + " ".join(words[i : i + toxicity.WINDOW]) + " ").encode() * 2
            over, n = over + max(0, length(model.ordinary, w) - length(model.toxic, w) - model.gain + 1), n + 1
        d = over / (n + toxicity.SMOOTH)
        assert abs(got[k]["score"] - (d / (d + model.threshold) if d else 0)) < 1e-12
    assert toxicity.report(docs, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.report(empty, marks).count() == 0
    assert toxicity.reject(docs.withColumn("tox", docs.doc_id), marks).columns == ["doc_id", "text", "tox"]
