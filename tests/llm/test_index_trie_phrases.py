"""Exact duplicates, conversation prefixes and collocations against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from mixlume.llm import exact_dup, phrases, prefix_trie, queries

LONG = " ".join(f"w{i % 977}" for i in range(60000))
TEXTS = [
    (1, "a b c"), (2, "abc "), (3, " a\tb\nc\r"), (4, "a b d"), (5, None), (6, ""), (7, " \n\t\x0b\x0c\r "), (8, LONG), (9, LONG.replace(" ", "  ")), (10, "é x"), (11, "é x"), (12, "x\x1cy"), (13, "xy"),
    (14, "abc"), (14, "abc"), (None, "a  b  c "), (None, "only here"), (None, "only here"), (15, "ABC"), (16, "same length"), (17, "same length"), (16, "same length"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def groups(rows):
    out = defaultdict(list)
    for doc, text in rows:
        out[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, text or ""))
    return out


@pytest.mark.parametrize("bits,capacity", [(64, 1 << 20), (64, 40), (3, 1 << 20), (1, 10)])
def test_exact_duplicates(docs, bits, capacity):
    expected = []
    for body, rows in groups(TEXTS).items():
        best = min(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(body.encode()).hexdigest()
        expected += [(doc, best[0], len(rows), sha) for doc, _ in rows]
    got = exact_dup.exact_duplicates(docs, capacity, bits).collect()
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got))) == sorted(map(str, expected))
    kept = [(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert len(kept) == len(groups(TEXTS)) == len({sha for _, sha in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_of_rows_with_clashing_columns(docs):
    names = ["row", "h", "n", "body", "best", "chars", "slot", "bucket", "text_sha256", "c0", "a.b", "tick`s"]
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    out = exact_dup.deduplicate(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert sorted(rows[0][2:]) == sorted(f"own {c}" for c in names)
    expected = [max(rows, key=lambda r: (len(r[1]), r[0] is not None, -(r[0] or 0))) for rows in groups(TEXTS).values()]
    assert sorted(map(str, ((r["doc_id"], r["text"] or "") for r in rows))) == sorted(map(str, expected))
    assert exact_dup.deduplicate(wide.limit(0)).count() == 0


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    rng = random.Random(3)
    rows = [(rng.getrandbits(64) - 2**63, rng.randint(1, 9)) for _ in range(500)] + [(7, 10_000), (7, 10_000), (8, 1)]
    entries = spark.createDataFrame(rows, "h long, size long")
    depth, slots = exact_dup.directory(entries, 60)
    bucket = dict(zip(*[slots.column(k).to_pylist() for k in range(2)]))
    assert len(bucket) == 2**depth
    loads = defaultdict(dict)
    for h, size in rows:
        loads[bucket[(h % 2**64) >> (64 - depth)]][h] = size
    assert all(sum(x.values()) - max(x.values()) <= 60 for x in loads.values())
    spans = defaultdict(list)
    for slot, b in bucket.items():
        spans[b].append(slot)
    assert all(max(s) - min(s) + 1 == len(s) and len(s) & (len(s) - 1) == 0 for s in spans.values())
    assert any(len(s) > 1 for s in spans.values())  # local depths differ
    assert exact_dup.directory(entries, 60, most_bits=2)[0] == 2


def conversations():
    rng = random.Random(5)
    rows = []
    for c in [0, 1, 2, 3, 5, 40, 99, 100, 101, 150, 299, 301, 399, -1, -7, 1000, 12345, 12399]:
        rows += [(c, k, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 2)}é" * rng.randint(0, 2)) for k in range(rng.choice([1, 2, 5, 7, 8, 9, 16, 17, 41]))]
    rows += [(c, k, "user", "copy") for c in (700, 701, 702, 703) for k in range(24)]
    rows += [(800, None, None, None), (800, None, "b", None), (800, 3, "x", "tie"), (800, 3, "x", "tie"), (800, 3, "a", "tie"), (801, 0, "", ""), (None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


def brute_trie(rows, rebuild):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        donor = int(c / 100) * 100
        built[c] = (turns.get(donor, [])[:h] if rebuild else []) + own[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        saved, leaves = ((len(members[node]) - 1) * len(node[-1][1]) if node else 0), not children[node]
        for child in children[node]:
            s, n = under(child)
            saved, leaves = saved + s, leaves + n
        return saved, int(leaves)

    out = []
    for node, convs in members.items():
        saved, leaves = under(node)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("rebuild", [True, False])
def test_prefix_trie(spark, rebuild, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("id", "key", "block", "level", "donor", "last", "t1", "rows")})
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(table, rebuild).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_trie(rows, rebuild)))
    assert prefix_trie.trie(table.limit(0), rebuild).count() == 0


def test_prefix_trie_of_turnless_conversations(spark):
    """One turn, which rebuilding replaces by a donor that isn't there: only the root is left, and it is a leaf."""
    lone = next(c for c in range(1, 99) if prefix_trie.head_turns(c) > 0)
    table = spark.createDataFrame([(lone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(table).collect()] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def brute_phrases(rows, least, top):
    grams, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                grams[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["The", "the", "OF", "é", "日本", "x\x1cy", "a", "b-c", "d", "'s", " "]
    rows = [(lang, " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\t", "  ", "\n"]) for _ in range(rng.randint(0, 60)))) for lang in ("en", "de", None, "odd\tlang") for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(300))
    rows += [("en", passage + ". ")] * 12 + [("en", f"before {passage}")] * 3 + [("de", passage)] * 9 + [("fr", "round round round " * 30)] + [("en", None), (None, None), ("en", ""), ("en", " .,; ")]
    rows += [("xx", "alone")] * 20 + [("en", LONG)]
    return rows


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, top, monkeypatch):
    monkeypatch.setattr(phrases, "SAMPLED", 2)
    monkeypatch.setattr(phrases, "CUT", 5)
    rows = phrase_rows()
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit("own") for c in ("edge", "n", "deal", "w1", "phrase", "size", "words", "i")})
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r[c] for c in names) for r in phrases.collocations(table, top=top).collect())
    assert got == sorted(brute_phrases(rows, phrases.LEAST, top))
    assert phrases.collocations(table.limit(0)).count() == 0


def test_paths_are_compacted_whole(spark):
    """A repeated passage is few paths; its pairs and triples come back from them."""
    table = spark.createDataFrame([("en", " ".join(f"p{i}" for i in range(200)))] * 10, "lang string, text string")
    flows = phrases._flows(table, 10)
    nodes, edges = flows.where("size = 2").select("lang", "w1", "w2", "n"), flows.where("size = 3").select("lang", "w1", "w2", "w3", "n")
    junctions, paths = phrases._paths(nodes, edges)
    lengths = [len(r["words"]) - 2 for r in paths.collect()]
    assert sum(lengths) == edges.count() == 198 and len(lengths) < 40
    assert junctions.count() + sum(n - 1 for n in lengths) == nodes.count() == 199


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_prefix_trie", "op13_collocations"])
def test_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    got, expected = [tuple(r[c] for c in names) for r in df.collect()], result.fetchall()
    assert sorted(map(str, got)) == sorted(map(str, expected))
