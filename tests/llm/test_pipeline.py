"""The pipeline's stages, each on what the one before kept, against plain Python."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from mixlume.llm import line_dedup, near_dup, queries, toxicity


def test_stages_and_registration(spark, tmp_path):
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu") for b in ("na", "le", "mo", "sin", "dur")]
    text = lambda k: " ".join(words[(k * 7 + i * i * (k % 5 + 1)) % len(words)] + str((k * i) % 11) for i in range(60))
    rows = [(k, f"{text(k)}\nAll rights kept here", "en", f"s{k % 2}", 0) for k in range(60)]
    rows.append((100, rows[5][1], "en", "s1", 0))
    leak = " ".join(f"leak{i}" for i in range(12))
    rows.append((101, f"{text(91)} {leak}", "en", "s0", 0))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        if name != "packing":
            assert docs.columns == before
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    every = {r[0] for r in rows}
    assert kept["toxicity"] == kept["line_dedup"] == every
    assert kept["near_dedup"] == every - {100}
    assert kept["decontamination"] == kept["packing"] == every - {100, 101}
    assert not [r for r in spark.read.parquet(f"{folder}/out-line_dedup").collect() if r["doc_id"] < 60 and "rights" in r["text"]]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == kept["packing"]
    assert sorted(queries.QUERIES) == sorted(f.__name__ for f in queries._ALL) and len(queries._ALL) == 13


def test_copies_that_make_up_most_of_a_source_keep_their_text(spark):
    line = lambda k, i: " ".join(f"{'abcdefgh'[(k + i) % 8]}{k}x{i}x{j}" for j in range(12))
    body = lambda k: [line(k, i) for i in range(8)]
    note = "All rights kept here"
    rows = [(k, "\n".join([*body(k), note])) for k in range(60)]
    rows += [(100 + k, "\n".join([*body(500), note])) for k in range(50)]
    near = {200 + k: [*body(600)[:7], line(600, 7).rsplit(" ", 1)[0] + f" end{k}"] for k in range(50)}
    rows += [(k, "\n".join([*lines, note])) for k, lines in near.items()]
    docs = spark.createDataFrame([(k, t, "en", "s0", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.line_dedup_stage(spark, docs, "")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup_stage(spark, cut, "").collect()}
    assert kept == {k: "\n".join(near[k] if k in near else body(500 if k == 100 else k)) for k in [*range(60), 100, 200]}


def test_near_dedup_stage_links_from_eighty_percent(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; each changed word far from the others changes five of each side: 90 / 110 and 85 / 115
    texts = [words, [*words[:20], "x", *words[21:60], "y", *words[61:]], [*words[:20], "p", *words[21:50], "q", *words[51:80], "r", *words[81:]]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2]
    assert near_dup.deduplicate(docs).count() == 3
    assert [near_dup.band_count(p) for p in (85, 80)] == [near_dup.BANDS, 35] and len(near_dup.least_matches(percent=80)) == 35 * near_dup.ROWS // near_dup.BATCH


def _words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _components(docs: dict) -> dict:
    """doc_id: smallest doc_id reachable over links of 80 % of the word shingles; documents without words are their own."""
    sets = {}
    for k, text in docs.items():
        w = _words(text, r"[^\x20\x09-\x0D]+")
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    out = {k: k for k in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    out[a] = out[b] = min(out[a], out[b])
    return out


def _brute(rows, bench, model):
    """(doc_id: text) that is packed, stage by stage in plain Python."""
    gains = toxicity._Gains(model.toxic, model.ordinary)
    score = {k: toxicity.distance(gains(t.encode()), model.gain) for k, t, _ in rows}
    kept = {k: (t, host) for k, t, host in rows if not score[k] or score[k] / (score[k] + model.threshold) < 0.5}
    groups = _components({k: t for k, (t, _) in kept.items()})
    pages, holding = {}, {}
    for k, (t, host) in kept.items():
        pages.setdefault(host, set()).add(groups[k])
        for line in {x.strip(" \t\r") for x in t.split("\n")} - {""}:
            holding.setdefault((host, line), set()).add(groups[k])
    boilerplate = {key for key, held in holding.items() if len(held) >= corpus_pipeline.LEAST_PAGES and len(held) > line_dedup.RATIO * len(pages[key[0]])}
    cut = {k: "\n".join(x for x in t.split("\n") if (host, x.strip(" \t\r")) not in boilerplate) for k, (t, host) in kept.items()}
    groups = _components(cut)
    cut = {k: t for k, t in cut.items() if groups[k] == k}
    grams = set()
    for _, text in bench:
        w = _words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = lambda w: not any(tuple(w[i : i + len(g)]) == g for g in grams for i in range(len(w) - len(g) + 1))
    return {k: t for k, t in cut.items() if clean(_words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))}


def test_run_against_plain_python(spark, tmp_path):
    rng = np.random.default_rng(6)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu") for b in ("na", "le", "mo") for c in ("x", "s", "nd", "lo")]
    rows, labels = [], []
    for k in range(120):
        text = [str(w) for w in rng.choice(vocabulary, 60)]
        if k % 3 == 0:
            for at in rng.integers(0, 60, 5):
                text[at] = str(rng.choice(["horrid", "vile"]))
            text = ["horrid", *text]
        lines = [" ".join(text[i : i + 20]) for i in range(0, 60, 20)] + ["All rights kept here"] * (k % 2)
        rows.append((k, "\n".join(lines), f"s{k % 2}"))
        labels.append((k, int(k % 3 == 0)))
    rows += [(200 + k, rows[1][1], "s1") for k in range(4)]  # copies
    rows += [(300, rows[2][1].replace(rows[2][1].split()[30], "changed", 1), "s0"), (400, "leak " + " ".join(f"w{i}" for i in range(12)), "s0"), (401, "", "s1"), (402, "short item", "s0")]
    bench = [("q", " ".join(f"w{i}" for i in range(11))), ("r", "Short, item!")]
    folder = str(tmp_path)
    spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    left = _brute(rows, bench, toxicity.fit(docs, marks.where(~toxicity.held_out())))
    assert 30 < len(left) < 90 and not left.keys() & {200, 400, 402} and 401 in left
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    expected = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in left.items()}
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == expected
