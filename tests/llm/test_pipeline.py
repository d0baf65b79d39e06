"""The pipeline and its stages on rows, against brute force; ids with several texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilia.llm import ann, neardup, queries, repeats, toxicity

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SECRET = "password=Zx81kQp0LmN4"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = [x.lower() if x.isascii() else x for x in words(text)]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_keep(rows, size=5, percent=80):
    """(id, text) kept: the first of each group of linked documents."""
    many = {i for i, _ in rows if len({t or "" for j, t in rows if j == i}) > 1}
    docs = sorted({(i, t) for i, t in rows if i is not None}, key=lambda d: (d[0] in many, d[0]))
    sets = [shingles(t, size) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return {docs[g] for g in set(group)}, [set(d for d, h in zip(docs, group) if h == g) for g in set(group)]


def brute_repeats(rows, width=20):
    """{(id, text): kept text} by windows that start earlier; ids of one text."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = set()
        for a in range(len(w) - width + 1):
            key = tuple(w[a:a + width])
            if key in seen:
                gone.update(range(a, a + width))
            seen.add(key)
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text
    return out


def made():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(60):
        body = [word() for _ in range(r.randint(30, 120))]
        if i % 7 == 3:
            at = r.randint(0, len(body))
            body[at:at] = passage
        if i % 5 == 1:
            body.append(SECRET)
        if i % 2:
            body[3:3] = ["vile", "scum", "filth"] if i % 4 == 1 else ["good", "day", "friend"]
        texts.append(" ".join(body))
    near = texts[4].split()
    near[40 % len(near)] = "changed"
    texts += [texts[2], texts[2], " ".join(near), None, "", "one two"]
    return [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]


def run_stages(spark, rows, toxic, folder):
    spark.createDataFrame(rows, KINDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
        steps[name] = docs.collect()
        docs = spark.createDataFrame(steps[name], docs.schema)
    return steps


def test_every_stage_and_run(spark, tmp_path):
    rows = made()
    toxic = [(i, 1, int("scum" in (t or ""))) for i, t, *_ in rows]
    steps = run_stages(spark, rows, toxic, tmp_path)
    left = {(r.doc_id, r.text) for r in steps["toxicity"]}
    assert left == {(i, t) for i, t, *_ in rows if "scum" not in (t or "")}
    want, groups = brute_keep(sorted(left, key=str))
    kept = {(r.doc_id, r.text) for r in steps["near_duplicates"]}
    assert kept == want and any(len(g) > 1 for g in groups)
    cut = brute_repeats(kept)
    got = {r.doc_id: r.text for r in steps["repeats"]}
    assert got == cut and any(got[i] != t for i, t in kept)
    for r in steps["secrets"]:
        assert SECRET.split("=")[1] not in (r.text or "")
        assert (SECRET in (got[r.doc_id] or "")) or r.text == got[r.doc_id]
    per_doc = {}
    for p in steps["packing"]:
        per_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert per_doc.keys() == got.keys()
    for pieces in per_doc.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.start) for p in whole if p.start == 0) == sorted((i, 0) for i in got)


def test_stages_take_empty_tables(spark, tmp_path):
    assert all(rows == [] for rows in run_stages(spark, [], [], tmp_path).values())


def test_different_texts_of_one_id_are_kept_and_copies_go(spark):
    r = random.Random(1)
    text = lambda: " ".join(str(r.randint(0, 9_999)) for _ in range(30))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, c), (1, a), (3, a), (None, a), (4, None), (4, ""), (5, c)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], KINDS)
    got = sorted(((x.doc_id, x.text) for x in neardup.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, b), (2, c), (3, a), (None, a), (4, None), (4, "")], key=repr)


def test_one_id_on_very_many_texts(spark):
    """No text of the id is lost or meets another's spans."""
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, " ".join(f"w{i}x{j}" for j in range(r.randint(1, 25)))) for i in range(10_000)]
    rows += [(0, passage), (1, f"head {passage} tail"), (2, passage)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], KINDS)
    got = {(x.doc_id, x.text): x.kept_text for x in repeats.remove_repeats(docs, "lang").collect()}
    assert got[(1, rows[10_001][1])] == "head tail" and got[(2, passage)] == "" and got[(0, passage)] == passage
    assert all(got[x] == x[1] for x in rows[:10_000])
    assert {(x.doc_id, x.text) for x in neardup.keep_one(docs).collect()} >= set(rows[:10_000])
    clash = docs.select("doc_id", "text", F.lit("c").alias("version"), F.lit("d").alias("row"), F.lit("e").alias("n_words"))
    out = repeats.remove_repeats(clash.limit(50), "version", "row", "n_words")
    assert {(x.version, x.row) for x in out.collect()} == {("c", "d")}


@pytest.mark.parametrize("copies", [1, 40])
def test_the_label_sample_is_bounded_in_texts(spark, copies):
    rows = [(i, f"text {i} {j}") for i in range(20) for j in range(copies)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    got = toxicity.sample(docs, labels, 7).collect()
    assert sorted(r.toxic for r in got) == [0] * 7 + [1] * 7 and len({(r.doc_id, r.version) for r in got}) == 14


def test_vectors_of_every_length_are_searched(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(100 * i, r.normal(size=4).tolist(), 0) for i in range(5)] + [(i, r.normal(size=3).tolist(), 0) for i in range(1, 20)]
    rows += [(500, rows[7][1], 0), (501, [], 0), (502, None, 0), (503, [0.0] * 4, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for x in queries.op7_ann(spark, str(tmp_path)).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    own = {i: np.float32(v).astype(float) for i, v, _ in rows if v and any(v)}
    want = {}
    for q, v in own.items():
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in own.items() if i != q and len(w) == len(v))
            want[q] = [(n + 1, i) for n, (_, i) in enumerate(near[:10])]
    assert {q: sorted(v) for q, v in got.items()} == want and len(want) == 6
    assert ann.usable(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).count() == len(own)
