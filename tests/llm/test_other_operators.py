"""Chat formatting, neighbours, archives, components and the pipeline."""

import base64
import glob
import hashlib
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vigilia.llm import ann, chat, components, fixity, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat ----------------------------------------------------------------------------------

def conversations():
    r = random.Random(1)
    odd = ["", None, "<|end|>", "<\\|says|>", "<\\\\|", "a<", "|>b", "</s>[INST]", "  ", "\n", "é😀", "x" * 4000, "<|turn|>assistant<|says|>"]
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", "system", None, "<|end|>"]), r.choice(odd) if r.random() < .6 else "plain words here"))
    return rows + [(None, 0, "user", "hi"), (None, 0, "assistant", "ho"), (3, None, "assistant", "early"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie")]


def test_conversations_read_back_and_masks_cover_the_assistant(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*x, "clash") for x in rows], "conv_id bigint, turn bigint, role string, text string, turns string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    own = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", own), (-7, 1, "assistant", own)]
    want = {}
    for c in {x[0] for x in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(said), sha(said))
    got = queries.op3_chat(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    made = chat.format_conversations(spark.read.parquet(f"{tmp_path}/conversations.parquet"),
                                     queries._tokenizer("byte_bpe_50k.json")).collect()
    for r in made:
        assert len(r.ids) == len(r.loss_mask) == len(r.token_starts)
        masked = {i for i, m in enumerate(r.loss_mask) if m}
        for i, (a, b) in enumerate(zip(r.token_starts, r.token_ends)):
            assert (i in masked) == any(a < s.end and b > s.start and b > a for s in r.loss_spans)


def test_escapes_are_reversible():
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice(["<", "\\", "|", ">", "a", "<|", "<\\|"]) for _ in range(12))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


# --- neighbours ----------------------------------------------------------------------------

def brute_nearest(vectors, k):
    out = {}
    for q, v in vectors.items():
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in vectors.items() if i != q)[:k]
    return out


def recall(spark, folder, vectors):
    got = {}
    for r in queries.op7_ann(spark, folder).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute_nearest(vectors, 10)
    assert got.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, min(10, len(vectors) - 1) + 1))
        found = [ranks[i] for i in sorted(ranks)]
        assert found == sorted(found)
        assert all(abs(d - float(np.sqrt(((vectors[q] - vectors[i]) ** 2).sum()))) < 1e-12 for d, i in found)
        hits += sum(d <= want[q][-1][0] + 1e-12 for d, _ in found)
        total += len(want[q])
    return hits / total


def test_recall_of_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert recall(spark, sf, {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}) >= 0.9


@pytest.mark.parametrize("kind, most", [("given", .6), ("noise", .3), ("clusters", .05)])
def test_few_vectors_are_verified(kind, most):
    """Recall holds while windows, not distances, rule most vectors out."""
    rng = np.random.default_rng(3)
    if kind == "given":
        vectors = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist(), float)
    elif kind == "noise":
        vectors = rng.standard_normal((8000, 64))
    else:
        vectors = 4 * rng.standard_normal((100, 64))[rng.integers(0, 100, 8000)] + .3 * rng.standard_normal((8000, 64))
    index = ann.Index(np.arange(len(vectors)), vectors)
    asked = range(0, len(vectors), 100)
    hits = 0
    for q in asked:
        want = np.sort(np.delete(np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1)), q))[:10]
        hits += sum(d <= want[-1] + 1e-12 for d, _ in index.search(q, vectors[q], 10))
    assert hits >= .93 * 10 * len(asked)
    assert index.verified <= most * len(vectors) * len(asked)


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    good = {i: rng.integers(-2, 3, 4).astype(float) for i in range(0, 700, 7)}
    good = {i: v for i, v in good.items() if v.any()}
    rows = [(i, v.tolist(), 0) for i, v in good.items()]
    rows += rows[:5] + [(1000, None, 1), (1100, [0.0] * 4, 1), (1200, [1.0, None, 2.0, 0.0], 1), (1300, [float("nan")] * 4, 1),
                        (1400, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [1.0] * 4, 1), (1500, [], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert recall(spark, str(tmp_path), good) >= 0.9


def test_few_or_no_vectors(spark, tmp_path):
    kind = "vec_id bigint, embedding array<float>, label int"
    spark.createDataFrame([(0, [1.0, 2.0], 0), (5, [1.0, 1.0], 0)], kind).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert [tuple(r) for r in queries.op7_ann(spark, f"{tmp_path}/a").collect()] == [(0, 1, 5, 1.0)]
    assert queries.op7_ann(spark, f"{tmp_path}/b").count() == 0


# --- archives ------------------------------------------------------------------------------

ODD_PAGES = [("http://a/b", "<html>é\r\n\r\nx</html>"), (None, None), ("u", ""), ("a b\r\nContent-Length: 3\r\n\r\nx", "y"),
             ("%20\x00\x7f é", "\r\n\r\nWARC/1.1\r\n"), ("", "x" * 70_000)]


def brute_record(url, html):
    url, body = (url or "").encode(), (html or "").encode()
    name = hashlib.sha256(str(len(url)).encode() + b":" + url + body).hexdigest()
    name = f"{name[:8]}-{name[8:12]}-8{name[13:16]}-a{name[17:20]}-{name[20:32]}"
    uri = b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url)
    kept = b"" if uri == url else b"\r\nWARC-X-Original-URI: " + base64.b64encode(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:" + name.encode()
            + b">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: " + uri + kept
            + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n")


def test_records_parse_back(spark):
    raw = spark.createDataFrame(ODD_PAGES, "url string, html string").withColumn("raw", fixity.record(F.col("url"), F.col("html")))
    got = raw.select("url", "html", "raw", fixity.parse(F.col("raw")).alias("p"), fixity.parse(F.expr("substring(raw, 1, octet_length(raw) - 1)")).alias("cut"),
                     fixity.parse(F.expr("substring(raw, 1, 30)")).alias("stump"))
    for r in got.collect():
        assert (r.p.url, r.p.html) == (r.url or "", r.html or "") and r.cut is None and r.stump is None
        assert bytes(r.raw) == brute_record(r.url, r.html)


def test_archives_are_read_back_record_by_record(spark, tmp_path):
    pages = [(i, f"http://s/{i} x", "<p>" + "é" * (i % 50)) for i in range(300)] + [(None, *p) for p in ODD_PAGES] + [(4, "http://s/4 x", "<p>éééé")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5)
    folder = f"{tmp_path}/archive"
    fixity.write_archive(df.select("page_id", fixity.record(F.col("url"), F.col("html")).alias("raw")), folder, 40)
    got = fixity.read_archive(spark, folder).collect()
    assert sorted(bytes(r.raw) for r in got) == sorted(brute_record(u, h) for _, u, h in pages)
    files = {}
    for r in sorted(got, key=lambda r: (r.file, r.start)):
        assert r.start == files.get(r.file, 0)
        files[r.file] = r.start + len(r.raw)
    sizes = [os.path.getsize(x) for x in glob.glob(f"{folder}/part-*")]
    assert sorted(files.values()) == sorted(s for s in sizes if s) and all(sum(r.file == f for r in got) <= 40 for f in files)


def test_a_damaged_file_loses_no_byte_and_one_record_only(spark, tmp_path):
    whole = [brute_record(f"http://s/{i}", "page " * i) for i in range(20)]
    for name, spoil in (("length", lambda x: x.replace(b"Content-Length: ", b"Content-Length: 9", 1)),
                        ("head", lambda x: b"?" + x[1:]), ("cut", lambda x: x[:-9] + b"\r\n\r\n")):
        data = [spoil(x) if i == 7 else x for i, x in enumerate(whole)]
        os.makedirs(f"{tmp_path}/{name}")
        with open(f"{tmp_path}/{name}/a.warc", "wb") as f:
            f.write(b"".join(data))
        got = [bytes(r.raw) for r in fixity.read_archive(spark, f"{tmp_path}/{name}").orderBy("start").collect()]
        assert got == data


def test_one_root_leads_to_the_segments_that_differ(spark):
    kind = "segment bigint, part int, digest string"
    ours = {(s, p): f"{s}.{p}" for s in (-300, -17, -1, 0, 1, 15, 16, 255, 256, 70_000) for p in range(40)}
    theirs = {k: v for k, v in ours.items() if k != (16, 39)} | {(-300, 0): "else", (70_000, 17): "else", (5, 2): "new"}
    a, b = (spark.createDataFrame([(*k, v) for k, v in x.items()], kind) for x in (ours, theirs))
    assert {tuple(r) for r in fixity._open_segments(a, b).collect()} == {(16, 39), (-300, 0), (70_000, 17), (5, 2)}
    assert fixity._open_segments(a, a).count() == 0


def brute_audit(pages, every=50):
    """The status of every distinct page, from its bytes and their places."""
    import zlib
    records = sorted({(-1 if i is None else i // 512, i, u, h) for i, u, h in pages}, key=repr)
    out, groups = {}, {}
    for seg, i, u, h in records:
        raw = brute_record(u, h)
        digest = hashlib.sha256(raw).hexdigest()
        crc = zlib.crc32(b"" if i is None else str(i).encode())
        copy = raw
        if crc % (2 * every) == 0:
            copy = raw[:-5]
        elif crc % every == 0:
            m = len(raw) // 2
            copy = raw[:m - 1] + b"#" + raw[m:]
        groups.setdefault(seg, {})[digest] = (i, raw, copy)
    for seg, members in groups.items():
        parts = -(-len(members) // fixity.SEGMENT)
        place = {}
        for digest, (i, raw, copy) in sorted(members.items(), key=lambda m: (m[1][0] is not None, m[1][0] or 0, m[0])):
            part = int(digest[:8], 16) % parts
            a, b = place.get(part, (0, 0))
            status = "damaged" if raw != copy else "moved" if a != b else "ok"
            out[digest] = (seg, part, a, len(raw), status)
            place[part] = (a + len(raw), b + len(copy))
    return out


def test_the_audit_finds_exactly_what_differs(spark, tmp_path):
    r = random.Random(6)
    pages = [(i, f"http://s/{i}", "<p>" + "x" * r.randint(0, 300)) for i in range(1500)]
    pages += pages[:40] + [(None, None, None), (None, "u", "v"), (7, "other", "text")] + [(9, "u", str(k)) for k in range(1500)]
    spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, content string") \
        .repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_warc(spark, str(tmp_path)).collect()
    want = brute_audit(pages)
    assert {x.record_sha256: (x.segment, x.part, x.start, x.length, x.status) for x in got} == want
    assert {"ok", "moved", "damaged"} == {x.status for x in got}
    assert sum(x.copies for x in got) == len(pages)


def test_missing_and_added_records(spark):
    kind = "segment bigint, part int, number bigint, start bigint, length bigint, content string"
    ours = [(0, 0, n, 10 * n, 10, f"c{n}") for n in range(40)]
    trees = [fixity.tree(spark.createDataFrame(rows, kind)) for rows in (ours, ours[:-3], ours + [(1, 0, 0, 0, 5, "new")])]
    assert fixity.audit(trees[0], trees[0]).count() == 0
    assert sorted((r.number, r.status) for r in fixity.audit(trees[0], trees[1]).collect()) == [(37, "missing"), (38, "missing"), (39, "missing")]
    assert [(r.segment, r.number, r.status) for r in fixity.audit(trees[0], trees[2]).collect()] == [(1, 0, "added")]


def test_a_replica_that_loses_and_gains_records_in_the_middle(spark, monkeypatch):
    monkeypatch.setattr(fixity, "SEGMENT", 64)
    r = random.Random(9)
    pages = [(i, f"page {i} " + "x" * r.randint(0, 60)) for i in range(600)] + [(None, "no id")]
    pages += [(700, f"crowded {k}") for k in range(193)]  # several parts, one fewer without a record
    pages += [(1, "twice"), (1, "twice"), (2, "thrice"), (2, "thrice"), (2, "thrice"), (3, "same"), (4, "same")]
    theirs = []
    for i, text in pages:
        fate = r.random() if i not in (1, 2, 3, 4, 700) else 1 if text != "crowded 90" else 0
        if fate < .03:
            continue
        theirs.append((i, sha(text), text[:-1] if fate < .06 else text + "!" if fate < .09 else text))
    theirs.remove((1, sha("twice"), "twice"))  # one copy lost, one of three damaged, a page lost whose bytes another has
    theirs.remove((2, sha("thrice"), "thrice"))
    theirs.append((2, sha("thrice"), "thr#ce"))
    theirs.remove((3, sha("same"), "same"))
    theirs += [(i, sha(text), text) for i, text in [(300, "gained"), (301, "gained"), (700, "gained"), (9000, "gained")]]

    def laid(rows):
        out, places, order = {}, {}, {}
        for i, name, text in rows:
            order.setdefault((i, name), []).append(text)
        for (i, name), texts in sorted(order.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1])):
            seg = -1 if i is None else i // 512
            part = int(name[:8], 16) % parts[seg]
            start = places.get((seg, part), 0)
            places[seg, part] = start + sum(len(x) for x in set(texts))
            out[i, name] = (seg, part, start, sorted(set(texts)), len(texts))
        return out

    mine = [(i, sha(text), text) for i, text in pages]
    counts = [{}, {}]
    for count, rows in zip(counts, (mine, theirs)):
        for i, _ in {x[:2] for x in rows}:
            seg = -1 if i is None else i // 512
            count[seg] = count.get(seg, 0) + 1
    parts = {s: -(-max(c.get(s, 0) for c in counts) // 64) for s in {*counts[0], *counts[1]}}
    a, b = laid(mine), laid(theirs)
    want = {}
    for key in {*a, *b}:
        x, y = a.get(key), b.get(key)
        status = ("added" if not x else "missing" if not y else "damaged" if x[3] != y[3] else "copies" if x[4] != y[4]
                  else "moved" if x[2] != y[2] else "ok")
        want[key] = (*(x or y)[:3], status)
    assert {"ok", "moved", "damaged", "missing", "added", "copies"} == {x[3] for x in want.values()}

    raw = F.col("raw").cast("binary").alias("raw")
    listed = (fixity.manifest(spark.createDataFrame([(i, x) for i, _, x in mine], "page_id bigint, raw string").select("page_id", raw)),
              fixity.manifest(spark.createDataFrame(theirs, "page_id bigint, id string, raw string").select("page_id", "id", raw)))
    got = fixity.compared(*fixity.lay_out(*listed)).collect()
    assert len(got) == len(want)
    assert {(x.page_id, x.id): (x.segment, x.part, x.start, x.status) for x in got} == want


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op9_warc(spark, str(tmp_path)).count() == 0


# --- components ----------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_stars_and_cycles(spark, seed):
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges += [(r.randint(400, 460), r.randint(400, 460)) for _ in range(40)]
    r.shuffle(edges)
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
