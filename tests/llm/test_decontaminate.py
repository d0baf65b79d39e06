"""Benchmark passages found by FM-indexes, against SQL and brute force."""

import random
import re

import numpy as np
from against_sql import equal_to_sql
from vigilia.llm import decontaminate
from vigilia.llm.fmindex import Index, suffix_ranks

DOCS = "doc_id bigint, text string, n_words string, spans string, item string"
ITEMS = "item_id bigint, text string, block string, words string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for doc_id, text, *_ in docs:
        w = split(text)
        hit, named = set(), set()
        for item_id, item, *_ in items:
            v = split(item)
            for k in range(max(1, len(v) - width + 1) if v else 0):
                p = v[k:k + width]
                for i in range(len(w) - len(p) + 1):
                    if w[i:i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        named |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), sorted(hit), sorted(named)))
    return sorted(out, key=repr)


def made():
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["la", "der", "x1", "Öl", "été", "the", "of"]) + r.choice(["", ",", ".", "\n", "\x00"]) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 9, 10, 11, 25])), "clash", "clash") for i in range(12)]
    items += [(5, "another text of the same id", "", ""), (None, "rare words without any id here", "", ""),
              (70, None, "", ""), (71, "  ,;", "", ""), (72, items[3][1], "", "")]
    docs = [(i, " ".join([say(r.randint(0, 40)), r.choice(items)[1] or "", say(4)]), "c", "c", "c") for i in range(80)]
    docs += [(1, docs[3][1], "c", "c", "c"), (1, docs[3][1], "c", "c", "c"), (None, docs[5][1], "c", "c", "c"), (90, None, "c", "c", "c"),
             (91, "", "c", "c", "c"), (92, (items[5][1] + " ") * 400, "c", "c", "c"), (93, "w" * 100_000, "c", "c", "c")]
    return docs, items


def test_equal_to_sql_and_brute_force_in_one_block_or_many(spark, tmp_path, monkeypatch):
    docs, items = made()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    equal_to_sql(spark, tmp_path, "op13_decontaminate", documents=d, benchmark=b)
    want = brute(docs, items)
    monkeypatch.setattr(decontaminate, "SHARD", 3_000)
    for block in (200_000, 60):
        got = []
        for x in decontaminate.find_leaks(d, b, block=block).collect():
            words = [j for s in x.spans for j in range(s.start, s.end)]
            assert words == sorted(set(words)) and all(a.end < c.start for a, c in zip(x.spans, x.spans[1:]))
            got.append((x.doc_id, x.n_words, words, x["items"]))
        assert sorted(got, key=repr) == want


def test_empty_tables(spark, tmp_path):
    docs, items = made()
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert equal_to_sql(spark, tmp_path / "a", "op13_decontaminate", documents=none[0], benchmark=spark.createDataFrame(items, ITEMS)) == []
    rows = equal_to_sql(spark, tmp_path / "b", "op13_decontaminate", documents=spark.createDataFrame(docs, DOCS), benchmark=none[1])
    assert len(rows) == len(docs) and not any(r.contaminated for r in rows)


def test_index_finds_every_occurrence():
    r = np.random.default_rng(1)
    for most, n in ((1, 50), (3, 400), (40, 3_000)):
        text = np.append(r.integers(0, most + 1, n), 0)
        ranks = suffix_ranks(text)
        assert sorted(ranks) == list(range(len(text)))
        index = Index(text, most)
        phrases = np.full((200, 5), -1)
        for i in range(200):
            size = r.integers(1, 6)
            at = r.integers(0, n - 5)
            piece = text[at:at + size] if i % 2 else r.integers(1, most + 1, size)
            phrases[i, 5 - size:] = np.where(piece == 0, 1, piece)
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            p = p[p >= 0]
            want = [i for i in range(n) if list(text[i:i + len(p)]) == list(p)]
            assert sorted(index.locate(np.arange(a, b))) == want
