"""Collocations against SQL, and quotient filters against dictionaries."""

import random

import numpy as np
from against_sql import equal_to_sql
from vigilia.llm import arrays, collocations, quotient

KINDS = "doc_id bigint, text string, lang string, n bigint, phrase string"


def made(seed=2, docs=150):
    r = random.Random(seed)
    vocabulary = ["of", "the", "Öl", "x", "new york city", "red tape", "a b", "été", "\x00n"]
    rows = []
    for i in range(docs):
        said = "".join(r.choice(vocabulary) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "!", " ;"]) for _ in range(r.randint(0, 60)))
        rows.append((i, said, r.choice(["en", "fr", None, "und"]), 1, "clash"))
    rows += [(1, rows[0][1], "en", 1, "c"), (None, rows[0][1], "en", 1, "c"), (7, None, "en", 1, "c"), (8, "", "de", 1, "c"),
             (9, "once only", "it", 1, "c"), (10, "w " * 30_000, "en", 1, "c"), (11, "y" * 70_000 + " z " * 12, "en", 1, "c")]
    return rows


def test_equal_to_sql(spark, tmp_path):
    rows = equal_to_sql(spark, tmp_path, "op12_collocations", documents=spark.createDataFrame(made(), KINDS))
    assert {r.lang for r in rows} >= {"en", "fr", "und"} and any(r.phrase.count(" ") == 2 for r in rows)


def test_empty_table(spark, tmp_path):
    assert equal_to_sql(spark, tmp_path, "op12_collocations", documents=spark.createDataFrame([], KINDS)) == []


def test_many_small_filters_and_narrow_word_hashes(spark, monkeypatch):
    """Filters sent early, in many ranges; ids that collide are made anew."""
    df = spark.createDataFrame(made(4), KINDS)
    want = sorted(collocations.collocations(df).collect())
    seeds = []

    class Colliding(collocations.Words):
        def __init__(self, batch, seed):
            super().__init__(batch, seed)
            if seed == 0:  # two frequent words of one id
                same = np.array([self.text(i) in ("of", "x") for i in range(len(self.ids))], dtype=bool)
                self.ids = np.where(same, np.uint64(7), self.ids)

    monkeypatch.setattr(collocations, "_HELD", 20)
    monkeypatch.setattr(collocations, "_RANGE", 300)
    original = collocations._ids
    monkeypatch.setattr(collocations, "_ids", lambda seed: seeds.append(seed) or original(seed))
    monkeypatch.setattr(collocations, "Words", Colliding)
    assert sorted(collocations.collocations(df).collect()) == want


def test_filters_hold_every_key_and_count():
    r = np.random.default_rng(5)
    for words in (2, 3):
        for shared in (0, 3):
            keys = [r.integers(0, 2**64, 900, dtype=np.uint64) for _ in range(words)]
            lanes = quotient.permute(keys)
            assert all((a == b).all() for a, b in zip(quotient.restore(lanes), keys))
            prefix = 5 if shared else 0
            if shared:
                lanes[0] = (lanes[0] >> np.uint64(3)) | (np.uint64(prefix) << np.uint64(61))
            lanes = [np.concatenate((x, x[:200], x[:50])) for x in lanes]
            lanes[0][10] = lanes[0][11]  # first lanes that agree
            some = quotient.counted(lanes, np.where(np.arange(1150) % 7 == 0, 300, 1))
            want = {}
            for *key, n in zip(*(x.tolist() for x in lanes), np.where(np.arange(1150) % 7 == 0, 300, 1).tolist()):
                want[tuple(key)] = want.get(tuple(key), 0) + n
            back = quotient.unpacked(quotient.packed(*some, shared), words, prefix, shared)
            assert dict(zip(zip(*(x.tolist() for x in back[0])), back[1].tolist())) == want
            twice = quotient.merged([some, back])
            assert {k: 2 * n for k, n in want.items()} == dict(zip(zip(*(x.tolist() for x in twice[0])), twice[1].tolist()))
            assert list(zip(*(x.tolist() for x in back[0]))) == sorted(want)


def test_hashes_follow_the_seed():
    data = np.frombuffer(b"one " + b"w" * 300, np.uint8)
    starts, ends, _ = arrays.words(data, np.array([0, len(data)]))
    a, b = (arrays.word_hashes(data, starts, ends, s) for s in (0, 1))
    assert (a != b).all()
