"""Corpus operators on texts against brute force, on a small table of awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilia.llm import arrays, bpe, imatch, neardup, packing, queries, repeats, secrets, toxicity

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, base int, spans string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def awkward(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(120).split(" ")
    texts = [None, "", "   \n\t", "one", "two words", "the " * 90, "ab " * 15 + "cd " * 40, passage,
             say(30) + " " + passage + "\n" + say(25), passage + "  " + say(10), say(3000), "x" * 5000,
             "naïve café É́ Σίσυφος \x1c <|endoftext|> <| </w>"]
    texts += [" ".join(base)] * 3
    for k in (1, 2, 4, 8):
        edited = list(base)
        for i in r.sample(range(len(base)), k):
            edited[i] = "changed"
        texts.append(" ".join(edited))
    texts += [say(r.randint(1, 200)) for _ in range(40)] + ["Upper CASE Words here", "upper case words HERE"]
    ids = list(range(10, 10 + len(texts)))
    r.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts)] + [(ids[15], texts[15])]  # a repeated row
    return sorted(rows, key=lambda x: x[0]) + [(None, passage), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    full = [(i, t, "en", None if i == 12 else "src0", None if t is None else len(t), "clash", 1, "clash") for i, t in rows]
    spark.createDataFrame(full, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(bool(t) and "changed" in t)) for i, t in rows if i is not None],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op1_secrets", "op2_neardup", "op4_imatch", "op5_toxicity", "op6_bpe", "op8_repeats",
                                  "op10_packing", "pipeline"])
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- secrets -------------------------------------------------------------------------------

SECRETS = [
    'password = "hunter2hunter2"', 'API_KEY: abcdefABCDEF123456', "token=short", "x = AKIA" + "Z" * 14,
    "AKIA" + "A" * 13, "f" * 15 + " " + "e" * 16, 'k = "Zx81kQp0LmN4"\nclient_secret = k\n',
    'auth_token = "Zx81kQ" + "p0LmN4vv"', "secret:secret=abcdefghijklmnop", "no secrets here", "", None,
    '"db_passphrase": "Xy7$kd93!!aQ"', "colour = \"Zx81kQp0LmN4\"", "ſecret = abcdefghijklmnop",
]


def brute_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_base_spans_are_the_fixed_patterns():
    r = random.Random(3)
    parts = ["token", "api-key", "apikey", "Secret", "=", " : ", "'", '"', "AKIA", "ABC123XYZ", "deadbeef", "a1b2", " ", "\n", "é"]
    texts = SECRETS + ["".join(r.choice(parts) for _ in range(60)) for _ in range(400)]
    for t in texts:
        base, found = secrets.scan(t)
        assert base == brute_base(t)
        assert set(base) <= set(found) and found == sorted(found)


def test_constants_reach_sensitive_names():
    def literal(text):
        return [text[s:e] for s, k, e in secrets.scan(text)[1] if k == 3]

    assert literal(SECRETS[6]) == ["Zx81kQp0LmN4"]
    assert literal(SECRETS[7]) == ["Zx81kQ", "p0LmN4vv"]
    assert literal(SECRETS[12]) == ["Xy7$kd93!!aQ"]
    assert literal(SECRETS[13]) == [] and literal(SECRETS[9]) == []


@pytest.mark.parametrize("text, want", [
    ("run --auth=Zx81kQp0LmN4 -v", ["Zx81kQp0LmN4"]), ("run -db-pwd=Zx81kQp0LmN4", ["Zx81kQp0LmN4"]),
    ("run --verbose --db-pwd Zx81kQp0LmN4", ["Zx81kQp0LmN4"]), ("--auth --db-pwd='Zx81kQp0LmN4'", ["Zx81kQp0LmN4"]),
    ("cmd = 'run --db-pwd=Zx81kQp0LmN4'", ["Zx81kQp0LmN4"]), ("--env=db_pwd=Zx81kQp0LmN4", ["Zx81kQp0LmN4"]),
])
def test_flags_are_read(text, want):
    assert [text[a:b] for a, b in secrets.added_spans(text)] == want


@pytest.mark.parametrize("text, want", [
    ('password: str = "S3cretPass99"', ["S3cretPass99"]), ('const password: string="S3cretPass99";', ["S3cretPass99"]),
    ('auth: Optional[str] | None = "S3cretPass99"', ["S3cretPass99"]), ("pwd: Zx81kQp0LmN4==", ["Zx81kQp0LmN4=="]),
    ('note: str = "db_pwd=Zx81kQp0LmN4"', ["Zx81kQp0LmN4"]),
])
def test_types_stand_between_name_and_value(text, want):
    assert [text[a:b] for a, b in secrets.added_spans(text)] == want


@pytest.mark.parametrize("text", ['config["password"] = "S3cretPass99"', "os.environ['API_TOKEN'] = 'S3cretPass99'",
                                  'a["x"][ "db_pwd" ]\t=\t"S3cretPass99"'])
def test_subscripts_are_names(text):
    assert [text[a:b] for a, b in secrets.added_spans(text)] == ["S3cretPass99"]


def test_tabs_stand_around_operators():
    text = 'db_pwd\t=\tZx81kQp0LmN4\nauth:\t"Zx81kQ"\t+\t"p0LmN4vv"'
    assert [text[a:b] for a, b in secrets.added_spans(text)] == ["Zx81kQp0LmN4", "Zx81kQ", "p0LmN4vv"]


def test_quoted_passphrases_of_several_words():
    text = 'db_passphrase = "correct horse battery staple"\nsalt = "correct horse battery staple"\ntitle = "some other words"'
    assert [text[a:b] for a, b in secrets.added_spans(text)] == ["correct horse battery staple"]
    assert secrets.added_spans("password = correct horse battery staple") == []


def test_long_names_and_literals_are_lexed_whole():
    name, value = "a" * 90 + "_secret", "Zx9+" * 2_000
    text = f'{name} = "{value}"\nb = "k7Qp" + "k7Qp"\npassword: b'
    spans = secrets.added_spans(text)
    assert [text[a:b] for a, b in spans] == [value, "k7Qp", "k7Qp"]


def test_secrets_query(spark, folder, rows):
    got = sorted((r.doc_id or -1, r.base_sha256) for r in queries.op1_secrets(spark, folder).collect())
    want = sorted((i or -1, sha(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(t)))) for i, t in rows)
    assert got == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, SECRETS[0], "en", "s", 5), (2, None, "en", "s", None)],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert got[1].text == '[assign]"' and got[1].n_chars == 9 and got[2].text is None


# --- near duplicates -----------------------------------------------------------------------

def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, size, percent):
    docs = sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: x[0])
    sets = [(i, shingles(t, size)) for i, t in docs]
    top = {i: i for i, _ in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1:]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_the_linked_documents(spark, folder, rows, size, percent):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = neardup.near_duplicates(docs, size, percent).collect()
    want = brute_components(rows, size, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_a_chain_across_a_bucket_is_linked_as_a_whole(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):  # each a few edits further from the first
        rows.append((i, " ".join(words)))
        for k in r.sample(range(300), 2):
            words[k] = f"v{i}.{k}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


def test_registers_merge_and_meet_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype("u8")
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 100).astype("u8")))
    both = np.unique(np.concatenate((a, b)))
    regs = neardup.sketches(np.concatenate((a, b, both)), np.array([0, 900, 1800, 1800 + len(both)]))
    assert neardup.merged(regs[0].tobytes(), regs[1].tobytes()) == regs[2].tobytes()
    assert abs((regs[0] == regs[1]).mean() - 0.8) < 0.12
    assert neardup.plausible(regs[:1], regs[1:2], np.array([900.0]), np.array([900.0]), 0.8)[0]
    assert not neardup.plausible(regs[:1], neardup.sketches(rng.integers(0, 2**63, 900).astype("u8"), np.array([0, 900])),
                                 np.array([900.0]), np.array([900.0]), 0.8)[0]


# --- fingerprints --------------------------------------------------------------------------

def test_fingerprints(spark, folder, rows):
    got = queries.op4_imatch(spark, folder).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows if i is not None}
    order = sorted(texts)
    by_text = {}
    for r in got:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        if r.doc_id != 25 and sum(i == r.doc_id for i, _ in rows) == 1:
            follower = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
            half = len(t) // 2
            assert r.edited_sha256 == sha(t[:len(t) - half] + follower[:half])
            assert r.n_chars == len(t)
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    whole = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited for r in whole) > sum(r.near_next for r in whole)


def test_the_lexicon_is_the_band_of_document_frequencies(spark):
    texts = ["a b c"] * 5 + ["a b d"] * 3 + ["a e"] * 2 + ["A a a f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    band = imatch.lexicon(df, 0.2, 0.8)
    want = [r[0] for r in spark.createDataFrame([("b",), ("c",), ("d",)], "w string").select(F.xxhash64("w")).collect()]
    assert band == sorted(want)  # a is everywhere, e and f are too rare


# --- toxicity ------------------------------------------------------------------------------

def test_toxicity_learns_from_its_share_only_and_generalises(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = np.mean([got[i].predicted == labels[i] for i in held])
    assert right >= 0.97
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    changed = spark.createDataFrame([(i, 0, t if got[i].held_out is False else 1 - t) for i, t in labels.items()],
                                    "doc_id bigint, quality int, toxic int")
    model = toxicity.train(texts, changed.where(~toxicity.held_out(F.col("doc_id"))))
    again = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-12 for i in got)


def test_toxicity_of_awkward_rows(spark, folder, rows):
    got = queries.op5_toxicity(spark, folder).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in {i for i, t in rows if i and not (t or "").strip()}}) == 1


# --- byte pair encoding --------------------------------------------------------------------

def odd_texts(rows):
    rng = np.random.default_rng(0)
    odd = [t for _, t in rows]
    odd += ["".join(chr(c) for c in rng.integers(32, 0x3000, 60) if not 0xD800 <= c < 0xE000) for _ in range(200)]
    odd += ["".join(rng.choice(list(letters), 40)) for letters in ("abcthein", "!-=.*#aA", "a \n\t", " \n<|x", "'sdre l")
            for _ in range(100)]
    return odd + ["a  b   c \n d", " x ", "  ", "x\n \nfoo", "x\n ", "a   b", "T̈ K", "a <|endoftext|>b", "<|endoftext|>"]


@pytest.mark.parametrize("kind", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(rows, kind):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = public_tokenizers.path(kind)
    library, texts = Tokenizer.from_file(path), odd_texts(rows)
    own = bpe.word_bpe(path) if kind.startswith("word") else packing.encoder(path)
    for t, ids in zip(texts, own.encode_batch(pa.array(texts, pa.string()))):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        if kind.startswith("word"):
            assert own.automaton.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_remembered_chunks_are_bounded(rows):
    import public_tokenizers
    import pyarrow as pa
    tight = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tight._chunks = packing.Remembered(50)
    texts = pa.array([t for _, t in rows], pa.string())
    wide = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts)
    assert [x for i in range(len(texts)) for x in tight.encode_batch(texts.slice(i, 1))] == wide


def test_bpe_query(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, folder).collect()]
    assert sorted(got) == sorted(want)


# --- repeats -------------------------------------------------------------------------------

def brute_repeats(rows, width=20):
    seen, out = {}, {}
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    for i, t in docs:
        words = WORD.findall(t)
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            w = tuple(words[s:s + width])
            if w in seen:
                gone[s:s + width] = [True] * width
            else:
                seen[w] = (i, s)
        out[i] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_repeats_of_awkward_rows(spark, folder, rows):
    got = queries.op8_repeats(spark, folder).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None} == brute_repeats(rows)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_repeats_of_a_corpus(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_repeats(rows)
    assert sum(n for _, n, _ in want.values()) > 1000
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_repeats(spark, sf).collect()} == want


def test_repeats_of_few_words(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("ab" if i % 2 else "abc") for _ in range(r.randint(0, 120)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, sha(x.kept_text)) for x in repeats.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)


def test_spans_of_a_repeated_row_are_found_once(spark):
    r = random.Random(12)
    say = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(n))
    passages = [say(60) for _ in range(3)]
    first = [(i, f"{say(20)} {p} {say(20)}") for i, p in enumerate(passages)]
    again = " ".join(f"{say(15)} {p}" for p in passages)
    rows = first + [(9, again)] * 300 + [(9, passages[1] + " other")] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spans = [tuple(x) for x in repeats.repeated(repeats.versions(df)).collect()]
    assert spans and len(spans) == len(set(spans)) and {x[0] for x in spans} == {9}
    got = repeats.remove_repeats(df).collect()
    assert len(got) == len(rows)
    want = {t: brute_repeats(first + [(9, t)])[9] for t in {x[1] for x in rows[3:]}}
    assert {x.text: (x.n_words, x.n_removed, sha(x.kept_text)) for x in got if x.doc_id == 9} == want


def test_span_hashes_depend_on_the_words_only():
    h = arrays.mix(np.arange(50, dtype="u8"))
    twice = np.concatenate((h, h[::-1], h))
    spans = arrays.Spans(twice)
    a, b = np.array([3, 103]), np.array([23, 123])
    assert len(set(spans.hash(a, b).tolist())) == 1
    assert len(set(spans.hash(np.arange(100), np.arange(100) + 20).tolist())) == 100


# --- packing -------------------------------------------------------------------------------

def test_packing_query(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    got = queries.op10_packing(spark, folder).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    padding = sum(0 if (n := sum(x for _, x in p)) & (n - 1) == 0 else 1024 - n for p in sequences.values())
    assert padding == 0
    for i, all_ids in texts.items():
        for ids in all_ids:
            mine = sorted((r for r in pieces[i, len(ids)]), key=lambda r: r.start)
            same = sum(len(x) == len(ids) for x in all_ids)
            assert sum(r.length for r in mine) == same * len(ids)
            for r in mine:
                assert r.ids_crc32 in {zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) for x in all_ids}


def test_differencing_spreads_evenly_and_windows_hold():
    r = random.Random(4)
    for _ in range(20):
        lengths = [r.randint(1, 1024) for _ in range(r.randint(1, 200))]
        windows = packing.whole_windows(lengths)
        assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in w) <= 1024 for w in windows)
        cut = packing.cut_windows(lengths)
        assert sum(n for w in cut for _, _, n in w) == sum(lengths)
    sums = [sum(w) for w in ([[8, 7], [6, 5, 4]],) for w in w]
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) in ([14, 16], [15, 15]), sums


def test_a_cluster_of_similar_but_unlinked_texts(spark, monkeypatch):
    """Most pairs lie below the threshold, some above, over several blocks."""
    monkeypatch.setattr(neardup, "_BLOCK", 16)
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in r.sample(range(150), 3 if i % 3 else 9):
            words[k] = f"v{i}.{k}"
        if i % 10 == 7:
            words = rows[-1][1].split() + [f"end{i}"]
        rows.append((i, " ".join(words)))
    want = {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}
    assert 2 < len(set(want.values())) < 90
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_intersections_are_exact():
    rng = np.random.default_rng(3)
    sets = tuple(np.unique(rng.integers(0, 900, n).astype("u8")) for n in (5, 300, 0, 700, 40))
    got = neardup._intersections(sets, np.array([0, 1, 2]), np.array([3, 4]), width=64)  # a set never meets itself
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in (3, 4)] for i in (0, 1, 2)]
