"""The conversation trie against its SQL and against a dictionary of prefixes."""

import hashlib
import random
import zlib

from against_sql import equal_to_sql
from vigilia.llm import trie

KINDS = "conv_id bigint, turn bigint, role string, text string, depth string"


def made(seed=3, convs=60):
    r = random.Random(seed)
    rows = []
    for c in [*range(convs), -7, -5, -3]:
        for t in range(r.choice([1, 2, 3, 5, 8, 9, 17, 40])):
            # Few different texts: prefixes are shared far down.
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "é😀"]) if t > 2 else "a", "clash"))
    rows += [(7, None, "user", None, "clash"), (7, None, None, "z", "clash"), (8, 1, "user", "tie", "clash"),
             (8, 1, "assistant", "tie", "clash"), (8, 1, "user", "tie", "clash"), (None, 0, "user", "nobody", "clash"),
             (101, 0, "user", "", "clash"), (102, 0, "user", "x" * 50_000, "clash")]
    return rows


def brute(rows):
    own = {}
    for c, t, role, text, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(full[c]) + 1):
            members.setdefault(tuple(full[c][:d]), []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and len(q) == len(p) + 1 for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(full[c]) == len(path)))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who),
                    sum(len(p) == len(path) + 1 for p in below), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_nodes_equal_sql_and_brute_force(spark, tmp_path):
    rows = made()
    got = equal_to_sql(spark, tmp_path, "op11_trie", conversations=spark.createDataFrame(rows, KINDS))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == brute(rows)


def test_one_conversation_holding_most_turns_and_many_equal_ones(spark, tmp_path):
    rows = [(3, t, "user", str(t % 7), "") for t in range(900)]
    rows += [(c, t, "user", "same", "") for c in range(1_000, 1_400) for t in range(2)]
    equal_to_sql(spark, tmp_path, "op11_trie", conversations=spark.createDataFrame(rows, KINDS))


def test_no_conversations_have_no_nodes(spark, tmp_path):
    assert equal_to_sql(spark, tmp_path, "op11_trie", conversations=spark.createDataFrame([], KINDS)) == []


def test_any_width_gives_the_same_nodes(spark):
    df = spark.createDataFrame(made(5, 12), KINDS)
    three, nine = ({tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df, w).collect()} for w in (3, 9))
    assert three == nine
