"""Reply trees against plain Python."""

import hashlib
import random

from simsift.llm import chat
from simsift.llm.queries import op3

SCHEMA = "tree long, node long, parent long, role string, text string, score double, leaf string"
NASTY = ["", None, "\\", "\\\\", "###", "### ", "#### a: b", "</turn>", "</turn>\n", "<\\/turn>", "</turn</turn>", ": ",
         "\\### Assistant: </turn> ok", "a\nb", "é😀 ", "$1 \\1", "#\\## x", "\\:", "</turn>" * 3]


def paths(rows):
    """[(score, path)] of every root-to-leaf path of one tree."""
    nodes = {r[1]: r for r in rows}
    parents = {r[2] for r in rows}
    out = []
    for n, r in nodes.items():
        if n in parents:
            continue
        path, at, seen = [], n, set()
        while at in nodes and at not in seen:
            seen.add(at)
            path.append(at)
            at = nodes[at][2]
        if at not in seen:
            out.append((sum(nodes[x][5] or 0.0 for x in path), path[::-1]))
    return sorted(out, key=lambda x: (-x[0], -len(x[1]), x[1][-1]))


def build():
    rng = random.Random(11)
    rows = []
    for tree in range(8):
        for node in range(rng.randint(1, 30)):
            parent = None if node == 0 else rng.choice([node - 1, rng.randrange(node)])
            rows.append((tree, node, parent, rng.choice(["user", "assistant", "odd: role", None]), rng.choice(NASTY),
                         rng.choice([None, 0.0, 0.5, 1.0, 0.25]), "x"))
    rows += [(50, n, n - 1 if n else None, "assistant", f"t{n}", 1.0, "x") for n in range(130)]     # a deep chain
    rows += [(60, 1, 2, "user", "loop", 0.0, "x"), (60, 2, 1, "user", "loop", 0.0, "x"),
             (61, 7, 99, "assistant", "orphan", 0.0, "x"), (None, 1, None, "user", "no tree", 0.0, "x")]
    return rows


def test_paths_equal_plain_search(spark):
    rows = build()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in chat.reply_paths(df, top=3).collect():
        got.setdefault((r.tree, r["rank"]), {})[r.pos] = r.node
    got = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    want = {}
    for tree in {r[0] for r in rows}:
        for rank, (_, path) in enumerate(paths([r for r in rows if r[0] == tree])[:3], 1):
            want[tree, rank] = path
    assert got == want


def test_round_trip_and_mask(spark):
    rows = build()
    by = {(r[0], r[1]): r for r in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_conversations(df, top=2)
    texts = {(r.tree, r.leaf): r for r in formatted.collect()}
    turns = {}
    for r in chat.parse(formatted).collect():
        turns.setdefault((r.tree, r.leaf), {})[r.pos] = r
    for tree in {r[0] for r in rows}:
        for _, path in paths([r for r in rows if r[0] == tree])[:2]:
            said = [by[tree, n] for n in path]
            got = turns[tree, path[-1]]
            assert [(got[i].role, got[i].text, got[i].loss) for i in range(len(path))] == [
                (s[3] or "", s[4] or "", s[3] == "assistant") for s in said]
            whole = texts[tree, path[-1]]
            masked = [whole.formatted[a:b] for a, b in whole.loss_spans]
            assert [m.replace("<\\/turn>", "</turn>").replace("#\\## ", "### ").replace("\\\\", "\\")
                    for m in masked] == [s[4] or "" for s in said if s[3] == "assistant"]


def test_contract_query(spark):
    got = {r.conv_id: r for r in op3(spark, "/root/testdata/sf0.001").collect()}
    by = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_linear_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 1), (1, 0, "user", "a", 2), (1, None, "user", None, 3)],
                               "conv_id long, turn long, role string, text string, node int")
    f = chat.format_conversations(chat.linear_trees(df, "conv_id", "turn", "role", "text"))
    assert [r.formatted for r in f.collect()] == ["### user: </turn>\n### user: a</turn>\n### user: a</turn>\n"]
    none = chat.linear_trees(df.limit(0), "conv_id", "turn", "role", "text")
    assert chat.digests(chat.format_conversations(none)).count() == 0
