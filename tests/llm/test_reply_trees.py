"""Reply trees against a recursive walk, and the template read back."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plantscope.llm import reply_trees as rt

SCHEMA = "tree_id long, node_id long, parent_id long, score double, role string, text string, t string, leaf string"
HARD = ["", None, "\\", "\\\\l<", "</turn>\n<turn assistant>x", "\\l\\g\\\\g", "é\U0001f600>", "a\nb", "\\### Assistant: </turn> ok", "<\\>"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def walk(rows):
    """tree -> root -> [(-score, -depth, leaf, path)] in order."""
    trees = defaultdict(dict)
    for t, n, p, s, *_ in rows:
        trees[t][n] = (p, s or 0.0)
    out = {}
    for t, nodes in trees.items():
        kids = defaultdict(list)
        for n, (p, _) in nodes.items():
            kids[p if p in nodes else None].append(n)
        for root in kids[None]:
            found, stack = [], [(root, [root])]
            while stack:
                n, path = stack.pop()
                if not kids[n]:
                    found.append((-sum(nodes[x][1] for x in path), 1 - len(path), n, path))
                stack += [(k, [*path, k]) for k in kids[n]]
            out[t, root] = sorted(found)
    return out


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths(spark, branches):
    rng = random.Random(3)
    rows = []
    for t in [*range(12), None]:
        for n in range(rng.randrange(1, 30)):
            parent = None if n == 0 else rng.choice([rng.randrange(n), n - 1, 999 if n % 9 == 0 else n - 1])
            rows.append((t, n, parent, rng.choice([None, 0.0, 1.0, 0.25]), rng.choice(["user", "assistant", None]), rng.choice(HARD), "x", "x"))
    rows += [(50, 1, 2, 1.0, "user", "cycle", "x", "x"), (50, 2, 1, 1.0, "user", "cycle", "x", "x"), (50, 3, 2, 1.0, "user", "below", "x", "x")]
    rows += [(51, k, k - 1 if k else None, 0.0, "user", str(k), "x", "x") for k in range(130)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = defaultdict(list)
    for r in rt.best_paths(df, branches=branches).collect():
        got[None if r.t == rt.NO_TREE else r.t, r.leaf, r["rank"]].append((r.position, r.n))
    want = {}
    for (t, _), found in walk(rows).items():
        for rank, (*_, leaf, path) in enumerate(found[:branches], 1):
            want[t, leaf, rank] = list(enumerate(path))
    assert {k: sorted(v) for k, v in got.items()} == want
    said = {(t, n): (role or "", text or "") for t, n, _, _, role, text, *_ in rows}
    made = rt.conversations(df, branches=branches).select("*", rt.read_back(F.col("text")).alias("turns")).collect()
    assert len(made) == len(want)
    for r in made:
        turns = [said[r.tree, n] for _, n in want[r.tree, r.leaf, r["rank"]]]
        assert [(x.role, x.text) for x in r.turns] == turns
        assert len(r.loss) == sum(role == "assistant" for role, _ in turns)
        for s, (_, text) in zip(r.loss, [x for x in turns if x[0] == "assistant"], strict=True):
            assert r.text[s.start : s.end].replace("\\\\", "\0").replace("\\l", "<").replace("\\g", ">").replace("\0", "\\") == text


def test_query(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(HARD)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(70, None, "user", "x"), (70, 0, "assistant", "y"), (70, 0, "assistant", "y"), (None, 0, "user", "null id")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, t string, leaf string")
    got = {r.conv_id: r for r in rt.digest(df).collect()}
    rows += [(-7, 0, "user", HARD[8]), (-7, 1, "assistant", HARD[8])]
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        taught = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(taught), sha(taught))


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in rt.digest(empty).collect()] == [-7]
    assert rt.conversations(spark.createDataFrame([], SCHEMA)).collect() == []
