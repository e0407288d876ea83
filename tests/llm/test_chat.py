import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm import chat
from reviewloom.llm.queries import REGISTRY

MESSAGES = "tree long, id long, parent long, role string, text string, score double"
PIECES = st.lists(st.sampled_from(["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[ROLE]", "[TEXT]", "\\", "[", "<", "s>", "/s>", "INST]", "a", "\n", "[\\INST]", "é"]))


@given(PIECES.map("".join), PIECES.map("".join))
@settings(max_examples=500, deadline=None)
def test_escapes_are_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    written = ""
    for name in ("user", "assistant", "system", role):
        line, begin, end = chat.turn(name, text)
        assert chat.unescape(line[begin:end]) == text
        written += line
    assert [t[:2] for t in chat.turns(written)] == [(n, text) for n in ("user", "assistant", "system", role)]


def brute(rows, keep=None):
    """{tree: [path]} with the best branches first; a path is a list of (role, text)."""
    one = {}
    for tree, i, parent, role, text, score in sorted(rows, key=repr):
        one.setdefault((tree, i), (parent, role, text, score or 0.0))
    found = {}
    replied = {(t, p) for (t, _), (p, *_) in one.items()}
    for tree, leaf in one:
        if (tree, leaf) in replied:
            continue
        at, path, seen, total = leaf, [], set(), 0.0
        while at is not None and (tree, at) in one and at not in seen:
            seen.add(at)
            parent, role, text, score = one[tree, at]
            path.append((role, text))
            total += score
            at = parent
        if at in seen:
            continue  # a circle
        found.setdefault(tree, []).append((-total / len(path), leaf, path[::-1]))
    return {t: [p[2] for p in sorted(x)[:keep]] for t, x in found.items()}


ROWS = [
    (1, 0, None, "user", "q", None), (1, 1, 0, "assistant", "a", 0.5), (1, 2, 0, "assistant", "b", 0.9), (1, 3, 2, "user", "c", 0.1),
    (1, 4, 3, "assistant", "d", 0.2), (1, 5, 2, "tool", None, 0.3), (1, 5, 2, "tool", None, 0.3),
    (2, 0, 99, None, "orphan", 1.0), (2, 7, 8, "user", "circle", 1.0), (2, 8, 7, "user", "circle", 1.0), (2, 9, 8, "user", "behind", 1.0),
    (None, 0, None, "user", "no tree", None), (None, 1, 0, "assistant", "</s>", None),
    *[(3, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(21)],
]


def read_paths(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (repr(r.tree), r.branch_rank or 0, r.leaf, r.place)):
        found.setdefault((r.tree, r.branch_rank, r.leaf), []).append((r.role, r.text))
    return found


def test_paths_of_trees(spark):
    df = spark.createDataFrame(ROWS, MESSAGES).repartition(3)
    every = read_paths(chat.paths(df))
    assert sorted(map(repr, every.values())) == sorted(repr(p) for x in brute(ROWS).values() for p in x)
    best = read_paths(chat.paths(df, keep=2))
    want = brute(ROWS, 2)
    assert {(t, n) for t, n, _ in best} == {(t, i + 1) for t, x in want.items() for i in range(len(x))}
    assert all(path == want[t][n - 1] for (t, n, _), path in best.items())
    assert want[1][0] != want[1][1]


def test_formatted_in_pieces_reads_back(spark):
    df = spark.createDataFrame(ROWS, MESSAGES).repartition(2)
    chosen = chat.written(chat.paths(df))
    whole, cut = chat.formatted(chosen).collect(), chat.formatted(chosen, piece=30).collect()
    joined = {}
    for r in sorted(cut, key=lambda r: r.piece):
        joined[r.tree, r.leaf] = joined.get((r.tree, r.leaf), "") + r.formatted
    assert {(r.tree, r.leaf): r.formatted for r in whole} == joined and len(cut) > len(whole)
    for r in whole:
        learned = [chat.unescape(r.formatted[s.begin : s.end]) for s in r.loss]
        assert learned == [text for role, text, *_ in chat.turns(r.formatted) if role == "assistant"]
    plain = lambda df: sorted(map(repr, chat.read_back(df).collect()))
    assert plain(chat.formatted(chosen)) == plain(chat.formatted(chosen, piece=1))


def test_odd_turns_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, tree string, id string, score string"
    rows = [(1, 5, "user", "b"), (1, 2, "assistant", None), (1, 2, "assistant", None), (None, None, None, "x"), (2, None, "bot", "[INST]"), (2, 3, "user", "y" * 70_000)]
    df = spark.createDataFrame([(*r, "t", "i", "s") for r in rows], schema)
    got = {r.tree: r for r in chat.read_back(chat.formatted(chat.paths(chat.from_turns(df)))).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("assistant\n\nassistant\n\nuser\nb\n") and got[1].loss_chars == 0
    assert got[None].turns_sha256 == digest("\nx\n") and got[None].n_turns == 1
    assert got[2].turns_sha256 == digest("user\n" + "y" * 70_000 + "\nbot\n[INST]\n") and got[2].loss_sha256 == digest("")
    assert chat.read_back(chat.formatted(chat.paths(chat.from_turns(df.limit(0))))).count() == 0


def test_query_against_the_turns(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ok = "</s>[INST] ok [/INST]"
    convs = {}
    for i, _, role, text in sorted([*rows, (-7, 0, "user", ok), (-7, 1, "assistant", ok)]):
        convs.setdefault(i, []).append((role, text or ""))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: r for r in REGISTRY["op13_chat_formatting"](spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for i, said in convs.items():
        learned = "".join(t for role, t in said if role == "assistant")
        want = (len(said), digest("".join(f"{a}\n{t}\n" for a, t in said)), len(learned), digest(learned))
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want
        assert got[i].formatted_chars == sum(len(chat.turn(a, t)[0]) for a, t in said)
